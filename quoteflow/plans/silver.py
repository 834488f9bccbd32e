"""Raw text -> typed, filtered, hash-keyed daily quotes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..audit import counted, measured
from ..control import get_watermark, put_watermark
from ..functions import daily_return, row_hash, row_text
from ..operators.deal import SHARE, counts_of, dealt
from ..operators.merge import new_rows_by_hash, split_rejects
from ..operators.quality import type_misfits
from ..schema import EQUITY_SERIES, HASH_COLUMNS, SILVER_COLUMNS, SILVER_SCHEMA
from ..sources.tables import append, ensure_table, read_since, read_table
from .bronze import append_rejects, mark_seen, unseen_commits


def typed_quotes(bronze: DataFrame) -> DataFrame:
    """The kept columns under their silver names and types; text that is no such value becomes null."""

    types = dict(bronze.dtypes)

    def column(raw: str, name: str, kind: T.DataType) -> str:
        wanted = kind.simpleString()
        if raw not in types:
            return f"cast(null as {wanted}) as {name}"
        return f"{raw} as {name}" if types[raw] == wanted else f"try_cast({raw} as {wanted}) as {name}"

    return bronze.selectExpr(*[column(raw, name, kind) for raw, (name, kind) in SILVER_COLUMNS.items()])


def equity_series(df: DataFrame, column: str = "security_series", series: Sequence[str] = EQUITY_SERIES) -> DataFrame:
    return df.filter(F.col(column).isin(*series))


def to_silver(bronze: DataFrame) -> DataFrame:
    """Silver columns for raw rows, a narrow step without any shuffle."""
    return _derived(equity_series(typed_quotes(bronze)))


def _derived(quotes: DataFrame) -> DataFrame:
    return quotes.withColumns(
        {
            "silver_load_date_time": F.current_timestamp(),
            "hash_key": row_hash(HASH_COLUMNS),
            "pnl_percentage": daily_return(F.col("closing_price"), F.col("previous_closing_price")),
        }
    )


def set_aside(raw: DataFrame, watermark: dt.date | None, again: Sequence[dt.date], since: dt.datetime | None) -> DataFrame:
    """The raw rows that a load leaves out, with a ``reason``: ``incomplete`` without ISIN or a readable date, ``late`` where
    dated at or before the watermark.  Only rows that arrived after ``since``, when the load before looked."""
    date = F.col("BizDt").try_cast("date")
    complete = (F.coalesce(F.btrim("ISIN"), F.lit("")) != "") & date.isNotNull()
    late = F.lit(False) if watermark is None else (date <= F.lit(watermark)) & ~date.isin(list(again))
    if since is not None and "_ingested_at" in raw.columns:
        raw = raw.filter(F.col("_ingested_at") > F.lit(since))
    marked = raw.withColumn("reason", F.when(~complete, "incomplete").when(late, "late"))
    return marked.filter(F.col("reason").isNotNull())


def dated(source: DataFrame, dates: Sequence[str | None], again: Sequence[dt.date]) -> DataFrame:
    """Raw rows of these dates (as the raw table spells them; None: none) or of ``again``: as literals, so that only their partitions are read."""
    wanted = F.col("BizDt").isin([d for d in dates if d is not None])
    if again:
        wanted = wanted | F.col("BizDt").try_cast("date").isin(list(again))
    return source.filter(wanted | F.col("BizDt").isNull() if None in dates else wanted)


def not_loaded(aside: DataFrame, held: DataFrame, watermark: dt.date | None) -> DataFrame:
    """Rows set aside but those late ones that silver holds: a touched date has its older rows beside the new ones."""
    if watermark is None:
        return aside
    names = {raw: name for raw, (name, _) in SILVER_COLUMNS.items()}
    keys = [raw for raw, name in names.items() if name in HASH_COLUMNS]
    texts = {f"_{names[raw]}": F.col(raw) if raw in aside.columns else F.lit(None).cast("string") for raw in keys}
    texts["_business_date"] = F.col("BizDt").try_cast("date").cast("string")
    marked = aside.withColumns(texts).withColumn("_hash", row_hash([f"_{c}" for c in HASH_COLUMNS]))
    late = F.col("reason") == "late"
    dates = [r[0] for r in marked.filter(late).select(F.col("BizDt").try_cast("date")).distinct().collect()]
    known = held.filter(F.col("business_date").isin(dates)).select(F.col("hash_key").alias("_held"))
    return marked.join(known, late & (F.col("_hash") == F.col("_held")), "left_anti").select(aside.columns)


def load_silver(
    spark: SparkSession, bronze: str, table: str, control: str, reprocess_dates: Iterable[dt.date] = (),
    rejects: str | None = None, type_log: str | None = None,
) -> dict:
    """Raw rows after the watermark into the silver table, then the new watermark.

    The watermark is the latest date of the filtered batch before the merge, so
    a batch of known rows still advances it.  Rows of the series that cannot be
    loaded, or come too late, go to ``rejects`` (``<table>_rejected``) with a reason;
    ``reprocess_dates`` loads late ones.

    Where the raw table has a log of its commits (``bronze.log_commit``), only the dates of commits not seen before are read, and those
    of ``reprocess_dates``; whenever a commit was stamped, it is looked at once.  Without a log, all dates are.

    With ``type_log``, a table, it gets a row per typed column of the batch: how many of its texts do not read as the type, and become null.
    """
    layer, name = table.split(".")
    watermark = get_watermark(spark, control, layer, name)
    again = list(reprocess_dates)
    source, logged = read_table(spark, bronze), unseen_commits(spark, bronze, table)
    if logged is not None:
        source = dated(source, logged[1], again)
    batch = read_since(source, "BizDt", watermark)
    if watermark is not None and again:
        batch = source.filter(
            (F.col("BizDt").try_cast("date") > F.lit(watermark)) | F.col("BizDt").try_cast("date").isin(again)
        )
    ensure_table(spark, table, SILVER_SCHEMA, ["business_date"])
    held = read_table(spark, table)
    before = None if logged is not None else held.agg(F.max("silver_load_date_time")).first()[0]
    aside = set_aside(equity_series(source, "SctySrs"), watermark, again, before)
    if logged is not None:
        aside = not_loaded(aside, held, watermark)
    left_out = {r["reason"]: r["n"] for r in aside.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    if left_out:
        append_rejects(aside, rejects or f"{table}_rejected", sum(left_out.values()))
    if type_log:
        found = type_misfits(batch, {raw: kind.simpleString() for raw, (_, kind) in SILVER_COLUMNS.items()})
        append(found.withColumn("checked_at", F.current_timestamp()), type_log)
    typed, _ = split_rejects(equity_series(typed_quotes(batch)), ["ISIN", "business_date"])
    key, dealt_by = row_text(HASH_COLUMNS), ["business_date", SHARE]
    counts = counts_of(typed, "business_date", key)
    if counts.heavy:
        # of many copies a row per task moves
        typed = new_rows_by_hash(_derived(typed), held.limit(0)).select(typed.columns)
    # the date and the text of a row's hash are equal where the hash is; what derives from a row is added where it is dealt to
    silver = _derived(dealt(typed, "business_date", key, counts))
    # rows of the batch lie after the watermark, so older partitions cannot hold them
    since = read_since(held, "business_date", watermark)
    if watermark is not None and again:
        since = held.filter((F.col("business_date") > F.lit(watermark)) | F.col("business_date").isin(again))
    since = dealt(since.select("business_date", "hash_key", *[c for c in HASH_COLUMNS if c != "business_date"]), "business_date", key, counts)
    fresh, written = counted(new_rows_by_hash(silver, since, dealt_by=dealt_by).drop(SHARE), "silver_written")
    append(fresh, table, ["business_date"], sort_by=["ISIN"], gathered=True)
    put_watermark(spark, control, layer, name, counts.last)
    if logged is not None:
        mark_seen(spark, logged[0], table)
    return {
        "rows_read": counts.rows, "rows_written": measured(written)["rows"],
        "rows_incomplete": left_out.get("incomplete", 0), "rows_late": left_out.get("late", 0),
    }
