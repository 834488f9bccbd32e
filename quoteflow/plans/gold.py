"""Silver -> moving averages and the enriched serving table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..audit import counted, measured
from ..control import put_watermark
from ..functions import daily_return, row_hash
from ..operators.deal import ROWS_OF_A_SHARE, SHARE, counts_of, dealt, restored, shed
from ..operators.ema import DEFAULT_SPAN_DAYS, ema_column, ema_final, ema_resumed, ema_series, ema_table, with_ema
from ..operators.returns import avg_return_by_day, means_by_code, with_avg_return
from ..schema import GOLD_RENAMES, HASH_COLUMNS
from ..sources.tables import publish, read_since, read_table, table_exists
from .serving import catalog_rows

EMA_MODES = {"series": ema_series, "final": ema_final}


def build_ema(
    silver: DataFrame, period: int = 7, mode: str = "series", span_days: int = DEFAULT_SPAN_DAYS, made_of: Sequence[str] = ()
) -> DataFrame:
    """``(hash_key, ema_<period>)``, and the columns that the hash is ``made_of`` if they are named.

    ``series`` holds the average as of each row, ``final`` the security's last
    average on all its rows.
    """
    if mode not in EMA_MODES:
        raise ValueError(f"mode must be one of {', '.join(EMA_MODES)}")
    return ema_table(EMA_MODES[mode](silver, period, span_days=span_days, made_of=made_of), made_of=made_of)


def enriched(silver: DataFrame) -> DataFrame:
    """Serving names and the average return; all of gold but the moving average and load time."""
    return with_avg_return(silver.drop("silver_load_date_time").withColumnsRenamed(GOLD_RENAMES))


def build_gold(silver: DataFrame, ema: DataFrame | None = None, period: int = 7) -> DataFrame:
    """Silver rows with average return, moving average and load time.

    Without ``ema``, a table of averages by row hash, they are computed where the rows lie, and the average returns join them there: whole
    rows move once.
    """
    if ema is None:
        named = silver.drop("silver_load_date_time").withColumnsRenamed(GOLD_RENAMES)
        mean = F.element_at("means", F.col("stock_code"))
        rows = with_ema(named, period, beside=means_by_code(named), avg_pnl_percentage=mean)
    else:
        rows = enriched(silver).join(ema_table(ema), "hash_key", "left")
    return rows.withColumn("gold_load_date_time", F.current_timestamp())


def holds_hash_columns(*tables: DataFrame) -> bool:
    """Whether the tables hold all that row hashes are made of."""
    return all(set(HASH_COLUMNS) <= set(t.columns) for t in tables)


def following(columns: Sequence[str], renamed: Mapping[str, str] = {}) -> dict[str, Column]:
    """What follows from other columns of a row of silver, or of gold with its names: the row hash and the daily return, if the others are there."""
    hashed = [renamed.get(c, c) for c in HASH_COLUMNS]
    derived = {}
    if {"hash_key", *hashed} <= set(columns):
        derived["hash_key"] = row_hash(hashed)
    if {"pnl_percentage", "closing_price", "previous_closing_price"} <= set(columns):
        derived["pnl_percentage"] = daily_return(F.col("closing_price"), F.col("previous_closing_price"))
    return derived


def gold_by_date(silver: DataFrame, ema: DataFrame, period: int = 7, means: bool = True) -> DataFrame:
    """As ``build_gold`` with a table of averages that has the columns of the hash (``load_ema``); rows come out gathered by date.

    Whole rows move once, by date and share of their security, without what follows from other columns.  Averages and mean returns, unless these are not
    wanted, come to them as narrow rows dealt alike.
    """
    day, security = F.coalesce(F.unix_date("business_date"), F.lit(-(2**31))), ["ISIN", "ticker_symbol"]
    silver, key, average = silver.drop("silver_load_date_time").withColumn("_day", day), F.xxhash64(*security), ema_column(period)
    counts = counts_of(silver, "_day", key)
    derived = following(silver.columns)
    hashed = {"hash_key": derived["hash_key"]}

    def lying(df: DataFrame, follows: dict) -> DataFrame:
        return restored(dealt(shed(df, follows), "_day", key, counts), follows)

    rows = lying(silver, derived)
    averages = lying(ema.select("hash_key", *HASH_COLUMNS, average, day.alias("_day")), hashed).select("_day", SHARE, "hash_key", average)
    added = [average]
    if means:
        daily = dealt(avg_return_by_day(silver, "_day", security), "_day", key, counts)
        rows, added = rows.join(daily.hint("shuffle_hash"), ["_day", SHARE, *security], "left"), ["avg_pnl_percentage", average]
    met = rows.join(averages.hint("shuffle_hash"), ["_day", SHARE, "hash_key"], "left")
    named = met.select(*[c for c in silver.columns if c != "_day"], *added).withColumnsRenamed(GOLD_RENAMES)
    return named.withColumn("gold_load_date_time", F.current_timestamp())


def refresh_ema(silver: DataFrame, previous: DataFrame, period: int = 7) -> DataFrame:
    """Side table after new silver rows: equal to ``build_ema`` over all of them.

    ``previous`` is the side table before.  Silver rows it lacks are new.  A
    security whose new rows all follow its old ones continues from its last
    average; one that got an earlier row is computed again.

    Rows move once, by security, and are looked at and folded there.  Where both sides have the columns of the row hash, these move in its place; else the old
    averages meet the rows by hash first.
    """
    column, held = ema_column(period), F.struct(F.col(ema_column(period)).alias("ema")).alias("_held")
    measured = ["ISIN", "business_date", "closing_price"]
    if holds_hash_columns(silver, previous):
        rest = [c for c in HASH_COLUMNS if c not in measured]
        rows = silver.select("hash_key", *measured, *rest, F.lit(None).cast("struct<ema:double>").alias("_held"), F.lit(False).alias("_old"))
        none = F.lit(None).cast(silver.schema["closing_price"].dataType).alias("closing_price")
        old = previous.select("hash_key", "ISIN", "business_date", none, *rest, held, F.lit(True).alias("_old"))
        met, derived = rows.unionByName(old), {"hash_key": row_hash(HASH_COLUMNS)}
    else:
        met = silver.select("hash_key", *measured).join(previous.select("hash_key", held), "hash_key", "left")
        derived = {}
    # rows without a security are dealt out evenly: each is a series of its own
    alone = F.when(F.col("ISIN").isNull(), F.xxhash64("hash_key"))
    # by their number: the few bytes that a row takes in the shuffle say little of what a task has to sort
    tasks = max(silver.sparkSession.sparkContext.defaultParallelism, 2 * silver.count() // ROWS_OF_A_SHARE + 1)
    lying = restored(shed(met.withColumn("_alone", alone), derived).repartition(tasks, "ISIN", "_alone"), derived)
    if derived:
        # an average of before meets its row by the hash; a null is no hash
        twins = Window.partitionBy("ISIN", "_alone", "hash_key")
        known = F.max(F.when(F.col("_old") & F.col("hash_key").isNotNull(), F.col("_held"))).over(twins)
        lying = lying.withColumn("_held", known).filter(~F.col("_old"))
    known, place, series = F.col("_held").isNotNull(), F.struct("business_date", "hash_key"), Window.partitionBy("ISIN", "_alone")
    late = F.min(F.when(~known, F.col("business_date"))).over(series) <= F.max(F.when(known, F.col("business_date"))).over(series)
    last = F.max_by(F.col("_held.ema"), F.when(known, place)).over(series)
    placed = lying.select("hash_key", *measured, "_held", F.coalesce(late, F.lit(False)).alias("_late"), last.alias("_last"))
    kept = F.col("_held").isNotNull() & ~F.col("_late")
    marked = placed.select("hash_key", *measured, "_held", (~kept).alias("_again"), F.when(~F.col("_late"), F.col("_last")).alias("_opening"))
    averages = ema_resumed(marked, period)
    return averages.select("hash_key", F.when(F.col("_again"), F.col(column)).otherwise(F.col("_held.ema")).alias(column))


def refresh_gold(silver: DataFrame, ema: DataFrame, previous: DataFrame) -> DataFrame:
    """Gold after new silver rows, computing only the securities that got one.

    A security's average return changes on all its rows, so those are rebuilt;
    the rows of every other security are taken over, load time included.
    """
    known = previous.select("hash_key")
    touched = silver.join(known, "hash_key", "left_anti").select("ISIN").distinct()
    rebuilt = build_gold(silver.join(touched, "ISIN", "left_semi"), ema)
    return previous.join(touched, "ISIN", "left_anti").unionByName(rebuilt.select(previous.columns))


def load_ema(spark: SparkSession, silver: str, table: str, period: int = 7, mode: str = "series") -> dict:
    """All averages computed and published, with the columns of the row hash, by which ``load_gold`` finds a row's date."""
    source = read_table(spark, silver)
    made_of = HASH_COLUMNS if holds_hash_columns(source) else ()
    ema, written = counted(build_ema(source, period, mode, made_of=made_of), "ema_written")
    publish(ema, table)
    return {"rows_written": measured(written)["rows"]}


def load_ema_of(spark: SparkSession, gold: str, table: str, period: int = 7) -> dict:
    """The averages of published gold, published as the side table."""
    ema, written = counted(read_table(spark, gold).select("hash_key", ema_column(period)), "ema_written")
    publish(ema, table)
    return {"rows_written": measured(written)["rows"]}


def load_gold(spark: SparkSession, silver: str, ema: str | None, table: str, control: str, period: int = 7) -> dict:
    """All of gold computed and published, then its watermark.  The averages are those of the table ``ema``, or else computed on the way."""
    source, averages = read_table(spark, silver), read_table(spark, ema) if ema else None
    gathered = averages is not None and holds_hash_columns(source, averages)
    gold = gold_by_date(source, averages, period) if gathered else build_gold(source, averages, period)
    gold, written = counted(gold, "gold_written", "business_date")
    publish(gold, table, ["business_date"], sort_by=["stock_code"], gathered=gathered)
    layer, name = table.split(".")
    put_watermark(spark, control, layer, name, measured(written)["last"])
    return {"rows_written": measured(written)["rows"]}


def load_catalog(spark: SparkSession, gold: str, table: str, rebuild: bool = True) -> None:
    """The latest row of every security, published for suggestions and for looking codes up.

    Unless ``rebuild``, only gold's dates after the catalog's last are read.
    """
    if not table_exists(spark, gold):
        return
    rows = read_table(spark, gold)
    if not rebuild and table_exists(spark, table):
        held = read_table(spark, table)
        since = held.agg(F.max("business_date")).first()[0]
        rows = read_since(rows, "business_date", since).select(held.columns).unionByName(held)
    publish(catalog_rows(rows), table, sort_by=["stock_code"])
