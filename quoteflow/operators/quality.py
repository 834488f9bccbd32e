"""Data-quality checks; each returns its findings as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: Sequence[str] = ("ISIN", "business_date")) -> DataFrame:
    """Keys held by more than one row.  Doubles as the uniqueness check of the row hash."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def duplicate_ids(df: DataFrame, column: str = "hash_key") -> DataFrame:
    """``duplicates`` of a long id.  Digests of eight bytes are counted first: where each occurs once all ids differ, and none of them moves."""
    digests = df.select(F.xxhash64(column).alias("_digest"))
    return duplicates(df.limit(0) if duplicates(digests, ["_digest"]).isEmpty() else df, [column])


CODES = ("ISIN", "stock_code", "stock_name")


def _blank_counts(columns: Sequence[str]) -> list[Column]:
    return [F.count_if(F.coalesce(F.btrim(F.col(c)), F.lit("")) == "").alias(f"missing_{c.lower()}") for c in columns]


def missing_codes(df: DataFrame, columns: Sequence[str] = CODES) -> DataFrame:
    """Rows with a null or blank code, counted per column."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), *_blank_counts(columns))


def price_problems(df: DataFrame) -> DataFrame:
    """Each row with the checks its prices fail (empty when all pass)."""
    prices = [F.col(c) for c in ("open_price", "high_price", "low_price", "closing_price")]
    not_positive = F.lit(False)
    for price in prices:
        not_positive = not_positive | F.coalesce(price <= 0, F.lit(False))
    high, low, close = F.col("high_price"), F.col("low_price"), F.col("closing_price")
    checks = {
        "not_positive": not_positive,
        "high_below_low": F.coalesce(high < low, F.lit(False)),
        "close_outside_range": F.coalesce((close < low) | (close > high), F.lit(False)),
        "close_missing": close.isNull(),
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    return df.withColumn("price_problems", found)


def invalid_prices(df: DataFrame) -> DataFrame:
    """Number of rows per failed price check."""
    return (
        price_problems(df)
        .select(F.explode("price_problems").alias("problem"))
        .groupBy("problem")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def findings(df: DataFrame, keys: Sequence[str] = ("ISIN", "business_date")) -> DataFrame:
    """``(check, findings)``: how many keys or rows fail each check, in one result."""

    def counted(check: str, found: DataFrame, number=None) -> DataFrame:
        number = F.count(F.lit(1)) if number is None else number
        return found.agg(F.lit(check).alias("check"), F.coalesce(number, F.lit(0)).cast("bigint").alias("findings"))

    # what a row shows on its own is counted in one pass
    row_checks = price_problems(df).agg(
        *_blank_counts(CODES), F.count_if(F.size("price_problems") > 0).alias("invalid_prices")
    )
    parts = [
        counted("duplicate_rows", duplicates(_dealt(df.select(*keys), *keys), keys)),
        counted("duplicate_hashes", duplicate_ids(df)),
        row_checks.unpivot([], row_checks.columns, "check", "findings"),
        counted("missing_days", missing_dates(df), F.sum("missing_days")),
        counted("unexpected_row_counts", row_count_alarms(df).filter("unexpected")),
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


#: What a text may be read as, from the narrowest kind to the widest; every ``bigint`` is a ``double``, and any text is a ``string``.
_INTEGER, _DECIMAL, _DAY = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _reads_as(text: Column) -> dict[str, Column]:
    trimmed = F.btrim(text)
    return {
        "bigint": trimmed.rlike(_INTEGER),
        "double": trimmed.rlike(_DECIMAL),
        "date": trimmed.rlike(_DAY) & trimmed.try_cast("date").isNotNull(),
    }


def type_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What the text columns hold: ``(column_name, filled, as_bigint, as_double, as_date, narrowest)``, in one pass over the rows.

    ``filled`` counts values that are neither null nor blank, ``as_…`` those of them that read as such a value. ``narrowest`` is the narrowest type that holds
    all of them: ``bigint``, else ``double``, else ``date``, else ``string``; ``void`` for a column without any.
    """
    names = list(columns) if columns is not None else [c for c, kind in df.dtypes if kind == "string"]
    counts = []
    for name in names:
        text = F.col(f"`{name}`")
        counts.append(
            F.struct(
                F.lit(name).alias("column_name"), F.count_if(F.btrim(text) != "").alias("filled"),
                *[F.count_if(test).alias(f"as_{kind}") for kind, test in _reads_as(text).items()],
            )
        )
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, filled bigint, as_bigint bigint, as_double bigint, as_date bigint, narrowest string")
    profile = df.agg(F.array(*counts).alias("profile")).select(F.inline("profile"))
    narrowest = F.when(F.col("filled") == 0, "void")
    for kind in ("bigint", "double", "date"):
        narrowest = narrowest.when(F.col(f"as_{kind}") == F.col("filled"), kind)
    return profile.withColumn("narrowest", narrowest.otherwise("string"))


def type_misfits(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Text columns against the types they are to get: ``(column_name, expected, filled, misfits, narrowest)``.

    ``expected`` names a type of ``type_profile`` for each column; columns that ``df`` lacks or that are no text any more are left out.
    """
    held = dict(df.dtypes)
    wanted = {c: kind for c, kind in expected.items() if held.get(c) == "string" and kind in ("bigint", "double", "date")}
    profile = type_profile(df, list(wanted))
    kinds = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]) if wanted else F.lit(None).cast("map<string,string>")
    fits = F.coalesce(*[F.when(F.col("expected") == kind, F.col(f"as_{kind}")) for kind in ("bigint", "double", "date")])
    named = profile.withColumn("expected", F.element_at(kinds, F.col("column_name")))
    return named.select("column_name", "expected", "filled", (F.col("filled") - fits).alias("misfits"), "narrowest")


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows by these columns in as many tasks as the session shuffles to.  Short rows take few bytes, by which Spark would merge
    partitions until a task has more of them than it can sort or group in memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def missing_dates(df: DataFrame, key: str = "ISIN", date: str = "business_date") -> DataFrame:
    """Market days a security has no row for, as runs between its rows, before its first and after its last.

    The market calendar is the set of dates in ``df``; a run before the first row has
    no ``gap_after``, one after the last no ``gap_before``.  Every date gets its
    ordinal; a gap is a jump of more than one.  No security-by-date grid is
    formed, and the output has at most a row per input row and one per security.
    The calendar has a row per day, so its window is small however large the table is.
    """
    days = df.select(date).where(F.col(date).isNotNull()).distinct()
    calendar = days.withColumn("_ordinal", F.row_number().over(Window.orderBy(date)))
    # the rows move once, by security; the calendar comes to them
    present = _dealt(df.select(key, date), key).distinct().join(F.broadcast(calendar), date)
    history = Window.partitionBy(key).orderBy("_ordinal")
    placed = present.withColumns(
        {"_after": F.lag(date).over(history), "_previous": F.coalesce(F.lag("_ordinal").over(history), F.lit(0)), "_next": F.lead("_ordinal").over(history)}
    )
    before = F.struct(F.col("_after").alias("gap_after"), F.col(date).alias("gap_before"), (F.col("_ordinal") - F.col("_previous") - 1).alias("missing_days"))
    after = F.struct(
        F.col(date).alias("gap_after"), F.lit(None).cast(df.schema[date].dataType).alias("gap_before"), (F.col("_of_all") - F.col("_ordinal")).alias("missing_days")
    )
    # a security's last row has the run after it as well
    runs = F.when(F.col("_next").isNull(), F.array(before, after)).otherwise(F.array(before))
    found = placed.withColumn("_of_all", calendar.agg(F.max("_ordinal")).scalar()).select(key, F.inline(runs))
    gaps = found.filter("missing_days > 0")
    return gaps.withColumn("missing_days", F.col("missing_days").cast("bigint"))


def row_count_alarms(df: DataFrame, date: str = "business_date", days: int = 20, tolerance: float = 0.5) -> DataFrame:
    """Each day's row count beside the mean of the ``days`` days before it.

    ``unexpected`` is true when the count is off that mean by more than
    ``tolerance`` of it.  The window runs over one row per day.
    """
    counts = df.groupBy(date).agg(F.count(F.lit(1)).alias("row_count"))
    trailing = Window.orderBy(date).rowsBetween(-days, -1)
    expected = F.try_divide(F.sum("row_count").over(trailing), F.count("row_count").over(trailing))
    return counts.withColumn("expected_count", expected).withColumn(
        "unexpected",
        F.coalesce(
            F.abs(F.col("row_count") - F.col("expected_count")) > tolerance * F.col("expected_count"), F.lit(False)
        ),
    )
