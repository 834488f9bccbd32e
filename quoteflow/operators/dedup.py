"""One row per key, chosen by a stated order.

``row_number() = 1`` lets Spark keep only the best row per key inside every map
task (WindowGroupLimit, partial) before anything is shuffled, so a key that
holds a large share of the rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import AUDIT_COLUMNS, BRONZE_KEY


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key under ``order``; null keys are equal to each other."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_position", F.row_number().over(ranked)).filter("_position = 1").drop("_position")


def series_preference(series: Column) -> Column:
    """Main-board equity before small and medium enterprises before any other series."""
    return F.when(series == "EQ", 0).when(series == "SM", 1).otherwise(2)


def quote_preference(columns: Sequence[str]) -> list[Column]:
    """Total order among raw rows of one security and day.

    Series, then larger turnover, then every other column as a tie-break, so
    that the surviving row does not depend on how the input was partitioned.
    """
    rest = [c for c in columns if c not in {*BRONZE_KEY, "SctySrs", "TtlTrfVal", *AUDIT_COLUMNS}]
    order = [series_preference(F.col("SctySrs"))]
    if "TtlTrfVal" in columns:
        order.append(F.col("TtlTrfVal").try_cast("double").desc_nulls_last())
    order.append(F.col("SctySrs"))
    order += [F.col(f"`{c}`") for c in rest]
    order += [F.col(c).desc_nulls_last() for c in AUDIT_COLUMNS if c in columns]
    return order


def dedup_quotes(df: DataFrame, order: Sequence[Column] | None = None, by_security: bool = False) -> DataFrame:
    """One raw row per security and business date.  Those of a security come out together with ``by_security``, which stored rows are smaller by."""
    # the date first: it sorts by value where security codes, alike in their first bytes, need comparing
    return keep_first(df, BRONZE_KEY if by_security else BRONZE_KEY[::-1], order or quote_preference(df.columns))


def latest_per_key(df: DataFrame, key: str, date: str, tiebreak: Sequence[Column]) -> DataFrame:
    """The row with the latest date per key.  A null date counts as latest, as ``DESC`` sorts it in PostgreSQL."""
    return keep_first(df, [key], [F.col(date).desc_nulls_first(), *tiebreak])
