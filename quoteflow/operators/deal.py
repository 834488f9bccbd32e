"""Whole rows moved once: dealt by date and share, so that one shuffle serves deduplication, the look at held rows, and the dated table they go to.

A share is a slice of a date's keys by hash.  All copies of a key are in one share, and a date has as many shares as its rows need, so a heavy date is
many tasks' work and a share makes one file.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = "_share"
#: Rows of a share, and of a task: what is sorted at once.
ROWS_OF_A_SHARE = 250_000
MOST_SHARES = 64


@dataclass(frozen=True)
class Counts:
    """What a batch holds.  ``undated`` rows are among ``rows``; ``heavy`` if copies of few keys would fill a task; ``dates`` but for null."""

    rows: int
    undated: int
    first: dt.date | str | None
    last: dt.date | str | None
    shares: int
    tasks: int
    heavy: bool
    dates: tuple = field(default=(), compare=False, repr=False)


def counts_of(df: DataFrame, date: str, key: Column) -> Counts:
    """Rows counted by date and by the finest shares; a row per date and share crosses the shuffle from each task."""
    fine = df.groupBy(F.col(date).alias("_date"), F.pmod(F.xxhash64(key), F.lit(MOST_SHARES)).alias("_fine")).agg(F.count("*").alias("n"))
    dates = fine.groupBy("_date").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    rows, undated, first, last, heaviest, most, many, days = dates.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_date").isNull(), F.col("n"))), F.lit(0)), F.min("_date"), F.max("_date"),
        F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0)), F.count("*"),
        F.collect_list("_date"),
    ).first()
    shares = min(MOST_SHARES, heaviest // ROWS_OF_A_SHARE + 1)
    # dates and shares fall on tasks by hash: twice as many tasks as full ones even that out
    tasks = min(many * shares, 2 * (rows // ROWS_OF_A_SHARE) + 1)
    return Counts(rows, undated, first, last, shares, max(1, tasks), most > 4 * ROWS_OF_A_SHARE, tuple(days))


def dealt(df: DataFrame, date: str, key: Column, counts: Counts) -> DataFrame:
    """The rows with their share, dealt by date and share."""
    return df.withColumn(SHARE, F.pmod(F.xxhash64(key), F.lit(counts.shares))).repartition(counts.tasks, date, SHARE)


def shed(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """The rows without columns that follow from others, so that they need not move; values that do not follow stay, set apart for ``restored``."""
    return df.withColumns({f"_odd_{c}": F.when(~F.col(c).eqNullSafe(e), F.struct(F.col(c).alias("as_is"))) for c, e in derived.items()}).drop(*derived)


def restored(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """The rows as they were before ``shed``."""
    odd = {c: F.col(f"_odd_{c}") for c in derived}
    return df.withColumns({c: F.when(odd[c].isNull(), e).otherwise(odd[c]["as_is"]) for c, e in derived.items()}).drop(*[f"_odd_{c}" for c in derived])


def as_numbers(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Texts beside the numbers they read as, and what the texts are if they are those numbers written out: for ``shed`` and ``restored``.

    A number of many digits takes a third of its text in a shuffle.  Texts that are written otherwise, or are none, move as they are.
    """
    numbers = {f"_number_{c}": F.col(c).try_cast("double") for c in columns}
    return df.withColumns(numbers), {c: F.col(f"_number_{c}").cast("string") for c in columns}
