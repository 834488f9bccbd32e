"""Averages continued from stored ones: rows move once, narrow; results are those of a full build, with odd rows among them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import values

from quoteflow.plans import gold
from quoteflow.plans.silver import to_silver
from quoteflow.schema import HASH_COLUMNS

DAYS = [dt.date(2026, 9, d) for d in range(1, 11)]


def silver(spark):
    """Missing prices, two codes of a security on a day, securities missing, an id that is no hash."""
    rows = [(f"I{n}" if n != 6 else None, str(d), "A", f"T{n}{c}", "EQ", str(10 + n + (i * 7) % 5) if (i + n) % 4 else None, "10") for n in range(8) for c in ("ab" if n == 1 else "a") for i, d in enumerate(DAYS)]
    quotes = to_silver(spark.createDataFrame(rows, "ISIN string, BizDt string, Src string, TckrSymb string, SctySrs string, ClsPric string, PrvsClsgPric string"))
    return quotes.withColumn("hash_key", F.when((F.col("ISIN") == "I5") & (F.dayofmonth("business_date") == 2), "as it is").otherwise(F.col("hash_key")))


def held_of(quotes):
    """To the fifth day; I2 all but an early day, I3 nothing yet."""
    day = F.dayofmonth("business_date")
    return quotes.filter((day <= 5) & ~(F.col("ISIN").eqNullSafe("I2") & (day == 3)) & ~F.col("ISIN").eqNullSafe("I3"))


@pytest.mark.parametrize("made_of", [(), HASH_COLUMNS])
def test_continued_averages_equal_a_full_build(spark, made_of):
    quotes = silver(spark).cache()
    held = gold.build_ema(held_of(quotes), made_of=made_of)
    stored = spark.createDataFrame(held.collect(), held.schema)
    ours = gold.refresh_ema(quotes, stored)
    assert values(ours, "hash_key", "ema_7") == values(gold.build_ema(quotes), "hash_key", "ema_7")
    # averages of before stay as they are stored, but for a security that got an earlier row
    odd = stored.withColumn("ema_7", F.col("ema_7") + 1)
    moved = {r["hash_key"] for r in gold.refresh_ema(quotes, odd).join(ours.withColumnRenamed("ema_7", "was"), "hash_key").filter("ema_7 != was").collect()}
    late = {r[0] for r in quotes.filter("ISIN in ('I2', 'I3')").select("hash_key").collect()}
    assert moved and not moved & late and {r[0] for r in stored.filter("ema_7 is not null").select("hash_key").collect()} - late <= moved


def test_rows_move_once_without_their_hash(spark):
    quotes = silver(spark)
    held = gold.build_ema(held_of(quotes), made_of=HASH_COLUMNS)
    stored = spark.createDataFrame(held.collect(), held.schema)
    plan = gold.refresh_ema(quotes, stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
