"""Gold from stored averages: whole rows move once, lie by date, and are those of the plain joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import values

from quoteflow.functions import row_hash
from quoteflow.operators import deal
from quoteflow.plans import gold
from quoteflow.plans.silver import to_silver
from quoteflow.schema import HASH_COLUMNS
from quoteflow.sources import tables

SHOWN = ["ISIN", "stock_code", "business_date", "hash_key", "closing_price", "pnl_percentage", "avg_pnl_percentage", "ema_7"]
DAYS = [dt.date(1992, 6, d) for d in (1, 2, 15, 16)] + [dt.date(2026, 9, 1)]


def shown(df):
    """Sums of doubles depend on their order in the last digits."""
    return values(df.withColumn("avg_pnl_percentage", F.round("avg_pnl_percentage", 9)), *SHOWN)


def silver(spark):
    """Two codes of a security, a code missing, prices missing, an id that is no hash, none at all, a return that does not follow."""
    rows = [(f"I{n}", str(d), "A", f"T{n}{'x' * (n == 2 and i > 2)}" if n != 3 else None, "EQ", str(10 + n + i * i), "10" if n != 4 else None) for n in range(9) for i, d in enumerate(DAYS)]
    raw = spark.createDataFrame(rows, "ISIN string, BizDt string, Src string, TckrSymb string, SctySrs string, ClsPric string, PrvsClsgPric string")
    first = F.col("business_date") == F.lit(DAYS[0])
    return to_silver(raw).withColumns({
        "hash_key": F.when(first & (F.col("ISIN") == "I5"), "as it is").when(first & (F.col("ISIN") == "I6"), None).otherwise(F.col("hash_key")),
        "pnl_percentage": F.when(first & (F.col("ISIN") == "I7"), 5.0).otherwise(F.col("pnl_percentage")),
    })


@pytest.mark.parametrize("mode", ["series", "final"])
@pytest.mark.parametrize("share_rows", [250_000, 3])
def test_rows_are_those_of_the_joins(spark, monkeypatch, mode, share_rows):
    monkeypatch.setattr(deal, "ROWS_OF_A_SHARE", share_rows)
    layer = f"joins_{mode}_{share_rows}"
    tables.overwrite(silver(spark), f"{layer}.quotes")
    gold.load_ema(spark, f"{layer}.quotes", f"{layer}.averages", mode=mode)
    # a row that came after the averages has its mean return and no average
    tables.append(silver(spark).filter("ISIN = 'I8'").limit(1).withColumns({"ISIN": F.lit("I1"), "ticker_symbol": F.lit("T1"), "hash_key": F.lit("late")}), f"{layer}.quotes")
    rows = spark.table(f"{layer}.quotes")
    wanted = shown(gold.build_gold(rows, gold.build_ema(silver(spark), mode=mode)))
    assert gold.load_gold(spark, f"{layer}.quotes", f"{layer}.averages", f"{layer}.gold", f"{layer}.state")["rows_written"] == len(wanted) == 46
    got = shown(spark.table(f"{layer}.gold"))
    assert got == wanted
    assert len([r for r in got if r[-1] is None]) == 2


def test_whole_rows_move_once(spark, monkeypatch):
    monkeypatch.setattr(deal, "ROWS_OF_A_SHARE", 3)
    rows = silver(spark)
    averages = gold.build_ema(rows, made_of=HASH_COLUMNS)
    # nothing but the rows is looked at: the averages come as a table
    averages = spark.createDataFrame(averages.collect(), averages.schema)
    with tables._set(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), tables.left_in_place(spark):
        plan = gold.gold_by_date(rows, averages)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 4 and "ENSURE_REQUIREMENTS" not in plan


def test_shed_columns_come_back_as_they_were(spark):
    rows = silver(spark)
    derived = {"hash_key": row_hash(HASH_COLUMNS), "pnl_percentage": F.col("closing_price") * 2}
    light = deal.shed(rows, derived)
    assert not set(derived) & set(light.columns)
    assert values(deal.restored(light, derived), *rows.columns[3:5], *derived) == values(rows, *rows.columns[3:5], *derived)


def test_averages_are_continued_from_the_published_table(spark, database):
    layer = database("c")
    tables.overwrite(silver(spark).filter("hash_key is not null"), f"{layer}.quotes")
    gold.load_ema(spark, f"{layer}.quotes", f"{layer}.averages")
    quotes, side = spark.table(f"{layer}.quotes"), spark.table(f"{layer}.averages")
    assert values(gold.refresh_ema(quotes, side), "hash_key", "ema_7") == values(side, "hash_key", "ema_7")
