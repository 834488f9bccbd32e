"""Incremental gold: whole rows move once, and late rows are folded where they lie; gold is that of a full build."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import values

from quoteflow.operators import deal
from quoteflow.operators.ema import ema_block_summaries
from quoteflow.plans import gold, incremental, late
from quoteflow.plans.silver import to_silver
from quoteflow.sources import tables

DAYS = [dt.date(2026, 1, 1) + dt.timedelta(days=3 * n) for n in range(40)]
PAST = [DAYS[5], DAYS[6], DAYS[30]]
SHOWN = ["ISIN", "stock_code", "business_date", "hash_key", "closing_price", "pnl_percentage", "avg_pnl_percentage", "ema_7"]


def silver(spark):
    """Two codes of a security on the same days, prices missing, and an id that is no hash."""
    rows = [(f"I{n}", str(d), "A", f"T{n}{c}", "EQ", str(10 + n + (i * 37) % 11) if (i + n) % 9 else None, "10") for n in range(9) for c in ("" if n else "ab") or [""] for i, d in enumerate(DAYS)]
    raw = spark.createDataFrame(rows, "ISIN string, BizDt string, Src string, TckrSymb string, SctySrs string, ClsPric string, PrvsClsgPric string")
    odd = (F.col("business_date") == F.lit(DAYS[7])) & (F.col("ISIN") == "I5")
    return to_silver(raw).withColumn("hash_key", F.when(odd, "as it is").otherwise(F.col("hash_key")))


def shown(df):
    return values(df.withColumns({c: F.round(c, 9) for c in ("avg_pnl_percentage", "ema_7")}), *SHOWN)


def wide_moves(df):
    """Exchanges of whole rows."""
    found, waiting = 0, [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if "Exchange" in node.nodeName() and node.output().size() > 15:
            found += 1
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        else:
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("share_rows", [250_000, 3])
def test_whole_rows_move_once(spark, database, monkeypatch, share_rows):
    monkeypatch.setattr(deal, "ROWS_OF_A_SHARE", share_rows)
    moves = {}

    def watched(write):
        def run(df, table, partition_by=(), sort_by=(), **how):
            with tables.left_in_place(spark, how.get("gathered", False)):
                laid = tables._laid_out(df, partition_by, sort_by, how.get("gathered", False))
                moves.setdefault(table.split(".")[1], []).append(wide_moves(laid))
            return write(df, table, partition_by, sort_by, **how)

        return run

    monkeypatch.setattr(late, "overwrite", watched(late.overwrite))
    for module in (late, incremental):
        monkeypatch.setattr(module, "overwrite_partitions", watched(module.overwrite_partitions))
    layer, every = database(f"m{share_rows}"), silver(spark)
    is_late = F.col("business_date").isin(PAST) & F.col("ISIN").isin("I1", "I5", "I0")
    names = (f"{layer}.quotes", f"{layer}.averages", f"{layer}.gold", f"{layer}.state")
    early = F.col("business_date") <= F.lit(DAYS[20])
    for part, again in ((early & ~is_late, []), (~early & ~is_late, []), (is_late, PAST)):
        tables.append(every.filter(part), names[0], ["business_date"])
        incremental.extend_gold(spark, *names, late_dates=again)
    assert shown(spark.table(names[2])) == shown(gold.build_gold(every, gold.build_ema(every)))
    if share_rows == 3:
        # two loads, then the staged rows, which are written where they lie; so few rows that one task takes them are dealt again for the join
        assert moves["gold_rows"] == [1, 1, 0] and moves["gold_late_rows"] == [1]


def test_a_block_over_several_stretches_is_one_row(spark, monkeypatch):
    from quoteflow.operators import ema as module

    rows = silver(spark).filter("hash_key != 'as it is'").cache()
    whole = values(ema_block_summaries(rows, span_days=64), "ISIN", "block", "n", "first", "last")
    monkeypatch.setattr(module, "_STRETCH", 3)
    with tables._set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2"):
        for how in ({}, {"gathered": True}, {"gathered": True, "made_of": gold.HASH_COLUMNS}):
            summaries = ema_block_summaries(rows, span_days=64, **how)
            assert values(summaries, "ISIN", "block", "n", "first", "last") == whole
            assert summaries._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_rows_are_sorted_in_tasks_by_their_number(spark):
    from quoteflow.operators.ema import ema_closing, ema_series

    rows = silver(spark).filter("hash_key != 'as it is'")
    for made in (ema_series, ema_closing):
        few, many = made(rows, span_days=64), made(rows, span_days=64, made_of=gold.HASH_COLUMNS, tasks=37)
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "_block" in plan and ", 37), REPARTITION_BY_NUM" in plan
        shared = [c for c in few.columns if c in many.columns]
        assert values(many, *shared) == values(few, *shared)
