"""Steps whose sorts and shuffles must stay within memory as tables grow."""

import datetime as dt

from pyspark.sql import functions as F

from quoteflow import fixtures
from quoteflow.operators.ema import ema_series, with_ema
from quoteflow.operators.quality import findings, missing_dates
from quoteflow.plans.gold import build_gold

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_silver_moves_line_items_once_and_sorts_them_after(spark):
    text = plan(fixtures.silver_quotes(spark, SF_DIR))
    assert text.count("Exchange ") == 2 and "SortMergeJoin" not in text
    scan_side = text[text.index("Exchange "):]
    assert "WindowGroupLimit" not in scan_side
    ours, plain = fixtures.quotes_by_security(spark, SF_DIR), fixtures.deduped_quotes(spark, SF_DIR)
    assert ours.count() == plain.count() and ours.exceptAll(plain).isEmpty()


def test_gold_carries_no_column_twice(spark):
    """Of the whole rows' shuffle: their own columns and the block."""
    quotes = fixtures.silver_table(spark, SF_DIR)
    exchanges, waiting = [], [build_gold(quotes)._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "Exchange":
            exchanges.append(node.output().size())
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    assert max(exchanges) <= len(quotes.columns)


def test_averages_beside_rows_over_several_blocks(spark):
    """Nothing is summarised of the last block; what comes before it counts, also where a security ends sooner or has gaps."""
    start = dt.date(2024, 1, 1)
    rows = [(f"h{s}{i:03d}", s, start + dt.timedelta(days=i), None if i % 7 == 3 else float(i * 37 % 11)) for s, n in (("a", 90), ("b", 40), ("c", 1)) for i in range(n)]
    rows += [("late", "c", start + dt.timedelta(days=89), 5.0), ("none", None, start, 1.0), ("undated", "b", None, 2.0)]
    df = spark.createDataFrame(rows, "hash_key string, ISIN string, business_date date, closing_price double")
    for span in (10, 32, 8192):
        ours = {r["hash_key"]: r["ema_7"] for r in with_ema(df, span_days=span).collect()}
        series = {r["hash_key"]: r["ema_7"] for r in ema_series(df, span_days=span).collect()}
        assert ours == series and len(ours) == len(rows)


def test_missing_dates_moves_rows_once_in_unmerged_tasks(spark):
    text = plan(missing_dates(fixtures.silver_table(spark, SF_DIR)))
    assert "REPARTITION_BY_NUM" in text and "SortMergeJoin" not in text


def test_missing_dates_with_odd_rows(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 4)]
    rows = [("a", days[0]), ("a", days[0]), ("a", days[3]), ("b", days[1]), ("b", None), (None, days[2]), ("c", None)]
    df = spark.createDataFrame(rows, "ISIN string, business_date date")
    found = {(r[0], r[1] and r[1].day, r[2] and r[2].day, r[3]) for r in missing_dates(df).collect()}
    assert found == {("a", 1, 4, 2), ("b", None, 2, 1), ("b", 2, None, 2), (None, None, 3, 2), (None, 3, None, 1)}
    gold = build_gold(fixtures.silver_table(spark, SF_DIR))
    gaps = missing_dates(gold).agg(F.sum("missing_days")).first()[0]
    assert gaps == findings(gold).filter(F.col("check") == "missing_days").first()["findings"]


def test_many_short_members_share_tasks():
    from quoteflow.sources.quotefiles import MOST_TASKS, unpacking_tasks

    assert unpacking_tasks(72_000, 3 << 30, 6) == 96
    assert unpacking_tasks(5, 100 << 30, 6) == 5
    assert unpacking_tasks(10, 1000, 6) == 10
    assert unpacking_tasks(10**6, 1 << 50, 6) == MOST_TASKS
    assert unpacking_tasks(0, 0, 6) == 1
