"""Physical plans: what is read, what is shuffled, and what never happens."""

import __spark_entry__ as driver
import pytest
from conftest import SF_DIR
from rows import day, gold

from quoteflow import fixtures
from quoteflow.operators.ema import ema_series
from quoteflow.plans import serving
from quoteflow.sources import quotefiles
from quoteflow.sources.tables import write_parquet


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in driver.queries() if n not in ("ema_stream", "dedup_events")])
def test_no_cross_products(spark, name):
    text = plan(driver.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gold") / "t")
    rows = [dict(stock_code=c, stock_name="n" + c, ISIN=c, business_date=day(n), closing_price=1.0 * n,
                 pnl_percentage=0.1, avg_pnl_percentage=0.1) for c in "ABC" for n in range(4)]
    write_parquet(gold(spark, *rows), path, ["business_date"])
    return spark.read.parquet(path)


def scans(text):
    return [line for line in text.splitlines() if "FileScan" in line]


def test_movers_read_only_the_last_partition(stored):
    out = serving.gainers(stored)
    assert out.count() == 3
    assert any("business_date" in s and "Subquery" in s.split("PartitionFilters:")[1].split("PushedFilters")[0]
               for s in scans(plan(out)))


def test_limits_are_top_k(stored):
    for df in (serving.history(stored, "a"), serving.latest(stored, "a"), serving.gainers(stored),
               serving.search(stored, "n"), serving.suggest(serving.stock_catalog(stored), "a")):
        assert "TakeOrderedAndProject" in plan(df)


def test_columns_are_pruned(stored):
    read = scans(plan(serving.history(stored, "a")))[0].split("ReadSchema:")[1]
    assert "ema_7" not in read and "stock_name" not in read
    for df in (serving.tracked_stocks(stored), serving.market_average(stored)):
        schema = scans(plan(df))[0].split("ReadSchema:")[1]
        assert schema.count(":") == 1


@pytest.mark.parametrize("name", ["latest", "history", "indicators", "details"])
def test_lookups_by_code_reach_the_reader(spark, name):
    text = plan(driver.queries()[name](spark, SF_DIR))
    assert any("stock_code" in s.split("PushedFilters:")[1].split("ReadSchema")[0] for s in scans(text))


def test_csv_headers_are_read_without_whole_files(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("binaryFile")

    monkeypatch.setattr(type(spark.read), "format", whole)
    assert quotefiles._paths_by_header(spark, [__file__])[0][0].startswith('"""Physical plans')


def test_date_range_prunes_partitions(stored):
    text = scans(plan(serving.history(stored, "a", day(1), day(2))))[0]
    assert ">=" in text.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_both_passes_over_a_series_share_one_shuffle(spark):
    # the summary and the scan branch must ask for the same columns of the same rows
    out = ema_series(fixtures.silver_table(spark, SF_DIR))
    out.write.format("noop").mode("overwrite").save()
    df = ema_series(fixtures.silver_table(spark, SF_DIR))
    df.collect()
    assert "ReusedExchange" in plan(df) or "Reused" in plan(df)


def test_deduplication_limits_before_the_shuffle(spark):
    text = plan(fixtures.deduped_quotes(spark, SF_DIR))
    assert text.index("Final") < text.index("hashpartitioning(BizDt") < text.index("Partial")


def test_gold_moves_whole_rows_once(spark):
    """Of the exchanges that gold runs with, one carries the quotes; averages come to the rows, not rows to the averages."""
    from quoteflow.plans.gold import build_ema, build_gold

    quotes = fixtures.silver_table(spark, SF_DIR)
    wide = {}
    for name, df in (("at once", build_gold(quotes)), ("by side table", build_gold(quotes, build_ema(quotes)))):
        df.collect()
        found, waiting = [], [df._jdf.queryExecution().executedPlan()]
        while waiting:
            node = waiting.pop()
            kind = node.nodeName()
            if kind == "Exchange":
                found.append(node.output().size())
            children = node.children()
            waiting += [children.apply(i) for i in range(children.size())]
            if kind == "AdaptiveSparkPlan":
                waiting.append(node.executedPlan())
            elif kind.endswith("QueryStage"):
                waiting.append(node.plan())
        wide[name] = sum(1 for n in found if n > 10)
    assert wide["at once"] == 1 <= wide["by side table"]


def test_gold_is_the_same_either_way(spark):
    from quoteflow.plans.gold import build_ema, build_gold

    quotes = fixtures.silver_table(spark, SF_DIR)
    columns = ["hash_key", "ISIN", "closing_price", "ema_7"]
    ways = [sorted(map(tuple, df.select(columns).collect())) for df in (build_gold(quotes), build_gold(quotes, build_ema(quotes)))]
    assert ways[0] == ways[1]
    assert build_gold(quotes).columns[-3:] == build_gold(quotes, build_ema(quotes)).columns[-3:]
