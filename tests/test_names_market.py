"""Name search by trigrams and market totals by date, against the plain queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import day, gold, values

from quoteflow.plans import market, names, serving
from quoteflow.sources.tables import append, write_parquet

NAMES = ["Red Green Ltd", "Bored gnome", "red", "RE", "aaaa", "Ärger & Söhne", "Straße", "x'y", None, "", "tred grey"]


@pytest.fixture
def table(spark):
    rows = [dict(stock_code=f"C{i % 6}" if i % 7 else None, stock_name=name, ISIN=f"I{i}", business_date=day(n), closing_price=1.0 * n, pnl_percentage=float(i - n) if i % 5 else None,
                 avg_pnl_percentage=float(i), hash_key=f"{i}-{n}") for i, name in enumerate(NAMES) for n in range(3)]
    return gold(spark, *rows)


@pytest.mark.parametrize("text", ["red", "Red G", "re", "a", "aaa", "aaaaa", "straße", "STRASSE", "& s", "x'y", "nothing", "", None, "%", "d_g", " red "])
def test_indexed_search_equals_search(table, text):
    index = names.name_index(table, "stock_name")
    found = names.search_indexed(table, index, text, 50)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in serving.search(table, text, 50).collect()]


@pytest.mark.parametrize("text", ["red", "c1", "c", "RED G", "e g", "zz", "", None])
def test_indexed_suggestions_equal_suggestions(table, text):
    catalog = serving.stock_catalog(table)
    index = names.name_index(catalog, "stock_code", "stock_name")
    found = names.suggest_indexed(catalog, index, text)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in serving.suggest(catalog, text).collect()]


def test_many_names_are_joined(table, monkeypatch):
    monkeypatch.setattr(names, "LITERALS", 1)
    index = names.name_index(table, "stock_name")
    assert values(names.search_indexed(table, index, "re"), "stock_code") == values(serving.search(table, "re"), "stock_code")


def test_only_hits_reach_the_reader(spark, table, database, tmp_path):
    write_parquet(table, str(tmp_path / "g"))
    stored, wanted = spark.read.parquet(str(tmp_path / "g")), f"{database('n')}.names"
    append(table, f"{database('n')}.gold")
    names.load_name_index(spark, f"{database('n')}.gold", wanted)
    plan = names.search_indexed(stored, spark.table(wanted), "red g")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "In(stock_name" in scan or "EqualTo(stock_name" in scan
    looked_up = names.names_with(spark.table(wanted), "RED G")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in looked_up


def test_states_of_separate_dates_add_up(spark, table, database):
    gold_name, state_name = f"{database('m')}.gold", f"{database('m')}.states"
    append(table.filter(F.col("business_date") < day(2)), gold_name, ["business_date"])
    assert market.load_market_states(spark, gold_name, state_name)["rows_written"] == 2
    append(table.filter(F.col("business_date") >= day(2)), gold_name, ["business_date"])
    assert market.load_market_states(spark, gold_name, state_name)["rows_written"] == 1
    append(table.filter(F.col("business_date") == day(0)), gold_name, ["business_date"])
    assert market.load_market_states(spark, gold_name, state_name, [day(0)])["rows_written"] == 1
    rows, states = spark.table(gold_name), spark.table(state_name)
    totals, plain = market.market_totals(states, serving.stock_catalog(rows)).first(), serving.overview(rows).first()
    assert totals["latest_business_date"] == plain["latest_business_date"] and totals["tracked_stocks"] == plain["tracked_stocks"]
    assert totals["average_pnl_percentage"] == pytest.approx(plain["average_pnl_percentage"], rel=1e-12)
    assert market.market_totals(states).first()["tracked_stocks"] == plain["tracked_stocks"]
    made = market.overview_from_states(rows, states).first()
    assert made["gainers"] == plain["gainers"] and made["losers"] == plain["losers"]
    plan = market.overview_from_states(rows, states)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "closing_price" in line]
    assert scans and all("business_date" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_totals_of_nothing(spark, table):
    row = market.market_totals(market.market_states(table.limit(0))).first()
    assert tuple(row) == (None, 0, 0.0) and isinstance(day(0), dt.date)
