import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import day, gold, values

from quoteflow.plans import serving

INFY = dict(stock_code="INFY", stock_name="Infosys Ltd.", ISIN="INE009A01021")


@pytest.fixture
def table(spark):
    return gold(
        spark,
        {**INFY, "business_date": day(1), "closing_price": 1490.0, "pnl_percentage": -0.2, "avg_pnl_percentage": 0.3,
         "ema_7": 1490.0, "total_trading_volume": 5},
        {**INFY, "business_date": day(4), "closing_price": 1500.25, "pnl_percentage": 0.35, "avg_pnl_percentage": 0.3,
         "ema_7": 1492.5, "total_trading_volume": 7},
        dict(stock_code="TCS", stock_name=" tata\tconsultancy", ISIN="I2", business_date=day(4), closing_price=9.0,
             pnl_percentage=1.0, avg_pnl_percentage=-0.5, ema_7=9.0),
        dict(stock_code="INFX", stock_name="Fund 100% of_gold", ISIN="I3", business_date=day(4), closing_price=2.0,
             pnl_percentage=2.0, avg_pnl_percentage=0.3, ema_7=2.0),
        dict(stock_code="NONE", stock_name=None, ISIN="I4", business_date=day(4), closing_price=2.0),
        dict(stock_code=None, stock_name="Nameless", ISIN="I5", business_date=day(2), closing_price=3.0),
        dict(stock_code="OLD", stock_name="Old infosys", ISIN="I6", business_date=day(0), avg_pnl_percentage=99.0),
    )


@pytest.fixture
def empty(spark):
    return gold(spark)


def codes(df):
    return [r["stock_code"] for r in df.collect()]


def test_bounded_limit():
    assert [serving.bounded_limit(n) for n in (-1, 0, 5, 100, 101)] == [20, 20, 5, 100, 100]


def test_catalog_skips_rows_without_code(table):
    assert sorted(codes(serving.stock_catalog(table))) == ["INFX", "INFY", "NONE", "OLD", "TCS"]
    assert serving.stock_catalog(table).columns == ["stock_code", "stock_name", "isin"]


def test_catalog_uses_the_latest_row(spark):
    df = gold(spark, dict(stock_code="A", stock_name="new", ISIN="2", business_date=day(2)),
              dict(stock_code="A", stock_name="old", ISIN="1", business_date=day(1)))
    assert [tuple(r) for r in serving.stock_catalog(df).collect()] == [("A", "new", "2")]


def test_suggestions_rank_code_before_name(table):
    catalog = serving.stock_catalog(table)
    assert codes(serving.suggest(catalog, " inf ")) == ["INFX", "INFY", "OLD"]
    assert codes(serving.suggest(catalog, "infy")) == ["INFY"]
    assert codes(serving.suggest(catalog, "tata")) == ["TCS"]
    assert codes(serving.suggest(catalog, "inf", 1)) == ["INFX"]
    assert codes(serving.suggest(catalog, "100%")) == ["INFX"]
    for blank in ("", "  ", None, "\t"):
        assert codes(serving.suggest(catalog, blank)) == []


def test_suggestion_limits(spark):
    rows = [dict(stock_code=f"C{n:02d}", stock_name="x", ISIN=str(n), business_date=day(1)) for n in range(40)]
    catalog = serving.stock_catalog(gold(spark, *rows))
    sizes = [serving.suggest(catalog, "c", n).count() for n in (-1, 0, 5, 101)]
    assert sizes == [20, 20, 5, 20] and serving.suggest(catalog, "c").count() == 10


def test_search_is_literal_unless_asked(table):
    assert codes(serving.search(table, "of_g")) == ["INFX"]
    assert codes(serving.search(table, "100%g")) == []
    assert codes(serving.search(table, "100%g", wildcards=True)) == ["INFX"]
    assert codes(serving.search(table, " INFOSYS ")) == ["INFY", "OLD"]
    assert codes(serving.search(table, None)) == ["INFX", "INFY", "NONE", "OLD", "TCS", None]
    assert codes(serving.search(table, " ", 2)) == ["INFX", "INFY"]


def test_latest(table):
    row = serving.fetch_latest(table, "infy")
    assert tuple(row) == ("INFY", "Infosys Ltd.", "INE009A01021", day(4), 1500.25, 0.35, 0.3)
    assert serving.latest(table, "nope").count() == 0
    with pytest.raises(serving.StockNotFound, match="Stock not found: nope"):
        serving.fetch_latest(table, "nope")


def test_null_date_is_latest(spark):
    df = gold(spark, dict(stock_code="A", business_date=day(1), closing_price=1.0), dict(stock_code="A", closing_price=2.0))
    assert serving.fetch_latest(df, "a")["closing_price"] == 2.0


def test_history_range_and_limit(table):
    def dates(*args, **kw):
        return [r["business_date"] for r in serving.history(table, "INFY", *args, **kw).collect()]

    assert dates() == [day(4), day(1)]
    assert dates(day(1), day(1)) == [day(1)]
    assert dates(day(2)) == [day(4)] and dates(None, day(3)) == [day(1)]
    assert dates(limit=1) == [day(4)]
    assert serving.history(table, "INFY").columns == serving.PRICES
    with pytest.raises(ValueError, match="^from must be before or equal to to$"):
        serving.history(table, "INFY", dt.date(2026, 9, 6), dt.date(2026, 9, 5))


def test_history_default_limit(spark):
    rows = [dict(stock_code="A", business_date=day(n)) for n in range(30)]
    df = gold(spark, *rows)
    assert serving.history(df, "A").count() == 14 and serving.history(df, "A", limit=0).count() == 20


def test_exact_spellings_reach_the_scan(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    exact = serving.spellings(serving.stock_catalog(stored), "infy")
    assert exact == ["INFY"]
    rows = serving.history(stored, exact)
    assert rows.count() == 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(stock_code,INFY)" in plan or "In(stock_code" in plan


def test_indicators_from_column_and_side_table(table):
    ema = table.select("hash_key", "ema_7")
    expected = [(day(4), 1500.25, 1492.5), (day(1), 1490.0, 1490.0)]
    assert [tuple(r) for r in serving.indicators(table, "infy").collect()] == expected
    assert [tuple(r) for r in serving.indicators(table, "infy", ema=ema).collect()] == expected
    assert [tuple(r) for r in serving.indicators(table, "infy", 1, ema).collect()] == expected[:1]
    partial = ema.filter("ema_7 = 1490.0")
    assert [r["ema_7"] for r in serving.indicators(table, "infy", ema=partial).collect()] == [None, 1490.0]


def test_details_arrays_follow_the_limited_order(table):
    """Two rows of one date: both arrays take them by hash, so place i is the same row in both."""
    twice = table.withColumn("other", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "hash_key": F.concat(F.lit("h"), (F.lit(1) - F.col("other")).cast("string"), "hash_key"),
        "closing_price": F.col("closing_price") + F.col("other"),
    }).drop("other")
    row = serving.details(twice, "infy").first()
    listed = [r["closing_price"] for r in serving.history(twice, "infy", limit=20).collect()]
    assert [p["closing_price"] for p in row["history"]] == listed == [i["closing_price"] for i in row["indicators"]]
    assert listed[0] > listed[1]


def test_details(table):
    row = serving.details(table, "infy").first()
    assert row["latest"]["closing_price"] == 1500.25
    assert [p["business_date"] for p in row["history"]] == [day(4), day(1)]
    assert [i["ema_7"] for i in row["indicators"]] == [1492.5, 1490.0]
    assert serving.details(table, "nope").count() == 0
    with pytest.raises(ValueError):
        serving.details(table, "infy", day(3), day(1))


def test_movers_rank_by_average_of_the_last_day_rows(table):
    assert codes(serving.gainers(table)) == ["INFX", "INFY", "TCS"]
    assert codes(serving.losers(table)) == ["TCS", "INFX", "INFY"]
    assert codes(serving.gainers(table, 1)) == ["INFX"]
    assert codes(serving.gainers(table, by="pnl_percentage")) == ["INFX", "TCS", "INFY"]
    assert serving.gainers(table).columns == serving.SUMMARY


def test_rollup_sums_rows_of_a_day(spark):
    row = dict(ISIN="I", stock_code="A", stock_name="n", business_date=day(1), open_price=1.0, closing_price=2.0,
               total_trading_volume=3, pnl_percentage=0.5)
    out = serving.daily_rollup(gold(spark, row, row)).first()
    assert (out["open_price"], out["closing_price"], out["total_trading_volume"]) == (2.0, 4.0, 6)
    assert out["avg_pnl_percentage"] is None


def test_overview(table):
    row = serving.overview(table).first()
    assert row["latest_business_date"] == day(4) and row["tracked_stocks"] == 5
    assert row["average_pnl_percentage"] == pytest.approx((-0.2 + 0.35 + 1.0 + 2.0) / 4)
    assert [r["stock_code"] for r in row["gainers"]] == ["INFX", "INFY", "TCS"]
    assert [r["stock_code"] for r in row["losers"]] == ["TCS", "INFX", "INFY"]


def test_empty_table(empty):
    row = serving.overview(empty).first()
    assert (row["latest_business_date"], row["tracked_stocks"], row["average_pnl_percentage"]) == (None, 0, 0.0)
    assert not row["gainers"] and not row["losers"]
    assert serving.market_average(empty).first()[0] == 0.0
    assert serving.gainers(empty).count() == 0 and serving.stock_catalog(empty).count() == 0


def test_approximate_count(table):
    assert abs(serving.tracked_stocks(table, approximate=True).first()[0] - 5) <= 1


def test_status(spark, table):
    table.createOrReplaceTempView("status_gold")
    assert tuple(serving.status(spark, "status_gold").first()) == (True, True, day(4))
    assert tuple(serving.status(spark, "no_such_table").first()) == (True, False, None)


def test_status_without_a_catalog():
    class Broken:
        def __init__(self, spark):
            self.spark = spark

        @property
        def catalog(self):
            raise ConnectionError

        def createDataFrame(self, *args):
            return self.spark.createDataFrame(*args)

    from pyspark.sql import SparkSession

    assert tuple(serving.status(Broken(SparkSession.getActiveSession()), "x").first()) == (False, False, None)


def test_views(spark, table):
    names = serving.create_views(table, "v_")
    assert names == ["v_stock_daily_summary", "v_stock_performance", "v_stock_technical_indicators",
                     "v_market_overview", "v_top_gainers", "v_top_losers"]
    assert spark.sql("select count(*) from v_top_gainers").first()[0] == 3
    assert spark.sql("select tracked_stocks from v_market_overview").first()[0] == 5
    assert values(spark.table("v_stock_technical_indicators").filter("isin = 'I2'"), "ema_7") == [(9.0,)]


def test_every_limit_can_be_raised(spark):
    rows = [dict(stock_code=f"C{n}", stock_name="n", ISIN=f"I{n}", business_date=day(0), closing_price=1.0, pnl_percentage=float(n), avg_pnl_percentage=float(n), ema_7=1.0) for n in range(130)]
    many = gold(spark, *rows)
    assert serving.gainers(many, 130).count() == serving.MAX_LIMIT < serving.gainers(many, 130, max_limit=None).count() == 130
    assert serving.losers(many, 130, max_limit=120).count() == 120
    one = gold(spark, *[{**r, "stock_code": "C", "business_date": day(n)} for n, r in enumerate(rows)])
    assert serving.indicators(one, "C", 130).count() == serving.MAX_LIMIT and serving.indicators(one, "C", 130, max_limit=None).count() == 130
    assert len(serving.details(one, "C", limit=130, max_limit=None).first()["history"]) == 130


def test_status_raises_errors_of_its_own(spark):
    class Wrong:
        @property
        def catalog(self):
            raise TypeError

    with pytest.raises(TypeError):
        serving.status(Wrong(), "x")
