import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from rows import day, raw, silver, values

from quoteflow.operators.returns import with_avg_return
from quoteflow.plans.gold import build_ema, build_gold, refresh_ema, refresh_gold
from quoteflow.plans.silver import equity_series, to_silver
from quoteflow.schema import GOLD_SCHEMA, SILVER_SCHEMA, schema_differences


def test_silver_types_filters_and_hashes(spark):
    bronze = raw(spark, [
        ("I1", "2026-09-01", "A", "EQ", "11", "10", "100"),
        ("I2", "2026-09-01", "B", "BE", "11", "10", "100"),
        ("I3", "01-SEP-2026", "C", "SM", " 12.5 ", "", "x"),
        ("I4", "2026-09-01", "D", "EQ", "3", "0", "1"),
    ]).withColumns({"Src": F.lit("S"), "TtlTradgVol": F.lit("3000000000"), "_ingested_at": F.current_timestamp(),
                    "Rmks": F.lit("dropped"), "_source_file": F.lit("f")})
    out = to_silver(bronze)
    assert schema_differences(out, SILVER_SCHEMA) == [] and out.columns == SILVER_SCHEMA.names
    got = {r["ISIN"]: r for r in out.collect()}
    assert set(got) == {"I1", "I3", "I4"}
    assert got["I1"]["pnl_percentage"] == (11.0 - 10.0) / 10.0 * 100
    assert got["I1"]["hash_key"] == hashlib.sha256(b"S|I1|A|2026-09-01").hexdigest()
    assert got["I1"]["total_trading_volume"] == 3_000_000_000 and got["I1"]["expiry_date"] is None
    assert got["I3"]["business_date"] is None and got["I3"]["closing_price"] == 12.5
    assert got["I3"]["pnl_percentage"] is None and got["I4"]["pnl_percentage"] is None


def test_silver_has_no_shuffle(spark):
    bronze = raw(spark, [("I1", "2026-09-01", "A", "EQ", "11", "10", "100")])
    assert "Exchange" not in to_silver(bronze)._jdf.queryExecution().executedPlan().toString()


def test_series_filter_drops_null_series(spark):
    df = spark.createDataFrame([("EQ",), ("SM",), ("BE",), ("eq",), (None,)], "security_series string")
    assert sorted(r[0] for r in equity_series(df).collect()) == ["EQ", "SM"]


def test_average_return_of_null_keys_is_null(spark):
    df = spark.createDataFrame(
        [("I1", "A", 1.0), ("I1", "A", 2.0), ("I1", "B", 7.0), (None, "A", 3.0), ("I2", None, 4.0), ("I3", "C", None)],
        "ISIN string, stock_code string, pnl_percentage double")
    got = values(with_avg_return(df), "ISIN", "stock_code", "avg_pnl_percentage")
    assert got == sorted([("I1", "A", 1.5), ("I1", "A", 1.5), ("I1", "B", 7.0), (None, "A", None), ("I2", None, None),
                          ("I3", "C", None)], key=repr)


def _full_silver(spark, rows):
    return silver(spark, rows).withColumns({
        "ticker_symbol": F.concat(F.lit("T"), F.col("ISIN")), "financial_instrument_name": F.lit("n"),
        "silver_load_date_time": F.current_timestamp()})


OLD = [("A", 1, 10.0, 1.0), ("A", 3, 12.0, 2.0), ("B", 1, 5.0, 0.5), ("C", 2, 7.0, 0.1)]
NEW = [("A", 2, 11.0, 4.0),  # before a known row of A
       ("B", 2, 6.0, 1.5), ("B", 5, 6.5, 1.0),  # after them
       ("D", 1, 1.0, 9.0)]  # a new security


def test_gold_columns(spark):
    quotes = _full_silver(spark, OLD)
    out = build_gold(quotes, build_ema(quotes))
    assert set(out.columns) == {
        "hash_key", "ISIN", "stock_code", "stock_name", "business_date", "closing_price", "pnl_percentage",
        "avg_pnl_percentage", "ema_7", "gold_load_date_time"} <= set(GOLD_SCHEMA.names)
    a = {r["business_date"]: r for r in out.filter("ISIN = 'A'").collect()}
    assert a[day(1)]["avg_pnl_percentage"] == 1.5 and a[day(3)]["ema_7"] == 0.25 * 12.0 + 0.75 * 10.0
    final = build_gold(quotes, build_ema(quotes, mode="final")).filter("ISIN = 'A'")
    assert {r["ema_7"] for r in final.collect()} == {0.25 * 12.0 + 0.75 * 10.0}
    with pytest.raises(ValueError):
        build_ema(quotes, mode="other")


def test_refreshed_averages_equal_a_full_build(spark):
    old, all_rows = silver(spark, OLD), silver(spark, OLD + NEW)
    refreshed = refresh_ema(all_rows, build_ema(old))
    assert values(refreshed, "hash_key", "ema_7") == values(build_ema(all_rows), "hash_key", "ema_7")


def test_sum_of_daily_refreshes_equals_a_full_build(spark):
    rows = [(s, n, 10.0 + (n * 7 + i * 3) % 11, 0.0) for i, s in enumerate("ABC") for n in range(6)]
    held = build_ema(silver(spark, [r for r in rows if r[1] == 0]))
    for n in range(1, 4):
        # collected between the days, as a stored table would be
        so_far = spark.createDataFrame(held.collect(), held.schema)
        held = refresh_ema(silver(spark, [r for r in rows if r[1] <= n]), so_far)
    full = build_ema(silver(spark, [r for r in rows if r[1] <= 3]))
    assert values(held, "hash_key", "ema_7") == values(full, "hash_key", "ema_7")


def test_refreshed_gold_equals_a_full_build(spark):
    old, all_rows = _full_silver(spark, OLD), _full_silver(spark, OLD + NEW)
    previous = build_gold(old, build_ema(old))
    ema = build_ema(all_rows)
    columns = ["hash_key", "stock_code", "business_date", "avg_pnl_percentage", "ema_7"]
    assert values(refresh_gold(all_rows, ema, previous), *columns) == values(build_gold(all_rows, ema), *columns)


def test_refresh_keeps_untouched_securities(spark):
    old, all_rows = _full_silver(spark, OLD), _full_silver(spark, OLD + NEW)
    stamp = dt.datetime(2020, 1, 1)
    previous = build_gold(old, build_ema(old)).withColumn("gold_load_date_time", F.lit(stamp))
    out = refresh_gold(all_rows, build_ema(all_rows), previous)
    untouched = {r["ISIN"] for r in out.filter(F.col("gold_load_date_time") == F.lit(stamp)).collect()}
    assert untouched == {"C"}
