import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rows import day, silver, values

from quoteflow.operators.ema import ema_closing, ema_final, ema_series, ema_table


def fold(prices, period=7, start=None):
    """The definition, one value after the other."""
    alpha, average, out = 2.0 / (period + 1.0), start, []
    for price in prices:
        if price is not None:
            average = price if average is None else alpha * price + (1 - alpha) * average
        out.append(average)
    return out


def series(df, column="ema_7", key="A"):
    rows = df.filter(F.col("ISIN") == key).orderBy("business_date", "hash_key").collect()
    return [r[column] for r in rows]


PRICES = [10.0, 11.5, 9.25, 12.0, 13.75, 8.5, 9.0, 20.0]


def test_series_equals_definition_bit_for_bit(spark):
    df = silver(spark, [("A", n, p, 0.0) for n, p in enumerate(PRICES)] + [("B", 3, 5.0, 0.0)])
    out = ema_series(df.repartition(5))
    assert out.columns == ["hash_key", "ISIN", "business_date", "closing_price", "ema_7"]
    assert series(out) == fold(PRICES)
    assert series(out, key="B") == [5.0]


def test_final_repeats_the_last_average(spark):
    df = silver(spark, [("A", n, p, 0.0) for n, p in enumerate(PRICES)] + [("B", 3, 5.0, 0.0)])
    out = ema_final(df)
    assert set(series(out)) == {fold(PRICES)[-1]} and series(out, key="B") == [5.0]
    assert out.columns == ema_series(df).columns


def test_null_prices_carry_the_average(spark):
    prices = [None, None, 4.0, None, 8.0, None]
    df = silver(spark, [("A", n, p, 0.0) for n, p in enumerate(prices)] + [("B", 0, None, 0.0)])
    assert series(ema_series(df)) == fold(prices) == [None, None, 4.0, 4.0, 5.0, 5.0]
    assert series(ema_series(df), key="B") == [None]
    assert set(series(ema_final(df))) == {5.0}


@pytest.mark.parametrize("span", [1, 2, 3, 7, 100])
def test_blocks_do_not_change_the_averages(spark, span):
    prices = [100.0 + 17 * math.sin(n) + (1e9 if n == 4 else 0) for n in range(40)]
    prices[0] = prices[9] = prices[10] = None
    df = silver(spark, [("A", 3 * n, p, 0.0) for n, p in enumerate(prices)])
    expected = fold(prices)
    got = series(ema_series(df, span_days=span))
    assert [g is None for g in got] == [e is None for e in expected]
    assert all(g == pytest.approx(e, rel=1e-9) for g, e in zip(got, expected) if e is not None)
    assert series(ema_final(df, span_days=span))[0] == pytest.approx(expected[-1], rel=1e-9)


def test_other_period_and_columns(spark):
    df = silver(spark, [("A", n, p, 0.0) for n, p in enumerate(PRICES)]).select(
        F.col("ISIN").alias("g"), F.col("business_date").cast("timestamp").alias("t"),
        F.col("closing_price").alias("v"), F.col("hash_key").alias("i"))
    out = ema_series(df, 3, group_col="g", target_col="t", value_col="v", row_id="i")
    assert out.columns == ["i", "g", "t", "v", "ema_3"]
    assert [r["ema_3"] for r in out.orderBy("t").collect()] == fold(PRICES, 3)
    assert ema_table(out, "i").columns == ["i", "ema_3"]


def test_rows_without_a_series_get_null(spark):
    df = silver(spark, [(None, n, 1.0, 0.0) for n in range(50)] + [("A", 1, 2.0, 0.0)])
    out = ema_series(df)
    assert out.count() == 51 and out.filter("ISIN is null and ema_7 is null").count() == 50
    assert ema_closing(df).collect()[0]["ISIN"] == "A" and ema_closing(df).count() == 1
    assert ema_final(df).filter("ISIN is null and ema_7 is null").count() == 50


def test_opening_value_continues_a_series(spark):
    df = silver(spark, [("A", n, p, 0.0) for n, p in enumerate(PRICES)] + [("B", 1, 3.0, 0.0)])
    early, late = (df.filter(F.col("business_date") <= F.lit(day(3))), df.filter(F.col("business_date") > F.lit(day(3))))
    got = ema_series(late, opening=ema_closing(early))
    assert series(got) == fold(PRICES)[4:]
    with_b = df.filter("ISIN = 'B'").unionByName(late)
    assert series(ema_series(with_b, opening=ema_closing(early)), key="B") == [3.0]
    assert values(ema_closing(late, opening=ema_closing(early)), "ema_7") == [(fold(PRICES)[-1],)]


def test_equal_dates_go_by_row_id(spark):
    df = spark.createDataFrame(
        [("A", day(0), 1.0, "x2"), ("A", day(0), 5.0, "x1"), ("A", day(1), 9.0, "x0")],
        "ISIN string, business_date date, closing_price double, hash_key string")
    assert series(ema_series(df)) == fold([5.0, 1.0, 9.0])


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="hash_key"):
        ema_series(spark.createDataFrame([("A", day(0), 1.0)], "ISIN string, business_date date, closing_price double"))


def test_one_series_with_a_third_of_the_rows(spark):
    """A heavy series is cut into blocks that different tasks scan."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("S"), (F.col("id") % 500))).alias("ISIN"),
        F.date_add(F.lit(day(0)), (F.col("id") % 9973).cast("int")).alias("business_date"),
        (F.lit(50.0) + F.col("id") % 89).alias("closing_price"),
        F.lpad(F.col("id").cast("string"), 6, "0").alias("hash_key"),
    )
    out = ema_series(rows, span_days=365)
    got = series(out, key="HOT")
    prices = [r["closing_price"] for r in rows.filter("ISIN = 'HOT'").orderBy("business_date", "hash_key").collect()]
    assert len(got) == 10_000
    assert all(g == pytest.approx(e, rel=1e-9) for g, e in zip(got, fold(prices)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ema_series(rows, span_days=64)
        held = _rows_per_task(out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(held) == 10_000 and sum(1 for n in held if n) > 1


def _rows_per_task(df):
    tasks = df.filter("ISIN = 'HOT'").groupBy(F.spark_partition_id()).count()
    return [r["count"] for r in tasks.collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    prices=st.lists(st.one_of(st.none(), st.floats(0.05, 1e6)), min_size=1, max_size=30),
    span=st.integers(1, 40),
    gap=st.integers(1, 9),
)
def test_any_series_any_block_length(spark, prices, span, gap):
    df = silver(spark, [("A", gap * n, p, 0.0) for n, p in enumerate(prices)])
    for g, e in zip(series(ema_series(df, span_days=span)), fold(prices)):
        assert g == (None if e is None else pytest.approx(e, rel=1e-9))


def test_stretches_and_long_series_fold_as_defined(spark, monkeypatch):
    """Rows cut into stretches of any size, and series on either side of the length that is folded alone."""
    from quoteflow.operators import ema as module

    rows = [(k, n, None if (n * 7 + len(k)) % 11 == 3 else 50.0 + (n * 31 + len(k)) % 17, 0.0) for k, m in (("A", 90), ("BB", 7), ("CCC", 40)) for n in range(m)]
    df = silver(spark, rows).repartition(3).cache()
    expected = {k: fold([r[2] for r in rows if r[0] == k]) for k in ("A", "BB", "CCC")}
    for stretch, long in ((1, 1024), (13, 5), (1 << 16, 5), (1 << 16, 1024)):
        monkeypatch.setattr(module, "_STRETCH", stretch)
        monkeypatch.setattr(module, "_LONG", long)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
        try:
            out, blocks = ema_series(df), ema_closing(df, span_days=16)
            assert all(series(out, key=k) == expected[k] for k in expected)
            closing = {r["ISIN"]: r["ema_7"] for r in blocks.collect()}
            assert all(closing[k] == pytest.approx(expected[k][-1], rel=1e-12) for k in expected)
            assert series(ema_final(df))[0] == expected["A"][-1]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_row_is_a_nan_average(spark):
    df = silver(spark, [("A", n, p, 0.0) for n, p in enumerate([float("nan"), 4.0, float("nan"), 8.0])])
    assert series(ema_series(df)) == [None, 4.0, 4.0, 5.0]
