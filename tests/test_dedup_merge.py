import datetime as dt

from pyspark.sql import functions as F
from rows import raw, values

from quoteflow.operators.dedup import dedup_quotes, keep_first, latest_per_key
from quoteflow.operators.merge import new_rows, new_rows_by_hash, split_rejects, within_dates

ROWS = [
    ("I1", "2026-09-01", "A", "BE", "9", "8", "900"),
    ("I1", "2026-09-01", "A", "EQ", "7", "8", "10"),
    ("I1", "2026-09-01", "A", "SM", "6", "8", "500"),
    ("I2", "2026-09-01", "B", "EQ", "5", "4", "9"),
    ("I2", "2026-09-01", "B", "EQ", "6", "4", "10"),  # larger as a number, smaller as text
    (None, "2026-09-01", "C", "EQ", "1", "1", "1"),
    (None, "2026-09-01", "D", "EQ", "1", "1", "1"),
]


def test_dedup_prefers_series_then_turnover(spark):
    kept = values(dedup_quotes(raw(spark, ROWS)), "ISIN", "SctySrs", "TtlTrfVal", "TckrSymb")
    assert kept == [("I1", "EQ", "10", "A"), ("I2", "EQ", "10", "B"), (None, "EQ", "1", "C")]


def test_dedup_does_not_depend_on_input_order(spark):
    df = raw(spark, ROWS)
    first = values(dedup_quotes(df), *df.columns)
    for seed in range(3):
        shuffled = df.orderBy(F.rand(seed)).repartition(3 + seed)
        assert values(dedup_quotes(shuffled), *df.columns) == first


def test_one_key_with_most_rows(spark):
    hot = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("I"), F.col("id"))).alias("ISIN"),
        F.lit("2026-09-01").alias("BizDt"), F.lit("EQ").alias("SctySrs"), F.col("id").cast("string").alias("TtlTrfVal"),
    )
    kept = dedup_quotes(hot)
    assert kept.count() == 1 + sum(1 for i in range(20_000) if i % 3)
    assert kept.filter("ISIN = 'HOT'").first()["TtlTrfVal"] == "19998"
    plan = kept._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_latest_per_key_takes_null_date_first(spark):
    df = spark.createDataFrame(
        [("A", dt.date(2026, 9, 1), 1), ("A", None, 2), ("B", dt.date(2026, 9, 1), 4), ("B", dt.date(2026, 9, 1), 3)],
        "c string, d date, n int",
    )
    assert values(latest_per_key(df, "c", "d", [F.col("n")]), "c", "n") == [("A", 2), ("B", 3)]


def test_new_rows_matches_null_keys(spark):
    batch = raw(spark, ROWS)
    assert new_rows(batch, batch, ["ISIN", "BizDt"]).count() == 0
    held = batch.filter("ISIN = 'I1'")
    assert {r["ISIN"] for r in new_rows(batch, held, ["ISIN", "BizDt"]).collect()} == {"I2", None}


def test_new_rows_is_a_hash_or_merge_join(spark):
    batch = raw(spark, ROWS)
    plan = new_rows(batch, batch, ["ISIN", "BizDt"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_new_rows_by_hash_keeps_main_board(spark):
    batch = spark.createDataFrame(
        [("k1", "SM", 9.0), ("k1", "EQ", 1.0), ("k2", "EQ", 1.0), ("k2", "EQ", 3.0), ("k3", "EQ", 1.0)],
        "hash_key string, security_series string, total_turnover_value double",
    )
    held = spark.createDataFrame([("k3",), ("k3",)], "hash_key string")
    assert values(new_rows_by_hash(batch, held), *batch.columns) == [("k1", "EQ", 1.0), ("k2", "EQ", 3.0)]


def test_split_rejects(spark):
    df = spark.createDataFrame([("a", "1"), (None, "1"), (" ", "1"), ("b", None)], "x string, y string")
    good, bad = split_rejects(df, ["x", "y"])
    assert [r["x"] for r in good.collect()] == ["a"] and bad.count() == 3


def test_within_dates(spark):
    df = spark.createDataFrame([(dt.date(2026, 9, d),) for d in range(1, 6)], "d date")
    assert within_dates(df, "d", dt.date(2026, 9, 2), dt.date(2026, 9, 4)).count() == 3
    assert within_dates(df, "d", None, None).count() == 5


def test_keep_first_with_null_keys_is_one_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1)], "k string, n int")
    assert [r["n"] for r in keep_first(df, ["k"], [F.col("n")]).collect()] == [1]
