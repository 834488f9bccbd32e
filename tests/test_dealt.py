"""Whole rows move once, by date and share; a heavy date is many tasks' work; results do not depend on the shares."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import values

from quoteflow.operators import deal
from quoteflow.operators.merge import new_rows_by_hash
from quoteflow.plans import bronze as bronze_module
from quoteflow.plans.bronze import append_bronze, append_rejects
from quoteflow.plans.silver import load_silver
from quoteflow.sources.tables import append

DATES = [dt.date(2026, 9, d) for d in (1, 2)]
RAW = "ISIN string, BizDt string, TckrSymb string, SctySrs string, ClsPric string, TtlTrfVal string"


def raw(spark, dates=DATES, copies=3, names=9):
    rows = [(f"I{n}", str(d), f"T{n}", s, "10", str(t)) for d in dates for n in range(names) for s, t in [("SM", 9), ("EQ", 1)] + [("EQ", 5)] * copies]
    return spark.createDataFrame(rows, RAW)


@pytest.fixture(params=[250_000, 2, 40])
def share_rows(request, monkeypatch):
    """All rows in a share, more shares than a date has, and so few rows to a share that copies count as heavy."""
    monkeypatch.setattr(deal, "ROWS_OF_A_SHARE", request.param)
    monkeypatch.setattr(bronze_module, "ROWS_OF_A_SHARE", request.param)


def test_shares_change_nothing(spark, database, share_rows):
    layer = database("s")
    for again in ([], DATES[:1]):
        assert append_bronze(raw(spark, DATES, 3 if not again else 4), f"{layer}.raw", f"{layer}.raw_rejected")["rows_written"] == (0 if again else 18)
        load_silver(spark, f"{layer}.raw", f"{layer}.quotes", f"{layer}.state", again)
    append(raw(spark).withColumn("_ingested_at", F.current_timestamp()), f"{layer}.copies")
    for again in ([], DATES[:1]):
        load_silver(spark, f"{layer}.copies", f"{layer}.of_copies", f"{layer}.state", again)
    wanted = sorted((f"I{n}", d, "EQ", 5.0) for d in DATES for n in range(9))
    for table in ("quotes", "of_copies"):
        assert values(spark.table(f"{layer}.{table}"), "ISIN", "business_date", "security_series", "total_turnover_value") == wanted


def test_a_heavy_date_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(deal, "ROWS_OF_A_SHARE", 20)
    one = raw(spark, DATES[:1], 0, 300)
    counts = deal.counts_of(one, "BizDt", F.col("ISIN"))
    assert (counts.rows, counts.first, counts.undated, counts.heavy) == (600, str(DATES[0]), 0, False) and counts.shares > 20
    sizes = deal.dealt(one, "BizDt", F.col("ISIN"), counts).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 150
    assert deal.counts_of(one.limit(0), "BizDt", F.col("ISIN")) == deal.Counts(0, 0, None, None, 1, 1, False)


def test_rows_move_once(spark):
    batch = raw(spark).withColumn("hash_key", F.sha2(F.concat("ISIN", "BizDt"), 256))
    counts = deal.counts_of(batch, "BizDt", F.col("hash_key"))
    sides = [deal.dealt(df, "BizDt", F.col("hash_key"), counts) for df in (batch, batch.select("BizDt", "hash_key"))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = new_rows_by_hash(*sides, dealt_by=["BizDt", deal.SHARE])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in plan


def test_rejects_once_each_whatever_the_columns(spark, database):
    table = f"{database('r')}.rejected"
    rows = [(None, "1"), (None, "1"), ("a", None), (None, None)]
    append_rejects(spark.createDataFrame(rows, "a string, b string"), table, 4)
    more = spark.createDataFrame([(None, "1", "x"), ("b", None, "x"), ("b", None, "x")], "a string, b string, c string")
    append_rejects(more, table, 3)
    assert values(spark.table(table), "a", "b") == sorted({*rows, ("b", None)}, key=repr)


def test_tables_are_written_with_zstd(spark, database):
    table = f"{database('z')}.rows"
    for _ in range(2):
        append(spark.range(3), table)
    assert all(f.endswith(".zstd.parquet") for f in spark.table(table).inputFiles())
