"""Partitions are replaced one by one in a session that would replace whole tables, Spark's default."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from quoteflow.sources.tables import overwrite_partitions, read_table
from quoteflow.streaming.dedup import dedup_within

MODE = "spark.sql.sources.partitionOverwriteMode"


@pytest.fixture
def static(spark):
    before = spark.conf.get(MODE)
    spark.conf.set(MODE, "static")
    yield spark
    spark.conf.set(MODE, before)


def test_other_partitions_stay(static, database):
    table = f"{database('own')}.rows"
    frame = static.createDataFrame([(1, "a"), (2, "b")], "i int, p string")
    overwrite_partitions(frame, table, ["p"])
    overwrite_partitions(frame.filter("p = 'b'").withColumn("i", F.lit(3)), table, ["p"])
    assert sorted(tuple(r) for r in read_table(static, table).collect()) == [(1, "a"), (3, "b")]
    # the rows may come from the table itself
    more = read_table(static, table).filter("p = 'a'").withColumns({"i": F.col("i") + 10, "p": F.lit("c")})
    overwrite_partitions(more, table, ["p"])
    assert sorted(tuple(r) for r in read_table(static, table).collect()) == [(1, "a"), (3, "b"), (11, "c")]
    assert static.conf.get(MODE) == "static"


def test_dedup_stream_keeps_the_rows_of_batches_before(static, database, tmp_path):
    table, folder = f"{database('own')}.events", str(tmp_path / "in")
    kind = "id int, k string, ts timestamp"
    for rows in ([(1, "a", dt.datetime(2024, 1, 1)), (2, "b", dt.datetime(2024, 1, 2))],
                 [(3, "a", dt.datetime(2024, 1, 3)), (4, "c", dt.datetime(2024, 1, 1))]):
        static.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        stream = static.readStream.schema(kind).parquet(folder)
        dedup_within(stream, table, ["k"], "ts").awaitTermination()
    assert sorted(r["id"] for r in read_table(static, table).collect()) == [1, 2, 4]
    assert [r["repeats"] for r in read_table(static, f"{table}_counts").orderBy("_batch").collect()] == [0, 1]


def test_late_rows_are_worked_in(static, sf_dir):
    gold = driver.queries()["late_reprocess"](static, sf_dir)
    assert gold.count() == driver.queries()["load_gold"](static, sf_dir).count()
