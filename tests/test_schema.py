import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoteflow.functions import base_name, daily_return, file_date, normalize, normalize_text, row_hash
from quoteflow.operators.align import align_schema, trim_headers, union_batches
from quoteflow.schema import database_type, require_columns, schema_differences
from quoteflow.sources.database import create_statement, read_options, write_options


def test_align_schema_casts_trims_adds_and_orders(spark):
    texts = [" ", " 12.5 ", "12.0", "01-SEP-2026", "3000000000", "2026-09-01", None]
    df = spark.createDataFrame([(t, t, t, "x") for t in texts], "d string, i string, f string, extra string")
    schema = T.StructType(
        [T.StructField("f", T.DoubleType()), T.StructField("i", T.IntegerType()), T.StructField("d", T.DateType()),
         T.StructField("new", T.LongType())]
    )
    out = align_schema(df, schema)
    assert out.columns == ["f", "i", "d", "new"]
    assert [tuple(r) for r in out.collect()] == [
        (None, None, None, None),
        (12.5, None, None, None),
        (12.0, None, None, None),
        (None, None, None, None),
        (3e9, None, None, None),
        (None, None, dt.date(2026, 9, 1), None),
        (None, None, None, None),
    ]


def test_align_schema_matches_names_in_any_case(spark):
    df = spark.createDataFrame([("1",)], "ISIN string")
    assert align_schema(df, T.StructType([T.StructField("isin", T.StringType())])).collect()[0]["isin"] == "1"


def test_trim_headers(spark):
    assert trim_headers(spark.createDataFrame([(1, 2)], "` a ` int, `b\t` int")).columns == ["a", "b"]


def test_union_batches_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2, True)], "s string, n int, extra boolean")
    assert sorted(map(tuple, union_batches(a, b).collect())) == [(1, "x", None), (2, "y", True)]


def test_file_date(spark):
    names = ["q_20260901_x.zip", "q_20261399.zip", "q_2026.zip", "20260230.zip", "a1234567890.zip"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(file_date(F.col("n"))).collect()]
    assert got == [dt.date(2026, 9, 1), None, None, None, None]


def test_base_name(spark):
    df = spark.createDataFrame([("file:/a/b/c.zip",)], "p string")
    assert df.select(base_name(F.col("p"))).first()[0] == "c.zip"


def test_normalize_agrees_for_columns_and_arguments(spark):
    texts = [" ab\t", "\x00\x1fX ", "a b", "", None, " x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(normalize(F.col("t"))).collect()] == [normalize_text(t) for t in texts]


def test_daily_return_edge_cases(spark):
    df = spark.createDataFrame([(11.0, 10.0), (1.0, 0.0), (0.0, 0.0), (1.0, None), (None, 2.0)], "c double, p double")
    got = [r[0] for r in df.select(daily_return(F.col("c"), F.col("p"))).collect()]
    assert got == [(11.0 - 10.0) / 10.0 * 100, None, None, None, None]


def test_row_hash_treats_null_as_empty_text(spark):
    import hashlib

    df = spark.createDataFrame([("S", None, "T", dt.date(2026, 9, 1))], "a string, b string, c string, d date")
    assert df.select(row_hash(["a", "b", "c", "d"])).first()[0] == hashlib.sha256(b"S||T|2026-09-01").hexdigest()


def test_require_columns(spark):
    with pytest.raises(ValueError, match="hash_key"):
        require_columns(spark.range(1), ["hash_key"], "the test")


def test_schema_differences(spark):
    expected = T.StructType([T.StructField("id", T.StringType()), T.StructField("x", T.LongType())])
    assert schema_differences(spark.range(1), expected) == ["id: bigint instead of string", "x: missing"]


def test_database_types_and_statements():
    kinds = [T.DateType(), T.TimestampType(), T.DoubleType(), T.FloatType(), T.LongType(), T.IntegerType(),
             T.BooleanType(), T.StringType(), T.ArrayType(T.StringType())]
    assert [database_type(k) for k in kinds] == [
        "DATE", "TIMESTAMP", "DOUBLE PRECISION", "DOUBLE PRECISION", "BIGINT", "INTEGER", "BOOLEAN", "TEXT", "TEXT"]
    schema = T.StructType([T.StructField("ISIN", T.StringType()), T.StructField("n", T.LongType())])
    assert create_statement(schema, "g.q") == 'CREATE TABLE IF NOT EXISTS g.q ("ISIN" TEXT, "n" BIGINT)'
    assert read_options("u", "t", "d", 1, 9, 4)["numPartitions"] == "4"
    assert write_options("u", "t")["batchsize"] == "1000" and write_options("u", "t")["truncate"] == "true"
