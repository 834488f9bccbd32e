"""Ids move to be counted only if their digests say that one may occur twice."""

import pytest
from rows import values

from quoteflow.operators import quality


@pytest.mark.parametrize("more, found", [([], []), ([("b",)], [("b", 2)]), ([(None,)], [(None, 2)])])
def test_duplicate_ids(spark, more, found):
    df = spark.createDataFrame([("a",), ("b",), (None,), *more], "hash_key string")
    ours = quality.duplicate_ids(df)
    assert values(ours, *ours.columns) == found == values(quality.duplicates(df, ["hash_key"]), "hash_key", "row_count")


def test_ids_that_differ_do_not_move(spark):
    df = spark.range(50).selectExpr("cast(id as string) as hash_key").repartition(3)
    plan = quality.duplicate_ids(df)._jdf.queryExecution().executedPlan().toString()
    assert "Repartition" not in plan and "RoundRobin" not in plan
