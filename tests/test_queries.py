"""Every registered query against its SQL on the supplied tables."""

import __spark_entry__ as driver
import compare
import pytest
from conftest import SF_DIR


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.quote_queries()))
def test_query_equals_sql(spark, connection, name):
    df = driver.queries()[name](spark, SF_DIR)
    assert compare.differences(df, connection, driver.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(driver.quote_queries()) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns[0] == "stock_code" and df.count() > 0


def test_stage_counts(spark):
    counts = {r["stage"]: r["row_count"] for r in driver.queries()["row_counts"](spark, SF_DIR).collect()}
    assert counts == {"bronze": 6000, "deduplicated": 5967, "silver": 4012}
