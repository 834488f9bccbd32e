"""External SQL databases over JDBC (the driver jar and the server are the caller's)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import database_type


def read_options(url: str, table: str, column: str, lower, upper, partitions: int, **extra: str) -> dict[str, str]:
    """A read split into ``partitions`` ranges of ``column`` instead of one connection."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
        **extra,
    }


def read_database(spark: SparkSession, url: str, table: str, column: str, lower, upper, partitions: int,
                  **extra: str) -> DataFrame:
    """Table scan; filters on the result are pushed into the database by Spark."""
    options = read_options(url, table, column, lower, upper, partitions, **extra)
    return spark.read.format("jdbc").options(**options).load()


def create_statement(schema: T.StructType, table: str) -> str:
    """DDL for a database table of this schema, to be run by whoever owns the database."""
    columns = ", ".join(f'"{f.name}" {database_type(f.dataType)}' for f in schema)
    return f"CREATE TABLE IF NOT EXISTS {table} ({columns})"


def write_options(url: str, table: str, batch: int = 1000, **extra: str) -> dict[str, str]:
    """``truncate`` keeps the table, and with it its indexes, on overwrite."""
    return {
        "url": url,
        "dbtable": table,
        "batchsize": str(batch),
        "truncate": "true",
        **extra,
    }


def write_database(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 1000, **extra: str) -> None:
    df.write.format("jdbc").options(**write_options(url, table, batch, **extra)).mode(mode).save()
