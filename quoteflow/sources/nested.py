"""Nested JSON payloads as flat tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(schema: T.StructType, path: tuple[str, ...], separator: str) -> list[Column]:
    columns = []
    for field in schema:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            columns += _leaves(field.dataType, here, separator)
        else:
            quoted = ".".join("`{}`".format(p.replace("`", "``")) for p in here)
            columns.append(F.col(quoted).alias(separator.join(here)))
    return columns


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Struct fields as columns ``a_b``; arrays stay arrays.  The schema is walked, not the data."""
    return df.select(*_leaves(df.schema, (), separator))


def flatten_records(df: DataFrame, records: str = "data", separator: str = "_") -> DataFrame:
    """The array of records inside each payload row, one flat row per record."""
    return flatten(df.select(F.explode(records).alias("_record")).select("_record.*"), separator)


def read_payloads(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """API replies saved as JSON, one document per file."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(paths if isinstance(paths, str) else list(paths))


def parse_column(df: DataFrame, column: str, schema: T.StructType, separator: str = "_") -> DataFrame:
    """A JSON text column replaced by its fields as ``column_field`` columns."""
    parsed = df.withColumn(column, F.from_json(column, schema))
    return flatten(parsed, separator)
