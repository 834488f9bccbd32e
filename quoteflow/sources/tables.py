"""Stored tables: Spark catalog tables (parquet unless told otherwise)."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.align import align_schema


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The table as it is now: a session remembers file listings, and another one may have written since."""
    spark.catalog.refreshTable(table)
    return spark.table(table)


def ensure_database(spark: SparkSession, table: str) -> None:
    """The database part of ``database.table``, made if missing."""
    if "." in table:
        database = table.rsplit(".", 1)[0]
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")


def _packed(writer: DataFrameWriter, format: str) -> DataFrameWriter:
    """Row hashes are hex text, which zstd halves; the table keeps the option for later inserts."""
    return writer.option("compression", "zstd") if format == "parquet" else writer


def ensure_table(
    spark: SparkSession, table: str, schema: T.StructType, partition_by: Sequence[str] = (), format: str = "parquet"
) -> None:
    """An empty table of this schema, unless the table is there."""
    ensure_database(spark, table)
    if table_exists(spark, table):
        return
    writer = _packed(spark.createDataFrame([], schema).write.format(format), format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)


def add_columns(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """Columns of ``schema`` the table lacks, added to it (null in the rows it holds)."""
    held = {c.lower() for c in spark.table(table).columns}
    added = [f for f in schema if f.name.lower() not in held]
    if added:
        columns = ", ".join(
            "`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in added
        )
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the queries that run in the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _only_partitions_written(spark: SparkSession):
    """Overwrites in the block replace the partitions they write, whatever the session says.

    Writing into a catalog table, Spark takes this from the session alone: an option of the writer is not looked at.
    """
    return _set(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic")


def left_in_place(spark: SparkSession, gathered: bool = True):
    """Joins of sides dealt alike by some of the join's keys leave both where they lie; by default Spark deals them again by all keys."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false") if gathered else nullcontext()


def _laid_out(df: DataFrame, partition_by: Sequence[str], sort_by: Sequence[str] = (), gathered: bool = False) -> DataFrame:
    """Rows gathered per table partition in even-sized tasks: small ones merge, a heavy date is split.  Rows ``gathered`` already stay where they are.

    ``sort_by`` orders the rows inside each file, which narrows the value range
    of every row group, so that an equality filter on it skips most of them.
    """
    if partition_by and not gathered:
        df = df.hint("rebalance", *partition_by)
    return df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df


def append(
    df: DataFrame, table: str, partition_by: Sequence[str] = (), format: str = "parquet", sort_by: Sequence[str] = (), gathered: bool = False
) -> None:
    """Rows added to the table, matched by name and aligned to its types."""
    spark = df.sparkSession
    ensure_table(spark, table, df.schema, partition_by, format)
    add_columns(spark, table, df.schema)
    aligned = align_schema(df, spark.table(table).schema)
    with left_in_place(spark, gathered):
        _laid_out(aligned, partition_by, sort_by, gathered).write.insertInto(table)


def overwrite(
    df: DataFrame, table: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), format: str = "parquet", gathered: bool = False
) -> None:
    """Table dropped and rebuilt from ``df``, schema included."""
    ensure_database(df.sparkSession, table)
    writer = _packed(_laid_out(df, partition_by, sort_by, gathered).write.format(format), format).mode("overwrite").option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with left_in_place(df.sparkSession, gathered):
        writer.saveAsTable(table)


def overwrite_partitions(
    df: DataFrame, table: str, partition_by: Sequence[str], sort_by: Sequence[str] = (), format: str = "parquet", gathered: bool = False
) -> None:
    """The partitions occurring in ``df`` replaced, all others kept.  The same write twice is the same as once."""
    spark = df.sparkSession
    ensure_table(spark, table, df.schema, partition_by, format)
    add_columns(spark, table, df.schema)
    aligned = align_schema(df, spark.table(table).schema)
    with _only_partitions_written(spark), left_in_place(spark, gathered):
        _laid_out(aligned, partition_by, sort_by, gathered).write.mode("overwrite").insertInto(table)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Partitioned, snappy-compressed parquet.  With dynamic partition overwrite only the dates in ``df`` are replaced."""
    writer = _laid_out(df, partition_by).write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def publish(
    df: DataFrame, table: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), keep: int = 1, gathered: bool = False
) -> str:
    """Full refresh that readers see all at once or not at all.

    ``df`` is written to a table of its own, then the view ``table`` is pointed
    at it.  ``df`` may read the version it replaces.  The ``keep`` versions
    before it stay, so that running queries can finish.
    """
    spark = df.sparkSession
    ensure_database(spark, table)
    database, name = table.rsplit(".", 1) if "." in table else ("default", table)
    version = f"{name}__{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S%f}_{uuid.uuid4().hex[:6]}"
    overwrite(df, f"{database}.{version}", partition_by, sort_by, gathered=gathered)
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {database}.{version}")
    versions = sorted(t.name for t in spark.catalog.listTables(database, f"{name}__*") if not t.isTemporary)
    for old in versions[: -(keep + 1)]:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{old}")
    return f"{database}.{version}"


def read_since(df: DataFrame, column: str, watermark: dt.date | None) -> DataFrame:
    """Rows dated strictly after the watermark (all rows without one).  Prunes partitions of a dated table."""
    if watermark is None:
        return df
    dated = F.col(column) if isinstance(df.schema[column].dataType, T.DateType) else F.col(column).try_cast("date")
    return df.filter(dated > F.lit(watermark))
