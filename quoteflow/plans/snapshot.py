"""Index-snapshot API payloads -> clean snapshot table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SNAPSHOT_DROPS, SNAPSHOT_RENAMES
from ..sources.nested import flatten_records, read_payloads
from ..sources.tables import overwrite, read_table
from .bronze import with_governance_columns

PARTITION = "ingestion_date"


def snapshot_bronze(payloads: DataFrame, source_system: str, run_id: str | None = None,
                    file_name: str | None = None) -> DataFrame:
    """One flat row per record of the payload, with its origin and the load date."""
    flat = with_governance_columns(flatten_records(payloads), source_system, run_id, file_name)
    return flat.withColumn(PARTITION, F.to_date(F.current_timestamp()))


def snapshot_silver(bronze: DataFrame) -> DataFrame:
    """Clean names, unneeded columns dropped where present."""
    return (
        bronze.drop(*SNAPSHOT_DROPS)
        .withColumnsRenamed(SNAPSHOT_RENAMES)
        .withColumn("processed_timestamp", F.current_timestamp())
        .withColumn(PARTITION, F.to_date(PARTITION))
    )


def load_snapshot(
    spark: SparkSession, paths: str | Sequence[str], bronze: str, silver: str, source_system: str,
    run_id: str | None = None,
) -> None:
    """Saved payloads into the raw snapshot table and the clean one, a partition per load date."""
    raw = snapshot_bronze(read_payloads(spark, paths), source_system, run_id)
    overwrite(raw, bronze, [PARTITION])
    overwrite(snapshot_silver(read_table(spark, bronze)), silver, [PARTITION])
