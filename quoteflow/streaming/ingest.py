"""Landed archives into the raw table, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..control import get_watermark, put_watermark
from ..plans.bronze import load_listed
from ..sources.listing import ZIP_FILES, landed_files

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA).option("pathGlobFilter", ZIP_FILES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(landing)


def ingest_files(
    spark: SparkSession,
    landing: str,
    table: str,
    control: str,
    checkpoint: str,
    rejects: str | None = None,
    late_files: str = "drop",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Starts the load.  The checkpoint remembers which files were taken, and the
    keyed append makes a repeated batch harmless.

    ``late_files`` says what happens to a file dated at or before the watermark
    the query started from: ``drop`` it, as the batch load does, or ``reprocess`` it.  Either way it is logged in ``<table>_files``.
    """
    if late_files not in ("drop", "reprocess"):
        raise ValueError("late_files must be drop or reprocess")
    layer, name = table.split(".")
    start = get_watermark(spark, control, layer, name) if late_files == "drop" else None

    def load(batch: DataFrame, _: int) -> None:
        _, last = load_listed(landed_files(batch.select("path", "modificationTime")), table, rejects, start)
        put_watermark(batch.sparkSession, control, layer, name, last)

    # the handler reads the archives by path, so their contents are not read here as well
    names = arriving_files(spark, landing, files_per_batch).select("path", F.col("modificationTime"))
    return (
        names.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
