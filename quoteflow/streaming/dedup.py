"""Streaming deduplication by row hash."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..audit import counted, measured
from ..operators.dedup import keep_first
from ..operators.merge import new_rows, within_dates
from ..session import shared_dir
from ..sources.tables import overwrite_partitions, read_table, table_exists


def dedup_stream(
    stream: DataFrame, keys: Sequence[str] = ("hash_key",), event_time: str = "business_ts", delay: str = "7 days"
) -> DataFrame:
    """One row per key, where copies arrive within ``delay`` of each other.

    State is kept per key only that long.  A row more than ``delay`` behind the newest one is dropped whether or not its
    key was seen: choose the delay no shorter than rows may be late, or take ``dedup_into``.  The event time is made a zoned
    timestamp, which watermarks need.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def dedup_into(stream: DataFrame, folder: str, keys: Sequence[str], day: str) -> StreamingQuery:
    """Starts a query that adds the rows of unseen keys to ``folder``/rows, however late they come.

    ``day`` is the date column among the keys: a micro-batch meets only the stored rows of the days it spans, so no
    state is held and none has to expire.  Every batch writes under its own number and looks at
    those before it; a repeated batch overwrites its own results.  Of copies in one batch any one stays.
    """
    stored = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(list(keys))
        if batch_id > 0:
            held = batch.sparkSession.read.schema(stored).parquet(f"{folder}/rows").filter(F.col("batch_id") < batch_id)
            first, last, undated = batch.agg(F.min(day), F.max(day), F.count_if(F.col(day).isNull())).first()
            rows = new_rows(rows, held if undated else within_dates(held, day, first, last), keys)
        rows.sortWithinPartitions(day).write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def dedup_within(stream: DataFrame, table: str, keys: Sequence[str], event_time: str, delay_days: int = 7) -> StreamingQuery:
    """Starts a query that keeps one row per key among rows at most ``delay_days`` apart, and loses none.  (As Spark's own watermarks do, it may
    take rows somewhat farther apart for repeats: the watermark is that of the batches before.)

    The watermark of a micro-batch is the latest event time of those before it, less the delay.  Rows behind it go to ``<table>_late``
    with the reason ``late``, rows without an event time with ``undated``; neither meets the kept rows.  Of the others, the earliest of a key stays
    unless a row of it kept before lies at or after the watermark.  So a batch reads the kept rows of the days since its watermark, however
    long the query has run, and no state is held.

    ``<table>`` is partitioned by ``_day`` and ``_batch``, the others by ``_batch``: a repeated batch overwrites its own results.
    ``<table>_counts`` has a row per batch: ``rows = kept + repeats + late + undated``, and the latest event time ``high``.
    """
    late_table, counts = f"{table}_late", f"{table}_counts"

    def high_before(spark, batch_id: int) -> dt.datetime | None:
        if not batch_id or not table_exists(spark, counts):
            return None
        row = read_table(spark, counts).filter(F.col("_batch") == batch_id - 1).select("high").first()
        return row["high"] if row else None

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        high, at = high_before(spark, batch_id), F.col(event_time).cast("timestamp")
        watermark = None if high is None else high - dt.timedelta(days=delay_days)
        behind = F.lit(False) if watermark is None else at < F.lit(watermark)
        rows = batch.withColumn("_fate", F.when(at.isNull(), "undated").when(behind, "late").otherwise("on time")).persist()
        try:
            total, late, undated, newest = rows.agg(
                F.count("*"), F.count_if(F.col("_fate") == "late"), F.count_if(F.col("_fate") == "undated"), F.max(at)
            ).first()
            others = [F.col(c) for c in batch.columns if c not in keys and c != event_time]
            fresh = keep_first(rows.filter(F.col("_fate") == "on time").drop("_fate"), list(keys), [F.col(event_time), *others])
            if watermark is not None and table_exists(spark, table):
                day = watermark.date() if watermark.tzinfo is None else watermark.astimezone(dt.timezone.utc).date()
                # a day more than needed, whatever the session's time zone; the event time decides
                held = read_table(spark, table).filter(
                    (F.col("_day") >= F.lit(day - dt.timedelta(days=1))) & (F.col("_batch") < batch_id) & (at >= F.lit(watermark))
                )
                fresh = new_rows(fresh, held, keys)
            placed = fresh.withColumns({"_day": at.cast("date"), "_batch": F.lit(batch_id).cast("long")})
            placed, written = counted(placed, f"kept_{batch_id}")
            overwrite_partitions(placed, table, ["_day", "_batch"])
            aside = rows.filter(F.col("_fate") != "on time").withColumnRenamed("_fate", "reason")
            overwrite_partitions(aside.withColumn("_batch", F.lit(batch_id).cast("long")), late_table, ["_batch"])
            kept = measured(written)["rows"]
            newest = max((t for t in (high, newest) if t is not None), default=None)
            row = [(total, kept, total - kept - late - undated, late, undated, newest, batch_id)]
            done = spark.createDataFrame(row, "rows bigint, kept bigint, repeats bigint, late bigint, undated bigint, high timestamp, _batch bigint")
            overwrite_partitions(done, counts, ["_batch"])
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", _checkpoint(stream, table)).trigger(availableNow=True).start()


def _checkpoint(stream: DataFrame, table: str) -> str:
    return f"{shared_dir(stream.sparkSession)}/checkpoints/{table}"
