"""Running moving averages over a stream, in two forms.

``keyed_ema`` keeps a series' last time and average in Spark's state store, so a micro-batch writes the state of the
series it touches and no other; a series' rows of one micro-batch are one task's work.  ``running_ema`` spreads a heavy series over tasks and rewrites all of its state.

``running_ema``: the state is a table with one row per series: its last time and average.  Every
micro-batch reads the state its predecessor wrote and writes its own, both
under the batch number, so a repeated batch overwrites its own results and the
outcome is the same.  The averages themselves come from the batch operator with
that state as the opening value; a heavy series is spread over tasks there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.ema import DEFAULT_SPAN_DAYS, ema_closing, ema_column, ema_series


def keyed_ema(
    stream: DataFrame,
    period: int = 7,
    group_col: str = "ISIN",
    target_col: str = "business_date",
    value_col: str = "closing_price",
    row_id: str = "hash_key",
) -> DataFrame:
    """A stream of ``(row_id, group, target, value, ema_<period>, late)``, to be written in append mode.

    A micro-batch's rows of a series are taken in time order, equal times by ``row_id``.  A row that is not later than what its series had before the
    micro-batch, or has no time, cannot be worked in by going forward: it is ``late`` and has no average.  Rows without a group have none either.
    A null or NaN value leaves the average as it was.
    """
    alpha, average = 2.0 / (period + 1.0), ema_column(period)
    rows = stream.select(row_id, group_col, target_col, F.col(value_col).cast("double").alias(value_col))
    kinds = {f.name: f.dataType for f in rows.schema}
    result = T.StructType([*rows.schema.fields, T.StructField(average, T.DoubleType()), T.StructField("late", T.BooleanType())])
    state_type = T.StructType([T.StructField("at", kinds[target_col]), T.StructField("average", T.DoubleType())])

    def step(key, frames, state):
        own = pd.concat(list(frames), ignore_index=True).sort_values([target_col, row_id], kind="stable")
        at, known = state.get if state.exists else (None, None)
        late = own[target_col].isna()
        if at is not None:
            late |= own[target_col] <= (pd.Timestamp(at) if own[target_col].dtype.kind == "M" else at)
        own["late"], own[average] = late, np.nan
        on_time = own[~late]
        if len(on_time) and not pd.isna(key[0]):
            values = np.concatenate([[np.nan if known is None else known], on_time[value_col].to_numpy(float)])
            averages = pd.Series(values).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]
            own.loc[~late, average] = averages
            last = on_time[target_col].iloc[-1]
            state.update((last.to_pydatetime() if isinstance(last, pd.Timestamp) else last, None if np.isnan(averages[-1]) else float(averages[-1])))
        yield own[[row_id, group_col, target_col, value_col, average, "late"]]

    return rows.groupBy(group_col).applyInPandasWithState(step, result, state_type, "append", GroupStateTimeout.NoTimeout)


def running_ema(
    stream: DataFrame,
    folder: str,
    period: int = 7,
    group_col: str = "ISIN",
    target_col: str = "business_date",
    value_col: str = "closing_price",
    row_id: str = "hash_key",
    span_days: int = DEFAULT_SPAN_DAYS,
) -> StreamingQuery:
    """Starts the query.  ``folder`` gets ``averages``, ``state``, ``late`` and the checkpoint.

    A row that is not later than its series' last row cannot be worked in by
    going forward; it goes to ``late`` for a batch refresh.
    """
    average = ema_column(period)
    names = dict(period=period, group_col=group_col, target_col=target_col, value_col=value_col, row_id=row_id,
                 span_days=span_days)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(row_id, group_col, target_col, value_col)
        held = spark.createDataFrame([], _state_schema(rows))
        if batch_id > 0:
            held = spark.read.schema(held.schema).parquet(f"{folder}/state/batch_id={batch_id - 1}")
        placed = rows.join(held.select(group_col, "_last_at"), group_col, "left")
        is_late = F.coalesce(F.col(target_col) <= F.col("_last_at"), F.lit(False))
        on_time = placed.filter(~is_late).drop("_last_at")
        opening = held.select(group_col, "_average")

        averages = ema_series(on_time, opening=opening, **names)
        averages.write.mode("overwrite").parquet(f"{folder}/averages/batch_id={batch_id}")
        if batch_id > 0:
            late = placed.filter(is_late).drop("_last_at")
            late.write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")

        closing = ema_closing(on_time, opening=opening, **names)
        moved = on_time.filter(F.col(group_col).isNotNull()).groupBy(group_col).agg(
            F.max(target_col).alias("_new_at")
        ).join(closing, group_col)
        state = held.join(moved, group_col, "full_outer").select(
            group_col,
            F.coalesce("_new_at", "_last_at").alias("_last_at"),
            F.coalesce(average, "_average").alias("_average"),
        )
        state.write.mode("overwrite").parquet(f"{folder}/state/batch_id={batch_id}")

    def _state_schema(rows: DataFrame) -> str:
        kinds = dict(rows.dtypes)
        return f"`{group_col}` {kinds[group_col]}, _last_at {kinds[target_col]}, _average double"

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
