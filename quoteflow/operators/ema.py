"""Exponential moving averages of long, unevenly sized series.

    e(0) = x(0),   e(t) = alpha * x(t) + (1 - alpha) * e(t-1),   alpha = 2 / (period + 1)

A null or NaN value leaves the average as it was.  The recurrence has no built-in
equivalent, so sorted partitions are folded in Arrow batches, all series of a stretch of
rows side by side: step t takes the t-th value of every series at once.  The few
that are much longer than the others go through pandas' compiled recursion.  Each value meets the same
multiplications and additions as in the definition, in the same order, so the averages are the same to the last bit
(for alphas that are no binary fractions, a long series may differ in the last digit).  No series is ever held in memory.

A series is cut into calendar blocks (``span_days`` each), so that one long or
heavy series is spread over many tasks.  The blocks are linked exactly: a block
of n values that starts and ends at ``first`` and ``last`` when it is folded on
its own ends at ``last + (1-alpha)^n * (c - first)`` when the average before it
was ``c``.  These maps are put together in the order of a series' blocks, and the
main pass starts each block from the right value.  The three figures of a block
can be stored: see ``plans.late``.  With one row per security and day a block holds at most ``span_days`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import row_hash
from ..schema import require_columns
from .deal import SHARE, counts_of, dealt, restored, shed

DEFAULT_SPAN_DAYS = 8192


def ema_column(period: int) -> str:
    return f"ema_{period}"


def block_of(target: Column, span_days: int) -> Column:
    """The calendar block of a date; rows without one come first, as in an ascending sort."""
    return F.coalesce(F.floor(F.unix_date(target.cast("date")) / span_days).cast("int"), F.lit(-(2**31)))


def _in_tasks(tasks: int | None):
    return lambda rows: rows.repartition(*([tasks] if tasks else []), "_key", "_block")


def _rows(df, group_col, target_col, value_col, row_id, span_days, made_of: Sequence[str] = (), deal=_in_tasks(None)) -> DataFrame:
    """The needed columns, hash-distributed by (series, block), or as ``deal`` does.  A row id that is the hash of ``made_of`` is made again where the row lies."""
    block = block_of(F.col(target_col), span_days)
    # rows without a series are not scanned; they are dealt out evenly
    block = F.when(F.col(group_col).isNotNull(), block).otherwise(F.pmod(F.xxhash64(row_id), F.lit(4096)).cast("int"))
    named = {group_col: "_key", target_col: "_at"}
    rows = df.select(
        F.col(row_id).alias("_id"),
        F.col(group_col).alias("_key"),
        F.col(target_col).alias("_at"),
        F.col(value_col).cast("double").alias("_x"),
        block.alias("_block"),
        *[c for c in made_of if c not in named],
    )
    derived = {"_id": row_hash([named.get(c, c) for c in made_of])} if made_of else {}
    return restored(deal(shed(rows, derived)), derived)


_TIME_ORDER = ("_key", "_block", "_at", "_id")


#: Rows folded side by side, and the length beyond which a series is folded on its own.
_STRETCH, _LONG = 1 << 16, 1024


def _folder(alpha: float):
    """The fold of several segments of rows at once, as a closure that travels with the job.

    ``fold(x, starts, opening)`` takes values (NaN: none), where each segment begins and the average before it (NaN: none),
    and gives the average at every row.
    """
    keep, long, stretch = 1.0 - alpha, _LONG, _STRETCH

    def alone(x: np.ndarray, opening: float) -> np.ndarray:
        known = np.concatenate([[opening], x])
        return pd.Series(known).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]

    def fold(x: np.ndarray, starts: np.ndarray, opening: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.append(starts, len(x)))
        out = np.empty(len(x))
        for k in np.flatnonzero(sizes > long):
            rows = slice(starts[k], starts[k] + sizes[k])
            out[rows] = alone(x[rows], opening[k])
        order = np.flatnonzero(sizes <= long)
        order = order[np.argsort(-sizes[order], kind="stable")]
        begin, average = starts[order], opening[order]
        # how many segments have a t-th row
        reach = np.searchsorted(-sizes[order], -np.arange(sizes[order].max(initial=0)), side="left")
        gaps = np.isnan(x).any()
        for step, active in enumerate(reach.tolist()):
            at = begin[:active] + step
            value, before = x[at], average[:active]
            now = alpha * value + keep * before
            if gaps or not step:
                # no value: as before; nothing before: the value
                now = np.where(np.isnan(value), before, np.where(np.isnan(before), value, now))
            average[:active] = out[at] = now
        return out

    def changes(column: pa.Array, last) -> np.ndarray:
        """Rows whose value differs from the row before; ``last`` is the row before the first (null equals null)."""
        both = pa.concat_arrays([last, column]) if last is not None else column
        differ = pc.fill_null(pc.not_equal(both[1:], both[:-1]), False).to_numpy(zero_copy_only=False)
        gone = both.is_null().to_numpy(zero_copy_only=False)
        out = differ | (gone[1:] != gone[:-1])
        return out if last is not None else np.concatenate([[True], out])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= stretch:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def numbers(column: pa.Array) -> np.ndarray:
        return pc.fill_null(column, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]):
        """Stretches of sorted rows with their values, segment starts, whether the first goes on from the stretch before, and averages."""
        key = block = None
        carry = float("nan")
        for batch in stretches(batches):
            keys, blocks = batch.column("_key"), batch.column("_block")
            fresh = changes(keys, key) | changes(blocks, block)
            x = np.where(keys.is_null().to_numpy(zero_copy_only=False), np.nan, numbers(batch.column("_x")))
            goes_on = not fresh[0]
            fresh[0] = True
            starts = np.flatnonzero(fresh)
            opening = numbers(batch.column("_before"))[starts] if "_before" in batch.schema.names else np.full(len(starts), np.nan)
            if goes_on:
                opening[0] = carry
            averages = fold(x, starts, opening)
            yield batch, x, starts, goes_on, averages
            carry, key, block = averages[-1], keys[-1:], blocks[-1:]

    def or_null(values: np.ndarray) -> pa.Array:
        return pa.array(values, pa.float64(), mask=np.isnan(values))

    return run, or_null


def _summarise(alpha: float):
    """Per block: number of values, first value, and where a fold of its own ends.  A block that goes on over several stretches is held until it ends."""
    run_over, or_null = _folder(alpha)

    def record(keys, blocks, counts, first, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, blocks, pa.array(counts), or_null(first), or_null(last)], names=["_key", "_block", "_n", "_first", "_last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch, x, starts, goes_on, averages in run_over(batches):
            value = ~np.isnan(x)
            counts = np.add.reduceat(value.astype(np.int64), starts)
            ends = np.append(starts[1:], len(x)) - 1
            # the first value of a segment, or any row of one that has none
            place = np.minimum.reduceat(np.where(value, np.arange(len(x)), len(x)), starts)
            first = np.where(counts > 0, x[np.minimum(place, len(x) - 1)], np.nan)
            if goes_on:
                first[0] = held[3][0] if held[2][0] else first[0]
                counts[0] += held[2][0]
            elif held is not None:
                yield record(*held)
            columns = (batch.column("_key").take(pa.array(starts)), batch.column("_block").take(pa.array(starts)), counts, first, averages[ends])
            yield record(*[c[:-1] for c in columns])
            held = [c[-1:] for c in columns]
        if held is not None:
            yield record(*held)

    return run


def _scan(alpha: float, names: Sequence[str]):
    """Average at every row, each block starting from the average before it, beside the columns ``names``."""
    run_over, or_null = _folder(alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, _, averages in run_over(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [or_null(averages)],
                names=[*names, "_ema"],
            )

    return run


def linked(blocks: DataFrame, alpha: float) -> DataFrame:
    """``_key, _block, _before, _after`` from ``_key, _block, _n, _first, _last, _opening``: the average before and after each block.

    A series' blocks are few (one per calendar span), so they are put together as one array, in order.
    """
    keep = 1.0 - alpha

    def after(carry: Column, b: Column) -> Column:
        moved = b["_last"] + F.pow(F.lit(keep), b["_n"]) * (carry - b["_first"])
        return F.when(b["_n"] == 0, carry).when(carry.isNull(), b["_last"]).otherwise(moved)

    def step(state: Column, b: Column) -> Column:
        now = after(state["carry"], b)
        done = F.struct(b["_block"].alias("_block"), state["carry"].alias("_before"), now.alias("_after"))
        return F.struct(now.alias("carry"), F.concat(state["done"], F.array(done)).alias("done"))

    kind = dict(blocks.dtypes)["_block"]
    empty = F.array().cast(f"array<struct<_block:{kind},_before:double,_after:double>>")
    series = blocks.groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_n", "_first", "_last"))).alias("_blocks"), F.max("_opening").alias("_opening")
    )
    start = F.struct(F.col("_opening").alias("carry"), empty.alias("done"))
    return series.select("_key", F.inline(F.aggregate("_blocks", start, step, lambda state: state["done"])))


def _fields(df: DataFrame, *names: str, **extra: T.DataType) -> T.StructType:
    known = {f.name: f.dataType for f in df.schema}
    return T.StructType(
        [T.StructField(n, known[n]) for n in names] + [T.StructField(n, t) for n, t in extra.items()]
    )


def _summaries(rows: DataFrame, alpha: float) -> DataFrame:
    """``_key, _block, _n, _first, _last`` of each block, whose rows lie in one task: a row per block, small beside the input."""
    kind = _fields(rows, "_key", "_block", _n=T.LongType(), _first=T.DoubleType(), _last=T.DoubleType())
    return rows.sortWithinPartitions(*_TIME_ORDER).mapInArrow(_summarise(alpha), kind)


def _linked_blocks(rows: DataFrame, alpha: float, opening: DataFrame | None) -> DataFrame:
    """``_key, _block, _before, _after`` of each block."""
    summary = _summaries(rows, alpha)
    if opening is None:
        summary = summary.withColumn("_opening", F.lit(None).cast("double"))
    else:
        summary = summary.join(opening.toDF("_key", "_opening"), "_key", "left")
    return linked(summary, alpha)


def _before_blocks(df, alpha, group_col, target_col, value_col, row_id, span_days) -> DataFrame:
    """``_key, _block, _before`` of each block of each series.

    Nothing follows the last block of the calendar, so its rows are not summarised: only that a series has it is looked at.
    """
    known = df.filter(F.col(group_col).isNotNull())
    block = block_of(F.col(target_col), span_days)
    last = known.agg(F.max(block)).scalar()
    summary = _summaries(_rows(known.filter(block < last), group_col, target_col, value_col, row_id, span_days), alpha)
    ends = known.filter(block == last).select(F.col(group_col).alias("_key"), block.alias("_block")).distinct()
    none = F.lit(None).cast("double")
    blocks = summary.unionByName(ends.select("_key", "_block", F.lit(0).cast("long").alias("_n"), none.alias("_first"), none.alias("_last")))
    return linked(blocks.withColumn("_opening", none), alpha).drop("_after")


def _checked(df: DataFrame, row_id: str, value_col: str) -> DataFrame:
    return require_columns(df, [row_id, value_col], "the moving average")


def ema_series(
    df: DataFrame,
    period: int = 7,
    group_col: str = "ISIN",
    target_col: str = "business_date",
    value_col: str = "closing_price",
    row_id: str = "hash_key",
    span_days: int = DEFAULT_SPAN_DAYS,
    opening: DataFrame | None = None,
    made_of: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Average as of every row: ``(row_id, group, target, value, ema_<period>)``, and further columns of ``made_of``.

    Rows with equal time are taken in ``row_id`` order.  A row without a group
    belongs to no series and gets null.  ``opening`` (group, average) continues
    series whose earlier rows are not part of ``df``.  ``made_of`` are columns that ``row_id`` is the ``row_hash`` of: they move in its place.
    ``tasks`` to sort in, where the number of rows is known; short rows take few bytes, by which Spark would make them few.
    """
    _checked(df, row_id, value_col)
    alpha, deal = 2.0 / (period + 1.0), _in_tasks(tasks)
    rows = _rows(df, group_col, target_col, value_col, row_id, span_days, made_of, deal)
    before = deal(_linked_blocks(rows, alpha, opening).drop("_after"))
    further = [c for c in made_of if c not in (group_col, target_col)]
    scanned = _scanned(rows, before, alpha, further=further)
    return scanned.toDF(row_id, group_col, target_col, value_col, *further, ema_column(period))


def _scanned(rows: DataFrame, before: DataFrame, alpha: float, how: str = "left", further: Sequence[str] = ()) -> DataFrame:
    """``_id, _key, _at, _x``, columns ``further`` and ``_ema`` of rows whose blocks start from ``before`` (``_key, _block, _before``)."""
    names = ["_id", "_key", "_at", "_x", *further]
    ordered = rows.join(before, ["_key", "_block"], how).sortWithinPartitions(*_TIME_ORDER)
    return ordered.mapInArrow(_scan(alpha, names), _fields(rows, *names, _ema=T.DoubleType()))


def ema_block_summaries(
    df: DataFrame,
    period: int = 7,
    group_col: str = "ISIN",
    target_col: str = "business_date",
    value_col: str = "closing_price",
    row_id: str = "hash_key",
    span_days: int = DEFAULT_SPAN_DAYS,
    made_of: Sequence[str] = (),
    gathered: bool = False,
) -> DataFrame:
    """What a block does to an average that reaches it: ``(group, block, n, first, last)``, a row per series and calendar block.

    The average ``c`` before the block becomes ``last + (1-alpha)^n (c - first)``, or ``last`` if there was none.  Summaries can be stored, and a block that
    gets another row is summarised again without the others.  Rows without a group have none.  Those of a calendar block come out ``gathered`` if wanted, as a
    table by block holds them; ``made_of`` as in ``ema_series``.
    """
    _checked(df, row_id, value_col)
    known, deal = df.filter(F.col(group_col).isNotNull()), _in_tasks(None)
    if gathered:
        key = F.col(group_col)
        counts = counts_of(known.select(key, block_of(F.col(target_col), span_days).alias("_block")), "_block", key)

        def deal(rows: DataFrame) -> DataFrame:
            return dealt(rows, "_block", F.col("_key"), counts).drop(SHARE)

    rows = _rows(known, group_col, target_col, value_col, row_id, span_days, made_of, deal)
    return _summaries(rows, 2.0 / (period + 1.0)).toDF(group_col, "block", "n", "first", "last")


def ema_linked_blocks(summaries: DataFrame, period: int = 7, group_col: str = "ISIN") -> DataFrame:
    """``(group, block, before, after)`` from summaries: the average before and after each block of a series."""
    named = summaries.select(group_col, "block", "n", "first", "last").toDF("_key", "_block", "_n", "_first", "_last")
    out = linked(named.withColumn("_opening", F.lit(None).cast("double")), 2.0 / (period + 1.0))
    return out.toDF(group_col, "block", "before", "after")


def ema_in_blocks(
    df: DataFrame,
    before: DataFrame,
    period: int = 7,
    group_col: str = "ISIN",
    target_col: str = "business_date",
    value_col: str = "closing_price",
    row_id: str = "hash_key",
    span_days: int = DEFAULT_SPAN_DAYS,
) -> DataFrame:
    """As ``ema_series``, but only for the blocks in ``before`` (``group, block, before``), each from the average stated there.

    ``df`` holds all rows of those blocks; it may hold others, which are left out.
    """
    _checked(df, row_id, value_col)
    rows = _rows(df, group_col, target_col, value_col, row_id, span_days)
    starts = before.select(group_col, "block", "before").toDF("_key", "_block", "_before")
    return _scanned(rows, starts, 2.0 / (period + 1.0), "inner").toDF(row_id, group_col, target_col, value_col, ema_column(period))


def with_ema_of_blocks(
    df: DataFrame,
    before: DataFrame,
    period: int = 7,
    group_col: str = "ISIN",
    target_col: str = "business_date",
    value_col: str = "closing_price",
    row_id: str = "hash_key",
    span_days: int = DEFAULT_SPAN_DAYS,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows with their ``ema_<period>``, made anew in the blocks of ``before`` (``group, block, before``) as ``ema_in_blocks`` does, and a column ``again`` that says where.

    ``df`` holds all rows of those blocks.  Whole rows move once, without what is ``derived`` from other columns: by calendar block and share of their
    series, as they come out; what lies in other blocks keeps its average.  To be written under ``left_in_place``.
    """
    _checked(df, row_id, value_col)
    average, key, derived = ema_column(period), F.col(group_col), derived or {}
    placed = df.withColumn("_block", block_of(F.col(target_col), span_days))
    counts = counts_of(placed, "_block", key)
    rows = restored(dealt(shed(placed, derived), "_block", key, counts), derived)
    starts = before.select(group_col, F.col("block").alias("_block"), F.col("before").alias("_before"), F.lit(True).alias("again"))
    met = rows.join(dealt(starts, "_block", key, counts).hint("shuffle_hash"), ["_block", SHARE, group_col], "left")
    ordered = met.drop(SHARE).withColumns({"_key": key, "_x": F.col(value_col).cast("double")}).sortWithinPartitions("_key", "_block", target_col, row_id)
    names = [*df.columns, "again"]
    folded = ordered.mapInArrow(_scan(2.0 / (period + 1.0), names), _fields(ordered, *names, _ema=T.DoubleType()))
    now = F.when(F.col("again"), F.col("_ema")).otherwise(F.col(average))
    return folded.select(*[now.alias(c) if c == average else c for c in df.columns], F.coalesce("again", F.lit(False)).alias("again"))


def with_ema(
    df: DataFrame,
    period: int = 7,
    group_col: str = "ISIN",
    target_col: str = "business_date",
    value_col: str = "closing_price",
    row_id: str = "hash_key",
    span_days: int = DEFAULT_SPAN_DAYS,
    beside: DataFrame | None = None,
    **added: Column,
) -> DataFrame:
    """All columns of ``df``, those ``added``, and ``ema_<period>`` as of every row.

    The whole rows move once, by series and block, and are folded where they lie: no average has to find its row again by ``row_id``.
    ``beside``, a row per series (its first column is the group), meets the rows in the same join; ``added`` columns may use it.
    """
    _checked(df, row_id, value_col)
    alpha, average = 2.0 / (period + 1.0), ema_column(period)
    before = _before_blocks(df, alpha, group_col, target_col, value_col, row_id, span_days)
    if beside is not None:
        before = before.join(beside.withColumnRenamed(beside.columns[0], "_key"), "_key", "left")
    names = [c for c in df.columns if c != average]
    block = F.when(F.col(group_col).isNotNull(), block_of(F.col(target_col), span_days)).otherwise(F.pmod(F.xxhash64(row_id), F.lit(4096)).cast("int"))
    rows = df.select(*names, block.alias("_at_block")).repartition(group_col, "_at_block")
    run_over, or_null = _folder(alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, _, averages in run_over(batches):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [or_null(averages)], names=[*names, average])

    met = rows.join(before, (F.col(group_col) == F.col("_key")) & (F.col("_at_block") == F.col("_block")), "left").withColumns(added)
    names += list(added)
    ordered = met.select(*names, "_at_block", "_before").sortWithinPartitions(group_col, "_at_block", target_col, row_id)
    # what the fold looks at is named after the shuffle and the sort, which carry no column twice
    folded = {"_key": F.col(group_col), "_block": F.col("_at_block"), "_x": F.col(value_col).cast("double")}
    narrow = ordered.select(*names, *[c.alias(n) for n, c in folded.items()], "_before")
    return narrow.mapInArrow(run, _fields(narrow, *names, **{average: T.DoubleType()}))


def ema_resumed(
    df: DataFrame, period: int = 7, group_col: str = "ISIN", target_col: str = "business_date", value_col: str = "closing_price", row_id: str = "hash_key",
) -> DataFrame:
    """All columns of ``df`` and ``ema_<period>`` of rows that lie by series already, each series' in one task; no row moves.

    Of a series, rows marked ``_again`` are folded from the average ``_opening`` it says; the others are passed, with an average of no meaning.
    """
    _checked(df, row_id, value_col)
    folded = df.withColumns({
        "_key": F.col(group_col), "_block": F.col("_again").cast("int"), "_x": F.col(value_col).cast("double"), "_before": F.when(F.col("_again"), F.col("_opening"))
    })
    ordered = folded.sortWithinPartitions("_key", "_block", target_col, row_id)
    out = ordered.mapInArrow(_scan(2.0 / (period + 1.0), df.columns), _fields(ordered, *df.columns, _ema=T.DoubleType()))
    return out.withColumnRenamed("_ema", ema_column(period))


def ema_closing(
    df: DataFrame,
    period: int = 7,
    group_col: str = "ISIN",
    target_col: str = "business_date",
    value_col: str = "closing_price",
    row_id: str = "hash_key",
    span_days: int = DEFAULT_SPAN_DAYS,
    opening: DataFrame | None = None,
    made_of: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Average after the last row of each series: ``(group, ema_<period>)``; ``made_of`` and ``tasks`` as in ``ema_series``."""
    _checked(df, row_id, value_col)
    alpha = 2.0 / (period + 1.0)
    rows = _rows(df, group_col, target_col, value_col, row_id, span_days, made_of, _in_tasks(tasks))
    return (
        _linked_blocks(rows, alpha, opening)
        .filter(F.col("_key").isNotNull())
        .groupBy(F.col("_key").alias(group_col))
        .agg(F.max_by("_after", "_block").alias(ema_column(period)))
    )


def ema_final(
    df: DataFrame,
    period: int = 7,
    group_col: str = "ISIN",
    target_col: str = "business_date",
    value_col: str = "closing_price",
    row_id: str = "hash_key",
    span_days: int = DEFAULT_SPAN_DAYS,
    made_of: Sequence[str] = (),
) -> DataFrame:
    """Every row with the *last* average of its series (same columns as ``ema_series``)."""
    last = ema_closing(df, period, group_col, target_col, value_col, row_id, span_days)
    further = [c for c in made_of if c not in (group_col, target_col)]
    kept = [row_id, group_col, target_col, F.col(value_col).cast("double").alias(value_col), *further]
    return df.select(*kept).join(last, group_col, "left").select(
        row_id, group_col, target_col, value_col, *further, ema_column(period)
    )


def ema_table(ema: DataFrame, row_id: str = "hash_key", made_of: Sequence[str] = ()) -> DataFrame:
    """Side table: row id and all averages, and the columns the id is made of where they are wanted."""
    return ema.select(row_id, *[c for c in ema.columns if c.startswith("ema_")], *made_of)
