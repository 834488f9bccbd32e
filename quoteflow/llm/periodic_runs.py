"""Periodic runs of words, by block convolution at dyadic scales.

A run is a stretch of consecutive words whose smallest period is q, at least
``max(24, 3 q)`` words long, that no neighbouring word extends.  At scale L the
text is cut into blocks of L words, and each block is looked for in the words that
follow it, at distances L to 2 L (1 to 9 and 8 to 16 for blocks of eight): the
squared differences of block and window are summed for all distances at once, as
two sums of squares less twice a correlation, which an integer number-theoretic
transform gives exactly.  A sum of zero is an occurrence.  A run of period q in that
range is at least 2 L + q - 1 words long, so it holds a whole block together with
the block's copy q words on: every run has a seed, at a distance that is its period.
Seeds are extended both ways, word by word, to the longest stretch that keeps the distance.

* Words are numbered exactly (equal numbers, equal words).  For the transform they are dealt into so few values
  that no sum reaches the modulus, so a sum is zero if and only if all dealt values agree; words that share a
  value are told apart when a seed is checked word by word.
* A stretch found at a multiple of its smallest period is the same stretch (it is three periods long, so the
  smaller period divides the larger), and is found at the smallest one as well: the smallest distance of a stretch is its period.
* A text is one task's work, in time n log^2 n of its words; texts are whole, and a long one is worked on alone.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, REPEATS = 24, 3
#: Primes with a power of two dividing p - 1, and a generator.  The small one needs no division; the large one serves blocks beyond 2^14 words.
SMALL_PRIME, LARGE_PRIME = (65537, 3), (2013265921, 31)
#: Bytes of text worked on at once, and numbers transformed at once.
TEXT_BYTES, CELLS = 1 << 21, 1 << 15

SCHEMA = "key {kind}, words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


# --- number-theoretic transform ---


def _reduce(x: np.ndarray, prime: int) -> np.ndarray:
    """Congruent numbers; for 65537, where 2^16 is -1, small ones of either sign."""
    return (x & 0xFFFF) - (x >> 16) if prime == SMALL_PRIME[0] else x % prime


@functools.lru_cache(maxsize=64)
def _twiddles(half: int, prime: int, generator: int, inverse: bool) -> np.ndarray:
    root = pow(generator, (prime - 1) // (2 * half), prime)
    root = pow(root, -1, prime) if inverse else root
    powers = np.ones(half, np.int64)
    size = 1
    while size < half:
        step = pow(root, size, prime)
        powers[size : 2 * size] = powers[:size] * step % prime
        size *= 2
    return powers[None, :, None]


def _forward(x: np.ndarray, field: tuple[int, int]) -> np.ndarray:
    """Transforms the columns; rows of the result are in bit-reversed order."""
    n, columns = x.shape
    half = n // 2
    while half:
        y = x.reshape(n // (2 * half), 2, half, columns)
        low, high = y[:, 0], y[:, 1]
        x = np.stack([_small(low + high, field[0]), _reduce((low - high) * _twiddles(half, *field, False), field[0])], axis=1).reshape(n, columns)
        half //= 2
    return x


def _inverse(x: np.ndarray, field: tuple[int, int]) -> np.ndarray:
    """Undoes ``_forward`` from bit-reversed rows; the result lies in [0, prime)."""
    n, columns = x.shape
    half = 1
    while half < n:
        y = x.reshape(n // (2 * half), 2, half, columns)
        low, high = y[:, 0], _reduce(y[:, 1] * _twiddles(half, *field, True), field[0])
        x = np.stack([_small(low + high, field[0]), _small(low - high, field[0])], axis=1).reshape(n, columns)
        half *= 2
    return x % field[0] * pow(n, -1, field[0]) % field[0]


def _small(x: np.ndarray, prime: int) -> np.ndarray:
    # sums of the small prime double at most 17 times from under 2^17, and stay far below 2^63 in products with 2^16
    return x if prime == SMALL_PRIME[0] else x % prime


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """``L x m`` blocks and ``2 L x m`` windows to ``L + 1 x m``: row s holds the sums of (block[i] - window[s + i])^2.

    Exact while L times the greatest value squared is below the modulus.
    """
    size = len(blocks)
    field = SMALL_PRIME if size <= 1 << 14 else LARGE_PRIME
    turned = np.zeros_like(windows)
    turned[0], turned[size + 1 :] = blocks[0], blocks[:0:-1]
    product = _reduce(_reduce(_forward(turned, field), field[0]) * _reduce(_forward(windows, field), field[0]), field[0])
    correlation = _inverse(product, field)[: size + 1]
    squares = np.zeros((2 * size + 1, windows.shape[1]), np.int64)
    np.cumsum(windows * windows, axis=0, out=squares[1:])
    return (blocks * blocks).sum(axis=0) + (squares[size:] - squares[: size + 1]) - 2 * correlation


def _deal(codes: np.ndarray, size: int) -> np.ndarray:
    """Word numbers as so few values that ``size`` squares of them stay below the modulus."""
    prime = SMALL_PRIME[0] if size <= 1 << 14 else LARGE_PRIME[0]
    values = max(2, math.isqrt((prime - 1) // size))
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(values)).astype(np.int64)


# --- seeds and their extension ---


def _seeds(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of ``size`` words begin, and the distances ``first`` to ``first + size`` at which they occur again within their text."""
    blocks = np.arange(len(codes) // size) * size
    owner = np.searchsorted(starts, blocks, side="right") - 1
    long = ends[owner] - starts[owner] >= max(LEAST, REPEATS * first)
    picked = long & (blocks + first + size <= ends[owner])
    blocks, end = blocks[picked], ends[owner[picked]]
    dealt = np.concatenate([_deal(codes, size), np.zeros(first + 3 * size, np.int64)])
    at, far = [], []
    step = max(1, CELLS // (2 * size))
    for low in range(0, len(blocks), step):
        x, last = blocks[low : low + step], end[low : low + step]
        found = squared_differences(dealt[np.arange(size)[:, None] + x], dealt[np.arange(2 * size)[:, None] + (x + first)])
        s, k = np.nonzero(found == 0)
        inside = x[k] + first + s + size <= last[k]
        at.append(x[k[inside]])
        far.append(first + s[inside])
    return (np.concatenate(at), np.concatenate(far)) if at else (blocks, blocks)


def _equal(codes: np.ndarray, at: np.ndarray, far: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` words at ``at`` equal those ``far`` words on, in truth."""
    out, step = np.zeros(len(at), bool), max(1, (1 << 20) // size)
    for low in range(0, len(at), step):
        i = at[low : low + step, None] + np.arange(size)
        out[low : low + step] = (codes[i] == codes[i + far[low : low + step, None]]).all(axis=1)
    return out


def _reach(codes: np.ndarray, at: np.ndarray, far: np.ndarray, room: np.ndarray, sign: int) -> np.ndarray:
    """How many words on from ``at`` (``sign`` 1: at, at + 1, …; -1: at - 1, at - 2, …) equal those ``far`` on, ``room`` at most."""
    out, active, width = np.zeros(len(at), np.int64), np.flatnonzero(room > 0), 8
    while len(active):
        still = []
        step = max(1, (1 << 20) // width)
        for low in range(0, len(active), step):
            k = active[low : low + step]
            offset = out[k, None] + np.arange(width)
            allowed = offset < room[k, None]
            i = at[k, None] + (offset if sign > 0 else -1 - offset)
            i = np.where(allowed, i, 0)
            differs = ~allowed | (codes[i] != codes[np.minimum(i + far[k, None], len(codes) - 1)])
            ended = differs.any(axis=1)
            out[k] += np.where(ended, differs.argmax(axis=1), width)
            still.append(k[~ended])
        active, width = np.concatenate(still), min(width * 2, 1 << 16)
    return out


def _known(at: np.ndarray, far: np.ndarray, size: int, runs: np.ndarray) -> np.ndarray:
    """Whether a seed lies in one of ``runs`` (start, end, period by start) at a multiple of its period: it says nothing new."""
    if not len(runs):
        return np.zeros(len(at), bool)
    # of the runs that begin at or before a seed, the one that reaches farthest
    reach = np.maximum.accumulate(runs[:, 1])
    farthest = np.maximum.accumulate(np.where(runs[:, 1] == reach, np.arange(len(runs)), 0))
    k = np.searchsorted(runs[:, 0], at, side="right") - 1
    run = runs[farthest[np.maximum(k, 0)]]
    return (k >= 0) & (run[:, 1] >= at + far + size) & (far % run[:, 2] == 0)


def find_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs of several texts, whose words' numbers lie in ``codes[starts[i]:ends[i]]``: rows start, end, period, by start, then period."""
    found = np.zeros((0, 3), np.int64)
    if not len(starts):
        return found
    longest = int((ends - starts).max())
    scales = [(8, 1)] + [(1 << k, 1 << k) for k in range(3, 64) if 1 << k <= longest // REPEATS]
    for size, first in scales if longest >= LEAST else []:
        at, far = _seeds(codes, starts, ends, size, first)
        new = ~_known(at, far, size, found)
        at, far = at[new], far[new]
        true = _equal(codes, at, far, size)
        at, far = at[true], far[true]
        if not len(at):
            continue
        # blocks that follow one another at one distance are one stretch
        order = np.lexsort((at, far))
        at, far = at[order], far[order]
        fresh = np.concatenate([[True], (far[1:] != far[:-1]) | (at[1:] != at[:-1] + size)])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(at)) - 1
        left, right, far = at[head], at[tail] + size, far[head]
        owner = np.searchsorted(starts, left, side="right") - 1
        left = left - _reach(codes, left, far, left - starts[owner], -1)
        right = right + far + _reach(codes, right, far, ends[owner] - far - right, 1)
        enough = right - left >= np.maximum(LEAST, REPEATS * far)
        if not enough.any():
            continue
        every = np.concatenate([found, np.stack([left, right, far], axis=1)[enough]])
        # one row a stretch, with its smallest distance
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        same = np.concatenate([[False], (every[1:, :2] == every[:-1, :2]).all(axis=1)])
        found = every[~same]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


# --- over a table ---


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about TEXT_BYTES; a longer text is alone."""
    low, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > low and held + size > TEXT_BYTES:
            yield low, i
            low, held = i, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps batches of ``key, text`` to ``key, words, runs, collapsed``."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for low, high in _slices(sizes):
            texts = pc.fill_null(batch.column(1).slice(low, high - low), "")
            split = pc.ascii_split_whitespace(texts)
            flat, owner = split.flatten(), pc.list_parent_indices(split)
            real = pc.not_equal(flat, "")
            flat, owner = flat.filter(real), owner.filter(real).to_numpy()
            counts = np.bincount(owner, minlength=high - low)
            ends = np.cumsum(counts)
            starts = ends - counts
            codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            some = counts > 0
            runs = find_runs(codes, starts[some], ends[some])
            depth = np.zeros(len(codes) + 1, np.int64)
            # two runs may begin or end at one word
            np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
            np.subtract.at(depth, runs[:, 1], 1)
            kept = np.cumsum(depth)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=high - low))])
            words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept)))
            of = np.searchsorted(starts[some], runs[:, 0], side="right") - 1
            of = np.flatnonzero(some)[of] if len(runs) else of
            columns = [runs[:, 0] - starts[of], runs[:, 1] - runs[:, 0], runs[:, 2]] if len(runs) else [runs[:, 0]] * 3
            listed = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=high - low))]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind)),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(counts, pa.int64()), listed, pc.binary_join(words, " ")],
                names=["key", "words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: ``key, words, runs, collapsed``.

    ``words`` counts the text's maximal stretches of other characters than ``[\\x20\\x09-\\x0D]``, numbered from 0.  ``runs`` lists ``start,
    length, period`` of every run, by start, then period.  ``collapsed`` is the text without the words that a run contains
    after its first period, the rest joined by one space.  Null, empty and wordless texts have no words, no
    runs and an empty collapsed text; a null or repeated key is carried along; an empty table gives no rows; other
    columns are not read.
    """
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = plain.mapInArrow(_describe, SCHEMA.format(kind=docs.schema[key].dataType.simpleString()))
    return found.select(F.col("key").alias(key), "words", "runs", "collapsed")


def with_planted_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, text`` where a tenth of the texts, told by crc32 of the key, repeat one passage from some word to their end.

    With h the crc32 of the key as decimal text, g = floor(h / 10) and n words: if h % 10 = 0 and n > 0, each word i >= a
    becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).  A null key leaves its text as it is.
    """
    white = r"[\x20\x09-\x0D]+"
    h = F.crc32(F.col(key).cast("string"))
    words = F.filter(F.split(F.col(text).cast("string"), white), lambda w: w != "")
    g, n = F.floor(h / 10), F.size("words")
    parts = docs.select(F.col(key), F.col(text).cast("string").alias("text"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    a = F.col("g") % F.nullif(n, F.lit(0))
    placed = parts.withColumn("a", F.when(n > 0, a)).withColumn(
        "p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    )
    turned = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    return placed.select(F.col(key), F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result of ``periodic_runs`` in short: counts, the run of greatest length by period, and digests of runs and collapsed texts.

    Lengths by periods are compared exactly; ties go to the smallest start, then period.
    """
    better = (
        lambda a, b: F.when(a.length * b.period != b.length * a.period, F.when(a.length * b.period > b.length * a.period, -1).otherwise(1))
        .when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1))
        .otherwise(F.when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0))
    )
    best = F.get(F.array_sort("runs", better), 0)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n"))))
    shown = found.withColumn("best", best)
    return shown.select(
        F.col(key),
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
