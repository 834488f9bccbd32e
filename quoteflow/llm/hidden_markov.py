"""Scores of texts by a hidden Markov language model with exact sequence likelihoods.

1. Word counts of the training rows: a bounded dictionary in each task, then one shuffle.  They are exact and unbounded.
2. The ``DICTIONARY`` most frequent words (a fixed bound, a few MB) go to every task; of these, ``alphabet`` words
   are symbols of the model, and all other words share one symbol.  Documents are written as symbols, so texts are split only twice.
   Words beyond the dictionary meet their counts in a join.
3. Baum-Welch: every task adds up expected counts of its documents, a table of states x symbols; the tables are added by
   state, and the model for the next round is as large as before, whatever the corpus.
4. The scaled forward recursion gives each whole text's likelihood.  A word outside the alphabet has the probability of its
   shared symbol times (c+1) / (its class's tokens + distinct words + 1), so the model is a distribution over words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep, most_frequent

#: Words known to every task, the longest of them in bytes, positions worked on at once, and the longest training sequence.
DICTIONARY, LONGEST, POSITIONS, SEQUENCE = 1 << 17, 64, 300_000, 1 << 16
#: Numbers of a state's table that one task adds up over all partitions.
SLICE = 2048


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ``[\\x20\\x09-\\x0D]``."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to ``word, n``; the null word counts texts."""
    counts: Counter = Counter()
    texts = 0

    def part():
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words(text))
            texts += 1
            if len(counts) > 400_000:
                yield part()
                counts.clear()
    yield part()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([texts], pa.int64())], names=["word", "n"])


def _symbols(known: dict[bytes, tuple[int, int]], alphabet: int, ends: int):
    """Maps ``row, text`` to symbols and what the dictionary says of a text's words."""
    outside, end = alphabet, alphabet + 1
    place = {w: i for w, (i, _) in known.items()}
    # by place; the last one is that of words beyond the dictionary
    logs = np.log10(np.array([c for _, c in known.values()] + [0], float) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = len(place)
        for batch in batches:
            symbols, seen, plain, beyond, rare, number = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                own = words(text)
                at = np.fromiter([place.get(w, unknown) for w in own], np.int64, len(own))
                missing = Counter([own[i] for i in np.flatnonzero(at == unknown).tolist()])
                value = logs[at]
                symbols.append(np.append(np.minimum(at, outside), end).astype(np.int32))
                number.append(len(own) + 1)
                seen.append(len(own) - missing.total() + (ends > 0))
                plain.append(float(value.sum()) + math.log10(ends + 1))
                beyond.append(float(value[at >= alphabet].sum()))
                rare.append(list(missing.items()))
            kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
            lists = pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, rare)]).astype(np.int32),
                pa.StructArray.from_arrays([pa.array([w for r in rare for w, _ in r], pa.binary()), pa.array([n for r in rare for _, n in r], pa.int64())], names=["word", "n"]))
            arrays = pa.ListArray.from_arrays(np.cumsum([0, *number]).astype(np.int32), pa.array(np.concatenate(symbols) if symbols else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int64()), pa.array(seen, pa.int64()), pa.array(plain, pa.float64()), pa.array(beyond, pa.float64()), arrays, lists.cast(kind)],
                names=["row", "n_tokens", "seen", "plain", "beyond", "symbols", "rare"])

    return run


class Model:
    """Start, transition and emission (symbols x states) probabilities."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit


def first_model(counts: np.ndarray, states: int, seed: int = 11) -> Model:
    """Sticky states whose emissions are the symbol shares, moved apart at random."""
    random = np.random.Generator(np.random.PCG64(seed))
    emit = (counts + 0.01)[:, None] * random.uniform(0.4, 1.6, (len(counts), states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _sequences(values: np.ndarray, offsets: np.ndarray, longest: int | None):
    """Sequences as (owner, from, to), cut at ``longest``, in batches of like length, longest first."""
    parts = []
    for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        step = longest or max(1, high - low)
        parts += [(i, at, min(high, at + step)) for at in range(low, high, step)]
    parts.sort(key=lambda p: p[1] - p[2])
    at = 0
    while at < len(parts):
        length = parts[at][2] - parts[at][1]
        count = max(1, POSITIONS // length)
        chosen = parts[at : at + count]
        at += count
        lengths = np.array([b - a for _, a, b in chosen])
        padded = np.zeros((length, len(chosen)), np.int32)
        for j, (_, a, b) in enumerate(chosen):
            padded[: b - a, j] = values[a:b]
        # how many sequences reach each position
        active = np.searchsorted(-lengths, -np.arange(1, length + 1), side="right")
        yield np.array([i for i, _, _ in chosen]), padded, active


def forward(model: Model, padded: np.ndarray, active: np.ndarray, stored: tuple | None = None) -> np.ndarray:
    """Natural log likelihoods by the scaled recursion; ``stored`` takes the scaled states and the scales."""
    n = padded.shape[1]
    total = np.zeros(n)
    state = np.tile(model.start, (n, 1))
    for t, m in enumerate(active.tolist()):
        now = (state[:m] if not t else state[:m] @ model.move) * model.emit[padded[t, :m]]
        scale = now.sum(axis=1)
        now /= scale[:, None]
        total[:m] += np.log(scale)
        state = now
        if stored:
            stored[0][t, :m], stored[1][t, :m] = now, scale
    return total


def expected_counts(model: Model, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of some sequences, and their log likelihood."""
    states, symbols = len(model.start), len(model.emit)
    start, move, emit, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)), 0.0
    for _, padded, active in _sequences(values, offsets, SEQUENCE):
        length, n = padded.shape
        alpha, scale = np.zeros((length, n, states)), np.ones((length, n))
        likelihood += forward(model, padded, active, (alpha, scale)).sum()
        beta = np.ones((n, states))
        for t in range(length - 2, -1, -1):
            m = active[t + 1]
            ahead = model.emit[padded[t + 1, :m]] * beta[:m] / scale[t + 1, :m, None]
            move += alpha[t, :m].T @ ahead
            # what stands behind in alpha becomes the posterior of the step after
            alpha[t + 1, :m] *= beta[:m]
            beta[:m] = ahead @ model.move.T
        alpha[0] *= beta
        start += alpha[0].sum(axis=0)
        held = np.arange(n)[None, :] < active[:, None]
        flat, weight = padded[held], alpha[held]
        for k in range(states):
            emit[k] += np.bincount(flat, weight[:, k], symbols)
    return start, move * model.move, emit, likelihood


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(), offsets


def _expectation(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = None
        for batch in batches:
            found = expected_counts(model, *_flat(batch.column(0)))
            sums = list(found) if sums is None else [a + b for a, b in zip(sums, found)]
        if sums:
            start, move, emit, likelihood = sums
            tables = [np.concatenate([[start[k]], move[k], emit[k], [likelihood if not k else 0.0]]) for k in range(len(start))]
            # a state's table goes in slices, so that as many tasks add up as there are slices
            slices = [(k, at // SLICE, table[at : at + SLICE].tobytes()) for k, table in enumerate(tables) for at in range(0, len(table), SLICE)]
            state, piece, data = zip(*slices)
            yield pa.RecordBatch.from_arrays(
                [pa.array(state, pa.int32()), pa.array(piece, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(slices), pa.int32()), pa.array(data, pa.binary())],
                names=["state", "slice", "part", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for state, piece, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            sums[state, piece] = sums.get((state, piece), 0.0) + np.frombuffer(data)
    if sums:
        state, piece = zip(*sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(state, pa.int32()), pa.array(piece, pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["state", "slice", "sums"])


def baum_welch(training: DataFrame, model: Model, rounds: int) -> tuple[Model, list[float]]:
    """The model after ``rounds`` over all of ``training`` (a column of symbols), and the log likelihood before each round."""
    states, history = len(model.start), []
    for _ in range(rounds):
        partial = training.mapInArrow(_expectation(model), "state int, slice int, part int, sums binary")
        tasks = states * -(-(len(model.emit) + states + 2) // SLICE)
        # in the order of the partitions, so that the sums are the same in every run
        dealt = partial.repartition(tasks, "state", "slice").sortWithinPartitions("state", "slice", "part")
        added = sorted(dealt.mapInArrow(_add, "state int, slice int, sums binary").collect(), key=lambda r: (r["state"], r["slice"]))
        if not added:
            return model, history
        table = np.concatenate([np.frombuffer(r["sums"]) for r in added]).reshape(states, -1)
        start, move, emit = table[:, 0] + 1e-3, table[:, 1 : states + 1] + 1e-3, table[:, states + 1 : -1] + 1e-2
        history.append(float(table[:, -1].sum()))
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T))
    return model, history


def _likelihoods(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _flat(batch.column(1))
            logs = np.zeros(batch.num_rows)
            for owner, padded, active in _sequences(values, offsets, None):
                logs[owner] = forward(model, padded, active)
            shared = [int((values[a:b] == len(model.emit) - 2).sum()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logs / math.log(10)), pa.array(shared, pa.int64())], names=["row", "likelihood", "shared"])

    return run


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", states: int = 6, alphabet: int = 1 << 15, rounds: int = 3,
          modulus: int = 7, remainder: int = 2) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Learned from rows whose crc32(key as text) mod ``modulus`` is not ``remainder``; null keys are learned from.  Null and
    empty texts are one end token.  Repeated rows count as often as they stand there.  Without training rows all words are unknown and
    the model is uniform.  An empty table gives no rows; other columns are not read.
    """
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), held_out(key, modulus, remainder).alias("held_out"))
    every = keep(
        plain.where("not held_out").select("text").mapInArrow(_count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts"
    )
    counts = every.where("word is not null")
    ends = every.where("word is null").agg(F.sum("n")).first()[0] or 0
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts.where(F.length("word") <= LONGEST), DICTIONARY).collect()
    top = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda w: (-w[1], w[0]))
    known = {w: (i, n) for i, (w, n) in enumerate(top)}
    alphabet = min(alphabet, len(top))
    inside = sum(n for _, n in top[:alphabet])
    kind = docs.schema[key].dataType.simpleString()
    read = _symbols(known, alphabet, ends)
    marked = keep(
        plain.select(F.struct("key", "held_out").alias("row"), "text")
        .mapInArrow(read, f"row struct<key:{kind},held_out:boolean>, n_tokens bigint, seen bigint, plain double, beyond double, symbols array<int>, "
                          "rare array<struct<word:binary,n:bigint>>")
        # the number is written, so it stays the row's
        .select("row.key", "row.held_out", F.monotonically_increasing_id().alias("row"), "n_tokens", "seen", "plain", "beyond", "symbols", "rare"),
        "symbols",
    )
    share = np.array([n for _, n in top[:alphabet]] + [tokens - inside, ends], float)
    model, _ = baum_welch(marked.where("not held_out").select("symbols"), first_model(share, states), rounds)
    likelihoods = marked.select("row", "symbols").mapInArrow(_likelihoods(model), "row bigint, likelihood double, shared bigint")
    # words beyond the dictionary: a row for each document that holds one
    rare = marked.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    met = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_seen"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_logs"),
    )
    whole = tokens + ends + distinct + (1 if ends else 0) + 1
    outside = tokens - inside + distinct - alphabet + 1
    joined = marked.drop("symbols", "rare").join(likelihoods, "row").join(met, "row", "left")
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return joined.select(
        F.col("key").alias(key), "held_out", "n_tokens",
        (F.col("seen") + F.coalesce("rare_seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens + ends).cast("long").alias("train_tokens"),
        (F.col("plain") + rare_logs - F.col("n_tokens") * math.log10(whole)).alias("base_score"),
        (F.col("likelihood") + F.col("beyond") + rare_logs - F.col("shared") * math.log10(outside)).alias("score"),
    )
