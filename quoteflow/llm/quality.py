"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network.

Every token (word or mark) has a sparse random index vector, given by its hash.  Its word vector is the sum of the
index vectors of the tokens within two places of it, over the whole corpus: whole numbers in a table of
``2^SLOT_BITS`` slots that tokens share by hash, 2 MB whatever the corpus, added up in the tasks and then by slices of the
table.  A document is pooled to the means, deviations and neighbour differences of its word vectors.  The network is fitted with
numpy on a bounded sample of labelled rows (``per_class`` of each class), a fifth of which sets the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import held_out, keep, labelled_sample, sample_texts

SLOT_BITS, INDEX_BITS, WIDTH, NONZERO, REACH, SLICES = 14, 12, 32, 6, 2, 16
POOLED = 3 * WIDTH + 2


def _index() -> np.ndarray:
    """Sparse index vectors of +1 and -1."""
    random = np.random.Generator(np.random.PCG64(3))
    table = np.zeros((1 << INDEX_BITS, WIDTH), np.int32)
    for row in table:
        row[random.choice(WIDTH, NONZERO, replace=False)] = random.choice([-1, 1], NONZERO)
    return table


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def context_sums(hashes: np.ndarray, begins: np.ndarray, index: np.ndarray, table: np.ndarray) -> None:
    """Adds to ``table`` the neighbours' index vectors of all tokens; texts do not reach into each other."""
    if not len(hashes):
        return
    own = index[(hashes & np.uint64(len(index) - 1)).astype(np.int64)]
    near = np.zeros_like(own)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    for d in range(1, REACH + 1):
        together = (owner[d:] == owner[:-d])[:, None]
        near[d:] += own[:-d] * together
        near[:-d] += own[d:] * together
    slots = _slots(hashes)
    order = np.argsort(slots, kind="stable")
    ordered = slots[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    table[ordered[starts]] += np.add.reduceat(near[order], starts, axis=0)


def _sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, table = _index(), np.zeros((1 << SLOT_BITS, WIDTH), np.int64)
    any_rows = False
    for batch in batches:
        for _, _, data, begins in tokens.blocks(batch.column(0).to_pylist()):
            any_rows = True
            context_sums(*tokens.hashes(data, begins, marks=True), index, table)
    if any_rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in np.split(table, SLICES)], pa.binary())], names=["slice", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[k] = sums.get(k, 0) + np.frombuffer(data, np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vectors of all slots, from the contexts of all documents; a slot never seen is zero."""
    schema = "slice int, sums binary"
    partial = docs.select(F.col(text).cast("string")).mapInArrow(_sum_contexts, schema)
    table = np.zeros((SLICES, (1 << SLOT_BITS) // SLICES, WIDTH))
    for row in partial.repartition(SLICES, "slice").mapInArrow(_add, schema).collect():
        table[row["slice"]] = np.frombuffer(row["sums"], np.int64).reshape(-1, WIDTH)
    table = table.reshape(-1, WIDTH)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Pooled vectors of whole texts; one without tokens gives zeros."""
    out = np.zeros((len(texts), POOLED), np.float32)
    for first, last, data, begins in tokens.blocks(texts):
        hashes, at = tokens.hashes(data, begins, marks=True)
        counts = np.diff(at)
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        each = vectors[_slots(hashes)]
        starts, n = at[:-1][some], counts[some][:, None]
        mean = np.add.reduceat(each, starts, axis=0) / n
        square = np.add.reduceat(each * each, starts, axis=0) / n
        step = np.zeros_like(each)
        step[1:] = np.abs(each[1:] - each[:-1])
        step[starts] = 0
        same = np.zeros(len(hashes), np.float32)
        same[1:] = hashes[1:] == hashes[:-1]
        same[starts] = 0
        rows = first + some
        out[rows, :WIDTH] = mean
        out[rows, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[rows, 2 * WIDTH : 3 * WIDTH] = np.add.reduceat(step, starts, axis=0) / n
        out[rows, -2] = np.add.reduceat(same, starts) / n[:, 0]
        out[rows, -1] = np.log1p(n[:, 0])
    return out


class Network:
    """tanh layer, logistic layer and a temperature; a model without labels of both classes gives 0.5."""

    def __init__(self, shift, scale, w1, b1, w2, b2, temperature):
        self.shift, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = shift, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, last: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 9) -> Network | None:
    """The network from the rows not in ``last``, its temperature from those in it, by Adam on the weighted logistic loss."""
    if not all(len(set(y[p])) == 2 for p in (last, ~last)):
        return None
    random = np.random.Generator(np.random.PCG64(seed))
    train = np.flatnonzero(~last)
    shift, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    parts = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    z, step, rate = (x - shift) / scale, 0, 3e-3
    mean_weight = weight[train].mean()
    for epoch in range(epochs):
        for rows in np.array_split(random.permutation(train), max(1, len(train) // 256)):
            w1, b1, w2, b2 = parts
            h = np.tanh(z[rows] @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -35, 35)))
            error = (p - y[rows]) * weight[rows] / mean_weight / len(rows)
            back = np.outer(error, w2) * (1 - h * h)
            gradients = [z[rows].T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ error + 1e-4 * w2, error.sum(keepdims=True)]
            step += 1
            for part, (m, v), g in zip(parts, moments, gradients):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                part -= rate * (1 - 0.9 * epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Network(shift, scale, *parts, 1.0)
    logits, target, mass = model.logits(x[last]), y[last], weight[last]
    tried = np.geomspace(0.25, 8, 121)
    losses = [(mass * (np.logaddexp(0, logits / t) - target * logits / t)).sum() for t in tried]
    model.temperature = float(tried[int(np.argmin(losses))])
    return model


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, per_class: int = 6000, text: str = "text", key: str = "doc_id") -> Network | None:
    """The network of ``labels.quality``, learned from rows whose crc32(id as text) mod 3 is not 1; ``per_class`` bounds the sample.
    A repeated id is learned from once."""
    wanted = labelled_sample(labels, "quality", 3, 1, per_class, seed=3)
    rows = sample_texts(docs, wanted, text, key)

    def measure(batches):
        for batch in batches:
            x = pooled(batch.column(0).to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x.tolist(), pa.list_(pa.float32()))], names=["doc_id", "label", "weight", "x"])

    kind = docs.schema[key].dataType.simpleString()
    found = keep(
        rows.select("text", "doc_id", "label", "weight").mapInArrow(measure, f"doc_id {kind}, label int, weight double, x array<float>"), "quality-sample"
    ).withColumn("last", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(5)) == 0).collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in found]).reshape(len(found), POOLED)
    return fit(x, np.array([r["label"] for r in found], float), np.array([r["weight"] for r in found], float), np.array([r["last"] for r in found], bool))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", per_class: int = 6000) -> DataFrame:
    """``key, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts pool to zeros and get that point's score.  Without labels of both classes every score is 0.5.  Repeated rows are
    scored alike; an empty table gives no rows; other columns are not read.  A null key is not held out.
    """
    vectors = word_vectors(docs, text)
    model = train(docs, labels, vectors, per_class, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1).to_pylist(), vectors)
            values = model.probability(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key), held_out("key", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
