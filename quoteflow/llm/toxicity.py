"""Toxicity scores: boosted trees over dense features of the whole text, calibrated by isotonic regression.

The model is fitted on a bounded sample of labelled training rows (``per_class`` of
each class, chosen by hash).  A lexicon holds words and word beginnings that mark toxic texts.  Each half of the
sample is measured with the lexicon of the other half, so an entry seen by chance does not look certain to the
trees; a third of it is left to the calibration.  Documents are scored with the lexicon of the whole sample, in one pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import held_out, keep, labelled_sample, sample_texts

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre usted ustedes tuyo ti tus".split()
)
#: Characters that stand for letters in hidden words.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

_WORD = re.compile(r"\w[\w@$!*]*\w|\w", re.UNICODE)
_HIDDEN = re.compile(r"(?<=[^\W\d_])[0134578@$!*]+(?=[^\W\d_])")
_SPACED = re.compile(r"\b(?:\w[ .\-_]){3,}\w\b")
#: Lengths of the word beginnings looked at, besides the whole word (0).
BEGINNINGS = (4, 5, 6)
FEATURES = 14


def entries(word: str) -> list[str]:
    """What of a lower-case word may stand in the lexicon; a beginning is marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def describe(word: str, lexicon: dict[str, float]) -> tuple | None:
    """Odds, odds once look-alikes are undone, whether the whole word is an entry, second person, capitals; None if nothing."""
    low = word.lower()
    odds = max((lexicon.get(e, 0.0) for e in entries(low)), default=0.0)
    undone = low.translate(LOOKALIKE)
    secret = 0.0 if odds or undone == low else max((lexicon.get(e, 0.0) for e in entries(undone)), default=0.0)
    found = (odds, secret, low in lexicon, low in SECOND_PERSON, len(word) > 2 and word.isupper())
    return found if any(found) else None


def features(text: str | None, lexicon: dict[str, float], cache: dict) -> list[float]:
    """Dense features of a whole text; one without words gives zeros.  ``cache`` keeps what ``describe`` says."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    if len(cache) > 300_000:
        cache.clear()
    number, total, heaviest, closest = 0, 0.0, 0.0, math.inf
    last_hit = last_you = -math.inf
    exact = hidden_hits = you = capitals = 0
    for i, word in enumerate(words):
        value = cache.get(word, cache)
        if value is cache:
            value = cache[word] = describe(word, lexicon)
        if value is None:
            continue
        odds, secret, whole, second, upper = value
        capitals += upper
        if second:
            you, last_you = you + 1, i
            closest = min(closest, i - last_hit)
        if odds or secret:
            number += 1
            total += odds or secret
            heaviest = max(heaviest, odds, secret)
            exact += whole
            hidden_hits += secret > 0
            last_hit = i
            closest = min(closest, i - last_you)
    signs = sum(map(text.count, "!?*#@$"))
    hidden = len(_HIDDEN.findall(text)) + len(_SPACED.findall(text)) + hidden_hits
    return [
        number / n, total / n, total, heaviest, float(number), float(exact), exact / n,
        1 / (1 + closest), you / n, capitals / n, signs / len(text), text.count("!") / n, hidden / n, math.log1p(n),
    ]


class Model:
    """Lexicon, trees and calibration; a few hundred kilobytes at most."""

    def __init__(self, lexicon: dict[str, float], boosted: trees.Boosted | None, points):
        self.lexicon, self.boosted, self.points = lexicon, boosted, points

    def score(self, texts: list[str | None], cache: dict) -> np.ndarray:
        if not texts or self.boosted is None:
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon, cache) for t in texts])
        return np.clip(np.interp(self.boosted.margin(x), *self.points), 0.0, 1.0)


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text, label`` to the number of toxic and clean documents that hold an entry, in parts of bounded size."""
    held = (Counter(), Counter())

    def part():
        names = list(held[0].keys() | held[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([held[v][e] for e in names], pa.int64()) for v in (1, 0))],
            names=["entry", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[label].update({e for w in set(_WORD.findall((text or "").lower())) for e in entries(w)})
            if len(held[0]) + len(held[1]) > 500_000:
                yield part()
                held[0].clear(), held[1].clear()
    yield part()


def learn_lexicon(sample: DataFrame, most: int = 3000) -> dict[str, float]:
    """At most ``most`` entries that toxic documents hold more often, with their log odds."""
    number = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = sample.select("text", "label").mapInArrow(_count_entries, "entry string, toxic bigint, clean bigint")
    odds = F.log((F.col("toxic") + 0.5) / (number.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (number.get(0, 0) + 1))
    best = (
        counts.where(F.length("entry") <= 40).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic >= 3").withColumn("odds", odds).where("odds > 1.5")
        .orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "entry").limit(most)
    )
    return {r["entry"]: min(r["odds"], 8.0) for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, text: str = "text", key: str = "doc_id") -> Model:
    """The model of ``labels.toxic``, learned from rows whose crc32(id as text) mod 4 is not 2; ``per_class`` bounds the sample.

    A repeated id is learned from once.  Without rows of both classes in every part of the sample, the model scores 0.
    """
    wanted = labelled_sample(labels, "toxic", 4, 2, per_class, seed=6)
    # at most 2 * per_class ids: small enough for every task
    rows = sample_texts(docs, wanted, text, key)
    sample = keep(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(61)), F.lit(6)).cast("int")), "toxicity-sample")
    lexicon = learn_lexicon(sample)
    halves = learn_lexicon(sample.where("part >= 3")), learn_lexicon(sample.where("part < 3"))

    def measure(batches):
        caches: tuple = {}, {}
        for batch in batches:
            x = [features(t, halves[p >= 3], caches[p >= 3]) for t, p in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "weight", "part", "x"])

    kind = docs.schema[key].dataType.simpleString()
    found = sample.select("text", "doc_id", "label", "weight", "part").mapInArrow(
        measure, f"doc_id {kind}, label int, weight double, part int, x array<double>"
    ).collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in found]).reshape(len(found), FEATURES)
    y, weight = np.array([r["label"] for r in found], float), np.array([r["weight"] for r in found], float)
    last = np.array([r["part"] % 3 == 2 for r in found], bool)
    if not all(len(set(y[p])) == 2 for p in (last, ~last)):
        return Model({}, None, None)
    boosted = trees.boost(x[~last], y[~last], weight[~last])
    return Model(lexicon, boosted, trees.isotonic(boosted.margin(x[last]), y[last], weight[last]))


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts have all features zero and get that point's score.  Repeated rows are scored alike; an empty
    table gives no rows; other columns are not read.  A null key is not held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            values = model.score(batch.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double")
    return scored.select(
        F.col("key").alias(key), held_out("key", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``threshold``; clashing names are no matter."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at).to_pylist(), cache) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
