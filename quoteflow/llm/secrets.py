"""Secret scans: a pattern finds candidates, a random forest removes the false ones.

A candidate is a run of at least 12 letters, digits and ``_+/-`` that holds a digit; whatever follows a secret's name and ``=`` or
``:``, up to white space or the closing quote; a password in an address; a known format; or a private key block.  A candidate within
one that is surely a secret is left out.  What is surely a secret (``known_label``) is always a finding, of score 1; the forest decides on the others.
Its features are a candidate's format match, its assignment, its length and character mix, how likely its character transitions are in the corpus' words, how much of it dictionary words cover, whether it stands in
a path or address, and the words beside it.  The forest is trained on labelled findings ``doc_id, start, end,
secret``; ``known_findings`` gives them where none are at hand, from formats and assignments that leave no doubt.
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
from .common import keep, most_frequent, sample_texts
from .hidden_markov import _count

_RUN = re.compile(r"([A-Za-z0-9_+/\-]{12,})={0,2}")
_LETTER, _DIGIT = re.compile("[A-Za-z0-9]"), re.compile(r"\d")
#: Names that secrets are assigned to, and words beside what only looks like one.
NAMES = frozenset("password passwd pwd secret token key apikey api_key access_key auth bearer credential private signature".split())
OTHERS = frozenset("http https www md5 sha1 sha256 commit uuid id card phone tel iban isbn order invoice example test sample digest checksum version".split())
_FORMATS = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})(?![A-Za-z0-9])")
_BLOCK = re.compile(
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|(?:\s*+[A-Za-z0-9+/=]{16,}+)*+)")
_LOGIN = re.compile(r"://[^\s/:@\"']*+:([^\s\"'/]+)@")
_SURE_NAME = r"password|passwd|pwd|secret(?:[_-]?key)?|token|(?:api|access|private)[_-]?key"
_NAME = re.compile(rf"(?i)(?:{_SURE_NAME}|(?<![A-Za-z])(?:key|auth|bearer|credential|private|signature))[\"']?\s{{0,2}}$")
_VALUE = re.compile(r"[=>:]?\s{0,2}(?:\"([^\"\n]++)\"|'([^'\n]++)'|[\"']?([^\s\"']++))")
_GIVEN = re.compile(rf"(?i)(?:{_NAME.pattern[4:-1]})[=:][=>:]?\s{{0,2}}[\"']?$")
_ASSIGNED = re.compile(rf"(?i)(?:{_SURE_NAME})[\"']?\s{{0,2}}([=:])[=>:]?\s{{0,2}}([\"']?)$")
_BLANK = re.compile(r"(?i)none|null|nil|true|false|undefined|\$\{.*|\$[A-Z_]+|\{\{.*|<[^<>]*>|%\w+%|\*+|x+")
_ADDRESS = re.compile(r"(?i)(?:https?://|www\.|@|/)[^\s\"']{0,80}$")
_NEAR = re.compile(r"[A-Za-z_]{2,}")
_REACH = 60
DICTIONARY, PER_CLASS, FEATURES = 20_000, 10_000, 19


def runs(text: str) -> list[tuple[int, int]]:
    """Spans of runs with a digit, from their first letter or digit on, up to two ``=`` included.  Every character is looked at a fixed number of times."""
    out = []
    for m in _RUN.finditer(text):
        end = m.end(1)
        first = _LETTER.search(text, m.start(), end)
        # a digit right behind the run counts as one in it
        if first and end - first.start() >= 12 and _DIGIT.search(text, first.start(), end + 1):
            out.append((first.start(), m.end()))
    return out


def assigned(text: str) -> list[tuple[int, int]]:
    """Spans of what follows a secret's name and ``=`` or ``:``."""
    spans, last = [], 0
    for m in re.finditer("[=:]", text):
        if not _NAME.search(text[max(0, m.start() - 30) : m.start()]):
            continue
        # inside an unquoted value, another one ends where that one does
        at = m.end() + len(re.match(r"[=>:]?\s{0,2}", text[m.end() : m.end() + 3]).group())
        if at < last and text[at : at + 1] not in ("'", '"'):
            continue
        if value := _VALUE.match(text, m.end()):
            spans.append(value.span(value.lastindex))
            last = value.end() if value.lastindex == 3 else last
    return spans


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of all candidates of a whole text, in order; those within one that is surely a secret are left out."""
    text = text or ""
    spans = {m.span() for pattern in (_FORMATS, _BLOCK) for m in pattern.finditer(text)}
    spans.update(runs(text))
    spans.update(m.span(1) for m in _LOGIN.finditer(text))
    spans.update(assigned(text))
    out, sure = [], 0
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end > sure:
            out.append((start, end))
            if known_label(text, start, end) == 1:
                sure = end
    return out


def _formatted(value: str) -> bool:
    return bool(_FORMATS.fullmatch(value) or _BLOCK.fullmatch(value))


def _in_login(text: str, start: int, end: int) -> bool:
    if text[start - 1 : start] != ":" or text[end : end + 1] != "@":
        return False
    at = text.rfind("://", 0, start)
    met = _LOGIN.match(text, at) if at >= 0 else None
    return met is not None and met.span(1) == (start, end)


def known_label(text: str, start: int, end: int) -> int | None:
    """1 for a format, login or assignment that is a secret, 0 for placeholders, numbers, addresses and paths, None where neither is sure."""
    value, before = text[start:end], text[max(0, start - _REACH) : start]
    if _formatted(value) or _in_login(text, start, end):
        return 1
    if met := _ASSIGNED.search(before):
        if _BLANK.fullmatch(value):
            return 0
        sign, quote = met.groups()
        digit, letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
        # a bare word or number may be prose or code
        return 1 if quote or runs(value) == [(0, len(value))] or digit and (letter or sign == "=") else None
    if _GIVEN.search(before):
        return None
    if value.isdigit() or _ADDRESS.search(before) or not re.search("[A-Za-z]", value.replace("-", "")):
        return 0
    return None


class Language:
    """The corpus' frequent words, and the likelihood of one character after another in them."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words = {w for w, _ in words if len(w) >= 4}
        pairs, firsts = Counter(), Counter()
        for word, n in words:
            for a, b in zip(word, word[1:]):
                pairs[a, b] += n
                firsts[a] += n
        self.pairs = {p: math.log((n + 0.5) / (firsts[p[0]] + 128)) for p, n in pairs.items()}
        self.unseen = {a: math.log(0.5 / (n + 128)) for a, n in firsts.items()}

    def transitions(self, value: str) -> float:
        low = value.lower()
        logs = [self.pairs.get((a, b)) or self.unseen.get(a, -9.0) for a, b in zip(low, low[1:])]
        return sum(logs) / max(1, len(logs))

    def coverage(self, value: str) -> float:
        """Share of characters inside dictionary words, longest first from the left."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            for n in range(min(12, len(low) - at), 3, -1):
                if low[at : at + n] in self.words:
                    covered += n
                    at += n
                    break
            else:
                at += 1
        return covered / len(low)


def features(text: str, start: int, end: int, language: Language) -> list[float]:
    value = text[start:end]
    n = len(value)
    before, after = text[max(0, start - _REACH) : start], text[end : end + _REACH]
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = [1 if c.isdigit() else 2 if c.isupper() else 3 if c.islower() else 4 for c in value]
    near_before = [w.lower() for w in _NEAR.findall(before)][-4:]
    near_after = [w.lower() for w in _NEAR.findall(after)][:4]
    near = near_before + near_after
    return [
        float(n), entropy, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n, kinds.count(4) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), len(counts) / n,
        language.transitions(value), language.coverage(value),
        float(value.count("/") + value.count("\\")), float(bool(_ADDRESS.search(before))),
        float(before.rstrip(" \"'")[-1:] in "=:" and bool(before.strip())), float(text[end : end + 1] in "\"'"),
        float(sum(w in NAMES for w in near)), float(sum(w in OTHERS for w in near)),
        float(all(c in "0123456789abcdefABCDEF" for c in value)), float(_formatted(value)), float(bool(_GIVEN.search(before))),
    ]


def known_findings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, start, end, secret`` of the candidates whose label is sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, a, b, label)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for a, b in candidates(text)
                if (label := known_label(text, a, b)) is not None
            ]
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "secret"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, start bigint, end bigint, secret int"
    )


def frequent_words(docs: DataFrame, text: str = "text") -> Language:
    """The ``DICTIONARY`` most frequent words, counted over all documents."""
    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, "word binary, n bigint").where("word is not null")
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.col("word").cast("string").alias("word"), "n")
    plain = keep(words.where(F.col("word").rlike(r"^\p{L}{2,24}$")), "plain-words")
    return Language(sorted((r["word"], r["n"]) for r in most_frequent(plain, DICTIONARY).collect()))


def train(docs: DataFrame, findings: DataFrame, language: Language, text: str = "text", key: str = "doc_id") -> trees.Forest | None:
    """The forest of labelled findings, at most ``PER_CLASS`` of each label, those of smallest hash; None without both labels.
    A repeated id is learned from once."""
    order = F.xxhash64("doc_id", "start", F.lit(8))
    fine = findings.where("doc_id is not null and start is not null and end is not null and secret in (0, 1)").select("doc_id", "start", "end", "secret").distinct()
    picked = None
    for label in (0, 1):
        part = fine.where(F.col("secret") == label).orderBy(order, "doc_id", "start", "end").limit(PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * PER_CLASS rows
    spans = picked.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "secret")).alias("spans"))
    rows = sample_texts(docs, spans, text, key)

    def measure(batches):
        for batch in batches:
            found = [
                features(text, s["start"], s["end"], language) + [float(s["secret"])]
                for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for s in spans if text and 0 <= s["start"] < s["end"] <= len(text)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], names=["x"])

    found = sorted(r["x"] for r in rows.select("text", "spans").mapInArrow(measure, "x array<double>").collect())
    x = np.array(found).reshape(len(found), FEATURES + 1)
    if len(set(x[:, -1])) < 2:
        return None
    return trees.forest(x[:, :-1], x[:, -1])


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """``key, n_candidates, n_secrets, findings`` for each row of ``docs``; a finding has start, end (code points) and score.

    ``findings`` are labelled ones to learn from (default: ``known_findings``).  Without labels of both kinds all candidates are
    findings of score 1.  Null and empty texts have none.  Repeated rows are scanned alike; a null key is kept; an empty table gives no
    rows; other columns are not read.
    """
    language = frequent_words(docs, text)
    known = keep(known_findings(docs, text, key) if findings is None else findings, "findings")
    model = train(docs, known, language, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rows, sure = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, b in candidates(text):
                    spans.append((i, a, b))
                    sure.append(known_label(text, a, b) == 1)
                    rows.append(features(text, a, b, language) if model else [])
            scores = model.probability(np.array(rows)) if model and rows else np.ones(len(rows))
            scores = np.where(np.array(sure, bool), 1.0, scores)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            number = np.bincount([i for i, _, _ in spans], minlength=batch.num_rows) if spans else np.zeros(batch.num_rows, int)
            for (i, a, b), s in zip(spans, scores.tolist()):
                if s >= threshold:
                    found[i].append({"start": a, "end": b, "score": s})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, kind)],
                names=["key", "n_candidates", "n_secrets", "findings"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, n_candidates bigint, n_secrets bigint, findings array<struct<start:bigint,end:bigint,score:double>>"
    ).withColumnRenamed("key", key)
