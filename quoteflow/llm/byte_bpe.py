"""Byte-level BPE with the ranks of a given vocabulary: whole texts to ids and back.

``encode`` is one scan without a shuffle.  A task splits its texts, and encodes each distinct piece (match of the split pattern)
once: the pieces of one byte length are a matrix of byte ids, and each step merges, in all rows at once, the leftmost pair of lowest
rank.  Ranks come from a table of the vocabulary's pairs that travels with the code.  Decoding concatenates the ids' bytes.

``encoded`` is the same fold as Spark higher-order functions over a literal rank table, and ``encode_words`` applies it to a
table of words.  It takes about 75 microseconds a word and core, which is beyond the budget for a corpus' distinct pieces (README).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text worked on at once, and the longest piece, in bytes, that is merged in a matrix.
CHUNK, LONGEST = 2 << 20, 256
_BUCKETS = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 pieces and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Two ids, as ``left * 65536 + right``, to the id of their bytes joined."""
    pairs = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pairs[left << 16 | right] = rank
    return pairs


# --- the fold, in Spark ---


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encoded(piece: Column, ranks: dict[bytes, int]) -> Column:
    """ids of a piece given as text of one character (0-255) a byte."""
    buckets: list[dict[int, int]] = [{} for _ in range(_BUCKETS)]
    for key, rank in pair_ranks(ranks).items():
        buckets[(key * 40503 + (key >> 16) * 7919) & (_BUCKETS - 1)][key] = rank
    table = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>").cast("array<map<bigint,int>>")
    # a byte that is no piece of the vocabulary cannot be written; such vocabularies are not byte-level
    single = F.split(F.lit(",".join(str(ranks[bytes([i])]) for i in range(256))), ",").cast("array<bigint>")

    def rank(left, right):
        slot = lambda key: (key * 40503 + F.shiftright(key, 16) * 7919).bitwiseAND(_BUCKETS - 1).cast("int")
        return _let(left * 65536 + right, lambda key: F.element_at(F.get(table, slot(key)), key))

    def step(ids, _):
        found = F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), rank)

        def merge(each, low):
            at = F.array_position(each, low).cast("int")
            joined = lambda i: F.concat(F.slice(ids, F.lit(1), i - 1), F.array(low.cast("bigint")), F.slice(ids, i + 2, F.size(ids)))
            return F.when(low.isNull(), ids).otherwise(_let(at, joined))

        return _let(found, lambda each: _let(F.array_min(each), lambda low: merge(each, low)))

    start = F.transform(F.sequence(F.lit(1), F.length(piece)), lambda i: F.get(single, F.ascii(F.substring(piece, i, F.lit(1)))))
    return F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(piece), F.lit(2))), start, step)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one long piece: the lowest-ranked, leftmost pair first, by a heap over a linked list."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, after = [i + 1 for i in range(n)], list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i):
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while heap:
        rank, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


# --- chunks ---


def splitter(pattern: str):
    r"""Function from a text to its matches of ``pattern``, which must be the public GPT-2 one for the quick way.

    Python's ``re`` has no ``\\p{L}``; on texts without the few characters whose classes differ (numbers that are no decimal digits,
    ASCII separators) an equivalent pattern of ``re`` gives the same matches, several times faster.
    """
    import regex

    exact = regex.compile(pattern).findall
    known = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if pattern != known:
        return exact
    quick = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""").findall
    # below U+0250 these are the only characters whose classes differ; beyond it, the exact pattern is used
    unlike = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]").search

    def find(text: str) -> list[str]:
        return exact(text) if unlike(text) else quick(text)

    return find


class Merges:
    """The vocabulary as arrays: ranks of byte pairs, and of all pairs by binary search."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = sorted(pair_ranks(ranks).items())
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.values = np.array([v for _, v in pairs] + [self.NONE], np.int32)
        self.of_bytes = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that two ids merge to, NONE where they don't."""
        key = left.astype(np.int64) << 16 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], self.NONE)

    def of_length(self, pieces: list[bytes]) -> list[list[int]]:
        """ids of pieces that have the same number of bytes."""
        n, length = len(pieces), len(pieces[0])
        raw = np.frombuffer(b"".join(pieces), np.uint8).reshape(n, length)
        ids, out, rows = self.single[raw], [None] * n, np.arange(n)
        ranks = self.of_bytes[raw[:, :-1], raw[:, 1:]]
        while len(rows):
            width = ids.shape[1]
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), self.NONE)
            ended = best == self.NONE
            for row, value in zip(rows[ended].tolist(), ids[ended].tolist()):
                out[row] = value
            rows, ids, ranks, at, best = rows[~ended], ids[~ended], ranks[~ended], at[~ended], best[~ended]
            if not len(rows):
                break
            # every row that goes on merges one pair, so all stay of one width
            place, each = np.arange(width - 1), np.arange(len(rows))
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            ids[each, at] = best
            if width == 2:
                ranks = ranks[:, :0]
                continue
            place = place[:-1]
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), axis=1)
            left, right = at > 0, at < width - 2
            ranks[each[left], at[left] - 1] = self.rank(ids[each[left], at[left] - 1], best[left])
            ranks[each[right], at[right]] = self.rank(best[right], ids[each[right], at[right] + 1])
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONGEST:
                out[i] = merged(piece, self.ranks)
            else:
                groups.setdefault(len(piece), []).append(i)
        for members in groups.values():
            for low in range(0, len(members), 1 << 16):
                part = members[low : low + (1 << 16)]
                for i, ids in zip(part, self.of_length([pieces[i] for i in part])):
                    out[i] = ids
        return out


def _encode(ranks: dict[bytes, int], pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, merges = splitter(pattern), Merges(ranks)
        # per piece: number of ids, ids in decimal, decoded bytes; emptied when full
        known: dict[str, tuple[int, bytes, bytes]] = {}

        def rows(found: list[list[str]]):
            new = list({p for pieces in found for p in pieces if p not in known})
            for piece, ids in zip(new, merges.encode([p.encode("utf-8", "surrogatepass") for p in new])):
                known[piece] = (len(ids), ",".join(map(str, ids)).encode(), b"".join([merges.bytes[i] for i in ids]))
            for pieces in found:
                own = [known[p] for p in pieces]
                yield (
                    sum([x[0] for x in own]),
                    hashlib.sha256(b",".join([x[1] for x in own])).hexdigest(),
                    hashlib.sha256(b"".join([x[2] for x in own])).hexdigest(),
                )

        for batch in batches:
            out, waiting, size = [], [], 0
            for text in batch.column(1).to_pylist():
                waiting.append(find(text or ""))
                size += len(text or "")
                if size >= CHUNK:
                    out.extend(rows(waiting))
                    waiting, size = [], 0
                    if len(known) > 200_000:
                        known.clear()
            out.extend(rows(waiting))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``: hashes of the ids in decimal joined by commas, and of
    the bytes that the ids decode to.

    Null texts are empty: no ids.  Repeated rows and ids give a row each; null keys are kept.  An empty table gives no rows; other
    columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        _encode(ranks, pattern), f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("key", key)


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """Distinct, non-null ``word`` (text) with its ``ids``, in Spark's own functions."""
    distinct = words.select(F.col(word).cast("string").alias(word)).where(F.col(word).isNotNull()).distinct()
    bytes_as_text = F.decode(F.col(word).cast("binary"), "ISO-8859-1")
    empty = F.array().cast("array<int>")
    return distinct.withColumn("ids", F.when(F.length(word) > 0, encoded(bytes_as_text, ranks).cast("array<int>")).otherwise(empty))
