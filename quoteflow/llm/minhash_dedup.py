"""Near-duplicate documents by consistent weighted sampling.

A document is the multiset of its runs of five words (``tokens``), each weighted
by tf times idf.  ``samples`` improved consistent weighted samples (Ioffe 2010)
agree between two documents with a probability equal to their weighted Jaccard
similarity; ``rows`` samples form a band, and documents with an equal band are
compared by their true weighted Jaccard similarity.  With 12 bands of 3, a pair of
similarity 0.8 is found with probability 0.9998, one of 0.9 with 1 - 1e-7.

* Document frequencies are counted over all documents into 2^20 slots by hash;
  the mean load of a slot is taken off.  The counts are of fixed size (8 MB), whatever
  the corpus, so they may go to every task.  idf = 1 + ln((N+1)/(max(df, 10)+1)) / (2 ln(N+2)), between 1 and 1.5: below ten documents
  a count says more of copies than of common phrases, and a large group of copies must not outweigh its few edits.
* Texts of equal words are one node: a hot text is one row from then on.
* Inside a band, documents are compared with a pivot first, in three rounds with other
  pivots.  A band whose members are linked by then is done; in the others, every pair
  that is not linked yet is compared: pair by pair where a band has at most ``SMALL`` members, else in blocks of about
  ``BLOCK`` documents, as products of their shingle matrices, which give out links and never pairs.
  So no pair of a band goes without a link or a path that makes it needless.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import keep
from .components import components

WIDTH, SLOT_BITS, SLICES = 5, 20, 64
SMALL, BLOCK = 64, 512
#: Rows that a file of texts may hold, or of what comes from comparing texts.
TEXTS_A_FILE = 5_000
_TABLE = 1 << 16
_SEED = 0xD1B54A32D192ED03
_FACTORS = tokens.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_SEED)) | np.uint64(1)


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of Gamma(2,1), log Gamma(2,1) and uniform draws that hash bits choose from."""
    random = np.random.Generator(np.random.PCG64(7))
    return (
        random.gamma(2.0, 1.0, _TABLE).astype(np.float32),
        np.log(random.gamma(2.0, 1.0, _TABLE)).astype(np.float32),
        random.random(_TABLE).astype(np.float32),
    )


def _shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of WIDTH words; fewer words make one run."""
    n = max(1, len(words) - WIDTH + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(WIDTH, len(words))):
        total += words[i : i + n] * _FACTORS[i]
    return tokens.mix(total)


def _documents(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Index, word hashes, distinct shingles and their counts, of each text."""
    for first, last, data, begins in tokens.blocks(texts):
        words, at = tokens.hashes(data, begins, marks=False)
        for i in range(last - first):
            own = words[at[i] : at[i + 1]]
            yield first + i, own, *(np.unique(_shingles(own), return_counts=True) if len(own) else (own, own))


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, documents = np.zeros(1 << SLOT_BITS, np.int64), 0
    for batch in batches:
        for _, _, shingles, _ in _documents(batch.column(0).to_pylist()):
            np.add.at(counts, (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
            documents += 1
    if documents:
        parts = counts.astype(np.int64).reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()),
             pa.array([documents] * SLICES, pa.int64())], names=["slice", "counts", "documents"])


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    documents: dict[int, int] = {}
    for batch in batches:
        for k, data, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            sums[k] = sums.get(k, 0) + np.frombuffer(data, np.int64)
            documents[k] = documents.get(k, 0) + n
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary()),
             pa.array(list(documents.values()), pa.int64())], names=["slice", "counts", "documents"])


def slot_idf(docs: DataFrame, text: str = "text") -> np.ndarray:
    """idf of each slot, counted over all documents."""
    schema = "slice int, counts binary, documents bigint"
    partial = docs.select(text).mapInArrow(_count_slots, schema)
    rows = partial.repartition(SLICES, "slice").mapInArrow(_add_slices, schema).collect()
    counts, documents = np.zeros((SLICES, (1 << SLOT_BITS) // SLICES), np.int64), 0
    for row in rows:
        counts[row["slice"]] = np.frombuffer(row["counts"], np.int64)
        documents = row["documents"]
    flat = counts.ravel()
    df = np.maximum(1.0, flat - np.floor(flat.mean()))
    rarity = np.log((documents + 1) / (np.minimum(np.maximum(df, 10), documents) + 1)) / np.log(documents + 2)
    return (1 + rarity / 2).astype(np.float32)


def _weights(shingles: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts.astype(np.float32) * idf[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]


def _digest(words: np.ndarray) -> str:
    return hashlib.md5(words.tobytes()).hexdigest()


def weighted_samples(found: list[tuple[np.ndarray, np.ndarray]], samples: int, draws) -> np.ndarray:
    """Consistent weighted samples of several documents, each of distinct shingles and weights: documents x samples."""
    scale, log_c, shift = draws
    sizes = np.array([len(s) for s, _ in found])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    shingles = np.concatenate([s for s, _ in found])
    log_s = np.log(np.concatenate([w for _, w in found]))
    owner = np.repeat(np.arange(len(found)), sizes)
    out = np.empty((len(found), samples), np.uint64)
    low = np.uint64(_TABLE - 1)
    for k in range(samples):
        x = (shingles ^ _FACTORS[k]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        r, b = scale[x & low], shift[(x >> np.uint64(16)) & low]
        t = np.floor(log_s / r + b)
        a = log_c[(x >> np.uint64(48))] - r * (t - b + 1)
        best = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == best[owner])
        of = owner[hit]
        # ties: the smallest shingle, as they are sorted
        one = hit[np.concatenate([[True], of[1:] != of[:-1]])]
        out[:, k] = tokens.mix(shingles[one] + t[one].astype(np.int64).astype(np.uint64) * _FACTORS[63])
    return out


def _signatures(idf, bands: int, rows: int):
    """Maps batches of ``key, text`` to ``key, node, total, bands``; no words: no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, table = _draws(), idf.value
        power = _FACTORS[:rows]
        for batch in batches:
            keys, node, total, band = batch.column(0), [], [], []
            held, size = [], 0

            def flush():
                nonlocal held, size
                if held:
                    drawn = weighted_samples(held, bands * rows, draws).reshape(len(held), bands, rows)
                    band.extend(tokens.mix((drawn * power).sum(axis=2)).view(np.int64).tolist())
                held, size = [], 0

            for _, words, shingles, counts in _documents(batch.column(1).to_pylist()):
                if not len(words):
                    flush()
                    node.append(None), total.append(0.0), band.append(None)
                    continue
                weights = _weights(shingles, counts, table)
                node.append(_digest(words)), total.append(float(weights.sum(dtype=np.float64)))
                held.append((shingles, weights))
                size += len(shingles)
                if size >= 40_000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(node, pa.string()), pa.array(total, pa.float64()), pa.array(band, pa.list_(pa.int64()))],
                names=["key", "node", "total", "bands"])

    return run


def _similar(idf, threshold: float):
    """Maps batches of ``a, b, text_a, text_b`` to those of weighted Jaccard similarity at or above ``threshold``."""

    def vector(text, table):
        (_, _, shingles, counts), = _documents([text])
        return shingles, _weights(shingles, counts, table).astype(np.float64)

    def run(batches):
        table, last, kept = idf.value, None, None
        for batch in batches:
            out = []
            for a, b, left, right in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != last:
                    last, kept = a, vector(left, table)
                (s, w), (s2, w2) = kept, vector(right, table)
                _, i, j = np.intersect1d(s, s2, assume_unique=True, return_indices=True)
                common = np.minimum(w[i], w2[j]).sum()
                out.append(common >= threshold * (w.sum() + w2.sum() - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    return run


def similar_blocks(left: list, right: list | None, threshold: float, columns: int = 4096) -> list[tuple[int, int]]:
    """Positions of all pairs of ``left`` and ``right`` (None: of ``left`` itself, each pair once) at or above ``threshold``.

    A document is its distinct shingles, counts and the shingles' idf.  The n-th occurrence of a shingle is a column of its own, so the sum of
    minima is a product of 0/1 matrices weighted by idf.
    """
    both = left + (right or [])
    marks, weights, owner = [], [], []
    for at, (shingles, counts, idf) in enumerate(both):
        copies = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(copies)) - np.repeat(np.cumsum(counts) - counts, counts)
        marks.append(tokens.mix(shingles[copies] + nth.astype(np.uint64) * _FACTORS[62]))
        weights.append(idf[copies].astype(np.float64))
        owner.append(np.full(len(copies), at))
    totals = np.array([w.sum() for w in weights])
    marks, weights, owner = np.concatenate(marks), np.concatenate(weights), np.concatenate(owner)
    _, first, column, times = np.unique(marks, return_index=True, return_inverse=True, return_counts=True)
    # a column that one document alone has adds to no pair
    place = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    rows, at, weight = owner[shared], place[column[shared]], weights[first][times > 1]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    n = len(left)
    common = np.zeros((n, len(right) if right else n))
    for low in range(0, len(weight), columns):
        part = slice(*np.searchsorted(at, [low, low + columns]))
        matrix = np.zeros((len(both), min(columns, len(weight) - low)), np.float32)
        matrix[rows[part], at[part] - low] = 1
        common += (matrix[:n] * weight[low : low + columns].astype(np.float32)) @ (matrix[n:] if right else matrix).T
    needed = threshold * (totals[:n, None] + (totals[n:] if right else totals)[None, :] - common)
    # single precision only picks; the picked pairs are added up in double precision
    picked = np.argwhere(common >= needed * (1 - 1e-4))
    out = []
    for i, j in picked.tolist():
        a, b = both[i], both[n + j if right else j]
        if right or i < j:
            _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
            exact = (np.minimum(a[1][x], b[1][y]) * a[2][x].astype(np.float64)).sum()
            if exact >= threshold * (totals[i] + totals[n + j if right else j] - exact) - 1e-9:
                out.append((i, j))
    return out


def _block_links(idf, threshold: float):
    """Maps the members of two parts of a band (``node, root, part, i, j, text``) to links ``a, b`` across roots."""

    def run(members: pd.DataFrame) -> pd.DataFrame:
        table = idf.value
        i, j = members["i"].iloc[0], members["j"].iloc[0]
        members = members.sort_values("node")
        sides = [members[members["part"] == p] for p in ((i,) if i == j else (i, j))]
        described = []
        for side in sides:
            found = [(s, c, table[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]) for _, _, s, c in _documents(side["text"].tolist())]
            described.append(found)
        out = []
        if all(described):
            pairs = similar_blocks(described[0], described[1] if len(described) > 1 else None, threshold)
            nodes, roots = [s["node"].tolist() for s in sides], [s["root"].tolist() for s in sides]
            out = [tuple(sorted((nodes[0][x], nodes[-1][y]))) for x, y in pairs if roots[0][x] != roots[-1][y]]
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return run


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, bands: int = 12,
                    rows: int = 3, pivot_rounds: int = 3, row: str | None = None) -> DataFrame:
    """A row per row of ``docs``: ``key, class_id, kept``.

    ``class_id`` is the smallest key of the documents linked by similarities of at
    least ``threshold``, directly or through others; ``kept`` marks that document.  Texts of the same words are
    always one class.  Null, empty and wordless texts are near nothing and stay, each its own class; a null key
    is never a class id where another is at hand.  Rows that repeat a kept key are all kept.  With ``row``, a column of
    distinct row numbers, exactly one row of a class is kept, of those with the smallest key the one of least number, and
    ``row`` is returned too.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    # the smallest (key is null, key, row number) stands for its class; the text's hash keeps rows of one id, or of none, apart in joins
    number = F.col(row).cast("long") if row else F.lit(None).cast("long")
    own = F.struct(
        F.col(key).isNull().alias("absent"), F.col(key).alias("id"), number.alias("number"), F.xxhash64(F.col(text).cast("string")).alias("mark")
    )
    plain = docs.select(own.alias("key"), F.col(text).cast("string").alias("text"))
    kind = f"struct<absent:boolean,id:{docs.schema[key].dataType.simpleString()},number:bigint,mark:bigint>"
    idf = spark.sparkContext.broadcast(slot_idf(plain))
    signed = keep(
        plain.mapInArrow(_signatures(idf, bands, rows), f"key {kind}, node string, total double, bands array<bigint>"),
        "signatures",
    )
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min("key").alias("key"), F.max("total").alias("total"), F.max("bands").alias("bands")
    )
    nodes = keep(nodes, "nodes", signed.count())
    banded = nodes.select("node", "total", F.posexplode("bands").alias("no", "value")).select(
        F.xxhash64("no", "value").alias("band"), "node", "total"
    )
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    all_nodes = nodes.count()
    members = keep(banded.join(shared, "band"), "members", bands * all_nodes)
    all_members = members.count()
    wanted = members.select("node").distinct().join(nodes.select("node", "key"), "node")
    texts = keep(_texts(plain, wanted), "texts", all_nodes, TEXTS_A_FILE)

    def links_among(pairs: DataFrame, name: str) -> DataFrame:
        close = pairs.select("a", "b").distinct()
        first = close.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        both = first.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        # rows in the order of a, as the join leaves them, let one vector serve many pairs
        return keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(idf, threshold), "a string, b string"), name, all_members, TEXTS_A_FILE)

    near = F.least("total_a", "total_b") >= F.greatest("total_a", "total_b") * threshold * (1 - 1e-6)

    def pairs_of(left: DataFrame, right: DataFrame, apart) -> DataFrame:
        a = left.select("band", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("total").alias("total_a"))
        b = right.select("band", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("total").alias("total_b"))
        return a.join(b, "band").where(apart & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    links, placed = None, members.withColumn("root", F.col("node"))
    for turn in range(pivot_rounds):
        # the first round takes the smallest node of a band, the later ones one chosen by hash
        order = F.struct(F.lit(0).cast("long") if not turn else F.xxhash64("node", "band", F.lit(turn)), "node", "root", "total")
        pivots = placed.groupBy("band").agg(F.min(order).alias("p")).select("band", "p.node", "p.root", "p.total")
        found = links_among(pairs_of(pivots, placed, F.col("root_a") != F.col("root_b")), "links")
        links = found if links is None else links.unionByName(found)
        placed = _unlinked(members, components(links), all_members)
    small = placed.where(F.col("n") <= SMALL)
    rest = links_among(pairs_of(small, small, F.col("root_a") < F.col("root_b")), "links")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = placed.where(F.col("n") > SMALL).withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    dealt = dealt.select("band", "node", "root", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    blocks = dealt.join(texts, "node").groupBy("band", "i", "j").applyInPandas(_block_links(idf, threshold), "a string, b string")
    roots = components(links.unionByName(rest).unionByName(keep(blocks, "block-links")))
    classes = nodes.join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.col("key").alias("own")
    )
    classes = keep(classes, "classes", all_nodes)
    smallest = classes.groupBy("root").agg(F.min("own").alias("best"))
    named = classes.join(smallest, "root").select("node", "best")
    met = signed.select("key", "node").join(named, "node", "left").withColumn("best", F.coalesce("best", "key"))
    kept = F.col("key.number") == F.col("best.number") if row else F.col("key.id").eqNullSafe(F.col("best.id"))
    return met.select(
        F.col("key.id").alias(key), F.col("best.id").alias("class_id"), kept.alias("kept"), *([F.col("key.number").alias(row)] if row else [])
    )


def _unlinked(members: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """The members of bands that are not yet linked throughout, with their ``root`` and the band's size ``n``."""
    placed = keep(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed", most)
    apart = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low != high")
    return keep(placed.join(apart.select("band", "n"), "band"), "unlinked", most)


def _texts(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes, each once."""

    def check(batches):
        for batch in batches:
            keep_row = [False] * batch.num_rows
            nodes = batch.column(0).to_pylist()
            for i, words, _, _ in _documents(batch.column(1).to_pylist()):
                keep_row[i] = _digest(words) == nodes[i]
            yield batch.filter(pa.array(keep_row, pa.bool_()))

    met = plain.join(wanted.select("key", "node"), "key")
    # equal keys are rows of one id and one text's hash: those of another node go
    return met.select("node", "text").mapInArrow(check, "node string, text string").groupBy("node").agg(F.min("text").alias("text"))
