"""Near-duplicate documents by fingerprints that differ in few bits, found by the generalised pigeonhole principle.

A fingerprint has 64 bits; bit b is one if it is set in over half the XXH64 hashes of
the document's runs of four words.  Fingerprints at most ``distance`` bits apart are linked.

The bits are dealt into m parts, correlated bits into one part.  With thresholds
t_1 + … + t_m = distance - m + 1 (-1: the part is left out), two fingerprints within
``distance`` differ by at most t_i bits in some part i: else they would differ by
more than the sum of (t_i + 1) - 1 bits.  Every fingerprint chooses its own
thresholds by dynamic programming, so that the values it has to look up and
the fingerprints it is likely to meet there are fewest: a part where its value is
a frequent one gets -1 or 0, others more.  It then looks up, in each part, all values within the threshold.

* Equal fingerprints are one node, so copies are one row from then on.
* Frequencies of part values are counted over all nodes; the most frequent ``VALUES`` of them go to the tasks exactly, the
  others by their mean.  They steer the choice only: whatever it is, no pair is missed.
* Where at most ``LIGHT`` nodes have a value, each node that looks it up is compared with them in a join.  Of a value of more
  nodes, it meets two at first (the one of most documents, and one by hash), and components are formed.  A value whose nodes
  are then all linked is done; in the others, the pairs not linked yet are compared in blocks of ``BLOCK`` by ``BLOCK``
  nodes, which give out a spanning forest of their links and never all pairs.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, most_frequent
from .components import components

BITS, WORDS, SEED = 64, 4, 42
#: Bytes of text hashed at once, part values known exactly in tasks, nodes of a value that a join compares with each node that asks, nodes of a block's side.
PIECE, VALUES, LIGHT, BLOCK = 1 << 20, 131_072, 1_024, 4_096
#: Thresholds that a part may have, and the numbers of parts that are weighed.
TOLD, PARTS = (-1, 0, 1, 2), (2, 3, 4, 5)
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Cost of a value looked up (a shuffled row), in pairs compared inside a join.
LOOKUP = 40.0


# --- fingerprints ---


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about PIECE bytes of it at a time; a word is never cut."""
    low = 0
    while len(data) - low > PIECE:
        high = low + PIECE
        # on to the end of the word that the cut would fall into
        end = _WHITE.search(data, high)
        if not end:
            break
        yield data[low : end.start()].split()
        low = end.start()
    yield data[low:].split()


def fingerprint(data: bytes) -> int:
    """Of a UTF-8 text, A-Z lower-cased: 0 where there is no word."""
    ones, total, carried = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _pieces(data.lower()):
        words = carried + words
        if len(words) < WORDS:
            carried = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[: -WORDS]])
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[WORDS - 1 :] - 1).tolist())]
        for at in range(0, len(hashes), 8192):
            part = np.array(hashes[at : at + 8192], np.uint64)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        carried = words[-(WORDS - 1) :]
    if not total:
        return digest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) if t else 0 for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp`` of each row; ``fp`` is the fingerprint as a signed number."""
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(_fingerprints, f"key {docs.schema[key].dataType.simpleString()}, fp bigint")


# --- parts of correlated bits ---


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bit i and bit j are both set (i = j: bit i), and the nodes."""
    both, nodes = np.zeros((BITS, BITS), np.int64), 0
    for batch in batches:
        values = batch.column(0).to_numpy()
        for low in range(0, len(values), 65_536):
            part = np.ascontiguousarray(values[low : low + 65_536])
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            nodes += len(part)
    if nodes:
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both[i, j], nodes))], names=["i", "j", "n"])


def correlation(nodes: DataFrame) -> np.ndarray:
    """Absolute correlation of each two bits over all nodes."""
    counted = nodes.select("fp").mapInArrow(_bit_counts, "i bigint, j bigint, n bigint")
    both, total = np.zeros((BITS, BITS)), 0
    for i, j, n in counted.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if i < 0:
            total = n
        else:
            both[i, j] = both[j, i] = n
    share = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return np.abs((both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))


def group_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` parts of about equal size: each begins with the bit most related to others and takes on the most related ones left."""
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        among = related[np.ix_(left, left)]
        part = [left[int((among.sum(axis=1) - np.diag(among)).argmax())]]
        while len(part) < size:
            rest = [b for b in left if b not in part]
            part.append(rest[int(related[np.ix_(rest, part)].mean(axis=1).argmax())])
        out.append(sorted(part))
        left = [b for b in left if b not in part]
    return out


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part, packed."""
    out = np.zeros(len(fps), np.int64)
    for place, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
    return out


def _masks(width: int, most: int) -> list[np.ndarray]:
    """For 0, 1, … ``most``: all patterns of ``width`` bits with exactly so many set."""
    return [np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), k)], np.int64) for k in range(most + 1)]


def _key(part: int, value):
    """Part and value as one number; a part has at most 32 bits."""
    return value + (part << 40)


# --- thresholds ---


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """The thresholds out of TOLD, one a part, that add up to ``total`` at the least cost: rows x parts.

    ``costs`` is rows x parts x len(TOLD).  Dynamic programming over the parts, all rows at once; ties go to the first found.
    """
    rows, parts, _ = costs.shape
    low, high = TOLD[0] * parts, TOLD[-1] * parts
    best = np.full((rows, high - low + 1), np.inf)
    best[:, -low] = 0
    picks = []
    for part in range(parts):
        after, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for at, told in enumerate(TOLD):
            shifted = np.full_like(best, np.inf)
            if told >= 0:
                shifted[:, told:] = best[:, : best.shape[1] - told]
            else:
                shifted[:, :told] = best[:, -told:]
            with_cost = shifted + costs[:, part, at][:, None]
            better = with_cost < after
            after, pick = np.where(better, with_cost, after), np.where(better, at, pick).astype(np.int8)
        best = after
        picks.append(pick)
    out, state = np.zeros((rows, parts), np.int64), np.full(rows, total - low)
    for part in range(parts - 1, -1, -1):
        told = np.array(TOLD)[picks[part][np.arange(rows), state]]
        out[:, part], state = told, state - told
    return out


def choose_parts(nodes: int, distance: int) -> int:
    """The number of parts that is cheapest if all values are equally frequent."""

    def cost(parts: int) -> float:
        widths = [BITS // parts + (k < BITS % parts) for k in range(parts)]
        balls = [[0.0] + list(itertools.accumulate(float(len(m)) for m in _masks(w, TOLD[-1]))) for w in widths]
        costs = np.array([[[b * (LOOKUP + nodes / 2**w) for b in ball] for ball, w in zip(balls, widths)]])
        picked = allocate(costs, distance - parts + 1)[0]
        return sum(costs[0, k, TOLD.index(t)] for k, t in enumerate(picked))

    return min((p for p in PARTS if TOLD[-1] * p >= distance - p + 1 >= TOLD[0] * p), key=cost)


def _choose(parts: list[list[int]], frequent: list[tuple[np.ndarray, np.ndarray, float]], distance: int):
    """Maps batches of ``fp, n`` to ``fp, n, told``: each node's thresholds, part by part."""
    masks = [_masks(len(p), TOLD[-1]) for p in parts]

    def estimate(values, part):
        """For each of TOLD: what looking up that many values costs, with the nodes expected there."""
        known, counts, rest = frequent[part]
        out, met = np.zeros((len(values), len(TOLD))), np.zeros(len(values))
        for k, mask in enumerate(masks[part]):
            for m in mask.tolist():
                near = values ^ m
                if len(known):
                    at = np.minimum(np.searchsorted(known, near), len(known) - 1)
                    met += np.where(known[at] == near, counts[at], rest)
                else:
                    met += rest
            met += LOOKUP * len(mask)
            out[:, k + 1] = met
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            costs = np.stack([estimate(_values(fps, p), k) for k, p in enumerate(parts)], axis=1)
            told = allocate(costs, distance - len(parts) + 1)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(told.ravel(), pa.int64()), len(parts)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=["fp", "n", "told"])

    return run


def _look_up(parts: list[list[int]]):
    """Maps batches of ``fp, root, told`` to ``value, fp, root``: all part values that a node has to look up."""
    masks = [_masks(len(p), TOLD[-1]) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                piece = batch.slice(low, 2048)
                fps, roots = (np.asarray(piece.column(i)) for i in range(2))
                told = piece.column(2).flatten().to_numpy().reshape(-1, len(parts))
                out = []
                for part, mask in enumerate(masks):
                    values = _values(fps.view(np.uint64), parts[part])
                    for radius in range(TOLD[-1] + 1):
                        who = np.flatnonzero(told[:, part] >= radius)
                        near = _key(part, (values[who][:, None] ^ mask[radius]).ravel())
                        out.append((near, np.repeat(who, len(mask[radius]))))
                who = np.concatenate([w for _, w in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([v for v, _ in out])), pa.array(fps[who]), pa.array(roots[who])], names=["value", "fp", "root"])

    return run


def _index(parts: list[list[int]]):
    """Maps batches of ``fp, root, n`` to ``value, fp, root, n``: the value of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for part, bits in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(_key(part, _values(fps, bits))), *batch.columns], names=["value", "fp", "root", "n"])

    return run


# --- links ---


def spanning_links(left: np.ndarray, left_root: np.ndarray, right: np.ndarray, right_root: np.ndarray, distance: int, step: int = 64) -> list[tuple[int, int]]:
    """A forest of links between roots that joins all that pairs of ``left`` and ``right`` at most ``distance`` bits apart join."""
    names, number = np.unique(np.concatenate([left_root, right_root]), return_inverse=True)
    label = np.arange(len(names))
    a, b = number[: len(left)], number[len(left) :]
    out = []
    for low in range(0, len(left), step):
        # pairs that the links so far have joined are left out
        apart = label[a[low : low + step]][:, None] != label[b][None, :]
        near = apart & (np.bitwise_count(left[low : low + step, None] ^ right[None, :]) <= distance)
        i, j = np.nonzero(near)
        pairs = np.unique(np.stack([label[a[low + i]], label[b[j]]], axis=1), axis=0) if len(i) else []
        for x, y in pairs:
            x, y = label[x], label[y]
            if x != y:
                out.append((int(names[x]), int(names[y])))
                label[label == max(x, y)] = min(x, y)
    return out


def _block_links(distance: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        asked = block["asks"].to_numpy()
        fps, roots = block["fp"].to_numpy().view(np.uint64), block["root"].to_numpy()
        links = spanning_links(fps[asked], roots[asked], fps[~asked], roots[~asked], distance)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def linked(nodes: DataFrame, distance: int = 4, light: int = LIGHT, block: int = BLOCK) -> DataFrame:
    """``node, root`` of the nodes (``fp, n``: fingerprints, each once, and their documents) that reach a smaller one; others are not listed.

    ``root`` is the smallest fingerprint, as a signed number, that is reached by links of at most ``distance`` bits.
    """
    total = nodes.count()
    if total < 2:
        return nodes.sparkSession.createDataFrame([], "node bigint, root bigint")
    parts = group_bits(correlation(nodes), choose_parts(total, distance))
    schema = "value bigint, fp bigint, root bigint"

    def held_in(rows: DataFrame) -> DataFrame:
        return rows.select("fp", "root", "n").mapInArrow(_index(parts), schema + ", n bigint")

    def asked_of(rows: DataFrame) -> DataFrame:
        return rows.select("fp", "root", "told").mapInArrow(_look_up(parts), schema)

    def close(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance

    def pairs(a: str, b: str) -> list:
        return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]

    held = held_in(nodes.withColumn("root", F.col("fp")))
    sizes = keep(held.groupBy("value").agg(F.count("*").alias("held")), "value-sizes")
    told = _choose(parts, _frequent(sizes, parts, total), distance)
    own = keep(nodes.select("fp", "n").mapInArrow(told, "fp bigint, n bigint, told array<bigint>").withColumn("root", F.col("fp")), "thresholds")

    # values of few nodes: every node that asks meets them all
    asked = asked_of(own).select("value", "fp")
    rare = held.join(sizes.where(F.col("held") <= light).select("value"), "value").select("value", F.col("fp").alias("other"))
    near = asked.join(rare, "value").where((F.col("fp") != F.col("other")) & close("fp", "other"))
    links = keep(near.select(*pairs("fp", "other")).distinct(), "links")
    frequent = keep(sizes.where(F.col("held") > light), "frequent-values")
    if frequent.isEmpty():
        return components(links)

    # values of many nodes: every node that asks meets two of them
    pivots = held.join(frequent.select("value"), "value").groupBy("value").agg(
        F.max(F.struct("n", "fp"))["fp"].alias("first"), F.min(F.struct(F.xxhash64("fp"), "fp"))["fp"].alias("second")
    )
    met = asked.join(pivots, "value").select("fp", F.explode(F.array("first", "second")).alias("other"))
    met = met.where((F.col("fp") != F.col("other")) & close("fp", "other"))
    links = links.unionByName(keep(met.select(*pairs("fp", "other")).distinct(), "pivot-links"))
    roots = components(links)

    # and where not all of a value's nodes are linked by then, the pairs that are not are compared in blocks
    placed = own.drop("root").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "told", F.coalesce("root", "fp").alias("root"))
    placed = keep(placed, "placed")
    asked = asked_of(placed).join(frequent.select("value"), "value")
    held = held_in(placed).join(frequent.select("value"), "value").select("value", "fp", "root")

    def summary(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("value").agg(F.count("*").alias(name), F.min("root").alias(f"{name}_low"), F.max("root").alias(f"{name}_high"))

    apart = F.least("held_low", "asked_low") != F.greatest("held_high", "asked_high")
    work = summary(held, "held").join(summary(asked, "asked"), "value").where(apart)
    slices = keep(work.select("value", *[F.ceil(F.col(c) / block).cast("int").alias(d) for c, d in (("held", "across"), ("asked", "down"))]), "slices")

    def dealt(rows: DataFrame, asks: bool, mine: str, others: str) -> DataFrame:
        """Each row in its own slice of its side, once for every slice of the other side."""
        met = rows.join(slices, "value").withColumn(mine + "_at", F.pmod(F.xxhash64("fp"), F.col(mine)).cast("int"))
        met = met.withColumn(others + "_at", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return met.select("value", "fp", "root", "across_at", "down_at", F.lit(asks).alias("asks"))

    blocks = dealt(asked, True, "down", "across").unionByName(dealt(held, False, "across", "down"))
    rest = blocks.groupBy("value", "across_at", "down_at").applyInPandas(_block_links(distance), "a bigint, b bigint")
    return components(links.unionByName(keep(rest.select(*pairs("a", "b")).distinct(), "block-links")))


def _frequent(sizes: DataFrame, parts: list[list[int]], total: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of each part, the most frequent values with their counts, and the mean count of the others."""
    kept = most_frequent(sizes.withColumnRenamed("held", "n"), VALUES).collect()
    out = []
    for part, bits in enumerate(parts):
        found = sorted((r["value"] - _key(part, 0), r["n"]) for r in kept if r["value"] >> 40 == part)
        rest = (total - sum(n for _, n in found)) / max(1, 2 ** len(bits) - len(found))
        out.append((np.array([v for v, _ in found], np.int64), np.array([n for _, n in found], np.float64), rest))
    return out


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = 4) -> DataFrame:
    """A row per row of ``docs``: ``key, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hexadecimal digits; a text of fewer than four words has one run, its words, and a null, empty
    or wordless text the fingerprint zero, which is linked like any other.  ``component_id`` is the smallest key of the
    documents reached by links of at most ``distance`` bits, itself included; a null key only where there is no other.
    Repeated rows stay rows.  An empty table gives no rows; other columns are not read.
    """
    found = keep(fingerprints(docs, text, key), "fingerprints")
    # min passes over null keys
    nodes = keep(found.groupBy("fp").agg(F.min("key").alias("key"), F.count("*").alias("n")), "nodes")
    roots = linked(nodes, distance)
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "key", F.coalesce("root", "fp").alias("root"))
    placed = keep(placed, "classes")
    smallest = placed.groupBy("root").agg(F.min("key").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return found.join(named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
