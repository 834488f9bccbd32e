"""Periodic runs, the Merkle manifest and fingerprint links against plain brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from quoteflow.llm import merkle, periodic_runs, queries, simhash_dedup
from rows_llm import no_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ---


def plain_runs(words):
    """Every period of every stretch, word by word; a stretch keeps its smallest."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 4
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def periodic_text(rng):
    words = [f"w{rng.randrange(rng.choice([1, 2, 3, 500]))}" for _ in range(rng.randint(0, 300))]
    for _ in range(rng.randint(0, 4) if words else 0):
        a = rng.randrange(len(words))
        p, m = rng.randint(1, max(1, (len(words) - a) // 3)), rng.randint(0, len(words) - a)
        for i in range(a, a + m):
            words[i] = words[a + (i - a) % p]
    return rng.choice([" ", "\n", " \t "]).join(words)


def test_squared_differences_are_exact():
    random_numbers = np.random.Generator(np.random.PCG64(1))
    for size in (8, 64, 1 << 14, 1 << 15):
        values = int(periodic_runs._deal(np.arange(9 * size), size).max()) + 1
        blocks, windows = random_numbers.integers(0, values, (size, 3)), random_numbers.integers(0, values, (2 * size, 3))
        windows[5 : 5 + size, 1] = blocks[:, 1]
        found = periodic_runs.squared_differences(blocks, windows)
        for s in (0, 5, size):
            assert (found[s] == ((blocks - windows[s : s + size]) ** 2).sum(axis=0)).all()
        assert found[5, 1] == 0


def test_runs_of_many_texts_at_once():
    rng = random.Random(5)
    for _ in range(25):
        texts = [w for w in ([int(x[1:]) for x in periodic_text(rng).split()] for _ in range(20)) if w]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        found = periodic_runs.find_runs(np.concatenate(texts), starts, ends).tolist()
        expected = [(s + a, s + a + n, q) for s, t in zip(starts.tolist(), texts) for a, n, q in plain_runs(t)]
        assert [tuple(r) for r in found] == expected


def test_runs_of_long_periodic_texts():
    one = np.zeros(200_000, np.int64)
    assert periodic_runs.find_runs(one, np.array([0]), np.array([200_000])).tolist() == [[0, 200_000, 1]]
    # repeats that are no runs
    assert periodic_runs.find_runs(np.tile(np.arange(11), 2), np.array([0]), np.array([22])).tolist() == []
    assert periodic_runs.find_runs(np.concatenate([np.tile(np.arange(11), 2), np.arange(50, 70)]), np.array([0]), np.array([42])).tolist() == []
    # a period beyond 2^14 words takes the larger modulus
    period = np.arange(20_000)
    words = np.concatenate([[70_000], np.tile(period, 3), period[:77], [70_001]])
    assert periodic_runs.find_runs(words, np.array([0]), np.array([len(words)])).tolist() == [[1, 60_078, 20_000]]


def test_run_query_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, periodic_text(rng)) for i in range(300)] + [(None, "a b c " * 20), (7, None), (7, ""), (8, " \t\n"), (9, "x " * 500), (9, "x " * 500), (11, "ü\x1cü " * 30)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, words int, key string").repartition(3)
    found = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_repeats(docs))).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(plain_digest(i, t)) for i, t in rows)


def test_run_query_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_periodic_runs(spark, sf_dir).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(plain_digest(r["doc_id"], r["text"])) for r in rows)


# --- Merkle manifest ---


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return sha("".join(map(shown, row)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 16])))
        i //= 16
    return out


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {name: levels_of([leaf(r) for r in groups[name]]) for name in names}
    top = levels_of([trees[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path, node = path_of(trees[name], i) + path_of(top, at), leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                node = leaf((*row[:4], re.sub("[A-Z]", lambda m: m.group().lower(), row[4])))
            for left, right in path:
                node = sha(left + node + right)
            out.append((row[0], leaf(row), trees[name][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_manifest_equals_brute_force(spark, groups):
    names = [None, "", "b", "é", "z"] + [f"s{i:03}" for i in range(groups)]
    rows = [(i % 90 if i % 7 else None, names[i % len(names)] if i > 9 else f"alone{i}", None if i % 3 else "en", i % 4, None if i % 11 == 0 else "Ab Ü" * (i % 3)) for i in range(900)]
    rows += [(10, "hot", "en", 1, "Hot")] * 400
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    docs = spark.createDataFrame(rows, schema).repartition(6).withColumn("group", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("leaf", F.lit("x"))
    found = merkle.tampered_check(docs, FIELDS).collect()
    assert sorted(map(repr, map(tuple, found))) == plain_manifest(rows)


def test_manifest_of_odd_tables(spark):
    assert merkle.tampered_check(no_documents(spark), FIELDS).collect() == []
    docs = odd_documents(spark)
    found = merkle.tampered_check(docs, FIELDS).collect()
    assert sorted(map(repr, map(tuple, found))) == plain_manifest([tuple(r) for r in docs.select(FIELDS).collect()])
    one = spark.createDataFrame([(1, "a", "en", 2, "x")], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    row = merkle.tampered_check(one, FIELDS).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == sha("") and row["verified"]


def test_a_path_proves_its_leaf_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = merkle.manifest(docs, FIELDS, carry={"other": F.lit(sha("other"))})
    checks = rows.select((merkle.folded(F.col("path"), F.col("leaf")) == F.col("root")).alias("own"), (merkle.folded(F.col("path"), F.col("other")) == F.col("root")).alias("wrong"))
    assert {tuple(r) for r in checks.collect()} == {(True, False)}


# --- fingerprints ---


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints, distance=4):
    names = sorted(set(fingerprints))
    label = np.arange(len(names))
    values = np.array(names, np.uint64)
    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= distance):
            label[label == max(label[i], label[j])] = min(label[i], label[j])
    return dict(zip(names, label.tolist()))


def plain_rows(rows):
    found = [(i, plain_fingerprint(t)) for i, t in rows]
    group = plain_components([f for _, f in found])
    low = {}
    for i, f in found:
        low[group[f]] = min((x for x in (low.get(group[f]), i) if x is not None), default=None)
    return sorted(repr((i, f"{f:016x}", low[group[f]])) for i, f in found)


@pytest.mark.parametrize("piece", [40, 300, 1 << 20])
def test_fingerprint_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash_dedup, "PIECE", piece)
    for text in ("", "One", "one TWO\x0bthree", "Ab  c\td é Hello World " * 30 + "x" * 400 + " end of it all", "x" * 999 + " y", " \n" * 99):
        assert simhash_dedup.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_query_on_odd_rows(spark, sf_dir):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, simhash_dedup.near_duplicates(docs).collect()))) == plain_rows(rows)
    assert simhash_dedup.near_duplicates(no_documents(spark)).collect() == []
    empty = spark.createDataFrame([(None, None), (3, ""), (2, " ")], "doc_id bigint, text string")
    assert {tuple(r) for r in simhash_dedup.near_duplicates(empty).collect()} == {(i, "0" * 16, 2) for i in (None, 2, 3)}


def test_fingerprint_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, queries.op13_simhash_dedup(spark, sf_dir).collect()))) == plain_rows(rows)


def test_thresholds_add_up_at_least_cost():
    random_numbers = np.random.Generator(np.random.PCG64(2))
    costs = random_numbers.random((50, 3, 4)) * 100
    found = simhash_dedup.allocate(costs, 2)
    told = simhash_dedup.TOLD
    for row in range(50):
        options = [(a, b, c) for a in told for b in told for c in told if a + b + c == 2]
        price = {o: sum(costs[row, k, told.index(t)] for k, t in enumerate(o)) for o in options}
        assert price[tuple(found[row].tolist())] == pytest.approx(min(price.values()))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("spread", "hot", "light", "block"), [(400, 0, 1024, 4096), (200, 500, 5, 60)])
def test_links_equal_all_pairs(spark, spread, hot, light, block):
    """Scattered groups, and one of many fingerprints around a centre, with limits so small that values are cut into blocks."""
    rng = random.Random(hot)

    def near(x, bits):
        for _ in range(bits):
            x ^= 1 << rng.randrange(64)
        return x

    centre = rng.getrandbits(64)
    names = {near(centre, rng.randint(0, 9)) for _ in range(hot)}
    for _ in range(spread):
        x = rng.getrandbits(64)
        names |= {x} | {near(x, rng.randint(1, 7)) for _ in range(rng.randint(0, 3))}
    nodes = spark.createDataFrame([(signed(x), rng.randint(1, 5)) for x in names], "fp bigint, n bigint")
    found = {r["node"]: r["root"] for r in simhash_dedup.linked(nodes, light=light, block=block).collect()}
    groups = {}
    for x, g in plain_components(names).items():
        groups.setdefault(g, []).append(signed(x))
    assert found == {x: min(g) for g in groups.values() for x in g if x != min(g)}
