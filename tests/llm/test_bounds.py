"""Searches at the edges of their arithmetic and time."""

import random
import re
import time

import numpy as np
import pytest
from quoteflow.llm import nearest, secrets


@pytest.mark.parametrize("large", [1e150, 1e200, 1.7e308])
def test_products_beyond_doubles_are_ranked(spark, large):
    """Bounds that are no numbers keep a candidate: every query has its neighbours."""
    random_numbers = np.random.Generator(np.random.PCG64(3))
    vectors = random_numbers.normal(size=(60, 8))
    vectors[20:50, 0] = large
    vectors[0, 0] = large
    rows = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, q string, size int")
    found = {}
    for r in nearest.nearest(rows, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 20, 40):
        others = np.array([i for i in range(60) if i != q])
        scores = nearest.exact(vectors[q], vectors[others])
        order = np.lexsort((others, -scores))[:20]
        assert sorted(found[q]) == [(n + 1, int(others[i]), float(scores[i])) for n, i in enumerate(order)]


def test_tiny_vectors_are_ranked(spark):
    rows = spark.createDataFrame([(i, [5e-324 * (i + 1), 1e-310]) for i in range(30)], "vec_id bigint, embedding array<double>")
    assert nearest.nearest(rows, k=5).count() == 10


def test_runs_equal_the_plain_pattern():
    plain = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z_+/\-]*\d)[A-Za-z0-9][A-Za-z0-9_+/\-]{11,}={0,2}")
    rng = random.Random(2)
    for _ in range(5000):
        text = "".join(rng.choice("aB7-_/+= .٣") if rng.random() < 0.9 else rng.choice("abcdefgh1234") for _ in range(rng.randint(0, 60)))
        assert secrets.runs(text) == [m.span() for m in plain.finditer(text)]


@pytest.mark.parametrize("text", ["-" * 1_000_000, "a/" * 500_000, "a-" * 500_000 + "1"])
def test_long_runs_take_time_in_proportion(text):
    began = time.thread_time()
    secrets.candidates(text)
    assert time.thread_time() - began < 2
