"""Raking and sampling against numpy, on tables with clashing columns, missing ids and targets that cannot be met."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from quoteflow.llm import mixing
from rows_llm import no_documents

TEXTS = {"licence": "Licensed under x", "contact": "a@b.c y", "table": "| | | | | z", "link": "http://q r", "markup": "### s", "prose": "just words here"}


def documents(spark, n=240, langs=3):
    topics = list(TEXTS)
    rows = [(i if i % 9 else None, TEXTS[topics[i * i % 6]] + " w" * (i % 11) + f" {i}", f"l{i % langs}", f"s{i % 5 if i % 2 else 0}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def plain_rake(cells, goals, rounds):
    """Cells ``(source, lang, topic) -> tokens`` fitted margin by margin, sources once more at the end."""
    weight = dict.fromkeys(cells, 1.0)
    for turn in range(rounds + 1):
        for axis, goal in enumerate(goals if turn < rounds else goals[:1]):
            now = dict.fromkeys(goal, 0.0)
            for cell, n in cells.items():
                now[cell[axis]] += n * weight[cell]
            weight = {c: w * (goal[c[axis]] / now[c[axis]] if now[c[axis]] else 0.0) for c, w in weight.items()}
    return weight


def plain_goals(cells, exponent, targets):
    total, goals = sum(cells.values()), []
    for axis, name in enumerate(("source", "lang", "topic")):
        margin = {}
        for cell, n in cells.items():
            margin[cell[axis]] = margin.get(cell[axis], 0) + n
        part = {k: targets[name].get(k, 0.0) if name in targets else n**exponent for k, n in margin.items()}
        goals.append({k: v / sum(part.values()) * total for k, v in part.items()})
    return goals


def cells_of(mixed):
    cells, weights = {}, {}
    for r in mixed.select("source", "lang", "topic", "tokens", "weight").collect():
        key = (r["source"], r["lang"], r["topic"])
        cells[key] = cells.get(key, 0) + r["tokens"]
        weights[key] = r["weight"]
    return cells, weights


@pytest.mark.parametrize("most", [10_000, 3])
@pytest.mark.parametrize("targets", [{}, {"lang": {"l0": 0.6, "l1": 0.3, "l2": 0.1}, "topic": dict(zip(TEXTS, (1, 1, 2, 1, 1, 4)))}])
def test_weights_equal_numpy(spark, most, targets):
    """With ``most`` pairs of language and topic, the languages' factors are a table of their own."""
    mixed = mixing.mix(documents(spark), targets=targets, rounds=4, tolerance=1e-13, most_margins=most)
    cells, found = cells_of(mixed)
    expected = plain_rake(cells, plain_goals(cells, 0.9, targets), 4)
    assert all(found[c] == pytest.approx(expected[c], rel=1e-9) for c in cells)


def test_many_languages_are_no_error(spark):
    docs = documents(spark, 120, langs=40)
    few, many = (mixing.mix(docs, most_margins=m, rounds=3).select("text", F.round("weight", 7)) for m in (10_000, 10))
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


@pytest.mark.parametrize("targets", [{"lang": {"l0": 0.9999999, "l1": 0.0000001}}, {"lang": {"l0": 1.0}}, {}])
@pytest.mark.parametrize("budget", [0.1, 0.5])
def test_the_budget_is_met_exactly(spark, budget, targets):
    rows = mixing.mix(documents(spark, 60), targets=targets, budget=budget, rounds=3).select("tokens", "weight", "probability").collect()
    tokens, weight, chance = (np.array([float(r[c]) for r in rows]) for c in ("tokens", "weight", "probability"))
    reachable = tokens[weight > 0].sum()
    assert (tokens * chance).sum() == pytest.approx(min(budget * tokens.sum(), reachable), rel=1e-9)
    assert (chance[weight == 0] == 0).all()


def test_targets_that_cells_cannot_meet(spark):
    rows = [(1, "a b c", "x", "p"), (2, "d e f", "y", "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    mixed = mixing.mix(docs, targets={"lang": {"x": 1.0, "z": 5.0}}, rounds=5).collect()
    # the source of the language without a share weighs nothing, and cannot be raised
    assert {r["lang"]: r["probability"] > 0 for r in mixed} == {"x": True, "y": False}
    assert all(np.isfinite(r["weight"]) and 0 <= r["probability"] <= 1 for r in mixed)


def test_columns_of_any_name_stay(spark):
    docs = documents(spark).withColumns({
        "Weight": F.lit("own"), "_source": F.lit(1), "_lang": F.lit(2), "cell_tokens": F.lit(3), "cell_source": F.lit("c"), "cell_lang": F.lit("d"),
        "doc": F.lit("e"), "draw": F.lit(0.0), "sampled": F.lit(None).cast("boolean"), "a.b": F.lit("dot"),
    })
    mixed = mixing.mix(docs, rounds=3)
    assert mixed.columns == [c for c in docs.columns if c not in ("Weight", "sampled")] + list(mixing.NEW)
    kept = mixing.sample(docs, rounds=3)
    assert kept.columns == docs.columns and kept.select("Weight").distinct().collect()[0][0] == "own"
    assert kept.count() == mixed.where("sampled").count() < docs.count()


def test_rows_without_id_are_drawn_apart(spark):
    docs = spark.range(400).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    assert 150 < mixing.sample(docs, budget=0.5).count() < 250
    assert mixing.sample(no_documents(spark)).count() == 0
