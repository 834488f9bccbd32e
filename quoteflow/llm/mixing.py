"""Mixing documents to target weights by iterative proportional fitting, in DataFrame operations only.

The tokens of every (source, language, topic) cell are summed once; raking then works on
cells alone.  A round is one job: each source's factor is set from its own cells, and the sums over
sources come back as one number for each (language, topic), a table of at most ``most_margins``
rows, on which the language and topic factors are set.  Where languages and topics make more pairs than that, the factors of
languages are a table as well, written each round, and only the topics' come back: the same steps, in two jobs a round.
Sources may be any number; they never leave the cluster.
A document's weight is its cell's.  Its chance of being sampled is min(1, c * weight), with the c at
which the expected tokens are the ``budget`` share of all.  They grow with c along a line that bends where a cell reaches
probability 1, so going from bend to bend along the line's own slope ends at the exact c after a few jobs over the cells.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

WORDS = r"[^\x20\x09-\x0D]+"

TOPICS = ("licence", "contact", "table", "link", "markup", "prose")


#: What tells the topics apart.
NOTICES = ("Licensed under", "All rights reserved", "Copyright")
MARKS = ("###", "***", "%%%", "&&&", "$$$")


def topic(text: Column) -> Column:
    """The topic of a text by its form, the first of ``TOPICS`` that holds.  Every test is linear in the text's length."""
    holds = lambda parts: reduce(Column.__or__, [text.contains(p) for p in parts])
    return (
        F.when(holds(NOTICES), "licence")
        .when(text.contains("@") & text.rlike(r"\w@\w+\.\w"), "contact")
        .when(F.char_length(text) - F.char_length(F.translate(text, "|", "")) >= 5, "table")
        .when(holds(("http://", "https://")), "link")
        .when(holds(MARKS), "markup")
        .otherwise("prose")
    )


def tempered(margin: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares proportional to tokens to the power ``exponent``: below 1, large parts shrink."""
    powered = {k: v**exponent for k, v in margin.items()}
    whole = sum(powered.values()) or 1.0
    return {k: v / whole for k, v in powered.items()}


NEW = ("tokens", "topic", "weight", "probability", "sampled")


def mix(docs: DataFrame, exponent: float = 0.9, targets: dict[str, dict[str, float]] | None = None, seed: int = 4,
        budget: float = 0.9, rounds: int = 100, tolerance: float = 1e-6, most_margins: int = 10_000) -> DataFrame:
    """``docs`` with ``tokens, topic, weight, probability, sampled``: a row per row, in columns beside its own.

    ``targets`` holds target shares of tokens under ``lang`` and ``topic``; where it has none, and for sources, the target is
    the tokens' own share to the power ``exponent``, made to sum to 1.  Raking sets source, then language, then topic margins, until no
    factor moves by more than ``tolerance`` or ``rounds`` are done.  ``weight`` is the raked weight of a token,
    ``probability`` the chance that makes the expected tokens ``budget`` of all, ``sampled`` a draw by a hash of doc_id (of the text, where that is null) and ``seed``.

    Null sources, languages and texts are parts of their own (``""``); a text without words has no tokens and its cell's weight, or
    probability 1 where the cell has no token at all.  A part with target 0 is never sampled; targets that its cells cannot meet are met as far as the last
    round got.  Rows that repeat an id are drawn alike.  An empty table gives no rows.
    Columns named like the new ones are replaced, others stay whatever their names.
    """
    kept = [f"doc.`{c}`" for c in docs.columns if c.lower() not in NEW]
    return _mixed(docs, exponent, targets, seed, budget, rounds, tolerance, most_margins).select(*kept, *NEW)


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` samples, with their own columns only."""
    return _mixed(docs, **options).where("sampled").select("doc.*")


def _mixed(docs: DataFrame, exponent: float = 0.9, targets: dict[str, dict[str, float]] | None = None, seed: int = 4,
           budget: float = 0.9, rounds: int = 100, tolerance: float = 1e-6, most_margins: int = 10_000) -> DataFrame:
    """``doc``, a row's own columns as one, and the new ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    drawn = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), "doc_id")).otherwise(F.xxhash64(F.lit(seed), F.lit("text"), text))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("tokens"),
        topic(text).alias("topic"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        (drawn.bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))).alias("draw"),
    )
    cells = keep(marked.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "cells")
    factors = keep(rake(cells, exponent, targets or {}, rounds, tolerance, most_margins), "cell-weights")
    scale = calibrated(factors, budget)
    # Spark broadcasts the cells where they are below its size limit, and shuffles beyond it
    met = marked.join(factors, (F.col("source") == F.col("cell_source")) & (F.col("lang") == F.col("cell_lang")) & (F.col("topic") == F.col("cell_topic")), "left")
    chance = F.coalesce(F.least(F.col("weight") * scale, F.lit(1.0)), F.lit(1.0))
    return met.withColumn("probability", chance).select(
        "doc", "tokens", "topic", "weight", "probability", (F.col("draw") < F.col("probability")).alias("sampled")
    )


def _goals(margin: DataFrame, column: str, total: float, exponent: float, wanted: dict[str, float] | None) -> DataFrame:
    """``column, n, goal`` from a margin's ``column, n``: the tokens that each part is to weigh."""
    if wanted is None:
        part = F.pow("n", F.lit(exponent))
    else:
        shares = F.from_json(F.lit(json.dumps(wanted)), "map<string,double>")
        part = F.coalesce(F.element_at(shares, F.col(column)), F.lit(0.0))
    parts = margin.withColumn("part", part)
    whole = parts.agg(F.sum("part")).first()[0] or 1.0
    return parts.select(column, "n", (F.col("part") / whole * total).alias("goal"))


def _moved(old: float, new: float) -> float:
    return abs(new - old) / max(abs(old), 1e-300) if old or new else 0.0


def rake(cells: DataFrame, exponent: float, targets: dict[str, dict[str, float]], rounds: int, tolerance: float, most: int) -> DataFrame:
    """Cells ``source, lang, topic, tokens`` to ``cell_source, cell_lang, cell_topic, cell_tokens, weight``."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    margins = {c: cells.groupBy(c).agg(F.sum("tokens").cast("double").alias("n")) for c in ("lang", "topic")}
    topic_rows = _goals(margins["topic"], "topic", total, exponent, targets.get("topic")).collect()
    langs = _goals(margins["lang"], "lang", total, exponent, targets.get("lang"))
    if margins["lang"].count() * len(topic_rows) > most:
        return _rake_many(cells, exponent, langs, topic_rows, total, rounds, tolerance)
    goal = {"topic": {r["topic"]: r["goal"] for r in topic_rows}, "lang": {r["lang"]: r["goal"] for r in langs.collect()}}
    by_source = cells.groupBy("source").agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent)).alias("part"))
    scale = total / (by_source.agg(F.sum("part")).first()[0] or 1.0)
    by_source = keep(by_source.withColumn("goal", F.col("part") * scale).drop("part"), "source-goals")

    def factored(a, b):
        """Cells with ``f``, the factor of their language and topic, and ``s``, the one of their source."""
        table = json.dumps({f"{x}\x00{y}": a[x] * b[y] for x in a for y in b})
        factor = F.element_at(F.from_json(F.lit(table), "map<string,double>"), F.concat("lang", F.lit("\x00"), "topic"))
        found = cells.withColumn("f", factor)
        sums = found.groupBy("source").agg(F.sum(F.col("tokens") * F.col("f")).alias("now")).join(by_source, "source")
        return found.join(sums.select("source", F.coalesce(F.try_divide("goal", "now"), F.lit(0.0)).alias("s")), "source")

    a, b = dict.fromkeys(goal["lang"], 1.0), dict.fromkeys(goal["topic"], 1.0)
    for _ in range(rounds):
        sums = factored(a, b).groupBy("lang", "topic").agg(F.sum(F.col("tokens") * F.col("s")).alias("n")).collect()
        row = dict.fromkeys(a, 0.0)
        for r in sums:
            row[r["lang"]] += (r["n"] or 0.0) * b[r["topic"]]
        new_a = {k: goal["lang"][k] / row[k] if row[k] else 0.0 for k in a}
        column = dict.fromkeys(b, 0.0)
        for r in sums:
            column[r["topic"]] += (r["n"] or 0.0) * new_a[r["lang"]]
        new_b = {k: goal["topic"][k] / column[k] if column[k] else 0.0 for k in b}
        moved = max((_moved(old, new) for olds, news in ((a, new_a), (b, new_b)) for old, new in zip(olds.values(), news.values())), default=0.0)
        a, b = new_a, new_b
        if moved <= tolerance:
            break
    return factored(a, b).select(
        F.col("source").alias("cell_source"), F.col("lang").alias("cell_lang"), F.col("topic").alias("cell_topic"),
        F.col("tokens").alias("cell_tokens"), (F.col("f") * F.col("s")).alias("weight"),
    )


def _rake_many(cells: DataFrame, exponent: float, langs: DataFrame, topic_rows: list, total: float, rounds: int, tolerance: float) -> DataFrame:
    """The same with the languages' factors in a table of their own; topics are as many as ``TOPICS``."""
    by_source = keep(_goals(cells.groupBy("source").agg(F.sum("tokens").cast("double").alias("n")), "source", total, exponent, None), "source-goals")
    langs = keep(langs.select("lang", "goal"), "lang-goals")
    a = keep(langs.withColumn("a", F.lit(1.0)), "lang-factors")
    b = {r["topic"]: 1.0 for r in topic_rows}

    def weighed(a: DataFrame, b: dict[str, float]) -> DataFrame:
        """Cells with ``a``, ``b`` and ``s``, the factors of their language, topic and source."""
        factor = F.element_at(F.from_json(F.lit(json.dumps(b)), "map<string,double>"), F.col("topic"))
        found = cells.join(a.select("lang", "a"), "lang").withColumn("b", factor)
        sums = found.groupBy("source").agg(F.sum(F.col("tokens") * F.col("a") * F.col("b")).alias("now")).join(by_source, "source")
        return found.join(sums.select("source", F.coalesce(F.try_divide("goal", "now"), F.lit(0.0)).alias("s")), "source")

    for _ in range(rounds):
        found = weighed(a, b)
        sums = found.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("s") * F.col("b")).alias("now"))
        new_a = sums.join(a, "lang").select("lang", "goal", F.coalesce(F.try_divide("goal", "now"), F.lit(0.0)).alias("a"), F.col("a").alias("old"))
        new_a = keep(new_a, "lang-factors")
        placed = found.drop("a").join(new_a.select("lang", "a"), "lang")
        now = {r["topic"]: r["n"] or 0.0 for r in placed.groupBy("topic").agg(F.sum(F.col("tokens") * F.col("s") * F.col("a")).alias("n")).collect()}
        new_b = {r["topic"]: r["goal"] / now[r["topic"]] if now.get(r["topic"]) else 0.0 for r in topic_rows}
        step = F.when((F.col("a") == 0) & (F.col("old") == 0), 0.0).otherwise(F.abs(F.col("a") - F.col("old")) / F.greatest(F.abs("old"), F.lit(1e-300)))
        moved = max([_moved(b[k], new_b[k]) for k in b] + [new_a.agg(F.max(step)).first()[0] or 0.0])
        a, b = new_a, new_b
        if moved <= tolerance:
            break
    return weighed(a, b).select(
        F.col("source").alias("cell_source"), F.col("lang").alias("cell_lang"), F.col("topic").alias("cell_topic"),
        F.col("tokens").alias("cell_tokens"), (F.col("a") * F.col("b") * F.col("s")).alias("weight"),
    )


def calibrated(factors: DataFrame, budget: float) -> float:
    """The scale c at which sum(tokens * min(1, c * weight)) is ``budget`` of sum(tokens), or the least c that gives every cell of some weight
    probability 1 if that is not enough."""
    tokens, weight = F.col("cell_tokens").cast("double"), F.col("weight")
    lowest, weighed, positive, every = factors.agg(
        F.min(F.when(weight > 0, weight)), F.sum(tokens * weight), F.sum(F.when(weight > 0, tokens)), F.sum(tokens)
    ).first()
    if lowest is None or budget * every >= positive:
        return 1.0 / (lowest or 1.0)
    scale = budget * every / weighed
    while True:
        # cells at probability 1 stay there as c grows; the others grow with it
        full = weight * scale >= 1
        sure, open_ = factors.agg(F.sum(F.when(full, tokens)), F.sum(F.when(~full, tokens * weight))).first()
        after = (budget * every - (sure or 0.0)) / open_ if open_ else scale
        if not after > scale * (1 + 1e-15):
            return scale
        scale = after
