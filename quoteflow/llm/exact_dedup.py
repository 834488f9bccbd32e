"""Exact deduplication: groups of texts equal but for white space, in DataFrame operations only.

Copies are combined three times, and each time the whole normalised text is part
of the key, so equal digests of different texts never meet:

1. inside each task (the partial aggregate before the first shuffle),
2. over salted digest groups: the copies of one text go to ``salts`` tasks,
3. over the salt winners of a digest, at most ``salts`` rows a text.

A hot text therefore crosses each shuffle as one row per task or salt.  The
documents then meet their group by digest.  Should a digest ever stand for two
texts, those documents are joined on the text as well, in a branch of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 8,
                 digest: Callable[[Column], Column] = sha256, row: str | None = None) -> DataFrame:
    """A row per row of ``docs``: ``key, keep_id, group_size, kept, text_sha256``.

    The row with the most code points in the original text stays, then the one
    of smallest key (null keys last).  Rows that tie in both are one document
    listed more than once: all of them are kept.  With ``row``, a column of distinct row numbers, the
    least number decides such ties, exactly one row of a group is kept, and ``row`` is returned too.  Null and
    empty texts are equal.  An empty table gives no rows; other columns are not read.
    """
    plain = normalised(F.col(text))
    # the smallest (-length, key is null, key, row number) wins
    order = F.struct(
        (-F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("shorter"),
        F.col(key).isNull().alias("absent"),
        F.col(key).alias("id"),
        *([F.col(row).alias("row")] if row else []),
    )
    same_key = F.col("order.id").eqNullSafe(F.col("best.id")) & (F.col("order.shorter") == F.col("best.shorter"))
    # the shuffle keys are computed in the scan, so the sorts compare short digests before long texts
    rows = docs.select(
        digest(plain).alias("digest"), (F.xxhash64(key) % salts).alias("salt"), plain.alias("plain"), order.alias("order")
    )
    combine = [F.min("order").alias("order"), F.sum("n").alias("n")]
    salted = rows.withColumn("n", F.lit(1).cast("long")).groupBy("digest", "salt", "plain").agg(*combine)
    winners = salted.groupBy("digest", "plain").agg(*combine)
    groups = keep(
        winners.groupBy("digest").agg(F.min("order").alias("best"), F.sum("n").alias("size"), F.count("*").alias("texts")),
        "exact-groups",
    )
    members = rows.select("digest", "order")
    every = members.join(groups.where("texts = 1").drop("texts"), "digest")
    shared = groups.where("texts > 1").select("digest")
    if not shared.isEmpty():
        several = winners.join(shared, "digest", "left_semi").select("digest", "plain", F.col("order").alias("best"), F.col("n").alias("size"))
        apart = rows.select("digest", "plain", "order").join(several, ["digest", "plain"]).drop("plain")
        every = every.unionByName(apart)
    return every.select(
        F.col("order.id").alias(key),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("order.row") == F.col("best.row") if row else same_key).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *([F.col("order.row").alias(row)] if row else []),
    )
