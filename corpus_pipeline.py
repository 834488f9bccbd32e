"""A corpus pipeline of five stages: toxicity filter, exact and near deduplication, mixing, byte-level BPE.

Each stage reads the documents its predecessor kept, as written Parquet, and returns
a DataFrame; all but the last return the columns of the documents, whatever else they hold and however
they are named.  Stages decide by row: null and repeated ids, null, empty and very long texts are documents like any other. An
empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteflow.llm import byte_bpe, exact_dedup, minhash_dedup, mixing, toxicity
from quoteflow.llm.common import keep, table
from quoteflow.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; texts without words score as such and stay or go by that, rows without id are scored like others."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number, and the name of its column; the number is written, so it stays the row's."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _keep_only(numbered: DataFrame, decisions: DataFrame, row: str) -> DataFrame:
    """``numbered`` without the rows that ``decisions`` does not keep, and without the row number."""
    dropped = decisions.where(~F.col("kept")).select(row)
    return numbered.join(dropped, row, "left_anti").drop(row)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows of equal texts one stays, the longest original, whatever their ids."""
    numbered, row = _numbered(docs)
    return _keep_only(numbered, exact_dedup.exact_groups(numbered, row=row), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, whatever their ids."""
    numbered, row = _numbered(docs)
    return _keep_only(numbered, minhash_dedup.near_duplicates(numbered, row=row), row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked source, language and topic shares; null sources and languages are parts of their own, rows without id are drawn
    by their text, texts without words weigh nothing."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row per document; a null or empty text has no tokens."""
    return byte_bpe.encode(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte bpe", encode),
]

#: Boosted trees, sampled bands and raking are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
