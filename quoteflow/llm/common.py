"""What the operators share: reading the tables and cutting lineage with written ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the cluster's checkpoint folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows does not depend on lost executors.

    With ``rows``, the most it can have, the files are at most so many that each may hold ``per_file``, or two a core of the cluster: narrow tables
    written again and again are no heaps of tiny files, whatever the number of shuffle partitions.
    """
    path = new_folder(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // per_file))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int, seed: int) -> DataFrame:
    """At most ``per_class`` training ids of each class, those of smallest hash, with the weight that restores the
    classes' shares: ``doc_id, label, weight``.  An id with two labels counts as its larger one."""
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id", modulus, remainder))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
        part = part.withColumn("weight", F.lit(max(1.0, totals.get(value, 0) / per_class)))
        picked = part if picked is None else picked.unionByName(part)
    return picked


def sample_texts(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """``wanted`` (a bounded table of ids, ``doc_id`` and more) with the ``text`` of each id.

    An id that stands in several rows gives one row, with the least of its texts, so the result is as bounded as ``wanted``.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(wanted), "doc_id")
    others = [c for c in wanted.columns if c != "doc_id"]
    return rows.groupBy("doc_id", *others).agg(F.min("text").alias("text")).select("doc_id", "text", *others)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` whose ``n`` is at or above the least value that leaves at most ``most`` rows.

    The value comes from a histogram of some two thousand buckets (exact below 1,024), so no task or driver sees more than ``most`` rows.
    """
    n = F.col("n")
    bucket = F.when(n < 1024, n).otherwise(1024 + F.floor(F.log(n / 1024) * 64)).cast("long")
    sizes = {r["bucket"]: r["size"] for r in counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("size")).collect()}
    total, least = 0, None
    for value in sorted(sizes, reverse=True):
        total += sizes[value]
        if total > most:
            break
        least = value
    return counts.where(F.lit(False) if least is None else bucket >= least)
