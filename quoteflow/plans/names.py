"""Search in names by trigrams: which rows to read is decided on an index of distinct names.

The index holds a row per distinct name and run of three of its characters, sorted by
the run, so that a lookup reads the row groups of the text's own runs.  Names that have all of them are
checked for the text itself; only their rows are then read from the serving table, by exact names that reach the
parquet reader.  A text of fewer than three characters is looked for in the distinct names themselves, which the index holds once
each under the empty run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, normalize_text
from ..sources.tables import publish, read_table
from .serving import DEFAULT_LIMIT, DEFAULT_SUGGESTIONS, MAX_LIMIT, SUGGESTION_LIMIT, search, suggest

#: Exact names that go into a filter as literals; more are joined.
LITERALS = 1000


def trigrams(text: str) -> list[str]:
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def _grams(text: Column) -> Column:
    """The distinct runs of three characters, and the empty one."""
    runs = F.transform(F.sequence(F.lit(1), F.char_length(text) - 2), lambda i: F.substr(text, i, F.lit(3)))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.when(F.char_length(text) >= 3, runs).otherwise(F.array().cast("array<string>"))))


def name_index(rows: DataFrame, *columns: str) -> DataFrame:
    """``gram, column, name``: every run of every distinct value of the columns, upper and lower case alike; nulls and empty names have none."""
    parts = [rows.select(F.lit(c).alias("column"), F.col(c).alias("name")).filter(F.coalesce("name", F.lit("")) != "").distinct() for c in columns]
    names = parts[0]
    for part in parts[1:]:
        names = names.unionByName(part)
    return names.select(F.explode(_grams(F.upper("name"))).alias("gram"), "column", "name")


def load_name_index(spark: SparkSession, gold: str, table: str, *columns: str) -> str:
    """The index of a serving table, published sorted by run."""
    index = name_index(read_table(spark, gold), *(columns or ("stock_name",)))
    return publish(index.repartitionByRange("gram", "name"), table, sort_by=["gram"])


def names_with(index: DataFrame, text: str, column: str = "stock_name", key=F.upper) -> DataFrame:
    """The distinct names that hold the (upper-case) text."""
    own, grams = index.filter(F.col("column") == column), trigrams(text)
    if not grams:
        found = own.filter(F.col("gram") == "").select("name")
    else:
        met = own.filter(F.col("gram").isin(grams)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        found = met.filter(F.col("n") == len(grams)).select("name")
    return found.filter(key(F.col("name")).contains(F.lit(text)))


def rows_named(rows: DataFrame, names: DataFrame, column: str = "stock_name") -> DataFrame:
    """The rows of these names: by literals, which the reader uses to leave row groups out, or by a join where the names are many."""
    few = names.limit(LITERALS + 1).collect()
    if len(few) <= LITERALS:
        return rows.filter(F.col(column).isin([r["name"] for r in few]))
    return rows.join(names.withColumnRenamed("name", column), column, "left_semi")


def search_indexed(gold: DataFrame, index: DataFrame, query: str | None, limit: int = DEFAULT_LIMIT, max_limit: int | None = MAX_LIMIT) -> DataFrame:
    """``serving.search`` on the rows that the index finds; the text is literal.  No text holds for every name, so all rows are read then."""
    text = (query or "").strip().upper()
    wanted = rows_named(gold, names_with(index, text)) if text else gold
    return search(wanted, query, limit, max_limit=max_limit)


def suggest_indexed(
    catalog: DataFrame, index: DataFrame, query: str | None, limit: int = DEFAULT_SUGGESTIONS, max_limit: int | None = SUGGESTION_LIMIT
) -> DataFrame:
    """``serving.suggest`` on the entries whose code or name the index (of ``stock_code`` and ``stock_name``) finds."""
    text = normalize_text(query)
    if not text.strip():
        return catalog.limit(0)
    found = [names_with(index, text, c, normalize).select(F.col("name").alias(c)) for c in ("stock_code", "stock_name")]
    by_code, by_name = (catalog.join(names, names.columns[0], "left_semi") for names in found)
    entries = by_code.unionByName(by_name).distinct()
    return suggest(entries, query, limit, max_limit)
