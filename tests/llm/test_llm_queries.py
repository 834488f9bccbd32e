"""The registered queries: SQL counterparts, and the pipeline's stages."""

import collections

import compare
import corpus_pipeline
import pytest
from conftest import SF_DIR
from quoteflow.llm import queries
from rows_llm import BASE, NEAR, no_documents, odd_documents


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, SF_DIR)
    assert compare.differences(df, compare.connect(SF_DIR), queries.oracle_sql()[name]) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    whole = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.keep(stage(spark, docs, SF_DIR), "test")
        assert after.columns == docs.columns and 0.7 * docs.count() < after.count() <= docs.count()
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == docs.count() < whole


def grouped(rows, group):
    """Rows ``id is null, id, text`` of each group."""
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[group(text)].append((i is None, i or 0, text))
    return groups


#: Repeated rows, ids shared by several texts, and null ids; equal and near texts.
ROWS = [
    (1, "x"), (5, "x"), (5, "y"), (5, "y"), (None, "y"), (None, "z"), (None, "z"), (None, "z "), (7, "w"), (7, "w"), (7, "w"), (None, "w"),
    (20, BASE), (20, BASE), (None, NEAR), (21, NEAR), (20, NEAR), (21, "!!!"), (22, " ".join(reversed(BASE.split()))),
    (21, " ".join(reversed(BASE.split()))), (None, "a b c d e f"), (None, "a b c d e f"),
]


def test_exact_stage_keeps_one_row_of_each_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(5)
    groups = grouped(ROWS, lambda t: "".join(t.split()))
    expected = [min(g, key=lambda r: (-len(r[2]), r[0], r[1])) for g in groups.values()]
    found = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((None if n else i, t)) for n, i, t in expected)


def test_near_stage_keeps_one_row_of_each_class(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(5)
    groups = grouped(ROWS, lambda t: "base" if t in (BASE, NEAR) else t.strip())
    expected = [min(g)[:2] for g in groups.values()]
    found = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(repr(r["doc_id"]) for r in found) == sorted(repr(None if n else i) for n, i in expected)
    assert collections.Counter("base" if r["text"] in (BASE, NEAR) else r["text"].strip() for r in found) == dict.fromkeys(groups, 1)


def test_stages_on_odd_and_empty_tables(spark):
    """Null and repeated ids, null, empty and long texts, columns named like the operators' own: rows pass or go, columns stay."""
    from pyspark.sql import functions as F

    clashing = {"weight": F.lit("own"), "topic": F.lit(1), "cell_source": F.lit("c"), "_row": F.lit(2), "group": F.lit(3)}
    for docs in (odd_documents(spark).withColumns(clashing), no_documents(spark).withColumns(clashing)):
        rows = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs, before = corpus_pipeline.keep(stage(spark, docs, SF_DIR), "test"), docs
            assert docs.columns == before.columns and docs.count() <= before.count()
            # what stays is as it was
            assert docs.exceptAll(before).isEmpty()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
        assert last.count() == docs.count() <= rows
        assert docs.isEmpty() or {r["weight"] for r in docs.collect()} == {"own"}
