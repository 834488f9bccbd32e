"""The operators on the supplied tables, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, hidden_markov, merkle, minhash_dedup, mixing, nearest, periodic_runs, quality, secrets, simhash_dedup, toxicity, warc
from .common import table


def tokenizer() -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled")


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), *tokenizer())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_repeats(table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(planted))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_check(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"])


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    named = [
        op1_warc, op2_exact_dedup, op3_quality, op4_mixing, op5_hidden_markov, op6_toxicity, op7_byte_bpe, op8_secrets, op9_nearest, op10_minhash_dedup,
        op11_periodic_runs, op12_merkle, op13_simhash_dedup,
    ]
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


_PLAIN = r"translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"

#: The table of CRC-32 by its rule, and the check sum of an id's decimal digits.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"""
_CRC_ID = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
                lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1])), 4294967295)"""


def _merkle_sql(levels: int = 8) -> str:
    """Trees of at most 16^levels rows a source and 16^levels sources: level by level, each as a table expression."""

    def field(expression: str) -> str:
        return f"coalesce(strlen(CAST({expression} AS VARCHAR)) || ':' || CAST({expression} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str) -> str:
        """From ``{name}0`` (g, pos, n, digest): the levels above, and the runs that each level's nodes stand in."""
        return "".join(f"""
        {name}run{k} AS (SELECT g, pos // 16 AS parent, any_value(n) AS n, list(digest ORDER BY pos) AS run FROM {name}{k} GROUP BY g, pos // 16),
        {name}{k + 1} AS (SELECT g, parent AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest
            FROM {name}run{k}),""" for k in range(levels))

    def walk(name: str, start: str, prefix: str) -> str:
        """Each row of ``start`` (g, spot, way: the digests left and right of it so far) up the tree."""
        out, before = "", start
        for k in range(levels):
            out += f"""
        {prefix}{k} AS (SELECT w.* REPLACE (spot // 16 AS spot, CASE WHEN r.n = 1 THEN way ELSE list_append(way, {{
                'l': array_to_string(run[1:spot % 16], ''), 'r': array_to_string(run[spot % 16 + 2:], '')}}) END AS way)
            FROM {before} w JOIN {name}run{k} r ON w.g IS NOT DISTINCT FROM r.g AND w.spot // 16 = r.parent),"""
            before = f"{prefix}{k}"
        return out

    last = levels - 1
    return f"""
        WITH leaves AS (
            SELECT source AS g, doc_id, {leaf("text")} AS leaf,
                CASE WHEN {_CRC_ID} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
            FROM documents, {_CRC_TABLE}),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
        low0 AS (SELECT g, pos, n, leaf AS digest FROM placed),{tree("low")}
        top0 AS (
            SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest, g AS source FROM low{levels}),{tree("top")}
        start AS (SELECT g, pos AS spot, doc_id, leaf, coalesce(tampered, leaf) AS now, [{{'l': '', 'r': ''}}][1:0] AS way FROM placed),{walk("low", "start", "up")}
        turned AS (
            SELECT 0 AS g, t.pos AS spot, u.doc_id, u.leaf, u.now, u.way, t.digest AS subroot FROM up{last} u JOIN top0 t ON u.g IS NOT DISTINCT FROM t.source),
        {walk("top", "turned", "over").lstrip()}
        checked AS (
            SELECT w.*, digest AS root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256,
                list_reduce(list_concat([{{'l': '', 'r': now}}], way), lambda a, s: {{'l': '', 'r': sha256(s.l || a.r || s.r)}}).r AS folded_root
            FROM over{last} w, top{levels})
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM checked
    """


ORACLES = {
    "op1_warc": """
        WITH rows AS (
            SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes,
                min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
            FROM pages),
        typed AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM rows)
        SELECT page_id, payload_bytes, sha256(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN again THEN first END AS refers_to
        FROM typed
    """,
    "op2_exact_dedup": f"""
        WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_PLAIN} AS plain FROM documents),
        best AS (
            SELECT plain, count(*) AS group_size,
                first(doc_id ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id, max(n) AS longest
            FROM rows GROUP BY plain)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = longest AS kept, sha256(plain) AS text_sha256
        FROM rows JOIN best USING (plain)
    """,
    "op9_nearest": """
        WITH usable AS (
            SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            GROUP BY vec_id),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
            FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT * FROM ranked WHERE rank <= 20
    """,
    "op12_merkle": _merkle_sql(),
}


def oracle_sql() -> dict[str, str]:
    return ORACLES
