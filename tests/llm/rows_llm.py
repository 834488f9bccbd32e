"""Rows with nulls, empty and long texts, ties, repeats and clashing extra columns."""

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(f"{a} {b}" for a in WORDS for b in WORDS[:60])
BASE = " ".join(WORDS[:120])
NEAR = " ".join([*WORDS[:60], "other", *WORDS[61:120]])

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, score double, key string, node string, tokens bigint"


def odd_documents(spark):
    texts = [
        (1, BASE), (2, NEAR), (3, BASE + "  \n"), (4, None), (5, ""), (6, " \t"), (7, LONG), (8, "one"), (9, "one"), (9, "one"),
        (None, "no id at all"), (10, "½ naïve ıdea wide  spaces\x1c 12345 don't"), (11, "!!!"), (12, "x" * 700),
    ]
    rows = [(i, t, "en" if i and i % 2 else None, "a" if i and i % 3 else None, 0, True, 0.5, "k", "n", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def label_rows(spark, name="toxic"):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)], "doc_id bigint, quality int, toxic int")
