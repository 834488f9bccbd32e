"""Raw rows move lighter and are looked into less often; what they hold does not change."""

from pyspark.sql import functions as F
from rows import values

from quoteflow.operators import deal
from quoteflow.plans import bronze

COLUMNS = "ISIN string, BizDt string, SctySrs string, ClsPric string, TtlTrfVal string, FinInstrmNm string"
TEXTS = ["1.5", "1.50", "12345.678901234567", "1e3", "abc", "", None, " 2.0", "NaN", "-0.0", "00012", "1.0E10", "Infinity", "5"]


def batch(spark):
    rows = [(f"I{n}", f"2026-09-0{n % 3 + 1}", "EQ", TEXTS[n % len(TEXTS)], TEXTS[(n * 5) % len(TEXTS)], f'a "{n}", b') for n in range(60)]
    return spark.createDataFrame(rows, COLUMNS)


def test_texts_come_out_as_they_were(spark):
    df = batch(spark)
    light, written_out = deal.as_numbers(df, ["ClsPric", "TtlTrfVal"])
    moved = deal.shed(light, written_out)
    assert not {"ClsPric", "TtlTrfVal"} & set(moved.columns)
    assert moved.filter("_odd_ClsPric is null").count() >= 25
    assert values(deal.restored(moved, written_out), *df.columns) == values(df, *df.columns)


def test_batch_is_looked_into_twice(spark, database, monkeypatch):
    """Once to count it and once to move it; the dates of the commit and the rows left out are known by then."""
    layer = database("looked")
    seen = spark.sparkContext.accumulator(0)

    def looked(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    df = batch(spark)
    done = bronze.append_bronze(df.mapInPandas(looked, df.schema), f"{layer}.raw", f"{layer}.rejected")
    # a frame of Python is run to be counted as well; lines that Spark reads are not parsed for that
    assert done == {"rows_read": 60, "rows_written": 60} and seen.value == 3 * 60
    assert values(spark.table(f"{layer}.raw"), *df.columns) == values(df, *df.columns)
    assert values(spark.table(f"{layer}.raw_commits"), "BizDt") == [(f"2026-09-0{n}",) for n in (1, 2, 3)]
    assert spark.table(f"{layer}.rejected").columns[:2] == ["ISIN", "BizDt"] and spark.table(f"{layer}.rejected").isEmpty()
    some = df.limit(3).withColumn("ISIN", F.lit(" "))
    assert bronze.append_bronze(some, f"{layer}.raw", f"{layer}.rejected") == {"rows_read": 3, "rows_written": 0}
    assert spark.table(f"{layer}.rejected").count() == 3
