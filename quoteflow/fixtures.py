"""The supplied star-schema tables as daily quotes.

A line item is a quote of its part: the part is the security, the ship date the
trading day, and the return flag the series.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.dedup import dedup_quotes, series_preference
from .plans.gold import build_ema, build_gold
from .plans.serving import stock_catalog
from .plans.silver import to_silver
from .session import shared_dir


_schemas: dict[str, T.StructType] = {}
_tables: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table.  Its schema is read from the files once per session, not by every query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


_CLOSE = "l_extendedprice / l_quantity"
QUOTE_COLUMNS = {
    "TradDt": "to_date(l_shipdate)",
    "BizDt": "to_date(l_shipdate)",
    "Src": "'SYN'",
    "ISIN": "concat('IN', lpad(cast(p_partkey as string), 8, '0'))",
    "TckrSymb": "concat(upper(split_part(p_name, ' ', 2)), p_partkey)",
    "SctySrs": "case l_returnflag when 'A' then 'EQ' when 'N' then 'SM' else 'BE' end",
    "FinInstrmNm": "concat(p_name, ' ', p_partkey)",
    "OpnPric": f"{_CLOSE} * (1 - l_discount)",
    "HghPric": f"{_CLOSE} * (1 + l_tax)",
    "LwPric": f"{_CLOSE} * (1 - l_discount)",
    "ClsPric": _CLOSE,
    "LastPric": _CLOSE,
    "PrvsClsgPric": "p_retailprice",
    "TtlTradgVol": "cast(l_quantity as bigint)",
    "TtlTrfVal": "l_extendedprice",
    "TtlNbOfTxsExctd": "cast(l_linenumber as bigint)",
}


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw quote per line item, before deduplication, with the types the tables have."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.selectExpr(*[f"{expression} as {name}" for name, expression in QUOTE_COLUMNS.items()])


def bronze_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the raw table holds it: every column text."""
    raw = quotes(spark, sf_dir)
    return raw.selectExpr(*[f"cast({c} as string) as {c}" for c in raw.columns])


def deduped_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per security and day.  Series and turnover decide alone here: turnover is unique within a
    security's day, so no other column has to be read for the choice."""
    order = [series_preference(F.col("SctySrs")), F.col("TtlTrfVal").try_cast("double").desc_nulls_last()]
    return dedup_quotes(quotes(spark, sf_dir), order)


LINES_OF_A_TASK = 500_000


def quotes_by_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``deduped_quotes``, those of a security together.

    The line items are chosen as they are and named as quotes afterwards: they move once, by security, as numbers, and are
    sorted in partitions of the shuffle instead of whole map tasks; the parts join them where they lie.
    """
    order = [series_preference(F.col("SctySrs")), F.col("TtlTrfVal").try_cast("double").desc_nulls_last()]
    isin, of_line = QUOTE_COLUMNS["ISIN"], QUOTE_COLUMNS["ISIN"].replace("p_partkey", "l_partkey")
    keyed = {n: QUOTE_COLUMNS[n] for n in ("BizDt", "SctySrs", "TtlTrfVal")} | {"ISIN": of_line}
    lines = table(spark, sf_dir, "lineitem").filter("l_partkey is not null")
    # by their number: the few bytes that a line takes in the shuffle say little of what a task has to sort
    tasks = max(spark.sparkContext.defaultParallelism, lines.count() // LINES_OF_A_TASK + 1)
    lines = lines.repartition(tasks, F.expr(of_line))
    kept = dedup_quotes(lines.selectExpr("*", *[f"{e} as {n}" for n, e in keyed.items()]), order, by_security=True)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").repartition(tasks, F.expr(isin))
    # a row per part, as the choice above leaves a row per quote
    parts = parts.withColumn("_isin", F.expr(isin)).dropDuplicates(["_isin", "p_partkey"]).hint("shuffle_hash")
    # equal keys, said so that the join goes by security alone and nothing moves again
    met = kept.join(parts, (F.col("ISIN") == F.col("_isin")) & F.col("l_partkey").between(F.col("p_partkey"), F.col("p_partkey")))
    return met.selectExpr(*[n if n in keyed else f"{e} as {n}" for n, e in QUOTE_COLUMNS.items()])


def silver_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver, computed from the line items."""
    return to_silver(quotes_by_security(spark, sf_dir))


def land_zips(raw: DataFrame, folder: str) -> list[str]:
    """Raw rows as zip archives of one CSV, each of a bounded number of rows of a task; the paths of those written."""
    columns = raw.columns
    dated = columns.index("BizDt")

    def write(frames):
        import zipfile
        from uuid import uuid4

        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for frame in frames:
            if not len(frame):
                continue
            name = f"quotes_{str(frame.iat[0, dated]).replace('-', '')}_{uuid4().hex}.zip"
            with system.open_output_stream(f"{path}/{name}", compression=None) as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("quotes.csv", frame.to_csv(index=False, columns=columns))
            yield frame.iloc[:1, :1].assign(path=f"{folder}/{name}")[["path"]]

    return [row["path"] for row in raw.mapInPandas(write, "path string").collect()]


#: Lines that a task sorts by date and packs at once.
PACKED_LINES = 200_000


def land_dated(raw: DataFrame, folder: str, lines: int = 1000) -> None:
    """Raw rows as one zip archive per ``BizDt``, of as many CSV members of ``lines`` rows as its quotes make.

    Rows are written as lines before they move, and move packed: those of a date that a task meets, so many at a time.
    """
    header, most = ",".join(raw.columns), PACKED_LINES

    def pack(frames):
        import json

        import pandas as pd
        import pyarrow as pa

        def packed(held):
            frame = pd.concat(held)
            # rows without a date land nowhere
            groups = [(day, json.dumps(rows.tolist()).encode()) for day, rows in frame.groupby("BizDt", sort=True)["line"]]
            return pd.DataFrame({"BizDt": [d for d, _ in groups], "size": [len(t) for _, t in groups], "packed": [pa.compress(t, codec="zstd", asbytes=True) for _, t in groups]})

        held, rows = [], 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows >= most:
                yield packed(held)
                held, rows = [], 0
        if rows:
            yield packed(held)

    def write(frames):
        import json
        import zipfile

        import pandas as pd
        import pyarrow as pa
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        date, out, archive, made, left = None, None, None, 0, []

        def members(least):
            nonlocal made, left
            low = 0
            while len(left) - low >= least:
                archive.writestr(f"quotes_{made}.csv", "\n".join([header, *left[low : low + lines], ""]))
                made, low = made + 1, low + lines
            left = left[low:]

        def close():
            if archive:
                members(1)
                archive.close()
                out.close()

        count = 0
        for frame in frames:
            for day, size, content in zip(frame["BizDt"], frame["size"], frame["packed"]):
                if day != date:
                    close()
                    out = system.open_output_stream(f"{path}/quotes_{day.replace('-', '')}.zip", compression=None)
                    date, archive, made = day, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1), 0
                found = json.loads(pa.decompress(content, decompressed_size=size, codec="zstd", asbytes=True))
                count += len(found)
                left += found
                members(lines)
        close()
        yield pd.DataFrame({"rows": [count]})

    # as pandas writes them: an empty text is nothing, a quote is doubled
    how = {"emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    texts = raw.select("BizDt", F.to_csv(F.struct(*raw.columns), how).alias("line"))
    dealt = texts.mapInPandas(pack, "BizDt string, size bigint, packed binary").repartition("BizDt").sortWithinPartitions("BizDt")
    dealt.mapInPandas(write, "rows bigint").agg(F.sum("rows")).collect()


def stored(df: DataFrame, name: str, sort_by: str | None = None) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}_{uuid.uuid4().hex}"
    # row hashes are hex text, which zstd halves
    (df.sortWithinPartitions(sort_by) if sort_by else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def silver_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver as a stored table.  It is written by the first query of a session
    that needs it, as the daily load writes it before averages and gold are built."""
    key = (spark.sparkContext.applicationId, sf_dir, "silver")
    if key not in _tables:
        _tables[key] = stored(silver_quotes(spark, sf_dir), "silver")
    return _tables[key]


def ema_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side table of moving averages, stored like silver."""
    key = (spark.sparkContext.applicationId, sf_dir, "ema")
    if key not in _tables:
        _tables[key] = stored(build_ema(silver_table(spark, sf_dir)), "ema")
    return _tables[key]


def gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold as a stored table, for the serving queries; written once per session like silver.  Its averages are made where the rows lie."""
    key = (spark.sparkContext.applicationId, sf_dir, "gold")
    if key not in _tables:
        _tables[key] = stored(build_gold(silver_table(spark, sf_dir)), "gold", "stock_code")
    return _tables[key]


def catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of securities, stored as the daily load stores it."""
    key = (spark.sparkContext.applicationId, sf_dir, "catalog")
    if key not in _tables:
        _tables[key] = stored(stock_catalog(gold_table(spark, sf_dir)), "catalog")
    return _tables[key]
