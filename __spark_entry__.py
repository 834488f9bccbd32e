"""

All queries read the supplied tables whole.  ``quoteflow.fixtures`` presents
the line items as daily quotes; ``oracles`` holds the same in SQL.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracles
from quoteflow import audit, control, fixtures
from quoteflow.functions import daily_return, row_hash
from quoteflow.operators import align, dedup, ema, indicators, merge, quality, returns
from quoteflow.plans import bronze, daily, gold, incremental, market, names, serving, silver, snapshot
from quoteflow.schema import HASH_COLUMNS
from quoteflow.session import shared_dir
from quoteflow.sources import html, listing, nested, quotefiles, tables
from quoteflow.streaming.dedup import dedup_into, dedup_within
from quoteflow.streaming.ema import keyed_ema, running_ema

SINCE = dt.date(1999, 1, 1)
CODE = "rod193"


def micro(column: str) -> Column:
    """Rounded to six places; sums of doubles depend on their order in the last bits."""
    return F.expr(f"floor({column} * 1e6D + 0.5D) / 1e6D as {column}")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[micro(c) if c in columns else F.col(c) for c in df.columns])


# --- raw and silver operators ---


def dedup_quotes(spark, sf):
    return fixtures.deduped_quotes(spark, sf).select(
        "ISIN", F.col("BizDt").cast("string").alias("BizDt"), "SctySrs", F.col("TtlTrfVal").alias("turnover")
    )


def series_filter(spark, sf):
    kept = silver.equity_series(fixtures.bronze_quotes(spark, sf), "SctySrs")
    return kept.select("ISIN", "BizDt", "SctySrs", F.col("TtlTradgVol").try_cast("bigint").alias("volume"))


def hash_key(spark, sf):
    typed = silver.typed_quotes(fixtures.quotes(spark, sf))
    return typed.select(
        "ISIN", "business_date",
        row_hash(["data_source_code", "ISIN", "ticker_symbol", "business_date"]).alias("hash_key"),
    )


def daily_returns(spark, sf):
    typed = silver.typed_quotes(fixtures.quotes(spark, sf))
    change = daily_return(F.col("closing_price"), F.col("previous_closing_price"))
    return typed.select("ISIN", "business_date", "total_turnover_value", change.alias("pnl_percentage"))


def typed_text(spark, sf):
    """Every raw column through text and back."""
    typed = silver.typed_quotes(fixtures.bronze_quotes(spark, sf))
    return typed.drop("ingestion_date_time", "expiry_date")


def silver_rows(spark, sf):
    return fixtures.silver_quotes(spark, sf).drop("ingestion_date_time", "silver_load_date_time", "expiry_date")


def load_silver(spark, sf):
    """The silver load itself, twice: rows of 1995 and later, then the older ones, some with unreadable dates or no ISIN.

    Every row of the series comes out as loaded or with the reason why not, but for a row hash's further rows.
    """
    layer = f"load_{uuid.uuid4().hex[:12]}"
    raw = fixtures.quotes(spark, sf).withColumn("BizDt", F.trunc("BizDt", "month")).withColumn("TradDt", F.col("BizDt"))
    volume = F.col("TtlTradgVol")
    faulty = raw.withColumns({
        "ISIN": F.when(volume != 8, F.col("ISIN")),
        "BizDt": F.when(volume == 7, F.date_format("BizDt", "dd/MM/yyyy")).otherwise(F.col("BizDt").cast("string")),
    })
    text = faulty.selectExpr(*[f"cast({c} as string) as {c}" for c in faulty.columns])
    recent = F.col("TradDt") >= "1995-01-01"
    for part in (recent, ~recent):
        tables.append(bronze.with_audit_columns(text.filter(part), "lineitem"), f"{layer}.raw")
        silver.load_silver(spark, f"{layer}.raw", f"{layer}.quotes", f"{layer}.state")
    loaded = spark.table(f"{layer}.quotes").select(
        F.lit("loaded").alias("outcome"), "ISIN", F.col("business_date").cast("string").alias("day"), F.col("total_turnover_value").alias("turnover")
    )
    left_out = spark.table(f"{layer}.quotes_rejected").select(
        F.col("reason").alias("outcome"), "ISIN", F.col("BizDt").alias("day"), F.col("TtlTrfVal").cast("double").alias("turnover")
    )
    return loaded.unionByName(left_out)


def load_touched(spark, sf):
    """Silver from the log of the raw table's commits: quotes of 1997 and later, older ones, and then two of their months asked for again.

    Every row of the series comes out as loaded or as late, those asked for as both.  Quotes are dated by month.
    """
    layer = f"load_{uuid.uuid4().hex[:12]}"
    raw = fixtures.bronze_quotes(spark, sf).withColumn("BizDt", F.trunc("BizDt", "month").cast("string"))
    recent = F.col("BizDt") >= "1997-01-01"
    for part, again in ((recent, []), (~recent, []), (None, [dt.date(1995, 8, 1), dt.date(1996, 7, 1)])):
        if part is not None:
            bronze.append_bronze(raw.filter(part), f"{layer}.raw", f"{layer}.raw_rejected")
        silver.load_silver(spark, f"{layer}.raw", f"{layer}.quotes", f"{layer}.state", again)
    loaded = spark.table(f"{layer}.quotes").select(
        F.lit("loaded").alias("outcome"), "ISIN", F.col("business_date").cast("string").alias("day"), "security_series", F.col("total_turnover_value").alias("turnover")
    )
    left_out = spark.table(f"{layer}.quotes_rejected").select(
        F.col("reason").alias("outcome"), "ISIN", F.col("BizDt").alias("day"), F.col("SctySrs").alias("security_series"), F.col("TtlTrfVal").cast("double").alias("turnover")
    )
    return loaded.unionByName(left_out)


def load_gold(spark, sf):
    """The load from raw text to gold, every step through its tables: silver, averages, gold.  Quotes are dated by month."""
    layer = f"load_{uuid.uuid4().hex[:12]}"
    raw = fixtures.bronze_quotes(spark, sf).withColumn("BizDt", F.trunc("BizDt", "month").cast("string")).withColumn("TradDt", F.col("BizDt"))
    tables.append(bronze.with_audit_columns(raw, "lineitem"), f"{layer}.raw")
    silver.load_silver(spark, f"{layer}.raw", f"{layer}.quotes", f"{layer}.state")
    gold.load_ema(spark, f"{layer}.quotes", f"{layer}.averages")
    gold.load_gold(spark, f"{layer}.quotes", f"{layer}.averages", f"{layer}.gold", f"{layer}.state")
    loaded = spark.table(f"{layer}.gold").select(
        "ISIN", "stock_code", "business_date", "security_series", "closing_price", "total_turnover_value", "hash_key", "pnl_percentage",
        "avg_pnl_percentage", "ema_7",
    )
    return _rounded(loaded, "avg_pnl_percentage")


def late_reprocess(spark, sf):
    """Gold kept up to date in steps: quotes to 1996, those after, and then a fifth of the securities' quotes of three months past.

    The late quotes are worked into the stored averages and totals; gold is what a build of all quotes gives.  Quotes are dated by month.
    """
    layer = f"late_{uuid.uuid4().hex[:12]}"
    month = F.trunc("BizDt", "month").cast("string")
    raw = fixtures.bronze_quotes(spark, sf).withColumn("BizDt", month).withColumn("TradDt", F.col("BizDt"))
    past = [dt.date(1995, 8, 1), dt.date(1996, 7, 1), dt.date(1998, 2, 1)]
    late = F.col("BizDt").isin([str(d) for d in past]) & (F.substring("ISIN", 3, 8).cast("int") % 5 == 0)
    early = F.col("BizDt") < "1997-01-01"
    for part, again in ((early & ~late, []), (~early & ~late, []), (late, past)):
        tables.append(bronze.with_audit_columns(raw.filter(part), "lineitem"), f"{layer}.raw")
        silver.load_silver(spark, f"{layer}.raw", f"{layer}.quotes", f"{layer}.state", again)
        incremental.extend_gold(spark, f"{layer}.quotes", f"{layer}.averages", f"{layer}.gold", f"{layer}.state", late_dates=again)
    loaded = spark.table(f"{layer}.gold").select(
        "ISIN", "stock_code", "business_date", "security_series", "closing_price", "total_turnover_value", "hash_key", "pnl_percentage",
        "avg_pnl_percentage", "ema_7",
    )
    return _rounded(loaded, "avg_pnl_percentage", "ema_7")


def load_daily(spark, sf):
    """The whole daily load from landed archives to gold and checks, twice: what its run log says, and the dates it loaded up to.

    The second run finds nothing new.  Quotes are dated by month.
    """
    layer = f"daily_{uuid.uuid4().hex[:12]}"
    landing = f"{shared_dir(spark)}/landing_{uuid.uuid4().hex}"
    fixtures.land_dated(fixtures.bronze_quotes(spark, sf).withColumn("BizDt", F.trunc("BizDt", "month").cast("string")), landing)
    own = daily.Tables(**{f: f"{layer}.{f}" for f in daily.Tables.__dataclass_fields__})
    for _ in range(2):
        daily.run_daily(spark, landing, own, incremental=True)
    runs = spark.table(own.runs)
    turn = F.dense_rank().over(Window.orderBy("run_id")).cast("int")
    steps = runs.withColumn("run", turn).select("run", "step", "status", F.coalesce("rows_written", F.lit(0)).alias("rows_written"))
    marks = control.watermarks(spark, own.control).select(
        F.lit(0).alias("run"), F.concat("table_layer", F.lit("."), "table_name").alias("step"), F.col("ingest_partition").cast("string").alias("status"), F.lit(0).cast("long").alias("rows_written")
    )
    return steps.unionByName(marks.withColumn("step", F.regexp_replace("step", r"^.*[.]", "up to: ")))


def reporting_views(spark, sf):
    """The rows of every reporting view."""
    views = serving.create_views(fixtures.gold_table(spark, sf), "report_")
    return audit.row_counts(**{name.removeprefix("report_"): spark.table(name) for name in views})


def align_schema(spark, sf):
    lines = fixtures.table(spark, sf, "lineitem")
    text = lines.select(
        F.concat(F.lit("  "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" ")).alias("volume"),
        F.concat(F.lit(" "), F.col("l_extendedprice").cast("string")).alias("price"),
        F.when(F.col("l_returnflag") == "R", F.lit("  ")).otherwise(F.to_date("l_shipdate").cast("string")).alias("day"),
        F.col("l_linestatus").alias("wrong"),
        "l_orderkey",
    )
    schema = T.StructType(
        [T.StructField(n, t) for n, t in (
            ("l_orderkey", T.LongType()), ("day", T.DateType()), ("volume", T.LongType()),
            ("price", T.DoubleType()), ("wrong", T.DoubleType()), ("absent", T.StringType()))]
    )
    return align.align_schema(text, schema)


def union_batches(spark, sf):
    raw = fixtures.bronze_quotes(spark, sf)
    narrow = raw.filter(F.col("SctySrs") == "BE").select("TtlTradgVol", "BizDt", "ISIN")
    wide = raw.filter(F.col("SctySrs") != "BE").select("ISIN", "BizDt", "SctySrs", "TtlTradgVol")
    return align.union_batches(wide, narrow)


def anti_join_new_rows(spark, sf):
    """A third of the batch has no ISIN; rows the target holds, null key or not, stay out."""
    raw = fixtures.quotes(spark, sf)
    unkeyed = raw.withColumn("ISIN", F.when(F.col("SctySrs") != "BE", F.col("ISIN")))
    batch = dedup.keep_first(unkeyed, ["ISIN", "BizDt"], [F.col("TtlTrfVal").desc_nulls_last()])
    existing = unkeyed.filter(F.col("BizDt") < F.lit(dt.date(1998, 7, 1))).select("ISIN", "BizDt")
    return merge.new_rows(batch, existing, ["ISIN", "BizDt"]).select(
        "ISIN", F.col("BizDt").cast("string").alias("BizDt"), F.col("TtlTrfVal").alias("turnover")
    )


def hash_dedup_append(spark, sf):
    quotes = silver.to_silver(fixtures.quotes(spark, sf))
    held = quotes.filter(F.col("business_date") <= F.lit(SINCE)).select("hash_key")
    return merge.new_rows_by_hash(quotes, held).select("hash_key", "security_series", "total_turnover_value")


# --- state ---


def incremental_files(spark, sf):
    """File names made from line items: with a date, with an impossible date, and without one."""
    lines = fixtures.table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    name = (
        F.when(flag == "A", F.concat(F.lit("quotes_0_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit(".zip")))
        .when(flag == "N", F.lit("quotes_20261399.zip"))
        .otherwise(F.lit("quotes_latest.ZIP"))
    )
    files = lines.select(
        F.concat(F.lit("file:/landing/"), F.col("l_linestatus"), F.lit("/"), name).alias("path"),
        F.col("l_shipdate").cast("timestamp").alias("modificationTime"),
    ).distinct()
    return listing.after_watermark(listing.dated_files(files), SINCE)


def incremental_scan(spark, sf):
    raw = fixtures.quotes(spark, sf)
    return tables.read_since(raw, "BizDt", SINCE).select(
        "ISIN", F.col("BizDt").cast("string").alias("BizDt"), F.col("ClsPric").alias("closing_price")
    )


def high_water_mark(spark, sf):
    return control.high_water_mark(silver.equity_series(silver.typed_quotes(fixtures.quotes(spark, sf))))


def watermark_upsert(spark, sf):
    lines = fixtures.table(spark, sf, "lineitem")
    key = [F.col("l_returnflag").alias("table_layer"), F.col("l_suppkey").cast("string").alias("table_name"),
           F.col("l_linestatus").alias("cycle")]
    day = F.to_date("l_shipdate")
    held = lines.filter(day < F.lit(SINCE)).groupBy(*key).agg(F.max(day).alias("ingest_partition"))
    written = lines.groupBy(*key).agg(F.min(day).alias("ingest_partition"))
    return control.upsert_watermarks(held, written)


def row_counts(spark, sf):
    raw, unique = fixtures.quotes(spark, sf), fixtures.deduped_quotes(spark, sf)
    return audit.row_counts(bronze=raw, deduplicated=unique, silver=silver.equity_series(unique, "SctySrs"))


# --- averages and gold ---


def avg_return(spark, sf):
    quotes = fixtures.silver_table(spark, sf).withColumnRenamed("ticker_symbol", "stock_code")
    return _rounded(returns.avg_return(quotes), "avg_pnl_percentage")


def avg_return_joinback(spark, sf):
    quotes = fixtures.silver_table(spark, sf).withColumnRenamed("ticker_symbol", "stock_code")
    joined = returns.with_avg_return(quotes.select("ISIN", "stock_code", "business_date", "pnl_percentage"))
    return _rounded(joined, "avg_pnl_percentage")


def avg_return_increment(spark, sf):
    """Return totals up to a date, the later rows' totals added."""
    quotes = fixtures.silver_table(spark, sf).withColumnRenamed("ticker_symbol", "stock_code")
    held = incremental.return_totals(quotes.filter(F.col("business_date") <= F.lit(SINCE)))
    new = incremental.return_totals(tables.read_since(quotes, "business_date", SINCE))
    totals = incremental.add_totals(held, new).withColumn("avg_pnl_percentage", F.try_divide("total", "days"))
    return _rounded(totals.drop("total", "days"), "avg_pnl_percentage")


def ema_series(spark, sf):
    return ema.ema_series(fixtures.silver_table(spark, sf))


def ema_final(spark, sf):
    return ema.ema_final(fixtures.silver_table(spark, sf))


def ema_resumed(spark, sf):
    """Averages up to a date, then continued from them: equal to one run over everything."""
    quotes = fixtures.silver_table(spark, sf)
    before = quotes.filter(F.col("business_date") <= F.lit(SINCE))
    return gold.refresh_ema(quotes, gold.build_ema(before, made_of=HASH_COLUMNS))


def gold_table(spark, sf):
    quotes = fixtures.silver_table(spark, sf)
    built = gold.build_gold(quotes)
    return _rounded(
        built.drop("gold_load_date_time", "ingestion_date_time", "expiry_date"), "avg_pnl_percentage"
    )


# --- serving ---


def stock_catalog(spark, sf):
    return serving.stock_catalog(fixtures.gold_table(spark, sf))


def _spellings(spark, sf):
    """The code as the stored catalog spells it, so that the lookups reach the parquet reader."""
    return serving.spellings(fixtures.catalog_table(spark, sf), CODE)


def suggest(spark, sf):
    return serving.suggest(fixtures.catalog_table(spark, sf), f" {CODE} ")


def suggest_by_name(spark, sf):
    return serving.suggest(fixtures.catalog_table(spark, sf), "hot rod", 50)


def search(spark, sf):
    return _rounded(serving.search(fixtures.gold_table(spark, sf), "Red g", 100), "avg_pnl_percentage")


def search_indexed(spark, sf):
    """The same search, on the rows that the index of names finds."""
    table = fixtures.gold_table(spark, sf)
    index = fixtures.stored(names.name_index(table, "stock_name").repartitionByRange("gram", "name"), "names", "gram")
    return _rounded(names.search_indexed(table, index, "Red g", 100), "avg_pnl_percentage")


def suggest_indexed(spark, sf):
    catalog = fixtures.catalog_table(spark, sf)
    index = fixtures.stored(names.name_index(catalog, "stock_code", "stock_name"), "names", "gram")
    return names.suggest_indexed(catalog, index, "hot rod", 50)


def latest(spark, sf):
    return _rounded(serving.latest(fixtures.gold_table(spark, sf), _spellings(spark, sf)), "avg_pnl_percentage")


def history(spark, sf):
    return serving.history(fixtures.gold_table(spark, sf), _spellings(spark, sf), dt.date(1996, 1, 1), dt.date(2000, 12, 31))


def indicators_of(spark, sf):
    return serving.indicators(fixtures.gold_table(spark, sf), _spellings(spark, sf), 10, fixtures.ema_table(spark, sf))


def details(spark, sf):
    """The nested record as flat rows: one per price row of the code."""
    found = serving.details(fixtures.gold_table(spark, sf), _spellings(spark, sf), limit=30)
    # the fields of "latest" are taken out before the explode: Spark 4.1 loses them behind it
    flat = found.select(
        F.col("latest.stock_name").alias("stock_name"),
        F.col("latest.business_date").alias("latest_date"),
        "history",
        "indicators",
    ).select("stock_name", "latest_date", "indicators", F.posexplode("history").alias("at", "price"))
    return flat.select(
        "stock_name",
        "latest_date",
        F.col("price.business_date").alias("business_date"),
        F.col("price.closing_price").alias("closing_price"),
        F.col("price.total_trading_volume").alias("total_trading_volume"),
        F.col("indicators")[F.col("at")]["ema_7"].alias("ema_7"),
    )


def gainers(spark, sf):
    return _rounded(serving.gainers(fixtures.gold_table(spark, sf)), "avg_pnl_percentage")


def losers(spark, sf):
    return _rounded(serving.losers(fixtures.gold_table(spark, sf)), "avg_pnl_percentage")


def gainers_of_the_day(spark, sf):
    return _rounded(serving.gainers(fixtures.gold_table(spark, sf), 50, "pnl_percentage"), "avg_pnl_percentage")


def daily_rollup(spark, sf):
    return _rounded(serving.daily_rollup(fixtures.gold_table(spark, sf)), "avg_pnl_percentage")


def overview(spark, sf):
    """The nested record as flat rows: one per gainer and loser."""
    record = serving.overview(fixtures.gold_table(spark, sf))
    total = ["latest_business_date", "tracked_stocks", micro("average_pnl_percentage")]
    sides = [
        record.select(*total, F.lit(side).alias("side"), F.posexplode(side).alias("position", "row"))
        for side in ("gainers", "losers")
    ]
    return sides[0].unionByName(sides[1]).select(
        "latest_business_date", "tracked_stocks", "average_pnl_percentage", "side", "position",
        F.col("row.stock_code").alias("stock_code"),
    )


def overview_from_states(spark, sf):
    """The overview from states by date, those to 1998 and those after made apart; the sketch of codes comes within its error of their number."""
    table, catalog = fixtures.gold_table(spark, sf), fixtures.catalog_table(spark, sf)
    early = F.col("business_date") <= F.lit(SINCE)
    states = [fixtures.stored(market.market_states(table.filter(part)), "market") for part in (early, ~early)]
    states = states[0].unionByName(states[1])
    estimate = market.market_totals(states).select("tracked_stocks").scalar()
    record = market.overview_from_states(table, states, catalog)
    total = ["latest_business_date", "tracked_stocks", micro("average_pnl_percentage"), (F.abs(estimate / F.col("tracked_stocks") - 1) < 0.05).alias("sketch_is_close")]
    sides = [record.select(*total, F.lit(side).alias("side"), F.posexplode(side).alias("position", "row")) for side in ("gainers", "losers")]
    return sides[0].unionByName(sides[1]).select(
        "latest_business_date", "tracked_stocks", "average_pnl_percentage", "sketch_is_close", "side", "position", F.col("row.stock_code").alias("stock_code")
    )


def latest_date(spark, sf):
    return serving.latest_date(fixtures.gold_table(spark, sf))


def tracked_stocks(spark, sf):
    return serving.tracked_stocks(fixtures.gold_table(spark, sf))


def market_average(spark, sf):
    return _rounded(serving.market_average(fixtures.gold_table(spark, sf)), "average_pnl_percentage")


def load_status(spark, sf):
    fixtures.gold_table(spark, sf).createOrReplaceTempView("serving_quotes")
    return serving.status(spark, "serving_quotes")


# --- sources ---


def flatten_json(spark, sf):
    events = fixtures.table(spark, sf, "events").select("event_id", "props")
    return nested.parse_column(events, "props", T.StructType([T.StructField("k", T.LongType())]))


def snapshot_rows(spark, sf):
    """Parts as records of a nested API reply, through the raw and the clean snapshot table."""
    parts = fixtures.table(spark, sf, "part")
    record = F.struct(
        F.col("p_name").alias("symbol"),
        F.col("p_retailprice").alias("lastPrice"),
        F.col("p_size").alias("change"),
        F.struct(
            F.col("p_brand").alias("companyName"),
            F.col("p_type").alias("industry"),
            F.concat(F.lit("IN"), F.col("p_partkey").cast("string")).alias("isin"),
            F.lit(True).alias("isCASec"),
        ).alias("meta"),
    )
    payloads = parts.select(F.array(record).alias("data"))
    clean = snapshot.snapshot_silver(snapshot.snapshot_bronze(payloads, "SYN", "run01", "parts.json"))
    return clean.drop("ingestion_timestamp", "ingestion_date", "processed_timestamp")


def html_items(spark, sf):
    return html.html_items(fixtures.table(spark, sf, "pages"), "li")


def html_table(spark, sf):
    """The list items of a page as the rows of a table, read back as a table."""
    rows = F.regexp_replace("html", r"(?is)<li[^>]*>(.*?)</li>", "<tr><td> $1</td><td>x</td></tr>")
    page = F.concat(F.lit('<table class="tb10 wide"><tbody>'), rows, F.lit("</tbody></table>"))
    pages = fixtures.table(spark, sf, "pages").select("page_id", page.alias("html"))
    found = html.html_table(pages)
    return found.select("page_id", "row_number", F.col("cells")[0].alias("cell"), F.col("headers")[1].alias("header"))


def html_nested(spark, sf):
    """Every page as a table of its address and title, a table of two cells inside each row, one more inside that; written with character references."""
    page = F.col("page_id").cast("string")
    number = (F.col("page_id") % 26 + 97).cast("string")
    inner = F.concat(F.lit("<TABLE class='x'><tr><th> n"), page, F.lit(" &#"), number, F.lit(";</th><td>&lt;b&gt;<table><tr><td>deep &#x41;&amp;</table>tail</td></tr></table>"))
    row = F.concat(F.lit("<tr><td>"), F.col("url"), inner, F.lit(" after </td><td>&eacute;"), F.length("html").cast("string"), F.lit("</td></tr>"))
    whole = F.concat(F.lit("</table><!-- <table> --><table id=a>"), F.repeat(row, (F.col("page_id") % 3 + 1).cast("int")), F.lit("</table><p>out</p>"))
    pages = fixtures.table(spark, sf, "pages").select("page_id", whole.alias("html"))
    return html.html_tables(pages)


def csv_scan(spark, sf):
    """Quotes written as daily CSV files and read back through the raw reader."""
    folder = f"{shared_dir(spark)}/csv_scan_{uuid.uuid4().hex}"
    raw = fixtures.bronze_quotes(spark, sf).select("ISIN", "BizDt", "SctySrs", "FinInstrmNm", "TtlTradgVol")
    raw.write.option("header", True).csv(folder)
    files = listing.incremental_files(spark, folder, pattern="*.csv").collect()
    return quotefiles.read_csvs(spark, [f["path"] for f in files]).drop("_source_file")


def zip_scan(spark, sf):
    """Quotes landed as archives of many members, one a year, and read back through the raw reader."""
    raw = fixtures.bronze_quotes(spark, sf).select("ISIN", "BizDt", "SctySrs", "FinInstrmNm", "TtlTradgVol")
    folder = f"{shared_dir(spark)}/zip_scan_{uuid.uuid4().hex}"
    fixtures.land_dated(raw.withColumns({"day": F.col("BizDt"), "BizDt": F.trunc("BizDt", "year").cast("string")}), folder, 500)
    found = quotefiles.read_zips(spark, listing.listed_files(spark, folder).select("path"))
    return found.select("ISIN", F.col("day").alias("BizDt"), "SctySrs", "FinInstrmNm", "TtlTradgVol")


def load_files(spark, sf):
    """What became of every landed file: a load, one more after files of months past and a new one came, and one that asks for a month again.

    A row per file, with the quotes of its month in the raw table.
    """
    layer = f"load_{uuid.uuid4().hex[:12]}"
    landing = f"{shared_dir(spark)}/landing_{uuid.uuid4().hex}"
    raw = fixtures.bronze_quotes(spark, sf).withColumn("BizDt", F.trunc("BizDt", "month").cast("string"))
    past = [dt.date(1995, 8, 1), dt.date(1996, 7, 1)]
    later = F.col("BizDt").isin([str(d) for d in past]) | (F.col("BizDt") >= "1998-06-01")
    counts = []
    for part, again in ((~later, []), (later, []), (F.lit(False), past[:1])):
        if not again:
            fixtures.land_dated(raw.filter(part), landing)
        done = bronze.load_bronze(spark, landing, f"{layer}.raw", f"{layer}.state", f"{layer}.rejects", again)
        counts.append((done["files"], done["files_skipped"]))
    outcomes = bronze.file_outcomes(spark, f"{layer}.raw_files")
    listed = listing.listed_files(spark, landing).count()
    if listed != outcomes.count() or [c for _, c in counts] != [0, len(past), 0]:
        raise AssertionError(f"{listed} files listed, loads took and skipped {counts}")
    quotes = spark.table(f"{layer}.raw").groupBy(F.col("BizDt").try_cast("date").alias("day")).agg(F.count("*").alias("quotes"))
    return outcomes.join(quotes, F.col("file_date") == F.col("day"), "left").select(
        "file_name", "file_date", "outcome", "reason", F.coalesce("quotes", F.lit(0)).alias("quotes")
    )


def load_bronze_zip(spark, sf):
    """The load of landed archives into the raw table, twice: the second finds nothing new.  Quotes are dated by month."""
    layer = f"load_{uuid.uuid4().hex[:12]}"
    landing = f"{shared_dir(spark)}/landing_{uuid.uuid4().hex}"
    raw = fixtures.bronze_quotes(spark, sf).withColumn("BizDt", F.trunc("BizDt", "month").cast("string"))
    fixtures.land_zips(raw, landing)
    for _ in range(2):
        bronze.load_bronze(spark, landing, f"{layer}.raw", f"{layer}.state", f"{layer}.rejects")
    return spark.table(f"{layer}.raw").select("ISIN", "BizDt", "SctySrs", F.col("TtlTrfVal").cast("double").alias("turnover"))


def parquet_scan(spark, sf):
    """Partitioned parquet written, then read with a partition filter."""
    folder = f"{shared_dir(spark)}/parquet_scan_{uuid.uuid4().hex}"
    raw = fixtures.bronze_quotes(spark, sf).select("ISIN", "BizDt", "SctySrs", "TtlTradgVol")
    tables.write_parquet(raw, folder, ["SctySrs"])
    return silver.equity_series(spark.read.parquet(folder), "SctySrs")


# --- streaming ---


def _events(spark, sf):
    schema = fixtures.table(spark, sf, "events").schema
    # a glob, as the reader takes a plain path for a folder: this one finds a file or a folder of part files
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def ema_stream(spark, sf):
    folder = f"{shared_dir(spark)}/ema_stream_{uuid.uuid4().hex}"
    query = running_ema(_events(spark, sf), folder, group_col="user_id", target_col="ts", value_col="value",
                        row_id="event_id")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/averages").select("event_id", "user_id", "value", "ema_7")


def ema_state(spark, sf):
    """The same averages with every user's in the state store: events of a month in four files, a file a micro-batch."""
    folder = f"{shared_dir(spark)}/ema_state_{uuid.uuid4().hex}"
    events = fixtures.table(spark, sf, "events")
    turn = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for n in range(4):
        events.filter(turn == n).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    averages = keyed_ema(stream, group_col="user_id", target_col="ts", value_col="value", row_id="event_id")
    writer = averages.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(averages.schema).parquet(f"{folder}/out").select("event_id", "user_id", "value", "ema_7", "late")


def dedup_events(spark, sf):
    folder = f"{shared_dir(spark)}/dedup_events_{uuid.uuid4().hex}"
    keyed = _events(spark, sf).select("user_id", "event_type", F.to_date("ts").alias("day"))
    dedup_into(keyed, folder, ["user_id", "event_type", "day"], "day").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch_id")


def dedup_stream(spark, sf):
    """Events of a month, a fifth of them a week late, in five files: one event of a user and type within seven days stays.

    Every event comes out as kept, late or a repeat.
    """
    layer = f"stream_{uuid.uuid4().hex[:12]}"
    events = fixtures.table(spark, sf, "events")
    turn = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    folder = f"{shared_dir(spark)}/{layer}"
    for n in range(5):
        events.filter(turn == n).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        dedup_within(stream, f"{layer}.events", ["user_id", "event_type"], "ts").awaitTermination()
    counts = spark.table(f"{layer}.events_counts")
    if not counts.filter("rows != kept + repeats + late + undated").isEmpty():
        raise AssertionError("events were lost")
    kept = spark.table(f"{layer}.events").select("event_id", F.lit("kept").alias("fate"))
    late = spark.table(f"{layer}.events_late").select("event_id", F.col("reason").alias("fate"))
    dealt = kept.unionByName(late)
    rest = events.select("event_id").join(dealt.select("event_id"), "event_id", "left_anti").withColumn("fate", F.lit("repeat"))
    return dealt.unionByName(rest)


# --- indicators and quality ---

_NARROW = ["ISIN", "business_date", "hash_key", "closing_price", "pnl_percentage"]


def sma(spark, sf):
    rows = fixtures.silver_table(spark, sf).select(_NARROW)
    return _rounded(indicators.sma(rows).select("hash_key", "sma_7"), "sma_7")


def volatility(spark, sf):
    rows = fixtures.silver_table(spark, sf).select(_NARROW)
    return _rounded(indicators.volatility(rows).select("hash_key", "volatility_7"), "volatility_7")


def price_change(spark, sf):
    rows = fixtures.silver_table(spark, sf).select(_NARROW)
    return indicators.price_change(rows).select("hash_key", "price_change", "price_change_percentage")


def normalised_price(spark, sf):
    rows = fixtures.silver_table(spark, sf).select(_NARROW)
    scaled = indicators.normalised_price(rows).select("hash_key", "price_zscore", "price_minmax")
    return _rounded(scaled, "price_zscore")


def stock_performance(spark, sf):
    serving.create_views(fixtures.gold_table(spark, sf), "report_")
    return _rounded(spark.table("report_stock_performance"), "avg_pnl_percentage")


def dq_duplicates(spark, sf):
    return quality.duplicates(silver.typed_quotes(fixtures.quotes(spark, sf)))


def dq_missing_codes(spark, sf):
    raw = silver.typed_quotes(fixtures.quotes(spark, sf)).withColumnRenamed("ticker_symbol", "stock_code")
    holes = raw.withColumn("stock_code", F.when(F.col("security_series") != "BE", F.col("stock_code")))
    named = holes.withColumn(
        "stock_name", F.when(F.col("security_series") == "SM", F.lit(" ")).otherwise(F.col("financial_instrument_name"))
    )
    return quality.missing_codes(named)


def dq_invalid_prices(spark, sf):
    quotes = silver.typed_quotes(fixtures.quotes(spark, sf))
    odd = quotes.withColumns(
        {
            "high_price": F.when(F.col("total_trading_volume") == 7, F.col("low_price") / 2).otherwise(F.col("high_price")),
            "open_price": F.when(F.col("total_trading_volume") == 8, F.lit(0.0)).otherwise(F.col("open_price")),
            "closing_price": F.when(F.col("total_trading_volume") != 9, F.col("closing_price")),
        }
    )
    return quality.invalid_prices(odd)


def dq_missing_dates(spark, sf):
    return quality.missing_dates(fixtures.silver_table(spark, sf))


def dq_row_counts(spark, sf):
    return _rounded(quality.row_count_alarms(fixtures.silver_table(spark, sf)), "expected_count")


def dq_types(spark, sf):
    """What the all-text quotes hold, column by column, with some prices and dates made unreadable and a column left empty."""
    odd = F.col("TtlTradgVol") == "7"
    raw = fixtures.bronze_quotes(spark, sf).withColumns({
        "LastPric": F.when(odd, F.lit("n/a")).otherwise(F.col("LastPric")),
        "TradDt": F.when(odd, F.date_format(F.col("TradDt").cast("date"), "dd-MM-yyyy")).otherwise(F.col("TradDt")),
        "XpryDt": F.when(odd, F.lit("  ")),
    })
    return quality.type_profile(raw)


def dq_findings(spark, sf):
    return quality.findings(fixtures.gold_table(spark, sf))


def entry(spark: SparkSession) -> DataFrame:
    return gainers(spark, "/root/testdata/sf0.001")


# the training-data operators are an addition that may be absent
try:
    from quoteflow.llm import queries as llm
except ImportError:
    llm = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**quote_queries(), **(llm.queries() if llm else {})}


def quote_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "dedup_quotes": dedup_quotes,
        "series_filter": series_filter,
        "hash_key": hash_key,
        "daily_return": daily_returns,
        "typed_text": typed_text,
        "silver": silver_rows,
        "load_silver": load_silver,
        "load_touched": load_touched,
        "load_gold": load_gold,
        "late_reprocess": late_reprocess,
        "load_daily": load_daily,
        "reporting_views": reporting_views,
        "align_schema": align_schema,
        "union_batches": union_batches,
        "anti_join_new_rows": anti_join_new_rows,
        "hash_dedup_append": hash_dedup_append,
        "incremental_files": incremental_files,
        "incremental_scan": incremental_scan,
        "high_water_mark": high_water_mark,
        "watermark_upsert": watermark_upsert,
        "row_counts": row_counts,
        "avg_return": avg_return,
        "avg_return_joinback": avg_return_joinback,
        "avg_return_increment": avg_return_increment,
        "ema_series": ema_series,
        "ema_final": ema_final,
        "ema_resumed": ema_resumed,
        "gold": gold_table,
        "stock_catalog": stock_catalog,
        "suggest": suggest,
        "suggest_by_name": suggest_by_name,
        "search": search,
        "search_indexed": search_indexed,
        "suggest_indexed": suggest_indexed,
        "latest": latest,
        "history": history,
        "indicators": indicators_of,
        "details": details,
        "gainers": gainers,
        "losers": losers,
        "gainers_of_the_day": gainers_of_the_day,
        "daily_rollup": daily_rollup,
        "overview": overview,
        "overview_from_states": overview_from_states,
        "latest_date": latest_date,
        "tracked_stocks": tracked_stocks,
        "market_average": market_average,
        "load_status": load_status,
        "flatten_json": flatten_json,
        "snapshot": snapshot_rows,
        "html_items": html_items,
        "html_table": html_table,
        "html_nested": html_nested,
        "csv_scan": csv_scan,
        "zip_scan": zip_scan,
        "load_bronze_zip": load_bronze_zip,
        "load_files": load_files,
        "parquet_scan": parquet_scan,
        "ema_stream": ema_stream,
        "ema_state": ema_state,
        "dedup_events": dedup_events,
        "dedup_stream": dedup_stream,
        "sma": sma,
        "volatility": volatility,
        "price_change": price_change,
        "normalised_price": normalised_price,
        "stock_performance": stock_performance,
        "dq_duplicates": dq_duplicates,
        "dq_missing_codes": dq_missing_codes,
        "dq_invalid_prices": dq_invalid_prices,
        "dq_missing_dates": dq_missing_dates,
        "dq_row_counts": dq_row_counts,
        "dq_findings": dq_findings,
        "dq_types": dq_types,
    }


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), **(llm.oracle_sql() if llm else {})}
