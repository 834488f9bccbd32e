"""The analytical queries over the gold table.

Each takes DataFrames and returns a DataFrame; nothing runs until an action.
Results with a limit plan as a top-k (each task keeps ``limit`` rows), and the
date filters reach the table's ``business_date`` partitions.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, normalize_text
from ..operators.dedup import latest_per_key
from ..operators.ema import ema_column
from ..sources.tables import read_table, table_exists

_log = logging.getLogger(__name__)

# Limits of the query service and its messages
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
SUGGESTION_LIMIT = 20
DEFAULT_SUGGESTIONS = 10
DEFAULT_HISTORY = 14
OVERVIEW_MOVERS = 5
RANGE_MESSAGE = "from must be before or equal to to"
NOT_FOUND_MESSAGE = "Stock not found: {}"

SUMMARY = ["stock_code", "stock_name", "isin", "business_date", "closing_price", "pnl_percentage",
           "avg_pnl_percentage"]
PRICES = ["business_date", "open_price", "high_price", "low_price", "closing_price", "last_price",
          "previous_closing_price", "pnl_percentage", "total_trading_volume"]


class StockNotFound(LookupError):
    def __init__(self, stock_code: str):
        super().__init__(NOT_FOUND_MESSAGE.format(stock_code))


def bounded_limit(requested: int, max_limit: int | None = MAX_LIMIT) -> int:
    """The limit of a request: the default for none, ``max_limit`` at most (None: no bound).  A cut is logged."""
    if requested <= 0:
        return DEFAULT_LIMIT
    if max_limit is not None and requested > max_limit:
        _log.warning("limit %d cut to %d", requested, max_limit)
        return max_limit
    return requested


def check_range(start: dt.date | None, end: dt.date | None) -> None:
    if start is not None and end is not None and start > end:
        raise ValueError(RANGE_MESSAGE)


def _columns(names: list[str]) -> list[Column]:
    return [F.col("ISIN").alias("isin") if n == "isin" else F.col(n) for n in names]


def spellings(catalog: DataFrame, stock_code: str) -> list[str]:
    """The codes of the catalog, which has a row per code, equal to this one but for upper and lower case."""
    found = catalog.filter(F.upper("stock_code") == F.upper(F.lit(stock_code))).select("stock_code")
    return sorted({row[0] for row in found.collect()})


def _has_code(stock_code: str | Sequence[str]) -> Column:
    """Rows of one code, upper and lower case alike.

    That comparison looks at every row.  Given a list of exact codes (see
    ``spellings``), the filter goes to the parquet reader instead, which skips
    the row groups without them; gold files are sorted by code for that.
    """
    if isinstance(stock_code, str):
        return F.upper("stock_code") == F.upper(F.lit(stock_code))
    return F.col("stock_code").isin(list(stock_code))


def _newest_first() -> list[Column]:
    return [F.col("business_date").desc_nulls_first(), F.col("hash_key")]


# --- search ---


def catalog_rows(gold: DataFrame) -> DataFrame:
    """Code, name, ISIN, date and hash of every security's latest row.  Such rows take the place of the gold rows they come from."""
    wanted = gold.filter(F.col("stock_code").isNotNull()).select(
        "stock_code", "stock_name", "ISIN", "business_date", "hash_key"
    )
    return latest_per_key(wanted, "stock_code", "business_date", [F.col("hash_key")])


def stock_catalog(gold: DataFrame) -> DataFrame:
    """Code, name and ISIN of every security, as of its latest row; from gold or from its ``catalog_rows``."""
    return catalog_rows(gold).select(*_columns(["stock_code", "stock_name", "isin"]))


def suggest(catalog: DataFrame, query: str | None, limit: int = DEFAULT_SUGGESTIONS, max_limit: int | None = SUGGESTION_LIMIT) -> DataFrame:
    """Catalog entries whose code or name holds the text: equal codes first, then
    codes and then names starting with it.  No text, no suggestions."""
    text = normalize_text(query)
    if not text.strip():
        return catalog.limit(0)
    code, name, wanted = normalize(F.col("stock_code")), normalize(F.col("stock_name")), F.lit(text)
    rank = F.when(code == wanted, 0).when(code.startswith(wanted), 1).when(name.startswith(wanted), 2).otherwise(3)
    return (
        catalog.filter(code.contains(wanted) | name.contains(wanted))
        .orderBy(rank, name, code, "isin")
        .limit(bounded_limit(limit, max_limit))
    )


def name_contains(query: str | None, wildcards: bool = False) -> Column:
    """Name holds the text, upper and lower case alike; no text holds for every name.

    ``wildcards`` gives ``%`` and ``_`` their LIKE meaning.
    """
    text = (query or "").strip().upper()
    if not text:
        return F.lit(True)
    name = F.upper(F.coalesce(F.col("stock_name"), F.lit("")))
    return name.like(f"%{text}%") if wildcards else name.contains(F.lit(text))


def search(gold: DataFrame, query: str | None, limit: int = DEFAULT_LIMIT, wildcards: bool = False,
           max_limit: int | None = MAX_LIMIT) -> DataFrame:
    """Latest summary per code among rows whose name holds the text, by code."""
    wanted = gold.filter(name_contains(query, wildcards)).select(*_columns(SUMMARY), "hash_key")
    newest = latest_per_key(wanted, "stock_code", "business_date", [F.col("hash_key")])
    return newest.select(SUMMARY).orderBy(F.col("stock_code").asc_nulls_last()).limit(
        bounded_limit(limit, max_limit)
    )


# --- one security ---


def latest(gold: DataFrame, stock_code: str | Sequence[str]) -> DataFrame:
    """Latest summary of one code; no row when it is unknown."""
    return (
        gold.filter(_has_code(stock_code)).orderBy(*_newest_first()).limit(1).select(*_columns(SUMMARY))
    )


def fetch_latest(gold: DataFrame, stock_code: str) -> Row:
    """``latest`` as a row; an unknown code is an error."""
    row = latest(gold, stock_code).first()
    if row is None:
        raise StockNotFound(stock_code)
    return row


def _prices(gold: DataFrame, stock_code: str | Sequence[str], start: dt.date | None, end: dt.date | None, limit: int,
            max_limit: int | None = MAX_LIMIT) -> DataFrame:
    check_range(start, end)
    rows = gold.filter(_has_code(stock_code))
    if start is not None:
        rows = rows.filter(F.col("business_date") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("business_date") <= F.lit(end))
    return rows.orderBy(*_newest_first()).limit(bounded_limit(limit, max_limit))


def history(
    gold: DataFrame,
    stock_code: str | Sequence[str],
    start: dt.date | None = None,
    end: dt.date | None = None,
    limit: int = DEFAULT_HISTORY,
    max_limit: int | None = MAX_LIMIT,
) -> DataFrame:
    """Newest price rows of one code within the inclusive date range."""
    return _prices(gold, stock_code, start, end, limit, max_limit).select(PRICES)


def _averages(gold: DataFrame, stock_code: str | Sequence[str], limit: int, ema: DataFrame | None, average: str,
              max_limit: int | None = MAX_LIMIT) -> DataFrame:
    newest = _prices(gold, stock_code, None, None, limit, max_limit)
    if ema is None:
        return newest
    newest = newest.select("business_date", "closing_price", "hash_key")
    hits = ema.select("hash_key", average).join(newest.select("hash_key"), "hash_key", "left_semi")
    return newest.join(hits, "hash_key", "left").orderBy(*_newest_first())


def indicators(
    gold: DataFrame, stock_code: str | Sequence[str], limit: int = DEFAULT_LIMIT, ema: DataFrame | None = None, period: int = 7,
    max_limit: int | None = MAX_LIMIT,
) -> DataFrame:
    """Newest closes of one code with their moving average.

    The average is gold's own column, or looked up in the side table ``ema``.
    That table has one row per hash, so the rows are limited first and only
    their hashes meet it.
    """
    average = ema_column(period)
    return _averages(gold, stock_code, limit, ema, average, max_limit).select("business_date", "closing_price", average)


def _as_array(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """A limited result as one array value, newest first; equal dates stand in the order they were limited in."""
    # rows without a date come first: null sorts before all numbers inside a struct
    place = F.struct((-F.unix_date("business_date")).alias("day"), "hash_key", F.struct(*names).alias("row"))
    items = F.transform(F.array_sort(F.collect_list(place)), lambda item: item["row"])
    return rows.agg(items.alias("items"))


def details(
    gold: DataFrame,
    stock_code: str | Sequence[str],
    start: dt.date | None = None,
    end: dt.date | None = None,
    limit: int = DEFAULT_LIMIT,
    ema: DataFrame | None = None,
    max_limit: int | None = MAX_LIMIT,
) -> DataFrame:
    """One row: latest summary, price history and indicators of one code; no row when it is unknown."""
    average = ema_column(7)
    prices = _as_array(_prices(gold, stock_code, start, end, limit, max_limit), PRICES)
    averages = _as_array(_averages(gold, stock_code, limit, ema, average, max_limit), ["business_date", "closing_price", average])
    return latest(gold, stock_code).select(
        F.struct(*SUMMARY).alias("latest"),
        prices.scalar().alias("history"),
        averages.scalar().alias("indicators"),
    )


# --- market ---


def latest_date(gold: DataFrame) -> DataFrame:
    return gold.agg(F.max("business_date").alias("latest_business_date"))


def tracked_stocks(gold: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of codes in the whole history (0 for an empty table)."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return gold.agg(count("stock_code").alias("tracked_stocks"))


def market_average(gold: DataFrame) -> DataFrame:
    """Mean daily return over all rows of all dates (0 for an empty table)."""
    return gold.agg(F.coalesce(F.avg("pnl_percentage"), F.lit(0.0)).alias("average_pnl_percentage"))


def daily_rollup(gold: DataFrame) -> DataFrame:
    """Sums per security and day; the row itself where the table holds one row per security and day."""
    measures = ["open_price", "closing_price", "previous_closing_price", "total_trading_volume", "pnl_percentage",
                "avg_pnl_percentage"]
    return gold.groupBy(F.col("ISIN").alias("isin"), "stock_code", "stock_name", "business_date").agg(
        *[F.sum(m).alias(m) for m in measures]
    )


def movers(
    gold: DataFrame, gainers: bool = True, limit: int = DEFAULT_LIMIT, by: str = "avg_pnl_percentage",
    max_limit: int | None = MAX_LIMIT,
) -> DataFrame:
    """Top securities of the last date, highest first for gainers, lowest first for losers.

    They rank by the mean return over their whole history; ``by="pnl_percentage"``
    ranks by the return of the day.  Only the last date's rows are summed up.
    """
    last_day = gold.filter(F.col("business_date") == gold.select(F.max("business_date")).scalar())
    ranked = daily_rollup(last_day).filter(F.col(by).isNotNull())
    order = F.col(by).desc() if gainers else F.col(by).asc()
    return ranked.select(SUMMARY).orderBy(order, "stock_code", "isin").limit(bounded_limit(limit, max_limit))


def gainers(gold: DataFrame, limit: int = DEFAULT_LIMIT, by: str = "avg_pnl_percentage", max_limit: int | None = MAX_LIMIT) -> DataFrame:
    return movers(gold, True, limit, by, max_limit)


def losers(gold: DataFrame, limit: int = DEFAULT_LIMIT, by: str = "avg_pnl_percentage", max_limit: int | None = MAX_LIMIT) -> DataFrame:
    return movers(gold, False, limit, by, max_limit)


def _ranked_array(rows: DataFrame, gainers: bool) -> DataFrame:
    """The few rows of a top-k as one array, in rank order."""
    key = F.col("avg_pnl_percentage") * F.lit(-1.0 if gainers else 1.0)
    items = F.array_sort(F.collect_list(F.struct(key.alias("k"), "stock_code", "isin", F.struct(*SUMMARY).alias("row"))))
    return rows.agg(F.transform(items, lambda item: item["row"]).alias("items"))


def overview(gold: DataFrame, top: int = OVERVIEW_MOVERS) -> DataFrame:
    """One row: last date, number of codes, mean return, and the top gainers and losers as arrays."""
    up = _ranked_array(movers(gold, True, top), True)
    down = _ranked_array(movers(gold, False, top), False)
    totals = gold.agg(
        F.max("business_date").alias("latest_business_date"),
        F.count_distinct("stock_code").alias("tracked_stocks"),
        F.coalesce(F.avg("pnl_percentage"), F.lit(0.0)).alias("average_pnl_percentage"),
    )
    return totals.select("*", up.scalar().alias("gainers"), down.scalar().alias("losers"))


def status(spark: SparkSession, table: str) -> DataFrame:
    """One row: catalog reachable, serving table there, its last date.

    An unreachable catalog gives (false, false, null) instead of an error; errors of the query itself are raised.
    """
    schema = "database_reachable boolean, gold_table_available boolean, latest_business_date date"
    try:
        available = table_exists(spark, table)
    except (ConnectionError, Py4JError, PySparkException):
        return spark.createDataFrame([(False, False, None)], schema)
    if not available:
        return spark.createDataFrame([(True, False, None)], schema)
    return latest_date(read_table(spark, table)).select(
        F.lit(True).alias("database_reachable"), F.lit(True).alias("gold_table_available"), "latest_business_date"
    )


def create_views(gold: DataFrame, prefix: str = "") -> list[str]:
    """Reporting views over gold for SQL users; returns their names."""
    views = {
        "stock_daily_summary": daily_rollup(gold),
        "stock_performance": gold.groupBy("ISIN", "stock_code").agg(
            F.min("business_date").alias("first_date"),
            F.max("business_date").alias("last_date"),
            F.count(F.lit(1)).alias("trading_days"),
            F.avg("pnl_percentage").alias("avg_pnl_percentage"),
        ),
        "stock_technical_indicators": gold.select(
            F.col("ISIN").alias("isin"), "stock_code", "business_date", "closing_price",
            *[c for c in gold.columns if c.startswith("ema_")],
        ),
        "market_overview": overview(gold),
        "top_gainers": gainers(gold),
        "top_losers": losers(gold),
    }
    for name, frame in views.items():
        frame.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in views]
