"""Column names, types and schema checks of the quote tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- Fixed values: the exchange's daily file format and the table contracts ---

# raw name -> (silver name, silver type); every raw column not listed is dropped in silver
SILVER_COLUMNS = {
    "TradDt": ("trading_date", T.DateType()),
    "BizDt": ("business_date", T.DateType()),
    "Src": ("data_source_code", T.StringType()),
    "ISIN": ("ISIN", T.StringType()),
    "TckrSymb": ("ticker_symbol", T.StringType()),
    "SctySrs": ("security_series", T.StringType()),
    "XpryDt": ("expiry_date", T.DateType()),
    "FinInstrmNm": ("financial_instrument_name", T.StringType()),
    "OpnPric": ("open_price", T.DoubleType()),
    "HghPric": ("high_price", T.DoubleType()),
    "LwPric": ("low_price", T.DoubleType()),
    "ClsPric": ("closing_price", T.DoubleType()),
    "LastPric": ("last_price", T.DoubleType()),
    "PrvsClsgPric": ("previous_closing_price", T.DoubleType()),
    "TtlTradgVol": ("total_trading_volume", T.LongType()),
    "TtlTrfVal": ("total_turnover_value", T.DoubleType()),
    "TtlNbOfTxsExctd": ("total_number_of_transactions_executed", T.LongType()),
    "_ingested_at": ("ingestion_date_time", T.TimestampType()),
}
AUDIT_COLUMNS = ["_ingested_at", "_source_file"]
BRONZE_KEY = ["ISIN", "BizDt"]
HASH_COLUMNS = ["data_source_code", "ISIN", "ticker_symbol", "business_date"]
EQUITY_SERIES = ["EQ", "SM"]
GOLD_RENAMES = {"ticker_symbol": "stock_code", "financial_instrument_name": "stock_name"}

SILVER_SCHEMA = T.StructType(
    [T.StructField(name, kind) for name, kind in SILVER_COLUMNS.values()]
    + [
        T.StructField("silver_load_date_time", T.TimestampType()),
        T.StructField("hash_key", T.StringType()),
        T.StructField("pnl_percentage", T.DoubleType()),
    ]
)
GOLD_SCHEMA = T.StructType(
    [
        T.StructField(GOLD_RENAMES.get(f.name, f.name), f.dataType)
        for f in SILVER_SCHEMA
        if f.name != "silver_load_date_time"
    ]
    + [
        T.StructField("avg_pnl_percentage", T.DoubleType()),
        T.StructField("ema_7", T.DoubleType()),
        T.StructField("gold_load_date_time", T.TimestampType()),
    ]
)
CONTROL_KEY = ["table_layer", "table_name", "cycle"]
CONTROL_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in CONTROL_KEY]
    + [T.StructField("ingest_partition", T.DateType())]
)

# index-snapshot API payload: columns left out of the clean table, and new names
SNAPSHOT_DROPS = [
    "priority", "identifier", "change", "pChange", "ffmc", "yearHigh", "yearLow", "nearWKH", "nearWKL",
    "perChange365d", "perChange30d", "date365dAgo", "date30dAgo", "chartTodayPath", "chart30dPath",
    "chart365dPath", "series", "meta_symbol", "meta_activeSeries", "meta_debtSeries", "meta_isCASec",
    "meta_isSLBSec", "meta_isDebtSec", "meta_isSuspended", "meta_tempSuspendedSeries", "meta_isMunicipalBond",
    "meta_isHybridSymbol", "meta_quotepreopenstatus_equityTime", "meta_quotepreopenstatus_preOpenTime",
    "meta_quotepreopenstatus_QuotePreOpenFlag",
]
SNAPSHOT_RENAMES = {
    "symbol": "stock_name",
    "lastPrice": "last_traded_price",
    "meta_companyName": "company_name",
    "meta_industry": "industry",
    "meta_isFNOSec": "is_FNO",
    "meta_isETFSec": "is_ETF",
    "meta_isDelisted": "is_Delisted",
    "meta_isin": "ISIN",
    "meta_slb_isin": "ISIN_SLB",
    "meta_listingDate": "listing_date",
    "meta_segment": "segment",
}

# Spark type -> column type of an external SQL database
DATABASE_TYPES = {
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "float": "DOUBLE PRECISION",
    "double": "DOUBLE PRECISION",
    "long": "BIGINT",
    "integer": "INTEGER",
    "boolean": "BOOLEAN",
}

# --- end of fixed values ---


def database_type(data_type: T.DataType) -> str:
    """SQL column type for a Spark type; anything unlisted is TEXT."""
    return DATABASE_TYPES.get(data_type.typeName(), "TEXT")


def require_columns(df: DataFrame, columns: Iterable[str], purpose: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{purpose} needs column(s) {', '.join(missing)}")
    return df


def schema_differences(df: DataFrame, expected: T.StructType) -> list[str]:
    """Names of required columns that are absent or of another type (a plan-time check)."""
    actual = {f.name: f.dataType for f in df.schema}
    problems = []
    for field in expected:
        if field.name not in actual:
            problems.append(f"{field.name}: missing")
        elif actual[field.name] != field.dataType:
            problems.append(
                f"{field.name}: {actual[field.name].simpleString()} instead of {field.dataType.simpleString()}"
            )
    return problems
