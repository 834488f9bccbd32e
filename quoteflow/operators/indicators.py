"""Indicators over the latest rows of a security.

They work at the table grain, one row per security and business date, so a
window partition is bounded by the number of trading days, whatever the number
of raw rows was.  Whole-history figures are grouped and joined back instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _history(key: str, date: str):
    return Window.partitionBy(key).orderBy(date, "hash_key")


def sma(df: DataFrame, days: int = 7, key: str = "ISIN", date: str = "business_date",
        value: str = "closing_price") -> DataFrame:
    """Simple moving average of the last ``days`` rows (fewer at the start)."""
    frame = _history(key, date).rowsBetween(-(days - 1), 0)
    return df.withColumn(f"sma_{days}", F.avg(value).over(frame))


def volatility(df: DataFrame, days: int = 7, key: str = "ISIN", date: str = "business_date",
               value: str = "pnl_percentage") -> DataFrame:
    """Sample standard deviation of the daily return over the last ``days`` rows."""
    frame = _history(key, date).rowsBetween(-(days - 1), 0)
    return df.withColumn(f"volatility_{days}", F.stddev_samp(value).over(frame))


def price_change(df: DataFrame, key: str = "ISIN", date: str = "business_date",
                 value: str = "closing_price") -> DataFrame:
    """Change against the security's previous row, absolute and in percent."""
    before = F.lag(value).over(_history(key, date))
    return df.withColumn("_before", before).withColumns(
        {
            "price_change": F.col(value) - F.col("_before"),
            "price_change_percentage": F.try_divide(F.col(value) - F.col("_before"), F.col("_before")) * 100,
        }
    ).drop("_before")


def normalised_price(df: DataFrame, key: str = "ISIN", value: str = "closing_price") -> DataFrame:
    """Price on the scale of the security's own history: z-score and 0..1."""
    scale = df.groupBy(key).agg(
        F.avg(value).alias("_mean"),
        F.stddev_samp(value).alias("_deviation"),
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
    )
    price = F.col(value)
    return (
        df.join(scale, key, "left")
        .withColumns(
            {
                "price_zscore": F.try_divide(price - F.col("_mean"), F.col("_deviation")),
                "price_minmax": F.try_divide(price - F.col("_low"), F.col("_high") - F.col("_low")),
            }
        )
        .drop("_mean", "_deviation", "_low", "_high")
    )
