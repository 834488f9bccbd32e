"""Average daily return per security and its join back onto the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def avg_return(df: DataFrame, keys: Sequence[str] = ("ISIN", "stock_code")) -> DataFrame:
    """Mean of ``pnl_percentage`` per key; partial means are formed before the shuffle."""
    return df.groupBy(*keys).agg(F.avg("pnl_percentage").alias("avg_pnl_percentage"))


def with_avg_return(df: DataFrame, keys: Sequence[str] = ("ISIN", "stock_code")) -> DataFrame:
    """Rows with their key's mean return; rows with a null key part get null.

    Group and join rather than a window: the group side is pre-aggregated, and
    the join side of a heavy key can be split by Spark's skew-join handling,
    which a window partition cannot.
    """
    return df.join(avg_return(df, keys), list(keys), "left")


def avg_return_by_day(df: DataFrame, day: str, keys: Sequence[str] = ("ISIN", "stock_code")) -> DataFrame:
    """``(*keys, day, avg_pnl_percentage)``: the mean return of a key on each of its days, for rows that lie by day.

    Rows move narrow, once; a key's window holds a row per day.  Rows with a null key part are left out.
    """
    complete = df.dropna(subset=list(keys)).select(*keys, day, "pnl_percentage").repartition(*keys)
    daily = complete.groupBy(*keys, day).agg(F.sum("pnl_percentage").alias("_total"), F.count("pnl_percentage").alias("_days"))
    whole = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum("_total").over(whole), F.sum("_days").over(whole))
    return daily.select(*keys, day, mean.alias("avg_pnl_percentage"))


def means_by_code(df: DataFrame, keys: Sequence[str] = ("ISIN", "stock_code")) -> DataFrame:
    """The mean returns of a security as a map from its codes, ``(security, means)``: a row per security, which has few codes."""
    security, code = keys
    means = avg_return(df.filter(F.col(security).isNotNull() & F.col(code).isNotNull()), keys)
    return means.groupBy(security).agg(F.map_from_entries(F.collect_list(F.struct(code, "avg_pnl_percentage"))).alias("means"))
