"""Small hand-made inputs."""

from __future__ import annotations

import datetime as dt
import zipfile


DAY = dt.date(2026, 9, 1)


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def raw(spark, rows, columns=("ISIN", "BizDt", "TckrSymb", "SctySrs", "ClsPric", "PrvsClsgPric", "TtlTrfVal")):
    """Bronze-shaped rows: all text."""
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def silver(spark, rows):
    """(ISIN, day number, close, return) -> narrow silver rows."""
    data = [(i, None if d is None else day(d), c, p, f"{i}-{d}") for i, d, c, p in rows]
    return spark.createDataFrame(
        data, "ISIN string, business_date date, closing_price double, pnl_percentage double, hash_key string"
    )


GOLD = (
    "ISIN string, stock_code string, stock_name string, business_date date, open_price double, high_price double, "
    "low_price double, closing_price double, last_price double, previous_closing_price double, "
    "total_trading_volume bigint, pnl_percentage double, avg_pnl_percentage double, ema_7 double, hash_key string"
)


def gold(spark, *rows):
    """Gold rows from keyword dicts; anything not given is null."""
    names = [c.split()[0] for c in GOLD.split(", ")]
    data = []
    for n, row in enumerate(rows):
        row = {"hash_key": f"h{n:03d}", **row}
        data.append(tuple(row.get(c) for c in names))
    return spark.createDataFrame(data, GOLD)


def write_zip(path, **members):
    """A zip of text members; ``__`` in a name stands for the dot."""
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members.items():
            archive.writestr(name.replace("__", "."), text)


HEADER = "TradDt, BizDt ,Sgmt,Src,ISIN,TckrSymb,SctySrs,FinInstrmNm,OpnPric,HghPric,LwPric,ClsPric,LastPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd"


def quote_line(isin, d, code, series, close, previous, volume=10, turnover=100.0):
    return (f"{d},{d},CM,SYN,{isin},{code},{series},\"{code}, Ltd\",{close},{close},{close},{close},{close},{previous},"
            f"{volume},{turnover},3")


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


__all__ = ["DAY", "GOLD", "HEADER", "day", "gold", "quote_line", "raw", "silver", "values", "write_zip"]
