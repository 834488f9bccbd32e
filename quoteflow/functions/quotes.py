from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_text(columns: Sequence[str]) -> Column:
    """The columns as text, joined by a pipe, nulls as ''."""
    parts = ", ".join(f"coalesce(cast(`{c}` as string), '')" for c in columns)
    return F.expr(f"concat_ws('|', {parts})")


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 (hex) of ``row_text``."""
    return F.sha2(row_text(columns), 256)


def daily_return(close: Column, previous: Column) -> Column:
    """Change against the previous close in percent; null when that close is missing or zero."""
    return F.try_divide(close - previous, previous) * 100
