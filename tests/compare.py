"""Runs a query and its SQL on the same tables and compares the rows, in any order."""

from __future__ import annotations

import math
import pathlib

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, sql):
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    return _sorted_rows(columns, result.fetchall())


def differences(df, connection, sql) -> str | None:
    """None when equal, else what differs first."""
    columns, rows = spark_rows(df)
    sql_columns, expected = sql_rows(connection, sql)
    if columns != sql_columns:
        return f"columns {columns} != {sql_columns}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    unequal = [(a, b) for a, b in zip(rows, expected) if a != b]
    return f"{len(unequal)} of {len(rows)} rows, first {unequal[0]}" if unequal else None
