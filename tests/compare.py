"""Run a registered query and its SQL side by side and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def differences(df, connection, sql: str) -> list[str]:
    """Empty when names, types and all values agree."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    sql_types = dict((r[0], r[1]) for r in connection.execute(f"DESCRIBE {sql}").fetchall())
    expected_columns, expected = _sorted_rows(names, connection.execute(sql).fetchall())
    columns, actual = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if columns != expected_columns:
        return [f"columns {columns} != {expected_columns}"]
    for name, kind in df.dtypes:
        if _KINDS.get(kind) != sql_types[name]:
            problems.append(f"type of {name}: {kind} != {sql_types[name]}")
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows != {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, e.g. {columns}: {wrong[:2]}")
    return problems
