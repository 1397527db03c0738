"""Run a query on Spark and its SQL on DuckDB, and compare the two row sets exactly."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, int)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return str(value)


def rows(names: list[str], records) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(canonical(record[i]) for i in order) for record in records)


KINDS = {
    "TINYINT": "integer", "SMALLINT": "integer", "INTEGER": "integer", "BIGINT": "integer",
    "HUGEINT": "hugeint", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "string",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp",
    "TIMESTAMP WITH TIME ZONE": "timestamp", "tinyint": "integer", "smallint": "integer",
    "int": "integer", "bigint": "integer", "double": "float", "float": "float",
    "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp",
    "timestamp_ntz": "timestamp",
}


def kind(type_name: str) -> str:
    head = type_name.split("(")[0]
    if head.lower() == "decimal":
        return type_name.lower().replace(" ", "")
    if type_name.endswith("[]") or type_name.startswith("array"):
        return "array"
    return KINDS.get(type_name, type_name.lower())


def differences(df, sql: str, connection: duckdb.DuckDBPyConnection) -> list[str]:
    """Human-readable differences; empty when both sides agree."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    kinds = {column[0]: kind(str(column[1])) for column in result.description}
    expected = rows(names, result.fetchall())
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns: spark={sorted(df.columns)} sql={sorted(names)}"]
    for name, type_name in df.dtypes:
        if kind(type_name) != kinds[name]:
            found.append(f"type of {name}: spark={type_name} sql={kinds[name]}")
    actual = rows(df.columns, [tuple(row) for row in df.collect()])
    if actual != expected:
        missing, extra = expected - actual, actual - expected
        found.append(
            f"rows: spark={sum(actual.values())} sql={sum(expected.values())} "
            f"only in sql={sum(missing.values())} only in spark={sum(extra.values())}\n"
            f"  {sorted(names)}\n  sql:   {[*missing][:2]}\n  spark: {[*extra][:2]}"
        )
    return found
