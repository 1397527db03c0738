"""Declared table schemas, and catalogs of what tables hold."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHOWN_COLUMNS = 8


def column_catalog(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table and column: position, type, nullability, rows and present values.

    One aggregation per table; Parquet answers it without reading more than the columns' pages.
    """
    parts = []
    for table, frame in frames.items():
        counted = frame.agg(
            F.count("*").alias("rows"),
            *[F.count(c).alias(f"c{i}") for i, c in enumerate(frame.columns)],
        )
        described = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(field.name).alias("column_name"),
                    F.lit(field.dataType.simpleString()).alias("type"),
                    F.lit(field.nullable).alias("nullable"),
                    F.col(f"c{i}").alias("present"),
                )
                for i, field in enumerate(frame.schema)
            ]
        )
        parts.append(
            counted.select(F.lit(table).alias("table_name"), "rows", F.inline(described))
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union


def schema_catalog(frames: Mapping[str, DataFrame], shown: int = SHOWN_COLUMNS) -> DataFrame:
    """Per table its rows and its ordered column names, the first ``shown`` of them and a mark."""
    parts = []
    for table, frame in frames.items():
        names = F.array(*[F.lit(c) for c in frame.columns])
        head = F.array_join(F.slice(names, 1, shown), ", ")
        text = F.when(F.size(names) > shown, F.concat(head, F.lit(", …"))).otherwise(head)
        parts.append(
            frame.agg(F.count("*").alias("rows")).select(
                F.lit(table).alias("table_name"),
                "rows",
                F.size(names).alias("column_count"),
                text.alias("columns"),
            )
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union


def spec_report(df: DataFrame, spec: T.StructType) -> DataFrame:
    """How a table meets its declared columns: present values and NULLs where none may be."""
    absent = [f.name for f in spec if f.name not in df.columns]
    counted = df.agg(
        F.count("*").alias("rows"),
        *[F.count(f.name).alias(f"c{i}") for i, f in enumerate(spec) if f.name not in absent],
    )
    described = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(f.nullable).alias("nullable"),
                F.lit(f.name not in absent).alias("exists"),
                (F.lit(0).cast("bigint") if f.name in absent else F.col(f"c{i}")).alias("present"),
            )
            for i, f in enumerate(spec)
        ]
    )
    rows = counted.select("rows", F.inline(described))
    missing = F.when(F.col("nullable"), F.lit(0)).otherwise(F.col("rows") - F.col("present"))
    return rows.withColumn("violations", missing.cast("bigint"))


Leaf = tuple[str, str, Callable[[Column], Column]]


def leaf_paths(data_type: T.DataType) -> list[Leaf]:
    """Every plain value inside a type: path, type, and how many a column value holds."""
    if isinstance(data_type, T.StructType):
        return [
            (f".{f.name}{path}", kind, lambda c, f=f, count=count: count(c[f.name]))
            for f in data_type
            for path, kind, count in leaf_paths(f.dataType)
        ]
    if isinstance(data_type, T.ArrayType):
        return [
            (f"[]{path}", kind, lambda c, count=count: _sum_over(c, count))
            for path, kind, count in leaf_paths(data_type.elementType)
        ]
    if isinstance(data_type, T.MapType):
        keys = [
            (f"{{key}}{path}", kind, lambda c, count=count: _sum_over(F.map_keys(c), count))
            for path, kind, count in leaf_paths(data_type.keyType)
        ]
        values = [
            (f"{{value}}{path}", kind, lambda c, count=count: _sum_over(F.map_values(c), count))
            for path, kind, count in leaf_paths(data_type.valueType)
        ]
        return keys + values
    return [("", data_type.simpleString(), lambda c: c.isNotNull().cast("bigint"))]


def _sum_over(array: Column, count: Callable[[Column], Column]) -> Column:
    total = F.aggregate(array, F.lit(0).cast("bigint"), lambda seen, item: seen + count(item))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def nested_report(df: DataFrame, spec: T.StructType) -> DataFrame:
    """Per leaf path of the declared nested columns: its type and how many values the table has."""
    leaves = [
        (f"{f.name}{path}", kind, count(F.col(f.name)))
        for f in spec
        for path, kind, count in leaf_paths(f.dataType)
    ]
    totals = df.agg(*[F.sum(count).alias(f"n{i}") for i, (_, _, count) in enumerate(leaves)])
    described = F.array(
        *[
            F.struct(
                F.lit(path).alias("path"), F.lit(kind).alias("type"), F.col(f"n{i}").alias("present")
            )
            for i, (path, kind, _) in enumerate(leaves)
        ]
    )
    return totals.select(F.inline(described))
