"""Scanning the base tables and running one side's SQL text against a namespace."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from migraspark.functions.text import clean_sql_text
from migraspark.session import prepare_session


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def cores(spark: SparkSession) -> int:
    """Tasks that run at a time; a small input whose rows are costly is dealt to as many."""
    return spark.sparkContext.defaultParallelism


def spread(df: DataFrame, tasks: int) -> DataFrame:
    """Deal the rows of an input with few splits to ``tasks`` tasks.

    Worth a shuffle only where each row costs much more to process than to move, such as texts
    that are searched or ids that whole rows are generated from.
    """
    return df.repartition(tasks)


def views(spark: SparkSession, frames: Mapping[str, DataFrame], namespace: str = "") -> None:
    """Register frames as temp views; ``namespace`` keeps a source and a target set apart."""
    prepare_session(spark)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(qualified(name, namespace))


def qualified(table: str, namespace: str) -> str:
    return f"{namespace}__{table}" if namespace else table


def run_side(
    spark: SparkSession, sql: str, frames: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Run one side's SQL text: comment lines and the closing ``;`` are dropped first.

    ``frames`` binds ``{name}`` placeholders in the text, so the same text can run against the
    source or the target namespace.
    """
    return spark.sql(clean_sql_text(sql), **dict(frames or {}))


def use_schema(spark: SparkSession, schema: str) -> None:
    """Make ``schema`` the catalog namespace that unqualified names resolve in."""
    spark.catalog.setCurrentDatabase(schema)
