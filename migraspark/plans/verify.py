"""Run both sides' SQL, export, compare and record: the whole verification of one workload."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from migraspark.operators import history
from migraspark.operators.reconcile import failed_result, reconcile, unique_names
from migraspark.session import cut_lineage
from migraspark.sources.results import MANIFEST_SCHEMA, export, export_path
from migraspark.sources.tables import run_side


class Verification(NamedTuple):
    result: DataFrame
    manifest: DataFrame
    patch: DataFrame


def verify(
    spark: SparkSession,
    run_id: int,
    source_sql: str,
    target_sql: str,
    source_tables: Mapping[str, DataFrame],
    target_tables: Mapping[str, DataFrame],
    base: str,
    source_file: str | None = None,
) -> Verification:
    """Both texts name their tables as ``{table}``; results are written before they are compared,
    so each query runs once however often the comparison reads its rows.

    A text that fails, or a result that cannot be written or compared, gives a failed result and the
    patch that records it; the manifest then has the sides that were written.
    """
    sides = (
        ("source", source_sql, source_tables),
        ("target", target_sql, target_tables),
    )
    written = spark.createDataFrame([], MANIFEST_SCHEMA)
    try:
        for side, sql, tables in sides:
            rows = unique_names(run_side(spark, sql, tables))
            written = written.unionAll(export(rows, run_id, side, base, schema_name=side))
        source, target = (spark.read.parquet(export_path(base, run_id, side)) for side, _, _ in sides)
        result = cut_lineage(reconcile(source, target, run_id, source_file))
    except Exception as error:
        result = cut_lineage(failed_result(spark, run_id, source_file, error))
    return Verification(result, written, history.verdict_patches(result))
