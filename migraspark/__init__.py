"""Proving data migrations with Spark. The verbs take and return DataFrames."""

from migraspark.functions.values import register_provider
from migraspark.operators import checks, history, lineage, progress
from migraspark.operators.conform import conform, conform_by_name, null_canonical
from migraspark.operators.diagnose import diagnose
from migraspark.operators.generate import ColumnGen, TableSpec, generate, generate_tables
from migraspark.operators.reconcile import reconcile, reconcile_runs, row_counts
from migraspark.plans import workload
from migraspark.plans.verify import verify
from migraspark.session import prepare_session

__all__ = [
    "ColumnGen",
    "TableSpec",
    "checks",
    "conform",
    "conform_by_name",
    "diagnose",
    "generate",
    "generate_tables",
    "history",
    "lineage",
    "null_canonical",
    "prepare_session",
    "progress",
    "reconcile",
    "reconcile_runs",
    "register_provider",
    "row_counts",
    "verify",
    "workload",
]
