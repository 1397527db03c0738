"""Run history as an append-only event table and its folded view.

A log event carries all columns of a new run; a patch event carries the fields to change. The
current state is a fold by run id, which Spark pre-aggregates in every task, so a run with very
many patches costs no more than any other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from migraspark.operators.ordered import asc, with_position

RUN_SCHEMA = (
    "run_id bigint, request_id string, source_file string, target_file string, "
    "target_file_path string, source_type string, target_type string, output_format string, "
    "source_code string, generated_code string, status string, success boolean, "
    "error_message string, error_type string, validation_passed boolean, "
    "validation_feedback string, code_length_original int, code_length_generated int, "
    "processing_time_ms double, warnings string, recon_ind string, source_schema string, "
    "target_schema string, source_result_path string, target_result_path string, "
    "recon_passed boolean, recon_result_path string, created_at timestamp_ntz"
)
GENERATION_SCHEMA = (
    "run_id bigint, table_name string, dialect string, input_schema_path string, "
    "output_file_path string, row_count int, column_count int, seed int, status string, "
    "success boolean, error_message string, created_at timestamp_ntz"
)

PATCH_FIELDS = (
    "recon_ind", "source_schema", "target_schema", "source_result_path", "target_result_path",
    "recon_passed", "recon_result_path",
)

LISTED = (
    "run_id", "request_id", "source_file", "target_file", "source_type", "target_type",
    "output_format", "status", "success", "validation_passed", "recon_ind", "source_schema",
    "target_schema", "source_result_path", "target_result_path", "recon_passed",
    "recon_result_path", "created_at",
)


def _last_id(existing: DataFrame) -> Column:
    return F.coalesce(existing.select(F.max("run_id")).scalar(), F.lit(0))


def log_runs(existing: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number a batch of finished requests after the existing runs and derive their fields.

    ``batch`` brings the request fields plus ``trans_error``, ``trans_error_type``, ``errors`` and
    ``warning_list`` (arrays) and ``trans_code_length``. One writer at a time numbers runs.
    """
    ids = _last_id(existing)
    placed = with_position(batch, [asc(c) for c in order], "__place", start=1)
    first_error = F.try_element_at("errors", F.lit(1))
    invalid = ~F.coalesce(F.col("validation_passed"), F.lit(False))
    given = F.nullif("trans_code_length", F.lit(0))
    derived = {
        "run_id": ids + F.col("__place"),
        "success": F.col("status") == "success",
        "error_message": F.coalesce("trans_error", first_error),
        "error_type": F.coalesce("trans_error_type", F.when(invalid, "ValidationError")),
        "code_length_original": F.coalesce(given, F.length("source_code")),
        "code_length_generated": F.length("generated_code"),
        "warnings": F.when(F.size("warning_list") > 0, F.to_json("warning_list")),
    }
    return evolve(placed.withColumns(derived))


def evolve(runs: DataFrame, schema: str = RUN_SCHEMA) -> DataFrame:
    """Bring an older history up to the current columns; missing ones are NULL."""
    spark = runs.sparkSession
    current = spark.createDataFrame([], schema)
    known = [c for c in runs.columns if c in current.columns]
    return current.unionByName(runs.select(*known), allowMissingColumns=True)


def list_runs(runs: DataFrame, pending_only: bool = False) -> DataFrame:
    """The overview columns, newest first."""
    chosen = runs.filter(F.col("recon_ind").isNull()) if pending_only else runs
    return chosen.select(*LISTED).orderBy(F.desc("run_id"))


def get_run(runs: DataFrame, run_id: int) -> DataFrame:
    """All columns of one run, SQL texts included; the filter reaches the scan."""
    return runs.filter(F.col("run_id") == run_id)


def apply_patches(runs: DataFrame, patches: DataFrame) -> DataFrame:
    """Current runs after all patches: per field the value with the highest ``seq`` that is set.

    NULL in a patch leaves a field as it is. A patch row may carry ``force_recon_ind`` = true, which
    sets ``recon_ind`` whatever it holds. Patches of unknown runs change nothing.
    """
    if "force_recon_ind" not in patches.columns:
        patches = patches.withColumn("force_recon_ind", F.lit(False))

    def set_at(field: str) -> Column:
        carries = F.col(field).isNotNull()
        if field == "recon_ind":
            carries = carries | F.col("force_recon_ind")
        return F.when(carries, F.col("seq"))

    folded = patches.groupBy("run_id").agg(
        *[
            F.max_by(F.struct(F.col(field).alias("v")), set_at(field)).alias(f"p_{field}")
            for field in PATCH_FIELDS
        ]
    )
    joined = runs.join(folded, "run_id", "left")

    def current(field: str) -> Column:
        if field not in PATCH_FIELDS:
            return F.col(field)
        patched = F.col(f"p_{field}")
        return F.when(patched.isNotNull(), patched["v"]).otherwise(F.col(field)).alias(field)

    return joined.select(*[current(c) for c in runs.columns])


def set_recon_ind(runs: DataFrame, run_ids: DataFrame, value: str | None) -> DataFrame:
    """Set the indicator of the given runs, unconditionally."""
    wanted = run_ids.select("run_id").distinct().withColumn("__hit", F.lit(True))
    joined = runs.join(wanted, "run_id", "left")
    changed = F.when(F.col("__hit"), F.lit(value).cast("string")).otherwise(F.col("recon_ind"))
    return joined.withColumn("recon_ind", changed).select(*runs.columns)


def verdict_patches(results: DataFrame, report_path: str | None = None) -> DataFrame:
    """The patch that records reconciliation verdicts."""
    verdict = F.when(F.col("passed"), "passed").otherwise("failed")
    return results.select(
        "run_id",
        verdict.alias("recon_ind"),
        F.col("passed").alias("recon_passed"),
        F.lit(report_path).cast("string").alias("recon_result_path"),
    )


def clear(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Empty the given history tables; returns how many rows each had. Numbering starts over."""
    counts = []
    for name, path in paths.items():
        table = spark.read.parquet(path)
        counts.append((name, table.count()))
        empty = spark.createDataFrame([], table.schema)
        empty.write.mode("overwrite").parquet(path)
    return spark.createDataFrame(counts, "table_name string, deleted bigint")


def log_generation(existing: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number generation runs and set their status."""
    ids = _last_id(existing)
    placed = with_position(batch, [asc(c) for c in order], "__place", start=1)
    status = F.when(F.col("success"), "success").otherwise("failed")
    numbered = placed.withColumns({"run_id": ids + F.col("__place"), "status": status})
    return evolve(numbered, GENERATION_SCHEMA)


def dashboard_metrics(runs: DataFrame) -> DataFrame:
    """Totals over the tri-state verdict."""
    return runs.agg(
        F.count("*").alias("total_runs"),
        F.count_if("success").alias("migrated_ok"),
        F.count_if("recon_passed").alias("recon_passed"),
        F.count_if(~F.col("recon_passed")).alias("recon_failed"),
        F.count("recon_passed").alias("recon_compared"),
    )


def recon_label() -> Column:
    return (
        F.when(F.col("recon_passed"), "recon passed")
        .when(~F.col("recon_passed"), "recon failed")
        .otherwise(F.coalesce(F.nullif("recon_ind", F.lit("")), F.lit("pending")))
    )


def run_listing(runs: DataFrame) -> DataFrame:
    """Display rows with ticks and dashes, newest first."""

    def tick(flag: str) -> Column:
        return F.when(F.coalesce(F.col(flag), F.lit(False)), "✓").otherwise("✗")

    recon = F.when(F.col("recon_passed"), "✓ pass").when(~F.col("recon_passed"), "✗ fail")
    return runs.select(
        "run_id",
        F.coalesce("source_file", F.lit("—")).alias("source_file"),
        tick("success").alias("migrate"),
        tick("validation_passed").alias("validate"),
        F.coalesce(recon, F.lit("—")).alias("recon"),
        F.coalesce("recon_ind", F.lit("—")).alias("recon_status"),
        F.substring(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), 1, 19).alias("created"),
    ).orderBy(F.desc("run_id"))


def _ranges(selection: str, swap: bool) -> list[tuple[int, int]]:
    found = []
    for part in selection.split(","):
        bounds = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if bounds:
            low, high = int(bounds[1]), int(bounds[2] or bounds[1])
            found.append((high, low) if swap and low > high else (low, high))
    return found


def select_runs(runs: DataFrame, selection: str, swap_reversed: bool = False) -> DataFrame:
    """Known run ids named by ``1,3,5-6``, ``A`` (all) or ``P`` (pending), distinct and sorted.

    A range becomes a BETWEEN that reaches the scan; it is never expanded to ids.
    """
    word = selection.strip().upper()
    if word == "A":
        chosen = runs
    elif word == "P":
        chosen = runs.filter(F.col("recon_ind").isNull())
    else:
        named = F.lit(False)
        for low, high in _ranges(selection, swap_reversed):
            named = named | F.col("run_id").between(low, high)
        chosen = runs.filter(named)
    return chosen.select("run_id").distinct().orderBy("run_id")


def runs_with_exports(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Runs with a manifest row on both sides."""
    for side in ("source", "target"):
        exported = manifest.filter(F.col("side") == side).select("run_id")
        runs = runs.join(exported, "run_id", "left_semi")
    return runs.select("run_id").orderBy("run_id")


def batch_status(outcomes: DataFrame, batch: str, succeeded: str) -> DataFrame:
    """Per batch: success without failures, partial with some successes, else failed."""
    counted = outcomes.groupBy(batch).agg(
        F.count_if(F.col(succeeded)).alias("succeeded"),
        F.count_if(~F.coalesce(F.col(succeeded), F.lit(False))).alias("failed"),
    )
    status = (
        F.when(F.col("failed") == 0, "success")
        .when(F.col("succeeded") > 0, "partial")
        .otherwise("failed")
    )
    return counted.withColumn("status", status)


def prep_counts(statuses: DataFrame) -> DataFrame:
    """How many runs the export step prepared, failed and skipped."""
    return statuses.agg(
        F.count_if(F.col("recon_ind") == "prepared").alias("prepared"),
        F.count_if(F.col("recon_ind") == "failed").alias("failed"),
        F.count_if(F.col("recon_ind") == "skipped").alias("skipped"),
    )
