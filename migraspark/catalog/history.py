"""Run history: each order is a run, each event a patch of one."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from migraspark.catalog import query
from migraspark.operators import history as H
from migraspark.operators.reconcile import prepare_status
from migraspark.plans import bindings as B
from migraspark.session import scratch_path
from migraspark.sources.tables import scan

RUNS = f"WITH {B.RUNS_CTE}"
SPLIT = date(2000, 1, 1)


@query(
    "run_01_log_run",
    f"""{RUNS}, old AS (SELECT * FROM runs WHERE created_at < DATE '{SPLIT}'),
fresh AS (SELECT *, ROW_NUMBER() OVER (ORDER BY created_at, request_id) AS place FROM runs
  WHERE created_at >= DATE '{SPLIT}')
SELECT (SELECT MAX(run_id) FROM old) + place AS run_id, request_id, status, status = 'success' AS success,
  COALESCE(error_message, CASE WHEN status = 'partial' THEN 'first' END) AS error_message,
  COALESCE(error_type, CASE WHEN NOT COALESCE(validation_passed, FALSE) THEN 'ValidationError' END)
    AS error_type,
  CASE WHEN status = 'success' THEN 77 ELSE length(source_code) END AS code_length_original,
  length(generated_code) AS code_length_generated,
  CASE WHEN status = 'failed' THEN '["slow"]' END AS warnings, recon_ind, created_at FROM fresh""",
)
def run_01(spark, folder):
    runs = B.runs(spark, folder)
    old = runs.filter(F.col("created_at") < F.lit(SPLIT))
    fresh = runs.filter(F.col("created_at") >= F.lit(SPLIT))
    status = F.col("status")
    texts = F.array().cast("array<string>")
    batch = fresh.drop("run_id", "success").withColumns(
        {
            "trans_error": F.col("error_message"),
            "trans_error_type": F.col("error_type"),
            "errors": F.when(status == "partial", F.array(F.lit("first"), F.lit("second"))).otherwise(texts),
            "warning_list": F.when(status == "failed", F.array(F.lit("slow"))).otherwise(texts),
            "trans_code_length": F.when(status == "success", 77).otherwise(0),
        }
    )
    logged = H.log_runs(old, batch, ["created_at", "request_id"])
    return logged.select(
        "run_id", "request_id", "status", "success", "error_message", "error_type",
        "code_length_original", "code_length_generated", "warnings", "recon_ind", "created_at",
    )


@query(
    "run_02_list_runs",
    f"{RUNS} SELECT {', '.join(H.LISTED)} FROM runs ORDER BY run_id DESC",
)
def run_02(spark, folder):
    return H.list_runs(B.runs(spark, folder))


@query(
    "run_02_list_pending",
    f"{RUNS} SELECT {', '.join(H.LISTED)} FROM runs WHERE recon_ind IS NULL ORDER BY run_id DESC",
)
def run_02_pending(spark, folder):
    return H.list_runs(B.runs(spark, folder), pending_only=True)


@query("run_03_get_run", f"{RUNS} SELECT * FROM runs WHERE run_id = 17")
def run_03(spark, folder):
    return H.get_run(B.runs(spark, folder), 17)


PATCHED_SQL = ", ".join(
    f"COALESCE(p.{f}, r.{f}) AS {f}" for f in H.PATCH_FIELDS
)
FOLDED_SQL = ", ".join(
    f"arg_max({f}, seq) FILTER ({f} IS NOT NULL) AS {f}" for f in H.PATCH_FIELDS
)


@query(
    "run_04_patch_run",
    f"""{RUNS}, {B.PATCHES_CTE}, p AS (SELECT run_id, {FOLDED_SQL} FROM patches GROUP BY run_id)
SELECT r.run_id, request_id, {PATCHED_SQL} FROM runs r LEFT JOIN p ON r.run_id = p.run_id""",
)
def run_04(spark, folder):
    patched = H.apply_patches(B.runs(spark, folder), B.patches(spark, folder))
    return patched.select("run_id", "request_id", *H.PATCH_FIELDS)


@query(
    "run_05_set_recon_ind",
    f"""{RUNS}, {B.PATCHES_CTE} SELECT run_id,
  CASE WHEN run_id IN (SELECT run_id FROM patches WHERE target_schema IS NOT NULL) THEN 'skipped'
       ELSE recon_ind END AS recon_ind FROM runs""",
)
def run_05(spark, folder):
    chosen = B.patches(spark, folder).filter(F.col("target_schema").isNotNull())
    changed = H.set_recon_ind(B.runs(spark, folder), chosen, "skipped")
    return changed.select("run_id", "recon_ind")


@query(
    "run_06_clear_history",
    """SELECT 'migration_runs' AS table_name, COUNT(*) AS deleted, CAST(0 AS BIGINT) AS remaining
FROM orders UNION ALL SELECT 'synthetic_data_runs', COUNT(*), 0 FROM part""",
)
def run_06(spark, folder):
    base = scratch_path(spark, "history")
    paths = {name: f"{base}/{name}" for name in ("migration_runs", "synthetic_data_runs")}
    B.runs(spark, folder).write.parquet(paths["migration_runs"])
    scan(spark, folder, "part").write.parquet(paths["synthetic_data_runs"])
    cleared = H.clear(spark, paths)
    left = [
        spark.read.parquet(path).agg(F.count("*").alias("remaining"))
        .select(F.lit(name).alias("table_name"), "remaining")
        for name, path in paths.items()
    ]
    return cleared.join(left[0].unionAll(left[1]), "table_name")


@query(
    "run_07_log_generation",
    """SELECT 100 + ROW_NUMBER() OVER (ORDER BY p_partkey) AS run_id, p_name AS table_name,
  p_size AS row_count, CASE WHEN p_retailprice > 950 THEN 'success' ELSE 'failed' END AS status,
  p_retailprice > 950 AS success, 42 AS seed FROM part""",
)
def run_07(spark, folder):
    batch = scan(spark, folder, "part").select(
        F.col("p_partkey"),
        F.col("p_name").alias("table_name"),
        F.col("p_size").alias("row_count"),
        (F.col("p_retailprice") > 950).alias("success"),
        F.lit(42).alias("seed"),
    )
    existing = spark.range(100, 101).withColumnRenamed("id", "run_id")
    logged = H.log_generation(existing, batch, ["p_partkey"])
    return logged.select("run_id", "table_name", "row_count", "status", "success", "seed")


@query(
    "run_08_evolve_schema",
    f"""{RUNS} SELECT run_id, request_id, status, NULL::VARCHAR AS recon_ind,
  NULL::BOOLEAN AS recon_passed FROM runs WHERE created_at < DATE '{SPLIT}'
UNION ALL SELECT run_id, request_id, status, recon_ind, recon_passed FROM runs
WHERE created_at >= DATE '{SPLIT}'""",
)
def run_08(spark, folder):
    runs = B.runs(spark, folder)
    old = runs.filter(F.col("created_at") < F.lit(SPLIT)).drop(*H.PATCH_FIELDS)
    new = runs.filter(F.col("created_at") >= F.lit(SPLIT))
    history = H.evolve(old).unionByName(H.evolve(new))
    return history.select("run_id", "request_id", "status", "recon_ind", "recon_passed")


@query(
    "run_09_dashboard_metrics",
    f"""{RUNS} SELECT COUNT(*) AS total_runs, COUNT(*) FILTER (success) AS migrated_ok,
  COUNT(*) FILTER (recon_passed IS TRUE) AS recon_passed,
  COUNT(*) FILTER (recon_passed IS FALSE) AS recon_failed,
  COUNT(recon_passed) AS recon_compared FROM runs""",
)
def run_09(spark, folder):
    return H.dashboard_metrics(B.runs(spark, folder))


@query(
    "run_10_recon_label",
    f"""{RUNS} SELECT run_id, CASE WHEN recon_passed THEN 'recon passed'
  WHEN NOT recon_passed THEN 'recon failed' WHEN recon_ind <> '' THEN recon_ind
  ELSE 'pending' END AS label FROM runs""",
)
def run_10(spark, folder):
    return B.runs(spark, folder).select("run_id", H.recon_label().alias("label"))


@query(
    "run_11_run_listing",
    f"""{RUNS} SELECT run_id, COALESCE(source_file, '—') AS source_file,
  CASE WHEN success THEN '✓' ELSE '✗' END AS migrate,
  CASE WHEN validation_passed THEN '✓' ELSE '✗' END AS validate,
  CASE WHEN recon_passed THEN '✓ pass' WHEN NOT recon_passed THEN '✗ fail' ELSE '—' END AS recon,
  COALESCE(recon_ind, '—') AS recon_status,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM runs ORDER BY run_id DESC""",
)
def run_11(spark, folder):
    return H.run_listing(B.runs(spark, folder))


@query(
    "run_12_select_runs",
    f"""{RUNS} SELECT run_id FROM runs
WHERE run_id IN (1, 3) OR run_id BETWEEN 5 AND 1200 OR run_id >= 1400 AND run_id <= 99999999""",
)
def run_12(spark, folder):
    return H.select_runs(B.runs(spark, folder), " 1,3, 5-1200,x,9-7,1400-99999999,3")


@query(
    "run_13_runs_with_exports",
    f"""{RUNS}, {B.MANIFEST_CTE} SELECT run_id FROM runs
WHERE run_id IN (SELECT run_id FROM manifest WHERE side = 'source')
  AND run_id IN (SELECT run_id FROM manifest WHERE side = 'target')""",
)
def run_13(spark, folder):
    return H.runs_with_exports(B.runs(spark, folder), B.manifest(spark, folder))


@query(
    "run_14_batch_status",
    """SELECT o_custkey AS batch, COUNT(*) FILTER (o_orderstatus = 'F') AS succeeded,
  COUNT(*) FILTER (o_orderstatus <> 'F') AS failed,
  CASE WHEN COUNT(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'success'
       WHEN COUNT(*) FILTER (o_orderstatus = 'F') > 0 THEN 'partial' ELSE 'failed' END AS status
FROM orders GROUP BY 1""",
)
def run_14(spark, folder):
    outcomes = scan(spark, folder, "orders").select(
        F.col("o_custkey").alias("batch"), (F.col("o_orderstatus") == "F").alias("ok")
    )
    return H.batch_status(outcomes, "batch", "ok")


@query(
    "run_15_prep_counts",
    f"""{RUNS}, {B.MANIFEST_CTE}, exported AS (SELECT run_id, COUNT(DISTINCT side) AS sides
  FROM manifest GROUP BY 1),
gated AS (SELECT CASE
  WHEN COALESCE(trim(source_code), '') = '' OR COALESCE(trim(generated_code), '') = '' THEN 'skipped'
  WHEN source_type <> 'teradata' OR target_type <> 'bigquery' THEN 'skipped'
  WHEN sides = 2 THEN 'prepared' ELSE 'failed' END AS s
  FROM runs LEFT JOIN exported USING (run_id))
SELECT COUNT(*) FILTER (s = 'prepared') AS prepared, COUNT(*) FILTER (s = 'failed') AS failed,
  COUNT(*) FILTER (s = 'skipped') AS skipped FROM gated""",
)
def run_15(spark, folder):
    return H.prep_counts(prepare_status(B.runs(spark, folder), B.manifest(spark, folder)))
