"""Runs that fail, verdicts that reach the history, and the time of a comparison."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F
from test_storage import requests

from migraspark.operators import reconcile as R
from migraspark.sources import results as IO
from migraspark.sources.history_store import HistoryStore


def test_a_raising_run_fails_alone_and_verdicts_are_recorded(spark, tmp_path):
    rows = spark.range(5).selectExpr("id AS order_id", "id * 2.0D AS amount")
    broken = rows.withColumn("amount", F.expr("raise_error('boom')").cast("double"))
    store = HistoryStore(spark, str(tmp_path / "history"))
    store.log(requests(spark, ["a", "b", "c"]), ["request_id"])
    pairs = [R.RunPair(1, "a", rows, rows), R.RunPair(2, "b", rows, broken), R.RunPair(3, "c", rows, rows.limit(2))]
    results = R.reconcile_runs(pairs, record=store.patch, report_path="report.md")
    found = {r["run_id"]: r for r in results.collect()}
    assert {k: r["passed"] for k, r in found.items()} == {1: True, 2: False, 3: False}
    assert found[2]["message"].startswith("Reconciliation error: ") and found[2]["source_file"] == "b"
    kept = {r["run_id"]: (r["recon_ind"], r["recon_passed"], r["recon_result_path"]) for r in store.runs().collect()}
    assert kept == {
        1: ("passed", True, "report.md"), 2: ("failed", False, "report.md"), 3: ("failed", False, "report.md"),
    }


def test_reports_say_when_they_were_compared(spark, tmp_path):
    rows = spark.range(2).selectExpr("id AS order_id", "id * 2.0D AS amount")
    results = R.reconcile_runs([R.RunPair(1, "a", rows, rows)])
    at = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)
    IO.write_reports(results, str(tmp_path), at)
    for part in ("reports", "summary"):
        (row,) = spark.read.schema("compared_at string").json(f"{tmp_path}/{part}").collect()
        assert row["compared_at"] == "2024-05-06T07:08:09+00:00"
    assert "compared_at" not in R.recon_summary(results).columns
