"""Files in and out, verification end to end, and streams fed in several steps."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.operators import history as H
from migraspark.operators import progress as P
from migraspark.operators import reconcile as R
from migraspark.plans.verify import verify
from migraspark.sources import results as IO
from migraspark.sources.corpus import read_corpus, read_ddl
from migraspark.sources.history_store import HistoryStore
from migraspark.sources.tables import run_side, use_schema, views
from migraspark.streaming import progress as live
from migraspark.streaming import reconcile as arrivals


def test_csv_keeps_awkward_text(spark, tmp_path):
    rows = [(1, 'say "hi"'), (2, "two\nlines"), (3, "a,b"), (4, " padded "), (5, "back\\slash"), (6, None)]
    df = spark.createDataFrame(rows, "id int, note string")
    IO.export(df, 1, "source", str(tmp_path), file_format="csv")
    path = IO.export_path(str(tmp_path), 1, "source")
    back = IO.read_result(spark, path, "id int, note string", multiline=True)
    assert sorted(tuple(r) for r in back.collect()) == rows
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        IO.read_result(spark, path, "id int, note string").collect()


def test_csv_types_are_inferred(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("id,day,amount\n1,2024-01-02,2.5\n2,2024-01-03,\n")
    assert IO.read_result(spark, str(path)).dtypes == [
        ("id", "int"), ("day", "date"), ("amount", "double"),
    ]


def test_export_checks_the_side(spark, tmp_path):
    with pytest.raises(ValueError, match="side"):
        IO.export(spark.range(1), 1, "middle", str(tmp_path))


def test_manifest_counts(spark, tmp_path):
    base = str(tmp_path)
    IO.export(spark.range(25), 4, "source", base, "legacy")
    IO.export(spark.range(0), 4, "target", base, "modern")
    found = {r["side"]: (r["row_count"], r["columns"]) for r in IO.manifest(spark, base).collect()}
    assert found == {"source": (25, ["id"]), "target": (0, ["id"])}


def test_failed_load_keeps_the_old_table(spark, tmp_path):
    path, spec = str(tmp_path / "t"), T.StructType.fromDDL("a BIGINT")
    good = spark.createDataFrame([("1",), ("2",)], "a string")
    assert IO.load(good, spec, path) == 2
    with pytest.raises(Exception, match="not a whole number"):
        IO.load(spark.createDataFrame([("1.5",)], "a string"), spec, path)
    assert spark.read.parquet(path).count() == 2
    assert IO.load(good.limit(1), spec, path) == 1
    assert spark.read.parquet(path).count() == 1


def test_interrupted_load_is_settled(spark, tmp_path):
    path, spec = tmp_path / "t", T.StructType.fromDDL("a BIGINT")
    two = spark.createDataFrame([("1",), ("2",)], "a string")
    IO.load(two, spec, str(path))
    path.rename(tmp_path / "t__replaced")
    IO.recover_folder(spark, str(path))
    assert spark.read.parquet(str(path)).count() == 2 and not (tmp_path / "t__replaced").exists()
    shutil.copytree(path, tmp_path / "t__replaced")
    assert IO.load(two.limit(1), spec, str(path)) == 1
    assert spark.read.parquet(str(path)).count() == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_replacement_that_cannot_move_keeps_the_old_table(spark, tmp_path):
    path = tmp_path / "t"
    spark.range(3).write.parquet(str(path))
    with pytest.raises(Exception):
        IO.replace_folder(spark, str(tmp_path / "absent"), str(path))
    assert spark.read.parquet(str(path)).count() == 3


@pytest.mark.parametrize("moved_in", [False, True])
def test_history_survives_an_interrupted_compaction(spark, tmp_path, moved_in):
    base = tmp_path / "history"
    store = HistoryStore(spark, str(base))
    store.log(requests(spark, ["a", "b"]), ["request_id"])
    ends = spark.range(1).select(F.lit(2).cast("bigint").alias("run_id"), F.lit("failed").alias("recon_ind"))
    store.patch(ends)
    store.runs().write.parquet(str(base / "runs__next"))
    (base / "runs").rename(base / "runs__replaced")
    if moved_in:
        (base / "runs__next").rename(base / "runs")
    again = HistoryStore(spark, str(base))
    for _ in range(2):
        found = {r["run_id"]: r["recon_ind"] for r in again.runs().collect()}
        assert found == {1: None, 2: "failed"}
        again.compact()
    assert not (base / "runs__replaced").exists()


def test_corpus(spark, tmp_path):
    for name, text in {
        "b.sql": "  CREATE SET TABLE bb (x INT)\n", "a.sql": "SELECT 1", "c.proc": "BEGIN", "d.md": "no",
        "e.txt": " \n ",
    }.items():
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in read_corpus(spark, str(tmp_path)).collect()] == [
        ("a.sql", "SELECT 1"), ("b.sql", "CREATE SET TABLE bb (x INT)"), ("c.proc", "BEGIN"),
    ]
    ddl = {r["stem"]: r["table_name"] for r in read_ddl(spark, str(tmp_path)).collect()}
    assert ddl == {"a": "a", "b": "bb"}


def test_two_namespaces(spark):
    views(spark, {"t": spark.range(3)}, "left")
    views(spark, {"t": spark.range(5)}, "right")
    assert [spark.table(f"{side}__t").count() for side in ("left", "right")] == [3, 5]
    assert run_side(spark, "-- x\nSELECT COUNT(*) AS n FROM right__t;").first()["n"] == 5
    use_schema(spark, "default")


def test_verify(spark, tmp_path):
    source, target = spark.range(10), spark.range(10).withColumn("id", F.col("id") * 1)
    text = "SELECT id % 3 AS bucket_id, COUNT(*) AS row_count FROM {t} GROUP BY 1;"
    done = verify(spark, 3, text, text, {"t": source}, {"t": target}, str(tmp_path), "q.sql")
    assert done.result.first()["passed"]
    assert done.patch.first()["recon_ind"] == "passed"
    assert sorted(r["row_count"] for r in done.manifest.collect()) == [3, 3]


def test_missing_side(spark):
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "run_id bigint, source_file string")
    manifest = spark.createDataFrame(
        [(1, "source"), (1, "target"), (2, "source")], "run_id bigint, side string"
    )
    (row,) = R.missing_sides(runs, manifest).collect()
    assert row["run_id"] == 2 and not row["passed"] and row["message"] == R.MISSING_EXPORT


EVENTS = "run_id bigint, seq bigint, key string, value string"


def test_stream_state_equals_batch(spark, tmp_path):
    base, incoming = str(tmp_path / "state"), str(tmp_path / "incoming")
    first = spark.range(400).selectExpr(
        "id % 5 AS run_id", "id AS seq", "concat('k', id % 7) AS key", "cast(id AS string) AS value"
    )
    late = spark.createDataFrame(
        [(1, 2, "k1", "late"), (1, 9999, "k1", "newest"), (9, 1, "k0", "new run")], EVENTS
    )
    schema = T.StructType.fromDDL(EVENTS)
    for part in (first, late):
        part.write.mode("append").parquet(incoming)
        live.keep_state(live.read_events(spark, incoming, schema), base)
    state = live.current_state(spark, base)
    batch = P.fold_state(first.unionByName(late))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_keeps_entries_steps_and_missing_keys(spark, tmp_path):
    base, incoming = str(tmp_path / "state"), str(tmp_path / "incoming")
    full = f"{EVENTS}, node string, node_status string"
    one, two, three = P.STEPS[:3]
    first = spark.createDataFrame(
        [
            (1, 5, "phase", "a", one, "complete"), (1, 7, "errors", "e7", three, "starting"),
            (1, 8, None, "none", three, "starting"), (2, 1, "agent_log", "l1", one, "starting"),
        ],
        full,
    )
    late = spark.createDataFrame(
        [
            (1, 6, "errors", "e6", two, "complete"), (1, 6, "errors", "e6 too", two, "complete"),
            (1, 2, None, "old", one, "starting"), (2, 3, "agent_log", "l3", two, "starting"),
        ],
        full,
    )
    for part in (first, late):
        part.write.mode("append").parquet(incoming)
        live.keep_state(live.read_events(spark, incoming, T.StructType.fromDDL(full)), base)
    every = first.unionByName(late)

    def same(a, b):
        return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))

    assert same(live.current_state(spark, base), P.fold_state(every))
    assert (1, None, "none", 8) in map(tuple, live.current_state(spark, base).collect())
    assert same(live.current_entries(spark, base), P.appended_entries(every))
    assert live.current_entries(spark, base).count() == 5
    assert same(live.current_steps(spark, base), P.step_states(every))


def test_arrivals_are_reconciled_once(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.range(20).selectExpr("id AS order_id", "id * 1.5D AS amount")
    IO.export(rows, 1, "source", base)
    IO.export(rows, 2, "source", base)
    IO.export(rows, 2, "target", base)
    arrivals.reconcile_arrivals(spark, base)
    assert [r["run_id"] for r in arrivals.results(spark, base).collect()] == [2]
    IO.export(rows.withColumn("amount", F.lit(1.0)), 1, "target", base)
    IO.export(rows, 2, "target", base)
    arrivals.reconcile_arrivals(spark, base)
    found = {r["run_id"]: r["passed"] for r in arrivals.results(spark, base).collect()}
    assert found == {1: False, 2: True}
    assert arrivals.results(spark, base).count() == 2


def test_a_broken_export_fails_its_run_alone(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.range(20).selectExpr("id AS order_id", "id * 1.5D AS amount")
    for run_id in range(1, 5):
        for side in IO.SIDES:
            IO.export(rows, run_id, side, base)
    broken = IO.export_path(base, 3, "target")
    for part in Path(broken).glob("*.parquet"):
        part.write_bytes(b"no parquet at all")
    query = arrivals.reconcile_arrivals(spark, base)
    assert query.exception() is None
    found = {r["run_id"]: (r["passed"], r["message"]) for r in arrivals.results(spark, base).collect()}
    assert {i: passed for i, (passed, _) in found.items()} == {1: True, 2: True, 3: False, 4: True}
    assert found[3][1].startswith("Reconciliation error")
    IO.export(rows, 5, "source", base)
    IO.export(rows, 5, "target", base)
    arrivals.reconcile_arrivals(spark, base)
    assert arrivals.results(spark, base).count() == 5


def test_a_run_becomes_complete_once(spark, tmp_path):
    """Runs named by a batch come from the stream's state, not from reading the manifest again."""
    base = str(tmp_path)
    rows = spark.range(3).selectExpr("id AS order_id", "id * 1.5D AS amount")
    named: list[list[int]] = []

    def pass_on():
        query = (
            arrivals.complete_runs(spark, base)
            .writeStream.option("checkpointLocation", f"{base}/seen")
            .foreachBatch(lambda df, _: named.append(sorted(r["run_id"] for r in df.collect())))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    for step in ([(1, "source"), (2, "target")], [(1, "target")], [(3, "source"), (3, "target")], [(2, "source")]):
        for run_id, side in step:
            IO.export(rows, run_id, side, base)
        pass_on()
    assert [ids for ids in named if ids] == [[1], [3], [2]]


def test_state_is_bounded_by_keys_and_survives_a_restart(spark, tmp_path):
    base, incoming = str(tmp_path / "state"), str(tmp_path / "incoming")
    schema = T.StructType.fromDDL(EVENTS)
    for start in range(0, 600, 200):
        part = spark.range(start, start + 200).selectExpr(
            "id % 3 AS run_id", "1000 - id AS seq", "concat('k', id % 5) AS key", "CAST(id AS STRING) AS value"
        )
        part.select(*schema.fieldNames()).write.mode("append").parquet(incoming)
        live.keep_state(live.read_events(spark, incoming, schema), base, parts=["state"])  # a new query each time
        stored = spark.read.format("statestore").load(f"{base}/checkpoint/state")
        assert stored.count() == 15
    every = spark.read.schema(schema).parquet(incoming)
    state = live.current_state(spark, base)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, P.fold_state(every).collect()))


def requests(spark, names):
    return spark.createDataFrame(
        [(name, "success", "SELECT 1", None, [], [], 0) for name in names],
        "request_id string, status string, source_code string, trans_error string, "
        "errors array<string>, warning_list array<string>, trans_code_length int",
    ).withColumns(
        {
            "generated_code": F.lit("x"),
            "trans_error_type": F.lit(None).cast("string"),
            "validation_passed": F.lit(True),
        }
    )


def test_history_store(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "history"))
    store.log(requests(spark, ["b", "a"]), ["request_id"])
    store.log(requests(spark, ["c"]), ["request_id"])
    found = {r["run_id"]: r["request_id"] for r in store.runs().collect()}
    assert found == {1: "a", 2: "b", 3: "c"}

    def patch(run_id, **fields):
        row = spark.range(1).select(F.lit(run_id).cast("bigint").alias("run_id"))
        store.patch(row.withColumns({k: F.lit(v) for k, v in fields.items()}))

    def state(run_id):
        row = H.get_run(store.runs(), run_id).first()
        return row["recon_ind"], row["recon_passed"], row["target_schema"]

    patch(2, recon_ind="prepared", target_schema="modern")
    patch(2, recon_ind="failed", recon_passed=False)
    assert state(2) == ("failed", False, "modern")
    store.compact()
    assert state(2) == ("failed", False, "modern") and state(1) == (None, None, None)
    patch(2, recon_ind="passed", recon_passed=True)
    HistoryStore(spark, str(tmp_path / "history"))
    assert state(2) == ("passed", True, "modern")
    metrics = H.dashboard_metrics(store.runs()).first()
    assert (metrics["total_runs"], metrics["recon_passed"], metrics["recon_failed"]) == (3, 1, 0)
    cleared = {r["table_name"]: r["deleted"] for r in store.clear().collect()}
    assert cleared == {"migration_runs": 3, "patches": 1} and store.runs().count() == 0
    store.log(requests(spark, ["z"]), ["request_id"])
    assert store.runs().first()["run_id"] == 1
