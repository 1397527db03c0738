"""Progress folds with each user as a run and each event as one of its events, and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from migraspark.catalog import query
from migraspark.catalog.reconcile import SIDES_SQL, orders, repriced
from migraspark.operators import progress as P
from migraspark.session import scratch_path
from migraspark.sources.results import export
from migraspark.sources.tables import scan
from migraspark.streaming import progress as live
from migraspark.streaming import reconcile as arrivals

NODES = {
    "view": "synthetic_data_generator",
    "click": "environment_provisioner",
    "signup": "migration_intake",
    "error": "migration_transpiler",
    "purchase": "recon_comparator",
}
KEYS = {
    "view": "phase",
    "click": "run_count",
    "signup": "agent_log",
    "error": "errors",
    "purchase": "docs_path",
}


def _case(mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE event_type {cases} END"


EVENT_EXPRESSIONS = {
    "run_id": "user_id",
    "seq": "event_id",
    "node": _case(NODES),
    "node_status": "CASE WHEN value > 100 THEN 'complete' ELSE 'starting' END",
    "key": _case(KEYS),
    "value": "props",
    "duration_ms": "sqrt(value)",
}
LISTED = [f"{text} AS {name}" for name, text in EVENT_EXPRESSIONS.items()]
EVENTS_SQL = f"WITH progress AS (SELECT {', '.join(LISTED)} FROM events)"


def events(spark, folder):
    return scan(spark, folder, "events").selectExpr(*LISTED)


FOLD_SQL = f"""{EVENTS_SQL} SELECT run_id, key, arg_max(value, seq) AS value, MAX(seq) AS seq
FROM progress WHERE key NOT IN ('errors', 'agent_log') GROUP BY run_id, key"""


@query("prg_01_fold_state", FOLD_SQL)
def prg_01(spark, folder):
    return P.fold_state(events(spark, folder))


APPENDED_SQL = f"""{EVENTS_SQL} SELECT run_id, key, seq, value FROM progress
WHERE key IN ('errors', 'agent_log')"""


@query("prg_01_appended_entries", APPENDED_SQL)
def prg_01_appended(spark, folder):
    return P.appended_entries(events(spark, folder))


STEPS_LIST = ", ".join(f"'{s}'" for s in P.STEPS)


STEPS_SQL = f"""{EVENTS_SQL}, latest AS (SELECT run_id, arg_max(node, seq) AS active FROM progress GROUP BY 1),
done AS (SELECT DISTINCT run_id, node FROM progress WHERE node_status = 'complete'),
steps AS (SELECT UNNEST([{STEPS_LIST}]) AS node, UNNEST(range(1, 9)) AS step),
every AS (SELECT run_id, active, node, step FROM latest, steps)
SELECT every.run_id, CAST(step AS INT) AS step, every.node,
  CASE WHEN done.node IS NOT NULL THEN 'done' WHEN active = every.node THEN 'active'
       ELSE 'pending' END AS state
FROM every LEFT JOIN done ON done.run_id = every.run_id AND done.node = every.node"""


@query("prg_02_step_states", STEPS_SQL)
def prg_02(spark, folder):
    return P.step_states(events(spark, folder))


@query(
    "prg_03_recent_feed",
    f"""{EVENTS_SQL} SELECT run_id, seq, node, node_status FROM progress
QUALIFY ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 200""",
)
def prg_03(spark, folder):
    return P.recent_feed(events(spark, folder)).select("run_id", "seq", "node", "node_status")


@query(
    "prg_04_step_durations",
    f"""{EVENTS_SQL} SELECT node AS agent, COUNT(*) AS entries,
  CAST(SUM(CAST(ROUND(duration_ms, 1) AS DECIMAL(20,1))) AS DOUBLE) AS total_ms,
  CAST(MAX(CAST(ROUND(duration_ms, 1) AS DECIMAL(20,1))) AS DOUBLE) AS longest_ms
FROM progress GROUP BY node""",
)
def prg_04(spark, folder):
    log = events(spark, folder).withColumnRenamed("node", "agent")
    return P.step_durations(log)


def _streamed(spark, folder, part):
    schema = scan(spark, folder, "events").schema
    base = scratch_path(spark, "stream_state")
    arriving = live.read_events(spark, folder, schema, "events.parquet").selectExpr(*LISTED)
    live.keep_state(arriving, base, parts=[part])
    return base


@query("str_01_stream_state", FOLD_SQL)
def str_01(spark, folder):
    return live.current_state(spark, _streamed(spark, folder, "state"))


@query("str_01_stream_appended", APPENDED_SQL)
def str_01_appended(spark, folder):
    return live.current_entries(spark, _streamed(spark, folder, "appended"))


@query("str_01_stream_steps", STEPS_SQL)
def str_01_steps(spark, folder):
    return live.current_steps(spark, _streamed(spark, folder, "activity"))


STATUSES = ("COMPLETED", "DELIVERED", "CANCELLED")


@query(
    "str_02_stream_reconcile",
    f"""{SIDES_SQL}, bad AS (SELECT s.status, COUNT(*) AS n,
    COUNT(*) FILTER (ABS(s.amount - t.amount) > 1e-4 + 1e-4 * t.amount) AS a,
    COUNT(*) FILTER (s.status <> t.status) AS b
  FROM src s JOIN repriced t USING (order_id) GROUP BY s.status)
SELECT CASE status WHEN 'COMPLETED' THEN 1 WHEN 'DELIVERED' THEN 2 END AS run_id,
  n AS source_rows, a + b = 0 AS passed, concat_ws(', ', CASE WHEN a > 0 THEN 'amount' END,
    CASE WHEN b > 0 THEN 'status' END) AS differing
FROM bad WHERE status <> 'CANCELLED'""",
)
def str_02(spark, folder):
    base = scratch_path(spark, "arrivals")
    source = orders(spark, folder)
    for run_id, status in enumerate(STATUSES, start=1):
        part = source.filter(F.col("status") == status)
        export(part, run_id, "source", base)
        if status != "CANCELLED":  # its target never arrives
            export(repriced(part), run_id, "target", base)
    arrivals.reconcile_arrivals(spark, base)
    differing = F.array_join(F.transform("column_diffs", lambda d: d["column"]), ", ")
    return arrivals.results(spark, base).select(
        F.col("run_id").cast("int").alias("run_id"),
        "source_rows",
        "passed",
        differing.alias("differing"),
    )
