"""Check suite: outcomes of checks on the tables, and tables of checks derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from migraspark.catalog import query
from migraspark.operators import checks as K
from migraspark.sources.tables import scan


def _checks(folder):
    def table(name):
        return lambda spark: scan(spark, folder, name)

    orders, customers, lines, parts = map(table, ("orders", "customer", "lineitem", "part"))
    orphans = {"table": orders, "refers": (("o_custkey", "c_custkey"),), "known": customers}
    broken = F.raise_error(F.lit("bad part")).isNotNull()
    paid, sizes = F.col("o_totalprice"), F.col("p_size")
    return [
        K.Check("data_001", "orders_have_customers", "unit", "No order without customer.", **orphans),
        K.Check("data_002", "line_keys_unique", "unit", "Line numbers are unique.", table=lines,
                unique=("l_orderkey", "l_linenumber")),
        K.Check("data_003", "parts_readable", "assets", "Every part can be read.", table=parts, violates=broken),
        K.Check("data_004", "part_sizes", "assets", "Sizes are positive.", table=parts, violates=sizes <= 0),
        K.Check("data_005", "orders_paid", "unit", "No order is free.", table=orders, violates=paid <= 0),
        K.Check("data_006", "orders_small", "unit", "No order is dear.", table=orders, violates=paid > 400_000),
        K.Check("data_007", "orders_dated", "unit", "Every order has a date.", table=orders,
                violates=F.col("o_orderdate").isNull()),
        K.Check("live_001", "live_rows", "integration", "Live rows.", slow=True, **orphans),
        K.Check("live_002", "slow_scan", "unit", "Slow scan.", slow=True, **orphans),
        K.Check("live_003", "needs_host", "unit", "Needs a host.", requires=("HOST", "USER"), **orphans),
    ]


@query(
    "chk_01_run_checks",
    """SELECT 'data_001' AS test_id, 'orders_have_customers' AS name, 'unit' AS category,
  CASE WHEN (SELECT COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0
    THEN 'passed' ELSE 'failed' END AS status, '' AS skip_reason
UNION ALL SELECT 'data_002', 'line_keys_unique', 'unit', CASE WHEN (SELECT COUNT(*) FROM
  (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)) = 0
    THEN 'passed' ELSE 'failed' END, ''
UNION ALL SELECT 'data_003', 'parts_readable', 'assets',
  CASE WHEN (SELECT COUNT(*) FROM part) = 0 THEN 'passed' ELSE 'failed' END, ''
UNION ALL SELECT 'data_004', 'part_sizes', 'assets',
  CASE WHEN (SELECT COUNT(*) FROM part WHERE p_size <= 0) = 0 THEN 'passed' ELSE 'failed' END, ''
UNION ALL SELECT 'data_005', 'orders_paid', 'unit',
  CASE WHEN (SELECT COUNT(*) FROM orders WHERE o_totalprice <= 0) = 0 THEN 'passed' ELSE 'failed' END, ''
UNION ALL SELECT 'data_006', 'orders_small', 'unit',
  CASE WHEN (SELECT COUNT(*) FROM orders WHERE o_totalprice > 400000) = 0 THEN 'passed' ELSE 'failed' END, ''
UNION ALL SELECT 'data_007', 'orders_dated', 'unit',
  CASE WHEN (SELECT COUNT(*) FROM orders WHERE o_orderdate IS NULL) = 0 THEN 'passed' ELSE 'failed' END, ''
UNION ALL SELECT 'live_001', 'live_rows', 'integration', 'skipped', 'integration tests disabled'
UNION ALL SELECT 'live_002', 'slow_scan', 'unit', 'skipped', 'slow tests disabled'
UNION ALL SELECT 'live_003', 'needs_host', 'unit', 'skipped', 'missing env: USER'""",
)
def chk_01(spark, folder):
    outcomes = K.run_checks(spark, _checks(folder), available=["HOST"])
    return outcomes.select("test_id", "name", "category", "status", "skip_reason")


# Each event stands for a check outcome: its type gives the category, its value the status.
OUTCOMES_SQL = """WITH outcomes AS (SELECT CAST(event_id AS VARCHAR) AS test_id,
  'check ' || event_id AS name,
  CASE event_type WHEN 'view' THEN 'unit' WHEN 'click' THEN 'unit' WHEN 'error' THEN 'assets'
       WHEN 'signup' THEN 'integration' ELSE 'other' END AS category,
  CASE WHEN value < 20 THEN 'failed' WHEN value < 40 THEN 'skipped' ELSE 'passed' END AS status,
  CASE WHEN value < 10 THEN concat_ws(chr(10), 'l1', 'l2', props) || chr(10)
       WHEN value < 20 THEN concat_ws(chr(10), 'a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', props)
       ELSE '' END AS error,
  event_type = 'view' AND value > 60 AS slow,
  CASE WHEN user_id < 20 THEN ['HOST'] WHEN user_id < 30 THEN ['HOST', 'USER'] ELSE [] END AS missing
  FROM events)"""


def outcomes(spark, folder):
    value, kind = F.col("value"), F.col("event_type")
    few = F.concat(F.concat_ws("\n", F.lit("l1"), F.lit("l2"), "props"), F.lit("\n"))
    many = F.concat_ws("\n", *[F.lit(c) for c in "abcdefgh"], "props")
    user = F.col("user_id")
    return scan(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("test_id"),
        F.concat(F.lit("check "), F.col("event_id").cast("string")).alias("name"),
        F.when(kind.isin("view", "click"), "unit")
        .when(kind == "error", "assets")
        .when(kind == "signup", "integration")
        .otherwise("other")
        .alias("category"),
        F.when(value < 20, "failed").when(value < 40, "skipped").otherwise("passed").alias("status"),
        F.col("props").alias("message"),
        F.when(value < 10, few).when(value < 20, many).otherwise("").alias("error"),
        ((kind == "view") & (value > 60)).alias("slow"),
        F.when(user < 20, F.array(F.lit("HOST")))
        .when(user < 30, F.array(F.lit("HOST"), F.lit("USER")))
        .otherwise(F.array().cast("array<string>"))
        .alias("missing"),
    )


@query(
    "chk_02_skip_reason",
    f"""{OUTCOMES_SQL} SELECT test_id, CASE
  WHEN category = 'integration' THEN 'integration tests disabled'
  WHEN slow THEN 'slow tests disabled'
  WHEN len(missing) > 0 THEN 'missing env: ' || array_to_string(missing, ', ') END AS skip_reason
FROM outcomes""",
)
def chk_02(spark, folder):
    reason = K.skip_reason(F.col("category"), F.col("slow"), F.col("missing"), False, False)
    return outcomes(spark, folder).select("test_id", reason.alias("skip_reason"))


@query(
    "chk_03_suite_totals",
    f"""{OUTCOMES_SQL} SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'passed') AS passed,
  COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) FILTER (status = 'skipped') AS skipped
FROM outcomes""",
)
def chk_03(spark, folder):
    return K.suite_totals(outcomes(spark, folder))


@query(
    "chk_04_category_counts",
    f"""{OUTCOMES_SQL} SELECT category, COUNT(*) AS checks,
  CASE category WHEN 'unit' THEN 1 WHEN 'assets' THEN 2 ELSE 3 END AS place
FROM outcomes WHERE category <> 'other' GROUP BY category""",
)
def chk_04(spark, folder):
    counts = K.category_counts(outcomes(spark, folder))
    return counts.withColumn("place", F.col("place").cast("int"))


@query(
    "chk_05_failure_digest",
    f"""{OUTCOMES_SQL}, lines AS (SELECT *, string_split(regexp_replace(error, '\\n\\z', ''), chr(10)) AS l
  FROM outcomes WHERE status = 'failed')
SELECT test_id, name, category, array_to_string(l[greatest(len(l) - 7, 1):], '|') AS error_tail
FROM lines""",
)
def chk_05(spark, folder):
    digest = K.failure_digest(outcomes(spark, folder))
    return digest.select(
        "test_id", "name", "category", F.array_join("error_tail", "|").alias("error_tail")
    )
