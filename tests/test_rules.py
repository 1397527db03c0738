"""Conforming rules, text checks, history and suites on small golden inputs."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.functions import conform as C
from migraspark.functions import text as X
from migraspark.operators import checks as K
from migraspark.operators import history as H
from migraspark.operators import lineage as L
from migraspark.operators import progress as P
from migraspark.operators.conform import conform, conform_by_name
from migraspark.operators.diagnose import significant


def values(spark, inputs, rule, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


# ---------------------------------------------------------------- conforming


def test_integers(spark):
    texts = ["12", " 7 ", "3.0", "1e3", "x", "", None, "nan", str(2**60 + 1)]
    assert values(spark, texts, C.to_integer) == [12, 7, 3, 1000, None, None, None, None, 2**60 + 1]


def test_fraction_is_an_error(spark):
    with pytest.raises(Exception, match="not a whole number"):
        values(spark, ["1.5"], C.to_integer)


def test_dates_and_times(spark):
    texts = ["2024-02-29", "2024-02-30", "2024-01-01 10:11:12.9", "no", None]
    days = values(spark, texts, C.to_date)
    assert days == [datetime.date(2024, 2, 29), None, datetime.date(2024, 1, 1), None, None]
    assert values(spark, texts, C.to_timestamp)[2] == datetime.datetime(2024, 1, 1, 10, 11, 12)


def test_decimals(spark):
    found = values(spark, ["1.005", "2", "x", None], lambda c: C.to_decimal(c).cast("string"))
    assert found == ["1.01", "2.00", None, None]


def test_strings_are_cut_only_when_declared(spark):
    texts = ["123456789012345678901", "short"]
    assert values(spark, texts, lambda c: C.to_string(c, 20)) == ["12345678901234567890", "short"]
    assert values(spark, texts, C.to_string) == texts


def test_absent_and_extra_columns(spark):
    df = spark.createDataFrame([("1", "keep")], "a string, other string")
    out = conform(df, T.StructType.fromDDL("missing DATE, a INT"))
    assert out.dtypes == [("a", "int"), ("other", "string")]


def test_rules_by_name(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-02", "2024-01-02 03:04:05.6", "x")],
        "customer_id string, signup_date string, created_at string, name string",
    )
    row = conform_by_name(df).first()
    assert row["customer_id"] == 1 and row["signup_date"] == datetime.date(2024, 1, 2)
    assert row["created_at"].second == 5 and row["name"] == "x"


# ---------------------------------------------------------------- texts


def test_precision_is_stripped(spark):
    assert values(spark, ["a DATETIME(0), b timestamp(6)", "DATETIME"], X.strip_precision) == [
        "a DATETIME, b TIMESTAMP", "DATETIME",
    ]


def test_table_name_of_ddl(spark):
    texts = ["CREATE MULTISET TABLE orders (\n id INT)", "create table x(a int)", "SELECT 1"]
    assert values(spark, texts, X.ddl_table_name) == ["orders", "x", None]


def test_fences(spark):
    texts = ["```sql\nSELECT 1\n```", " ```\na\nb\n``` ", "SELECT ```x```", "```sql\nopen"]
    assert values(spark, texts, X.strip_fence) == [
        "SELECT 1", "a\nb", "SELECT ```x```", "```sql\nopen",
    ]


def test_clean_sql_matches_the_driver_side(spark):
    texts = ["-- a\nSELECT 1 -- b\n  -- c\r\nFROM t;;\n", ";", "", "x"]
    assert values(spark, texts, X.clean_sql) == [
        X.clean_sql_text(t).replace("\r\n", "\n") for t in texts
    ]


def test_procedural_flags(spark):
    texts = ["create function f", "begin; declare x", "begin", "select spend", "as $$ x"]
    assert values(spark, texts, X.is_procedural_output) == [True, True, False, False, True]
    assert values(spark, texts, X.is_procedural_source) == [True] * 5
    words = values(spark, texts, lambda c: X.is_procedural_source(c, whole_words=True))
    assert words == [True, True, True, False, True]


def test_validation(spark):
    df = spark.createDataFrame(
        [(" ", "a", "b"), ("x", "a", "a"), ("x", None, ""), ("x", "a", "b")], "c string, s string, t string"
    )
    errors = [r[0] for r in df.select(X.validate_request(F.col("c"), F.col("s"), F.col("t"))).collect()]
    assert errors == [[X.EMPTY_CODE], [X.SAME_SIDES], [X.NO_SOURCE, X.NO_TARGET], []]


def test_references(spark):
    texts = [
        "SELECT * FROM Orders o JOIN `proj`.sales.customers c ON 1=1 left join\n products",
        "WITH a AS (SELECT 1 FROM orders), b AS (SELECT * FROM a) SELECT * FROM b",
        "DELETE FROM where", "", None,
    ]
    assert values(spark, texts, L.table_refs) == [
        ["customers", "orders", "products"], ["a", "b", "orders"], [], [], [],
    ]
    assert values(spark, texts[1:2], L.cte_names) == [["a", "b"]]


def test_significant_digits(spark):
    numbers = [100.0, 0.5, 1.23456789, 1234567.0, 0.0000123, 500.25]
    assert values(spark, numbers, significant, "double") == [f"{n:.6g}" for n in numbers]


# ---------------------------------------------------------------- history


@pytest.fixture
def history(spark):
    rows = [(1, "passed", True), (2, None, None), (3, "skipped", None), (7, None, None)]
    base = spark.createDataFrame(rows, "run_id bigint, recon_ind string, recon_passed boolean")
    return H.evolve(base)


def selected(runs, text, **options):
    return [r[0] for r in H.select_runs(runs, text, **options).collect()]


def test_selection(history):
    assert selected(history, "3, 1,1") == [1, 3]
    assert selected(history, "2-9,x") == [2, 3, 7]
    assert selected(history, "9-2") == []
    assert selected(history, "9-2", swap_reversed=True) == [2, 3, 7]
    assert selected(history, "a") == [1, 2, 3, 7]
    assert selected(history, " P ") == [2, 7]
    assert selected(history, "") == []


def test_patches_fold_in_order(spark, history):
    columns = "run_id bigint, seq bigint, recon_ind string, recon_passed boolean, force_recon_ind boolean"
    patches = spark.createDataFrame(
        [
            (2, 5, "failed", False, False),
            (2, 3, "passed", True, False),
            (2, 9, None, None, False),
            (3, 1, None, None, True),
            (99, 1, "passed", True, False),
        ],
        columns,
    ).withColumns(
        {f: F.lit(None).cast("string") for f in H.PATCH_FIELDS if f not in ("recon_ind", "recon_passed")}
    )
    out = {r["run_id"]: (r["recon_ind"], r["recon_passed"]) for r in H.apply_patches(history, patches).collect()}
    assert out == {1: ("passed", True), 2: ("failed", False), 3: (None, None), 7: (None, None)}


def test_ids_continue(spark, history):
    batch = spark.createDataFrame(
        [(f"r{i}", "success" if i else "failed", "SELECT 1", None, [], [], 0) for i in range(4)],
        "request_id string, status string, source_code string, trans_error string, "
        "errors array<string>, warning_list array<string>, trans_code_length int",
    ).withColumns(
        {
            "generated_code": F.lit("x"),
            "trans_error_type": F.lit(None).cast("string"),
            "validation_passed": F.lit(True),
        }
    )
    rows = H.log_runs(history, batch, ["request_id"]).orderBy("run_id").collect()
    assert [(r["run_id"], r["request_id"], r["success"]) for r in rows] == [
        (8, "r0", False), (9, "r1", True), (10, "r2", True), (11, "r3", True),
    ]
    assert rows[0]["code_length_original"] == 8 and rows[0]["error_type"] is None
    assert H.log_runs(history.limit(0), batch, ["request_id"]).agg(F.min("run_id")).first()[0] == 1


# ---------------------------------------------------------------- suites and progress


def test_checks(spark):
    def rows(n):
        return lambda s: s.range(n)

    def broken(s):
        raise ValueError("no table")

    out = K.run_checks(
        spark,
        [
            K.Check("a", "a", "unit", "", rows(0)),
            K.Check("b", "b", "unit", "", rows(3)),
            K.Check("c", "c", "unit", "", broken),
            K.Check("d", "d", "integration", "", rows(0), requires=("X",), slow=True),
            K.Check("e", "e", "integration", "", rows(0), requires=("X", "Y")),
        ],
        integration=True,
        available=["Y"],
    )
    found = {r["test_id"]: r for r in out.collect()}
    assert [found[k]["status"] for k in "abcde"] == ["passed", "failed", "failed", "skipped", "skipped"]
    assert found["c"]["message"] == "no table" and found["d"]["skip_reason"] == K.SLOW_OFF
    assert found["e"]["skip_reason"] == "missing env: X"
    assert K.suite_totals(out).first().asDict() == {"total": 5, "passed": 1, "failed": 2, "skipped": 2}
    digest = {r["test_id"]: r["error_tail"] for r in K.failure_digest(out).collect()}
    assert digest["b"] == [] and digest["c"][-1] == "ValueError: no table" and len(digest["c"]) <= 8


def test_checks_of_a_table_are_one_scan(spark):
    opened = []

    def numbers(s):
        opened.append(1)
        return s.range(100).withColumn("half", F.col("id") % 50)

    def few(s):
        return s.range(40).withColumnRenamed("id", "key")

    n = F.col("id")
    checks = [
        K.Check("a", "a", "unit", "", table=numbers, violates=n < 0),
        K.Check("b", "b", "unit", "", table=numbers, violates=n > 98),
        K.Check("c", "c", "unit", "", table=numbers, violates=F.col("half").isNull()),
    ]
    found = {r["test_id"]: r for r in K.run_checks(spark, checks).collect()}
    assert [found[k]["status"] for k in "abc"] == ["passed", "failed", "passed"] and len(opened) == 1
    assert found["b"]["message"] == "violated by {'id': 99, 'half': 49}"
    broken = K.Check("d", "d", "unit", "", table=numbers, violates=F.raise_error(F.lit("no")).isNotNull())
    more = [
        K.Check("u", "u", "unit", "", table=numbers, unique=("half",)),
        K.Check("v", "v", "unit", "", table=numbers, unique=("half", "id")),
        K.Check("r", "r", "unit", "", table=numbers, refers=(("half", "key"),), known=few),
    ]
    found = {r["test_id"]: r["status"] for r in K.run_checks(spark, [*checks, broken, *more]).collect()}
    assert found == {"a": "passed", "b": "failed", "c": "passed", "d": "failed", "u": "failed", "v": "passed", "r": "failed"}
    plan = K.compiled(numbers(spark), [c.violates for c in checks])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Join" not in plan
    values = K.unknown_values(numbers(spark), few(spark), (("half", "key"),))._jdf.queryExecution().optimizedPlan().toString()
    assert values.index("LeftOuter") < values.index("Aggregate [half")


def test_feed_keeps_the_newest(spark):
    events = spark.range(1000).selectExpr("id % 2 AS run_id", "id AS seq", "'n' AS node")
    feed = P.recent_feed(events)
    assert feed.groupBy("run_id").agg(F.count("*"), F.min("seq")).orderBy("run_id").collect() == [
        (0, 200, 600), (1, 200, 601),
    ]
