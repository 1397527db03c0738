"""Plans: what must not appear in them at scale, and what must reach the scan."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from migraspark.catalog import load
from migraspark.plans import workload
from migraspark.plans.bindings import AS_OF, base_tables

QUERIES = load()[0]
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LIGHT = [
    name for name in QUERIES
    if not name.startswith(("str_", "snk_", "src_0", "chk_01", "gen_21", "rec_15_c", "rec_16", "rec_17", "rec_20", "udf_"))
]


@pytest.mark.parametrize("name", LIGHT)
def test_no_pairwise_join_and_no_python(name, spark, tiny):
    text = plan(QUERIES[name](spark, tiny))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not any(node in text for node in PYTHON_NODES)


@pytest.mark.parametrize("name", ["wq_1_customer_lifetime", "wq_3_lapsed_high_value", "top_01_top_n_per_group", "prg_03_recent_feed"])
def test_ranks_are_cut_before_the_shuffle(name, spark, tiny):
    assert re.search(r"WindowGroupLimit.*Partial", plan(QUERIES[name](spark, tiny)))


def test_filters_and_columns_reach_the_scan(spark, tiny):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = plan(QUERIES["flt_02_range_pred"](spark, tiny))
    assert "GreaterThanOrEqual(o_totalprice" in text and "GreaterThan(o_orderkey" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_orderpriority" not in schema
    point = plan(QUERIES["run_12_select_runs"](spark, tiny))
    assert "o_orderkey" in re.search(r"ReadSchema: struct<([^>]*)>", point).group(1)
    assert "o_totalprice" not in re.search(r"ReadSchema: struct<([^>]*)>", point).group(1)


def test_orders_are_folded_before_they_meet_customers(spark, tiny):
    base = base_tables(spark, tiny)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(workload.lapsed_high_value(base.customers, base.orders, AS_OF, sort=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = text.index("SortMergeJoin")
    assert "HashAggregate" in text[join:] or "SortAggregate" in text[join:]


def test_generation_needs_no_shuffle(spark):
    from migraspark.operators import generate as G

    table = G.generate(G.BASE_SPECS["orders"], G.row_spine(spark, 100))
    assert "Exchange" not in plan(table)


def test_unpartitioned_windows_only_see_one_row_per_partition(spark, tiny):
    """The row-scale input of an un-partitioned window would be a scan or a join; these windows sit
    on the per-partition summary."""
    from migraspark.operators import ordered as O

    df = base_tables(spark, tiny).orders.select("order_id", "amount")
    text = plan(O.with_position(df, [O.asc("amount"), O.asc("order_id")]))
    window = text[text.index("Window [") :]
    assert re.search(r"HashAggregate\(keys=\[.*__pid", window)


def test_input_of_a_hot_key_is_split(spark, monkeypatch):
    from migraspark.operators import skew as S

    left = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(20000).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = S.lookup_join(left, right, ["k"])
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in sizes) == 20000
    assert max(r["count"] for r in sizes) < 2.5 * 20000 / len(sizes)
