"""Verdicts by range digests: equal to those of ``reconcile``, without moving what is equal."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from migraspark.functions import normalize as N
from migraspark.operators import hash_tree
from migraspark.operators.hash_tree import cell, reconcile_ranges
from migraspark.operators.reconcile import reconcile

ROWS = 40_000


@pytest.fixture(scope="module")
def sales(spark):
    return spark.range(ROWS).select(
        F.col("id").alias("order_id"),
        (F.pmod(F.xxhash64("id"), F.lit(10**7)) / 1000).alias("amount"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("status"),
    )


def compared(source, target, **more):
    """The result and the rows moved, after comparing with ``reconcile``."""
    found = reconcile_ranges(source, target, 3, "a.sql", **more).collect()[0].asDict(recursive=True)
    moved = found.pop("rows_compared")
    assert found == reconcile(source, target, 3, "a.sql").collect()[0].asDict(recursive=True)
    return found, moved


@pytest.mark.parametrize("rtol, atol", [(1e-4, 1e-4), (0.0, 0.01), (1e-3, 0.0), (0.5, 0.1), (0.0, 0.0)])
def test_values_of_one_cell_match(spark, rtol, atol):
    rng = random.Random(3)
    pairs = []
    for _ in range(4000):
        y = rng.choice([0.0, 1.0, -1.0]) * 10 ** rng.uniform(-8, 12)
        step = (atol + rtol * abs(y)) * rng.uniform(-1.3, 1.3)
        pairs.append((y + step, y))
    pairs += [(0.0, -0.0), (float("inf"), float("inf")), (float("inf"), 1.0), (1e300, -1e300), (0.0, 1e-300)]
    df = spark.createDataFrame(pairs, "x double, y double")
    for shift in (0.0, 0.5):
        same = cell(F.col("x"), rtol, atol, shift) == cell(F.col("y"), rtol, atol, shift)
        rows = df.select(same.alias("same"), N.numbers_match(F.col("x"), F.col("y"), rtol, atol).alias("match"))
        counts = {(r.same, r.match): r["count"] for r in rows.groupBy("same", "match").count().collect()}
        assert (True, False) not in counts
        assert counts[True, True] > (0 if rtol + atol == 0 else 500)


def test_equal_sides_move_no_row(sales):
    result, moved = compared(sales, sales.withColumn("amount", F.col("amount") * F.lit(1 + 1e-13)))
    assert result["passed"] and moved < ROWS / 100


def test_few_changes_move_few_rows(sales):
    changed = sales.withColumns({
        "amount": F.when(F.col("order_id") == 77, F.lit(-5.0)).otherwise(F.col("amount")),
        "status": F.when(F.col("order_id") == 78, "gone").otherwise(F.col("status")),
    })
    result, moved = compared(sales, changed)
    assert [d["mismatch_count"] for d in result["column_diffs"]] == [1, 1]
    assert 4 <= moved <= 40


def test_ranges_are_split(sales, monkeypatch):
    """From four wide ranges down to a handful of rows."""
    changed = sales.withColumn("status", F.when(F.col("order_id") == 5, "new").otherwise(F.col("status")))
    result, moved = compared(sales, changed, bits=2)
    assert not result["passed"] and 2 <= moved < ROWS / 50
    monkeypatch.setattr(hash_tree, "NAMED", 0)
    result, moved = compared(sales, changed, bits=2)
    assert 2 * ROWS / 4 - 2000 < moved < 2 * ROWS / 4 + 2000


def test_differences_in_every_range_are_joined_after_one_fold(sales, monkeypatch):
    """Before, ranges finer than rows were folded once more on both sides, which moves every row's digests."""
    folds, fold = [], hash_tree.folded
    monkeypatch.setattr(hash_tree, "folded", lambda rows, bits: folds.append(bits) or fold(rows, bits))
    result, moved = compared(sales, sales.withColumn("amount", F.col("amount") * 1.00001), bits=10)
    assert result["passed"] and moved == 2 * ROWS and folds == [10, 10]


def test_swapped_values_and_missing_values_differ(sales):
    swapped = sales.withColumn("order_id", F.when(F.col("order_id") == 1, 2).when(F.col("order_id") == 2, 1).otherwise(F.col("order_id")))
    result, _ = compared(sales, swapped)
    assert result["message"].startswith("Data mismatch: amount (2 mismatches)")
    shifted = sales.withColumn("amount", F.when(F.col("order_id") == 9, None).otherwise(F.col("amount")))
    assert compared(sales, shifted)[0]["column_diffs"][0]["mismatch_count"] == 1


def test_counts_keys_and_types(sales):
    result, moved = compared(sales, sales.where("order_id > 3"))
    assert result["message"].startswith("Row count mismatch") and moved == 0
    result, _ = compared(sales, sales.withColumn("order_id", F.when(F.col("order_id") == 4, -4).otherwise(F.col("order_id"))))
    assert result["column_diffs"][0]["column"] == "(keys)"
    result, moved = compared(sales, sales.withColumn("amount", F.col("amount").cast("string")))
    assert result["passed"] and moved == 0
    assert not compared(sales, sales.withColumn("order_id", F.col("order_id").cast("string")))[0]["passed"]
    assert compared(sales.limit(0), sales.limit(0))[0]["passed"]


def test_repeated_keys_are_left_to_positions(spark):
    rows = [(1, 2.0, "a"), (1, 3.0, "a"), (None, 4.0, None)]
    schema = "order_id bigint, amount double, status string"
    source = spark.createDataFrame(rows, schema)
    target = spark.createDataFrame([(1, 2.0, "a"), (1, 3.5, "a"), (None, 4.0, "")], schema)
    result, moved = compared(source, target)
    assert result["alignment"] == "position" and moved == 6


def test_only_digests_are_shuffled(spark, sales):
    left, right = (hash_tree._row_digests(sales, sales, ["order_id"], 1e-4, 1e-4) for _ in range(2))
    plan = hash_tree.folded(left, 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan, plan
    kept = hash_tree._within(right, spark.range(3).select(F.col("id").alias(hash_tree.RANGE)), 16)
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
