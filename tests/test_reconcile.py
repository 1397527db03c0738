"""Golden comparisons, the awkward cases, and properties."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from migraspark.operators import long_mode as L
from migraspark.operators import reconcile as R
from migraspark.operators.diagnose import diagnose
from migraspark.plans import bindings


def compared(spark, columns, source, target, target_columns=None, **options):
    one = spark.createDataFrame(source, columns)
    two = spark.createDataFrame(target, target_columns or columns)
    return R.reconcile(one, two, **options).first()


def test_identical_frames_pass(spark):
    rows = [(1, 10.0), (2, 20.0)]
    result = compared(spark, "id int, amount double", rows, rows)
    assert result["passed"] and result["message"].startswith("Reconciliation passed (2 rows")


def test_row_count_mismatch(spark):
    result = compared(spark, "id int", [(1,), (2,)], [(1,)])
    assert not result["passed"] and not result["row_counts_match"]
    assert result["message"] == "Row count mismatch: source=2, target=1"


def test_numbers_within_tolerance(spark):
    result = compared(spark, "id int, value double", [(1, 1.0000001)], [(1, 1.0000002)])
    assert result["passed"]


def test_numbers_beyond_tolerance(spark):
    result = compared(spark, "id int, value double", [(1, 100.0)], [(1, 200.0)])
    assert not result["passed"]
    (diff,) = result["column_diffs"]
    assert (diff["column"], diff["mismatch_count"], diff["max_numeric_diff"]) == ("value", 1, 100.0)


def test_reversed_rows_pass_by_key(spark):
    rows = [(10, 1, 50.0), (20, 2, 75.0)]
    result = compared(spark, "order_id int, product_id int, amount double", rows, rows[::-1])
    assert result["passed"] and result["alignment"] == "keys: order_id"


def test_other_column_name(spark):
    result = compared(spark, "a int", [(1,)], [(1,)], "b int")
    assert not result["columns_match"]
    assert [d["column"] for d in result["column_diffs"]] == ["(schema)"]


def test_column_order_counts(spark):
    result = compared(spark, "a int, b int", [(1, 2)], [(2, 1)], "b int, a int")
    assert not result["columns_match"]


def test_missing_values_are_equal(spark):
    nan = float("nan")
    source = [(1, None, ""), (2, nan, "nan"), (3, 4.0, " None ")]
    target = [(1, nan, None), (2, None, "<NA>"), (3, 4.0, "NONE")]
    assert compared(spark, "order_id int, amount double, note string", source, target)["passed"]


def test_infinity_is_not_close_to_anything(spark):
    inf = float("inf")
    columns = "order_id int, amount double"
    assert not compared(spark, columns, [(1, 5.0)], [(1, inf)])["passed"]
    assert not compared(spark, columns, [(1, inf)], [(1, 5.0)])["passed"]
    assert not compared(spark, columns, [(1, inf)], [(1, -inf)])["passed"]
    assert compared(spark, columns, [(1, inf)], [(1, inf)])["passed"]


def test_tolerance_scales_with_the_target(spark):
    columns = "order_id int, amount double"
    low, high = 10000.0, 10000.0 + 1.00015
    assert compared(spark, columns, [(1, low)], [(1, high)])["passed"]
    assert not compared(spark, columns, [(1, high)], [(1, low)])["passed"]


def test_booleans_compare_as_numbers(spark):
    result = compared(spark, "order_id int, flag boolean", [(1, True)], [(1, False)])
    (diff,) = result["column_diffs"]
    assert diff["column"] == "flag" and diff["max_numeric_diff"] == 1.0


def test_repeated_key_on_one_side_falls_back(spark):
    columns = "order_id int, amount double"
    result = compared(spark, columns, [(1, 1.0), (1, 2.0)], [(1, 1.0), (2, 2.0)])
    assert result["alignment"] == "position" and not result["passed"]
    assert [d["column"] for d in result["column_diffs"]] == ["order_id"]


def test_keys_on_one_side_only(spark):
    columns = "order_id int, amount double"
    rows = [(i, float(i)) for i in range(5)]
    result = compared(spark, columns, rows, [(i + 2, a) for i, a in rows])
    (diff,) = result["column_diffs"]
    assert diff["column"] == "(keys)"
    assert "2 source-only rows, 2 target-only rows" in diff["sample_mismatch"]


def test_key_types_clash(spark):
    result = compared(
        spark, "order_id int, amount double", [(1, 1.0)], [("1", 1.0)],
        "order_id string, amount double",
    )
    assert [d["column"] for d in result["column_diffs"]] == ["(keys)"]


def test_country_is_taken_for_a_measure(spark):
    assert R.key_candidates(["country", "city", "revenue"]) == [["city"]]
    rows = [("A", "x", 1.0), ("B", "x", 2.0)]
    result = compared(spark, "country string, city string, revenue double", rows, rows[::-1])
    assert result["alignment"] == "position" and result["passed"]


def test_all_columns_measures_means_no_key():
    assert R.key_candidates(["amount", "order_count"]) == []
    assert R.key_candidates(["id", "name"]) == []
    assert R.key_candidates(["order_id", "amount"]) == [["order_id"], ["order_id"]]


def test_null_keys_are_paired(spark):
    rows = [(None, 1.0), (2, 2.0)]
    result = compared(spark, "order_id int, amount double", rows, rows)
    assert result["passed"] and result["alignment"] == "keys: order_id"


def test_date_column_with_a_bad_value(spark):
    columns = "order_id int, order_date string, amount double"
    source = [(1, "2024-01-05", 1.0), (2, "oops", 2.0)]
    target = [(1, "2024-01-05 00:00:00", 1.0), (2, None, 2.0)]
    assert compared(spark, columns, source, target)["passed"]


def test_text_that_is_no_number_on_both_sides(spark):
    result = compared(
        spark, "order_id int, amount string", [(1, "x")], [(1, float("nan"))],
        "order_id int, amount double",
    )
    assert result["passed"]


def test_empty_frames_pass(spark):
    assert compared(spark, "id int, amount double", [], [])["passed"]
    assert compared(spark, "amount double", [], [])["passed"]


def test_large_whole_keys_do_not_collide(spark):
    big = 2**60
    columns = "order_id bigint, amount double"
    rows = [(big, 1.0), (big + 1, 2.0)]
    result = compared(spark, columns, rows, rows)
    assert result["passed"] and result["alignment"] == "keys: order_id"


def test_positional_comparison_of_repeated_rows(spark, many_partitions):
    source = spark.createDataFrame([("a", 1.0)] * 400 + [("b", 2.0)] * 200, "city string, amount double")
    target = spark.createDataFrame([("a", 1.0)] * 390 + [("b", 2.0)] * 210, "city string, amount double")
    result = R.reconcile(source, target).first()
    counts = {d["column"]: d["mismatch_count"] for d in result["column_diffs"]}
    assert counts == {"city": 10, "amount": 10}
    assert "row 390: source=a target=b" in result["column_diffs"][0]["sample_mismatch"]


def test_shuffled_table_passes(spark, tiny, many_partitions):
    orders = bindings.orders(spark, tiny)
    assert R.reconcile(orders, orders.orderBy(F.desc("amount"))).first()["passed"]
    coarse = orders.select("status", F.round("amount", -4).alias("amount"))
    result = R.reconcile(coarse, coarse.repartition(5)).first()
    assert result["passed"] and result["alignment"] == "position"


@pytest.mark.parametrize("changed", [1, 7])
def test_changed_cells_are_counted_exactly(spark, tiny, changed):
    orders = bindings.orders(spark, tiny)
    target = orders.withColumn(
        "amount", F.when(F.col("order_id") < changed, F.col("amount") * 2).otherwise(F.col("amount"))
    )
    result = R.reconcile(orders, target).first()
    assert [(d["column"], d["mismatch_count"]) for d in result["column_diffs"]] == [
        ("amount", changed)
    ]


def test_message_lists_three_columns(spark):
    columns = "order_id int, " + ", ".join(f"v{i} int" for i in range(5))
    result = compared(spark, columns, [(1, 1, 1, 1, 1, 1)], [(1, 2, 2, 2, 2, 2)])
    assert result["message"].endswith("v2 (1 mismatches), +2 more")


def test_diagnosis(spark):
    rows = [(1, 10.0)]
    passed = R.reconcile(*[spark.createDataFrame(rows, "id int, amount double")] * 2)
    assert "agree in every column" in diagnose(passed).first()["explanations"][0]
    columns = "order_id int, pct_of_total_revenue double"
    one, two = (spark.createDataFrame([(1, v)], columns) for v in (1.0, 2.5))
    found = diagnose(R.reconcile(one, two)).first()
    assert "DECIMAL" in found["explanations"][0]
    assert found["details"] == [
        'pct_of_total_revenue: 1 row(s) differ (max numeric delta: 1.5), for example key {"order_id":1}: '
        "source=1.0 target=2.5"
    ]


def test_long_mode_agrees_with_wide_mode(spark, tiny):
    orders = R.normalize(bindings.orders(spark, tiny))
    target = orders.withColumn(
        "amount", F.when(F.col("order_id") < 20, F.col("amount") + 900).otherwise(F.col("amount"))
    )
    long = L.compare_melted(
        L.melt(orders, 3, ["order_id"]), L.melt(target, 3, ["order_id"])
    ).filter("mismatch_count > 0")
    wide = R.explode_diffs(R.reconcile(orders, target, run_id=3))
    keep = ["run_id", "column", "mismatch_count", "max_numeric_diff"]
    assert long.select(*keep).collect() == wide.select(*keep).collect()


def test_long_mode_with_repeated_keys(spark):
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "id int, amount double")
    once = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, amount double")
    off = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 0.0)], "id int, amount double")
    source = L.melt(twice, 1, ["id"]).unionAll(L.melt(once, 2, ["id"])).unionAll(L.melt(once, 3, ["id"]))
    target = L.melt(twice, 1, ["id"]).unionAll(L.melt(off, 2, ["id"])).unionAll(L.melt(twice, 3, ["id"]))
    found = {(r["run_id"], r["column"]): tuple(r)[2:] for r in L.compare_melted(source, target).collect()}
    equal, short = (0, 0, 0, None), (0, 1, None, None)
    assert found == {
        (1, "id"): equal, (1, "amount"): equal, (2, "amount"): (0, 1, 1, 3.0),
        (3, "id"): short, (3, "amount"): short,
    }


def test_long_mode_pairs_repeated_rows_like_reconcile(spark):
    """Several runs with copies and without a usable key, in one job."""
    rng = random.Random(5)
    pairs = {}
    for run_id in range(1, 5):
        rows = [(rng.choice("abc"), float(rng.randint(1, 4)), rng.choice([None, 1, 2])) for _ in range(120)]
        other = [(a, b + (rng.random() < 0.1), c) for a, b, c in rows]
        rng.shuffle(other)
        pairs[run_id] = [spark.createDataFrame(x, "name string, amount double, n int") for x in (rows, other)]
    source = target = None
    for run_id, sides in pairs.items():
        long = [L.melt(R.normalize(side), run_id, ["name"]) for side in sides]
        source = long[0] if source is None else source.unionAll(long[0])
        target = long[1] if target is None else target.unionAll(long[1])
    found = sorted(
        (r.run_id, r.column, r.mismatch_count, r.max_numeric_diff)
        for r in L.compare_melted(source, target).collect() if r.mismatch_count
    )
    expected = []
    for run_id, sides in pairs.items():
        result = R.reconcile(*sides, run_id).first()
        assert result["alignment"] == "position"
        expected += [(run_id, d["column"], d["mismatch_count"], d["max_numeric_diff"]) for d in result["column_diffs"]]
    assert found == sorted(expected) and found


def test_unique_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert R.unique_names(df.toDF("a", "b", "a", "a")).columns == ["a", "b", "a_1", "a_2"]
    assert R.unique_names(df.toDF("a", "a_1", "a", "A")).columns == ["a", "a_1", "a_2", "A"]
    one = df.toDF("order_id", "x", "x", "y")
    result = R.reconcile(one, spark.createDataFrame([(1, 2, 7, 4)], "a int, b int, c int, d int").toDF(*one.columns)).first()
    assert result["message"] == "Data mismatch: x_1 (1 mismatches)"


def test_nested_values(spark):
    schema = "order_id int, m map<string, double>, s struct<a: int, b: array<double>>, l array<string>"
    rows = [(1, {"x": 1.0, "y": 2.0}, (1, [1.0, 2.0]), ["p"]), (2, None, (None, None), []), (3, {}, (5, [None]), None)]
    near = [(1, {"y": 2.00001, "x": 1.0}, (1, [1.00001, 2.0]), ["p"]), *rows[1:]]
    source = spark.createDataFrame(rows, schema)
    assert R.reconcile(source, spark.createDataFrame(near, schema)).first()["passed"]
    far = [(1, {"x": 1.0, "z": 2.0}, (1, [1.0, 2.5]), ["p", "q"]), (2, {}, (None, []), [None]), (3, {}, (5, [0.0]), None)]
    diffs = {d["column"]: d for d in R.reconcile(source, spark.createDataFrame(far, schema)).first()["column_diffs"]}
    assert {c: d["mismatch_count"] for c, d in diffs.items()} == {"m": 2, "s": 3, "l": 2}
    assert diffs["s"]["sample_mismatch"] == 'key {"order_id":1} at s.b[1]: source=2.0 target=2.5'
    assert diffs["s"]["max_numeric_diff"] == 0.5
    assert diffs["l"]["sample_mismatch"] == 'key {"order_id":1} at l[1]: source=NULL target=q'
