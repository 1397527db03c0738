"""Joins with one key holding a third of the rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from migraspark.operators import skew as S


@pytest.fixture(scope="module")
def sides(spark):
    left = [(i, 1 if i % 3 == 0 else (None if i % 50 == 1 else i % 400)) for i in range(6000)]
    right = [(k, f"name{k}") for k in range(0, 400, 2)] + [(1, "hot"), (None, "nobody")]
    return (
        left,
        right,
        spark.createDataFrame(left, "id int, k int").repartition(8),
        spark.createDataFrame(right, "k int, name string"),
    )


def test_heavy_keys_are_found(sides):
    _, _, left, _ = sides
    found = S.heavy_shares(left, ["k"], 0.05)
    hot = left.filter("k = 1").select(F.xxhash64("k")).first()[0]
    share = left.filter("k = 1").count() / 6000
    assert list(found) == [hot] and share <= found[hot] <= share + 0.025


def test_salts_follow_the_share():
    """Ten thousand partitions: a key with a third of the rows, and two hundred small heavy ones."""
    shares = {1: 1 / 3, **{k: 0.00015 + k * 1e-6 for k in range(2, 202)}, 999: 0.00009}
    tiers = S.salt_tiers(shares, 10_000)
    assert tiers[8192] == [1] and 999 not in sum(tiers.values(), [])
    assert sum(salts * len(keys) for salts, keys in tiers.items()) < 8192 + 8 * 200
    assert S.salt_tiers({1: 1.0}, 1) == {}


def test_copies_of_right_rows(spark):
    """A key with 40 % of the rows on 8 partitions needs eight copies; its neighbours one."""
    left = spark.range(5000).selectExpr("CASE WHEN id % 10 < 4 THEN -1L ELSE id END AS k", "id")
    right = spark.range(-1, 5000).selectExpr("id AS k", "id * 2 AS v")
    joined = S.lookup_join(left, right, ["k"], partitions=8)
    assert joined.count() == 5000
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (0, 5000") == 1  # the scan that looked for heavy keys was another, single one
    shares = S.heavy_shares(left, ["k"], 1 / 8)
    tiers = S.salt_tiers(shares, 8)
    copies = right.withColumn("n", S._salts(["k"], tiers)).agg(F.sum("n")).first()[0]
    assert copies == 5001 + 7


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(sides, how):
    left, right, ldf, rdf = sides
    joined = S.lookup_join(ldf, rdf, ["k"], how=how, partitions=100, null_safe=True)
    assert "__salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    names = dict(right)
    expected = Counter(
        (i, k, names.get(k)) for i, k in left if how == "left" or k in names
    )
    assert Counter(tuple(r) for r in joined.collect()) == expected


def test_equal_rows_of_a_hot_key_are_all_kept(spark):
    left = spark.createDataFrame([("x", 1)] * 5000, "v string, k int").repartition(8)
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, name string")
    assert S.lookup_join(left, right, ["k"]).count() == 10000


def test_left_join_with_hot_right_side(sides):
    left, right, many, few = sides
    joined = S.expand_left_join(few, many, ["k"])
    expected = Counter()
    for k, name in right:
        ids = [i for i, key in left if key is not None and key == k]
        expected.update([(k, name, i) for i in ids] or [(k, name, None)])
    assert Counter(tuple(r) for r in joined.select("k", "name", "id").collect()) == expected


def test_rows_with_maps_can_be_salted(spark):
    left = spark.range(600).selectExpr("1 AS k", "map('a', id) AS m")
    right = spark.createDataFrame([(1, "x")], "k int, name string")
    assert S.lookup_join(left, right, ["k"]).count() == 600
