"""Groups of near copies: exact components, and few pairs to compare."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from migraspark.llm import linking
from migraspark.llm.near_dedup import near_duplicates


def brute(sets: dict[int, set], percent: int) -> dict[int, int]:
    parent = {n: n for n in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in sets}


def variants(n: int, size: int, edits, seed: int) -> dict[int, set]:
    rng = random.Random(seed)
    base = list(range(size))
    out = {}
    for node in range(n):
        k = rng.randint(*edits)
        gone = set(rng.sample(base, k))
        out[node] = {e for e in base if e not in gone} | {10**6 * (node + 1) + i for i in range(k)}
    return out


@pytest.mark.parametrize("n, size, edits", [(60, 40, (3, 12)), (80, 300, (20, 70))])
def test_components_of_a_bucket_equal_all_pairs(spark, n, size, edits):
    sets = variants(n, size, edits, n)
    rows = spark.createDataFrame([(node, e) for node, s in sets.items() for e in s], "node bigint, element bigint").cache()
    lists = rows.groupBy("node").agg(F.collect_set("element").alias("s"))

    def verify(pairs):
        left, right = (lists.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        joined = pairs.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("sa", "sb")))
        return joined.where("100 * c >= 75 * (size(sa) + size(sb) - c)").select("a", "b")

    buckets = spark.range(n).select(F.lit(7).cast("bigint").alias("bucket"), F.col("id").alias("node"))
    found = {
        r.node: r.component
        for r in linking.link(buckets, verify, lambda nodes: rows.join(nodes, "node", "left_semi"), 75).collect()
    }
    expected = brute(sets, 75)
    assert {node: found.get(node, node) for node in sets} == expected
    assert 1 < len(set(expected.values())) < n


def test_few_pairs_are_left_of_a_group_below_the_threshold(spark):
    """Six hundred copies, each too far from the others: the bitmaps rule nearly all pairs out."""
    sets = variants(600, 150, (22, 30), 3)
    rows = spark.createDataFrame([(node, e) for node, s in sets.items() for e in s], "node bigint, element bigint")
    members = spark.range(600).selectExpr("7L AS bucket", "id AS node", "id AS component")
    pairs = linking._across_components(members, lambda nodes: rows, 75)
    assert pairs.count() <= 20 * 600


def test_a_repeated_id_joins_the_classes_of_its_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    docs = spark.createDataFrame([(1, one), (2, one), (2, two), (3, two + " end"), (4, three)], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert found == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_open_members_meet_block_by_block(spark, monkeypatch):
    """Each pair once, and no join key with more than a block's members."""
    monkeypatch.setattr(linking, "BLOCK", 8)
    members = spark.range(100).selectExpr("7L AS bucket", "id AS node", "id AS component")
    held = spark.range(1000).selectExpr("id DIV 10 AS node", "id % 10 AS element")
    pairs = linking._across_components(members, lambda nodes: held.join(nodes, "node", "left_semi"), 75)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(a, b) for a in range(100) for b in range(a + 1, 100)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "(bucket#" in plan and "(i#" in plan and "(j#" in plan


def test_light_groups_equal_all_pairs_by_parities(spark):
    """One large bucket of sets about the threshold: components as of all pairs, and few pairs left to compare."""
    sets = variants(120, 300, (15, 60), 5)
    rows = spark.createDataFrame([(node, e) for node, s in sets.items() for e in s], "node bigint, element bigint").cache()
    lists = rows.groupBy("node").agg(F.collect_set("element").alias("s"))

    def elements(nodes):
        return rows.join(nodes, "node", "left_semi")

    def verify(pairs):
        left, right = (lists.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        joined = pairs.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("sa", "sb")))
        return joined.where("100 * c >= 80 * (size(sa) + size(sb) - c)").select("a", "b")

    buckets = spark.range(120).select(F.lit(7).cast("bigint").alias("bucket"), F.col("id").alias("node"))
    found = {r.node: r.component for r in linking.link(buckets, verify, elements, 80, light=True).collect()}
    expected = brute(sets, 80)
    assert {node: found.get(node, node) for node in sets} == expected
    assert 1 < len(set(expected.values())) < 120
    far = variants(400, 300, (60, 80), 6)
    rows = spark.createDataFrame([(node, e) for node, s in far.items() for e in s], "node bigint, element bigint")
    members = spark.range(400).selectExpr("7L AS bucket", "id AS node", "id AS component")
    assert linking._within_parity(members, lambda nodes: rows, 80).count() == 0


def test_chains_and_stars_fall_into_components(spark):
    """The moves of all rounds, put together at the end, lead every node to the smallest of its component."""
    links = spark.range(400).selectExpr("id - id % 100 AS a", "id AS b").union(
        spark.range(300, 700).selectExpr("id AS a", "id + 1 AS b")
    )
    found = {r.node: r.component for r in linking.components(links).collect()}
    assert found == {**{n: n - n % 100 for n in range(300)}, **{n: 300 for n in range(300, 701)}}
    assert linking.components(links.limit(0)).count() == 0
