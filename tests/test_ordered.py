"""Ordered operators against plain Python on skewed data."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.operators import ordered as O
from migraspark.operators.ordered import asc, desc

pytestmark = pytest.mark.usefixtures("many_partitions")
random.seed(7)


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, a third with one value, some NULLs."""
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else f"g{i % 17}"
        value = 5 if i % 3 == 1 else random.randint(-50, 50)
        rows.append((i, group, None if i % 97 == 0 else value))
    return rows, spark.createDataFrame(rows, "id int, grp string, val int").repartition(7)


def low_nulls(value):
    return (value is not None, value or 0)


def test_position(skewed):
    rows, df = skewed
    out = O.with_position(df, [asc("val"), asc("id")], "place").collect()
    ordered = sorted(rows, key=lambda r: (low_nulls(r[2]), r[0]))
    assert {r["id"]: r["place"] for r in out} == {r[0]: i for i, r in enumerate(ordered)}


def test_position_of_equal_rows_is_dense(spark):
    df = spark.createDataFrame([(1,)] * 500, "v int").repartition(5)
    places = sorted(r["place"] for r in O.with_position(df, [asc("v")], "place").collect())
    assert places == list(range(500))


def test_ties_are_split_over_partitions(spark):
    df = spark.range(20000).select(F.lit(1).alias("v"), "id").repartition(8)
    laid = O.lay_out(df, [asc("v")], split_ties=True)
    sizes = [r["count"] for r in laid.groupBy(O.PID).count().collect()]
    assert sum(sizes) == 20000 and len(sizes) == 8 and max(sizes) < 5000


@pytest.mark.parametrize("make", [asc, desc])
def test_a_hot_value_and_missing_values_fill_ranges_by_their_share(spark, make):
    """Half of the rows tie, a quarter has no value; positions are dense and in order all the same."""
    df = spark.range(16_000).select(
        F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 < 3, 7.5).otherwise(F.col("id") / 100).alias("v"), "id"
    )
    laid = O._laid(df, [make("v")], split_ties=True)
    assert not laid.stored
    sizes = [r["count"] for r in laid.rows.groupBy(O.PID).count().collect()]
    assert sum(sizes) == 16_000 and max(sizes) < 2.2 * 16_000 / 8
    places = {r["place"]: r["v"] for r in O.with_position(df, [make("v")], "place").collect()}
    assert sorted(places) == list(range(16_000))
    known = [places[i] for i in range(16_000) if places[i] is not None]
    assert known == sorted(known, reverse=make is desc)
    gaps = [i for i in range(16_000) if places[i] is None]
    assert gaps == (list(range(12_000, 16_000)) if make is desc else list(range(4_000)))


def test_rows_are_shuffled_once(spark):
    df = spark.range(5000).select((F.col("id") * 1.5).alias("v"), "id", F.lit("x" * 50).alias("wide"))
    for out in (O.with_position(df, [asc("v")], "p"), O.with_running_total(df, [asc("v")], "id", "t")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line and "wide" in line]
        assert len(exchanges) <= 1
        assert plan.count("Exchange hashpartitioning(__pid") == 2  # the rows, and their partial counts
        assert "Scan ExistingRDD" not in plan


def test_ranges_of_many_boundaries(spark):
    bounds = [i * 2 for i in range(1000)]
    df = spark.range(-5, 2010).select(
        "id",
        O._count_below(bounds, F.col("id"), T.LongType(), False).alias("below"),
        O._count_below(bounds, F.col("id"), T.LongType(), True).alias("upto"),
    )
    for r in df.collect():
        assert r["below"] == sum(b < r["id"] for b in bounds) and r["upto"] == sum(b <= r["id"] for b in bounds)


def test_running_total(skewed):
    rows, df = skewed
    out = O.with_running_total(df.fillna(0), [asc("id")], "val", "total").collect()
    expected, total = {}, 0
    for r in rows:
        total += r[2] or 0
        expected[r[0]] = total
    assert {r["id"]: r["total"] for r in out} == expected


def test_row_number_per_group(skewed):
    rows, df = skewed
    out = O.with_row_number(df, ["grp"], [desc("val"), asc("id")], "rn").collect()
    expected, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
        seen[r[1]] = seen.get(r[1], 0) + 1
        expected[r[0]] = seen[r[1]]
    assert {r["id"]: r["rn"] for r in out} == expected


def test_rank_and_percent_rank(skewed):
    rows, df = skewed
    out = O.with_rank(df, ["grp"], [desc("val")], "rk").collect()

    def above(value, other):
        return other is not None and (value is None or other > value)

    for r in out[::50]:
        ahead = sum(1 for x in rows if x[1] == r["grp"] and above(r["val"], x[2]))
        assert r["rk"] == ahead + 1
    shares = O.with_percent_rank(df, [asc("val")], "share").collect()
    assert len(shares) == len(rows)
    for r in shares[::50]:
        below = sum(1 for x in rows if low_nulls(x[2]) < low_nulls(r["val"]))
        assert r["share"] == pytest.approx(below / (len(rows) - 1))


def test_top_ranked(skewed):
    rows, df = skewed
    for limit in (1, 3, 40):
        out = O.top_ranked(df, ["grp"], desc("val"), limit, "rk").collect()
        expected = {}
        for i, grp, val in rows:
            ahead = sum(1 for _, g, v in rows if g == grp and v is not None and (val is None or v > val))
            if ahead < limit:
                expected[i] = ahead + 1
        assert {r["id"]: r["rk"] for r in out} == expected


def test_ties_do_not_meet_in_one_task(spark):
    """Half of the rows tie: no window of the plan is over rows, only over counts of values."""
    df = spark.range(20_000).select((F.col("id") % 2 * F.col("id")).alias("v"), F.lit("g").alias("g"), "id")
    top = O.top_ranked(df, ["g"], asc("v"), 5)
    assert top.count() == 10_000
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [") < plan.index("Aggregate [g")


def test_rolling_average(skewed):
    rows, df = skewed
    out = O.with_rolling_average(df, ["grp"], [asc("id")], "val", 2, "mean").collect()
    groups, expected = {}, {}
    for r in rows:
        window = groups.setdefault(r[1], [])
        window.append(r[2])
        values = [v for v in window[-3:] if v is not None]
        expected[r[0]] = sum(values) / len(values) if values else None
    got = {r["id"]: r["mean"] for r in out}
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == (value if value is None else pytest.approx(value))


@pytest.mark.parametrize("preceding", [0, 1, 5])
def test_rolling_frames_reach_over_short_ranges(spark, preceding):
    """More ranges than a frame has rows, and frames that reach over several of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(90).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 2).alias("v"))
        got = {r["id"]: r["m"] for r in O.with_rolling_average(df, ["g"], [asc("id")], "v", preceding, "m").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for i in range(90):
        frame = [j * 2 for j in range(i, -1, -2)][: preceding + 1]
        assert got[i] == pytest.approx(sum(frame) / len(frame))


def test_the_halo_is_a_few_rows(spark):
    df = spark.range(4000).select(F.lit(1).alias("g"), "id", F.col("id").alias("v"))
    out = O.with_rolling_average(df, ["g"], [asc("id")], "v", 2, "m")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" not in plan and "ObjectHashAggregate" not in plan
    laid = [line for line in plan.splitlines() if "Exchange hashpartitioning(__pid" in line and "g#" in line]
    assert len(laid) == 1


def test_nearest_items(spark):
    points = [(i, 7.0 if i % 3 == 0 else random.uniform(-20, 120)) for i in range(900)]
    values = sorted({round(random.uniform(0, 100), 1) for _ in range(60)})
    out = O.nearest_items(
        spark.createDataFrame(points, "id int, x double").repartition(6),
        "x",
        spark.createDataFrame([(v, str(v)) for v in values], "v double, label string"),
        "v",
    ).collect()
    assert len(out) == len(points)
    for r in out:
        below = [v for v in values if v <= r["x"]]
        above = [v for v in values if v >= r["x"]]
        assert (r["below"]["v"] if r["below"] else None) == (below[-1] if below else None)
        assert (r["above"]["v"] if r["above"] else None) == (above[0] if above else None)
        assert r["below"] is None or r["below"]["label"] == str(r["below"]["v"])


@pytest.mark.parametrize("kind", ["double", "string"])
def test_nearest_items_take_running_frames_only(spark, kind):
    """A frame to the end of the range is summed up anew for every row."""
    points = spark.range(500).select("id", (F.col("id") * 7 % 500 + 1000).cast(kind).alias("x"))
    items = spark.range(0, 500, 25).select((F.col("id") + 1000).cast(kind).alias("v"))
    out = O.nearest_items(points, "x", items, "v")
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        x = int(float(r["x"])) - 1000
        below, above = (float(r[c]["v"]) - 1000 if r[c] else None for c in ("below", "above"))
        assert below == x // 25 * 25
        if x % 25:
            assert above == (x // 25 * 25 + 25 if x < 475 else None)


def test_band_count(spark):
    points = [(i, random.randint(0, 60)) for i in range(400)]
    bands = [(random.randint(0, 50), random.randint(0, 60)) for _ in range(120)]
    out = O.with_band_count(
        spark.createDataFrame(points, "id int, x int"),
        "x",
        spark.createDataFrame(bands, "lo int, hi int"),
        "lo",
        "hi",
        "n",
    ).collect()
    for r in out:
        assert r["n"] == sum(1 for lo, hi in bands if lo <= r["x"] <= hi)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id int, grp string, val int")
    assert O.with_position(empty, [asc("id")]).count() == 0
    assert O.with_rank(empty, ["grp"], [asc("val")]).count() == 0
    assert O.with_percent_rank(empty, [asc("val")]).count() == 0
