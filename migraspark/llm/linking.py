"""Connected components of verified links between rows that share buckets.

The buckets come from locality-sensitive hashing and may be of any size, so no step pairs all
members of one. Each round tests the members of a bucket against one pivot and joins up what
passes; members that ended in one component need no further test. Pairs of a bucket that are
still in different components after the pivot rounds are all tested, so no candidate is lost;
only those go untested whose similarity is bounded below the threshold, by the number of elements
that either end shares with any other open node and by the bits that the shared elements of both
set in a small bitmap. Both bounds are exact: no pair that reaches the threshold goes untested.
Light nodes are bounded by parities instead, which need no elements to meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migraspark.llm.common import kept_table
from migraspark.session import prepare_session

PIVOT_ROUNDS = 3
# All open pairs are tested at once when they number at most so many times the open members.
PAIRS_PER_MEMBER = 2
# Where nodes are cheap to compare: open pairs per open member that go straight to the comparison, and
# shared buckets (16 bytes each) that are sent to all tasks.
LIGHT_PAIRS, BROADCAST_BUCKETS = 16, 1_000_000
# Numbers of 64 bits that make the bitmap of a node's shared elements, and the parities of all of its elements.
BITMAP, PARITIES = 32, 16
# Open members of a bucket are joined in blocks of about so many.
BLOCK = 256


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); the component is its smallest node.

    Every round moves each node to its smallest neighbour, twice over, and renames the ends of
    all links accordingly; links inside a node vanish. A link to the neighbour a node moved to
    stays, renamed, so nothing falls apart before the last round. The number of rounds grows with
    the logarithm of the longest chain. A round moves only nodes that still have a link, and the moves
    are put together at the end, last round first. An empty input gives an empty result.
    """
    edges = kept_table(
        links.select("a", "b").where("a <> b").distinct(), "component-links"
    )
    moves = [edges.select(F.col("a").alias("old"), F.col("b").alias("new")).limit(0)]
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = kept_table(
            both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "component-step"
        )
        second = step.select(F.col("a").alias("to"), F.col("to").alias("to2"))
        step = kept_table(
            step.join(second, "to").select(F.col("a").alias("old"), F.col("to2").alias("new")),
            "component-step",
        )
        left = step.select(F.col("old").alias("a"), F.col("new").alias("a2"))
        right = step.select(F.col("old").alias("b"), F.col("new").alias("b2"))
        edges = kept_table(
            edges.join(left, "a")
            .select("a2", "b")
            .where("a2 <> b")
            .join(right, "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct(),
            "component-links",
        )
        moves.append(step)
    labels = moves.pop().toDF("node", "component")
    for step in reversed(moves[1:]):
        later = labels.toDF("new", "component")
        labels = step.join(later, "new", "left").select(
            F.col("old").alias("node"), F.coalesce("component", "new").alias("component")
        )
    return kept_table(labels, "component-labels")


def link(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    elements: Callable[[DataFrame], DataFrame],
    percent: int,
    light: bool = False,
) -> DataFrame:
    """(node, component) of all nodes with a verified link.

    ``buckets`` has (bucket, node), both BIGINT; ``verify`` takes pairs (a, b) with a < b and
    returns those whose sets have a Jaccard similarity of ``percent`` or more; ``elements`` takes
    nodes (node) and returns their distinct elements (node, element). Nodes without a link are
    not in the result. The first call of ``verify`` has every node that shares a bucket.

    ``light`` nodes are many, and cheap to compare. Their ``buckets`` have no row twice; nodes are
    not shuffled with their buckets where few are shared; rounds end when one settles less than half of the
    pairs; and open pairs that number at most LIGHT_PAIRS times the open members go to ``verify``
    without a look at their elements.
    """
    prepare_session(buckets.sparkSession)
    members = _light_members(buckets) if light else _members(buckets)
    pairs = members.where("node <> pivot").select(
        F.col("pivot").alias("a"), F.col("node").alias("b")
    )
    tested = kept_table(pairs.distinct(), "pairs")
    links = kept_table(verify(tested), "links")
    found = components(links)
    members = members.select("bucket", "node")
    for round_number in range(1, PIVOT_ROUNDS + 1):
        members, open_members, open_pairs, all_pairs = _unsettled(members, found)
        if not open_members:
            return found
        straight = light and open_pairs <= LIGHT_PAIRS * open_members
        stuck = light and 2 * open_pairs > all_pairs
        few = open_pairs <= PAIRS_PER_MEMBER * open_members
        last = straight or stuck or few or round_number == PIVOT_ROUNDS
        if straight:
            pairs = _open_pairs(members)
        elif last:
            pairs = (_within_parity if light else _across_components)(members, elements, percent)
        else:
            pairs = _against_pivot(members, round_number)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = kept_table(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = kept_table(verify(pairs), "links")
        tested = tested.union(pairs)
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)
        if last:
            return found
        members = members.select("bucket", "node")
    return found


def _members(buckets: DataFrame) -> DataFrame:
    """(bucket, node, pivot) of the buckets with several nodes; the pivot is the smallest."""
    shared = kept_table(
        buckets.groupBy("bucket")
        .agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
        .where("pivot < last")
        .select("bucket", "pivot"),
        "bucket-pivots",
    )
    return kept_table(buckets.join(shared, "bucket"), "bucket-members")


def _light_members(buckets: DataFrame) -> DataFrame:
    """The same of buckets without repeated rows: they are counted alone, and nodes are read for shared ones.

    Nearly all buckets have one row, so they are dealt out before they are counted.
    """
    dealt = buckets.select("bucket").repartition("bucket")
    counted = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = kept_table(counted.select("bucket"), "shared-buckets")
    few = shared.count() <= BROADCAST_BUCKETS
    members = kept_table(buckets.join(F.broadcast(shared) if few else shared, "bucket"), "bucket-nodes")
    pivots = members.groupBy("bucket").agg(F.min("node").alias("pivot"))
    return kept_table(members.join(kept_table(pivots, "bucket-pivots"), "bucket"), "bucket-members")


def _unsettled(members: DataFrame, found: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Members, with their components, of the buckets that still hold several components, their
    number, the number of pairs among them, and that of all buckets. A bucket of two has no pair but
    the tested one."""
    labelled = members.join(found, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component")
    )
    several = kept_table(
        labelled.groupBy("bucket")
        .agg(
            F.min("component").alias("first"),
            F.max("component").alias("last"),
            F.count("*").alias("size"),
        )
        .where("size > 2")
        .selectExpr("bucket", "CAST(size AS DOUBLE) AS size", "first < last AS open"),
        "bucket-sizes",
    )
    pairs = "sum(size * (size - 1) / 2)"
    counts = ("sum(size) FILTER (WHERE open)", f"{pairs} FILTER (WHERE open)", pairs)
    total = several.agg(*[F.expr(c) for c in counts]).first()
    unsettled = labelled.join(several.where("open").select("bucket"), "bucket")
    return kept_table(unsettled, "bucket-members"), *(n or 0 for n in total)


def _open_pairs(members: DataFrame) -> DataFrame:
    """All pairs of a bucket with ends in different components."""
    left, right = (
        members.select("bucket", F.col("node").alias(node), F.col("component").alias(f"component_{node}"))
        for node in ("a", "b")
    )
    return left.join(right, "bucket").where("component_a < component_b").select("a", "b")


def _against_pivot(members: DataFrame, round_number: int) -> DataFrame:
    """Members against one pivot of their bucket, another one every round."""
    drawn = members.withColumn("draw", F.xxhash64("node", F.lit(round_number)))
    lowest = kept_table(drawn.groupBy("bucket").agg(F.min("draw").alias("draw")), "bucket-draws")
    pivots = kept_table(
        drawn.join(lowest, ["bucket", "draw"]).select(
            "bucket", F.col("node").alias("a"), F.col("component").alias("pivot_component")
        ),
        "bucket-pivots",
    )
    return (
        members.join(pivots, "bucket")
        .where("component <> pivot_component")
        .select("a", F.col("node").alias("b"))
    )


def _across_components(
    members: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int
) -> DataFrame:
    """The pairs of a bucket with ends in different components that can still reach ``percent``.

    An element that no other open node has is in no intersection, so the elements a node shares
    with any other bound all its intersections. Of two nodes, each common element sets the same bit
    in both bitmaps, and at most as many common elements hide behind others' bits as either node has
    more shared elements than bits.
    """
    held = kept_table(elements(members.select("node").distinct()), "open-elements")
    common = (
        held.groupBy("element").agg(F.count("*").alias("nodes")).where("nodes > 1").select("element")
    )
    sizes = held.groupBy("node").agg(F.count("*").alias("size"))
    number, one = _bit(BITMAP)
    bits = [F.bit_or(F.when(number == i, one).otherwise(F.lit(0).cast("bigint"))) for i in range(BITMAP)]
    shared = (
        held.join(kept_table(common, "common-elements"), "element", "left_semi")
        .groupBy("node")
        .agg(F.count("*").alias("shared"), F.array(*bits).alias("bits"))
    )
    set_bits = F.aggregate("bits", F.lit(0), lambda n, b: n + F.bit_count(b))
    profile = kept_table(
        sizes.join(shared, "node")
        .where(f"100 * shared >= {percent} * size")
        .withColumn("hidden", F.col("shared") - set_bits),
        "open-profiles",
    )
    rows = kept_table(members.join(profile, "node"), "bucket-members")
    both = " + ".join(f"bit_count(x_bits[{i}] & y_bits[{i}])" for i in range(BITMAP))
    most = f"least(x_shared, y_shared, {both} + least(x_hidden, y_hidden))"
    return (
        _across_blocks(rows, ["size", "shared", "hidden", "bits"])
        .where(f"100 * least(x_shared, y_shared) >= {percent} * (x_size + y_size - least(x_shared, y_shared))")
        .where(f"{100 + percent} * {most} >= {percent} * (x_size + y_size)")
        .select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    )


def _within_parity(
    members: DataFrame, elements: Callable[[DataFrame], DataFrame], percent: int
) -> DataFrame:
    """The same pairs, bounded by the parities of the elements of each node that fall on a bit.

    Where two parities differ, an element is in one of the two sets alone, so the bits that differ are
    no more than the elements that do. Elements are folded where they are made.
    """
    held = elements(members.select("node").distinct())
    number, bit = _bit(PARITIES)
    folded = (
        held.select("node", number.alias("number"), bit.alias("bit"))
        .groupBy("node", "number")
        .agg(F.count("*").alias("size"), F.bit_xor("bit").alias("bits"))
    )
    numbers = range(PARITIES)
    bits = [F.coalesce(F.max(F.when(F.col("number") == i, F.col("bits"))), F.lit(0)).alias(f"b{i}") for i in numbers]
    profile = kept_table(folded.groupBy("node").agg(F.sum("size").alias("size"), *bits), "open-profiles")
    rows = kept_table(members.join(profile, "node"), "bucket-members")
    differ = " + ".join(f"bit_count(x_b{i} ^ y_b{i})" for i in numbers)
    return (
        _across_blocks(rows, ["size", *[f"b{i}" for i in numbers]])
        .where(f"100 * least(x_size, y_size) >= {percent} * greatest(x_size, y_size)")
        .where(f"{100 + percent} * ({differ}) <= {100 - percent} * (x_size + y_size)")
        .select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    )


def _bit(numbers: int) -> tuple[Column, Column]:
    """Of an element: which of so many numbers it falls on, and that number with its bit set."""
    mixed = F.xxhash64("element")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(mixed, 58).cast("int"))
    return F.pmod(mixed, F.lit(numbers)), bit


def _across_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs of members of a bucket in different components, with the given columns as x_ and y_ ones.

    Any two blocks of a bucket meet in a key of their own, so that no task has all pairs of a large one.
    """
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    x, y = ([F.col(c).alias(f"{side}_{c}") for c in ("node", "component", *columns)] for side in "xy")
    left = dealt.select("bucket", F.col("block").alias("i"), every.alias("j"), *x)
    right = dealt.select("bucket", every.alias("i"), F.col("block").alias("j"), *y)
    return left.join(right, ["bucket", "i", "j"]).where("x_component < y_component")
