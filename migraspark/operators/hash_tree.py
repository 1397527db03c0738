"""Reconciling by digests of key ranges, so that only rows that may differ are moved.

A row's place is the hash of its key. Both sides fold every range of places to its row count and
order-free digests; ranges that agree are settled in that scan. Ranges that differ are split into
smaller ones and folded again, without the rest, while they hold many rows. The rows of the ranges
left over are joined by key and compared value by value.

Numbers count as equal within a tolerance. Besides the exact digest there are two over cells of the
number line no wider than the tolerance, the second shifted by half a cell: values in one cell are
equal by tolerance, so a range is settled as soon as one of the three digests agrees, and a noise
far below the tolerance seldom crosses cells of both kinds in one range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migraspark.functions import normalize as N
from migraspark.operators import reconcile as R
from migraspark.session import cut_lineage

PLACE = "__place"
RANGE = "__range"
# Ranges of the first fold, as bits of the place; every further fold cuts each into 2**FINER.
FIRST_BITS, FINER, LAST_BITS = 16, 8, 32
# Ranges that differ are split while they hold more rows than this share of all, and named to every
# task up to this many (eight bytes each); beyond, most of the tables differ and are joined.
SMALL_SHARE, NAMED = 0.001, 1 << 20
# Where most rows are open and finer ranges would hold fewer rows than this on average, a finer fold
# moves about as many digests as the join moves rows.
FEW_ROWS = 8
DIGESTS = ("exact", "near", "shifted")


def cell(value: Column, rtol: float, atol: float, shift: float = 0.0) -> Column:
    """A number that two values have in common only if they are equal within the tolerance.

    The scale counts how many tolerances lie between 0 and the value; its cells are a little
    narrower than one, as the tolerance is that of the target, which may be the smaller value.
    """
    size = F.abs(value)
    if atol > 0 and rtol > 0:
        scale = F.log1p(size * F.lit(rtol / atol)) / F.lit(rtol)
    elif atol > 0:
        scale = size / F.lit(atol)
    elif rtol > 0:
        scale = F.ln(size) / F.lit(rtol)
    else:
        return value + F.lit(0.0)
    narrower = 1.01 * math.exp(rtol)
    if atol > 0:
        return F.rint(F.signum(value) * scale * F.lit(narrower) + F.lit(shift)) + F.lit(0.0)
    place = F.rint(scale * F.lit(narrower) + F.lit(shift)) + F.lit(0.0)
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * (F.abs(place) * 2 + (place < 0).cast("int") + 1))


def _place_of(side: DataFrame, other: DataFrame, keys: Sequence[str]) -> Column:
    mine, theirs = side.schema, other.schema
    return F.xxhash64(
        *[
            F.col(k).cast("double")
            if N.is_numeric(mine[k].dataType) or N.is_numeric(theirs[k].dataType)
            else F.col(k)
            for k in keys
        ]
    )


def _row_digests(side: DataFrame, other: DataFrame, keys: Sequence[str], rtol: float, atol: float) -> DataFrame:
    """The place of every row and its three digests."""
    mine, theirs = ({f.name: f.dataType for f in frame.schema} for frame in (side, other))
    exact, near, shifted = [], [], []
    for name, kind in mine.items():
        numeric = N.is_numeric(kind) or N.is_numeric(theirs[name])
        if name in keys:
            value = F.col(name).cast("double") if numeric else F.col(name)
            cells = (value, value, value)
        elif numeric:
            value = N.to_number(F.col(name), kind)
            cells = (value + F.lit(0.0), cell(value, rtol, atol), cell(value, rtol, atol, 0.5))
        else:
            cells = (N.canonical_text(F.col(name)),) * 3
        for columns, found in zip((exact, near, shifted), cells, strict=True):
            columns += [found.isNull(), found]  # hashing skips NULLs, so they are told apart first
    return side.select(
        _place_of(side, other, keys).alias(PLACE),
        *[F.xxhash64(*columns).alias(n) for n, columns in zip(DIGESTS, (exact, near, shifted), strict=True)],
    )


def _range_of(bits: int) -> Column:
    return F.shiftrightunsigned(PLACE, 64 - bits)


def folded(rows: DataFrame, bits: int) -> DataFrame:
    """Per range its rows and, per digest, the sums of the upper and lower halves of the rows'."""
    sums = []
    for name in DIGESTS:
        low = F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))
        sums.append(F.struct(F.sum(low), F.sum(F.shiftrightunsigned(name, 32))).alias(name))
    return rows.groupBy(_range_of(bits).alias(RANGE)).agg(F.count("*").alias("rows"), *sums)


def differing_ranges(source: DataFrame, target: DataFrame) -> DataFrame:
    """Ranges of two folds with the rows of both sides, and whether they may differ."""
    right = target.withColumnsRenamed({c: f"t_{c}" for c in target.columns})
    joined = source.join(right, F.col(RANGE) == F.col(f"t_{RANGE}"), "full_outer")
    agrees = F.lit(False)
    for name in DIGESTS:
        agrees = agrees | F.coalesce(F.col(name) == F.col(f"t_{name}"), F.lit(False))
    same = F.coalesce(F.col("rows") == F.col("t_rows"), F.lit(False)) & agrees
    return joined.select(
        F.coalesce(RANGE, f"t_{RANGE}").alias(RANGE),
        F.coalesce("rows", F.lit(0)).alias("source_rows"),
        F.coalesce("t_rows", F.lit(0)).alias("target_rows"),
        (~same).alias("differs"),
    )


@dataclass(frozen=True)
class Ranges:
    """What is left to compare: the ranges (NULL: all), their width, and the rows of both sides."""

    left: DataFrame | None
    bits: int
    open_rows: int
    source_rows: int
    target_rows: int


def _within(rows: DataFrame, left: DataFrame, bits: int) -> DataFrame:
    """Rows of the named ranges; at most NAMED numbers go to every task."""
    return rows.withColumn(RANGE, _range_of(bits)).join(F.broadcast(left), RANGE, "left_semi").drop(RANGE)


def settle(source: DataFrame, target: DataFrame, bits: int = FIRST_BITS) -> Ranges:
    """Fold and compare until the ranges that differ are few rows, or splitting them further can't help.

    ``source`` and ``target`` come from ``_row_digests``. If the sides have different numbers of
    rows the first fold ends it.
    """
    total = None
    while True:
        found = cut_lineage(differing_ranges(folded(source, bits), folded(target, bits)))
        sums = found.agg(
            F.coalesce(F.sum("source_rows"), F.lit(0)).alias("s"),
            F.coalesce(F.sum("target_rows"), F.lit(0)).alias("t"),
            F.coalesce(F.sum(F.when(F.col("differs"), F.col("source_rows") + F.col("target_rows"))), F.lit(0)).alias("open"),
            F.count_if("differs").alias("ranges"),
        ).first()
        total = total or (sums["s"], sums["t"])
        if sums["ranges"] > NAMED:
            return Ranges(None, bits, sums["open"], *total)
        left = found.where("differs").select(RANGE)
        few = sums["open"] <= SMALL_SHARE * sum(total)
        spread = sums["open"] > sum(total) / 2 and sums["open"] < 2 * FEW_ROWS * 2 ** (bits + FINER)
        if spread and total[0] == total[1]:
            return Ranges(None, bits, sum(total), *total)
        if few or total[0] != total[1] or bits + FINER > LAST_BITS:
            return Ranges(left, bits, sums["open"], *total)
        source, target = _within(source, left, bits), _within(target, left, bits)
        bits += FINER


def reconcile_ranges(
    source: DataFrame,
    target: DataFrame,
    run_id: int = 0,
    source_file: str | None = None,
    keys: Sequence[str] | None = None,
    rtol: float = N.RTOL,
    atol: float = N.ATOL,
    bits: int = FIRST_BITS,
) -> DataFrame:
    """The result row of ``reconcile`` with ``rows_compared``, the rows of both sides that were moved.

    ``keys`` default to the first candidate of ``key_candidates``. Without any, or where rows of the
    ranges that differ repeat a key, ``reconcile`` decides and compares all rows. Rows that repeat a
    key inside a settled range are the same on both sides. Two ranges of different rows are taken
    for equal with a chance of one in 2**60 or so.
    """

    def whole() -> DataFrame:
        result = R.reconcile(source, target, run_id, source_file, rtol, atol)
        return result.withColumn("rows_compared", F.col("source_rows") + F.col("target_rows"))

    source, target = R.unique_names(source), R.unique_names(target)
    candidates = R.key_candidates(source.columns)
    keys = list(keys or (candidates[0] if candidates else []))
    if not keys or not R.schema_match(source, target):
        return whole()
    src, tgt = R.normalize(source), R.normalize(target)
    if R._key_type_clash(src, tgt, keys):
        return whole()
    ranges = settle(_row_digests(src, tgt, keys, rtol, atol), _row_digests(tgt, src, keys, rtol, atol), bits)
    counts = ranges.source_rows, ranges.target_rows
    spark = source.sparkSession
    alignment = "keys: " + ", ".join(keys)
    if counts[0] != counts[1] or not ranges.open_rows:
        named = alignment if counts[0] == counts[1] else "none"
        result = R._result(R._no_diffs(spark), run_id, source_file, *counts, True, named)
        return result.withColumn("rows_compared", F.lit(0).cast("bigint"))
    if ranges.left is not None:
        src, tgt = (
            _within(side.withColumn(PLACE, _place_of(side, other, keys)), ranges.left, ranges.bits).drop(PLACE)
            for side, other in ((src, tgt), (tgt, src))
        )
    if any(row["copies"] > 1 for row in R.key_profile(src, tgt, keys).collect()):
        return whole()
    result = R._by_key(src, tgt, keys, run_id, source_file, counts, rtol, atol)
    return result.withColumn("rows_compared", F.lit(ranges.open_rows).cast("bigint"))
