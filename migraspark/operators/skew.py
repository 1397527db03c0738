"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SHARE = 0.0001  # the smallest share that heavy keys are looked for at
TRACKED = 8  # counters of the sketch per key that may have the least share


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_shares(df: DataFrame, keys: Sequence[str], least: float) -> dict[int, float]:
    """Hash and share of every key with at least ``least`` of the rows.

    One scan of the key columns and no shuffle of rows: every task keeps a sketch of the most
    frequent items, a few counters per key that may be heavy, and the sketches are merged. A share
    is never too small, and too large by less than half of ``least``.
    """
    most = int(2 / least) + 1
    tracked = min(max(int(TRACKED / least), 1000), 1_000_000)
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    found = hashed.agg(
        F.expr(f"approx_top_k(h, {min(most, tracked)}, {tracked})").alias("top"), F.count("*").alias("n")
    ).first()
    return {r["item"]: r["count"] / found["n"] for r in found["top"] or () if r["count"] >= least * found["n"]}


def salt_tiers(shares: dict[int, float], partitions: int) -> dict[int, list[int]]:
    """Keys by the number of salts that cuts each to pieces of about half a partition's worth of rows.

    Salts fall into partitions by chance, so pieces are halves. Their number is 2 x share x partitions,
    rounded up to a power of two: few numbers of salts occur, and all heavy keys together have fewer
    than four copies per partition and two more per key.
    """
    tiers: dict[int, list[int]] = {}
    for key, share in sorted(shares.items()):
        wanted = math.ceil(2 * share * partitions)
        if share * partitions > 1:
            tiers.setdefault(1 << (wanted - 1).bit_length(), []).append(key)
    return tiers


def _salts(keys: Sequence[str], tiers: dict[int, list[int]]) -> Column:
    """The number of salts of a row's key; one for most."""
    count = F.lit(1)
    for salts, hashes in tiers.items():
        count = F.when(F.xxhash64(*keys).isin(hashes), F.lit(salts)).otherwise(count)
    return count


def row_spread(df: DataFrame) -> Column:
    """A value that differs between rows, and between copies of a row in different input splits.

    It depends on the row and its split only, never on row order, so a retried task repeats it.
    Maps cannot be hashed and are left out.
    """
    columns = [name for name, kind in df.dtypes if "map<" not in kind]
    return F.xxhash64(*columns, F.spark_partition_id())


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    partitions: int | None = None,
    hot_from: DataFrame | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join of many ``left`` rows to few ``right`` rows per key; with ``null_safe`` NULL is a key.

    A left key with more rows than one of ``partitions`` (as many as shuffles have, unless stated)
    should get is dealt over as many copies of its right rows as it fills partitions; all other keys
    join as usual. ``how`` is ``inner`` or ``left``. ``hot_from`` is a cheaper frame with the keys of
    ``left`` to look for heavy keys in, such as the table that ``left`` was computed from.
    """
    extra = [c for c in right.columns if c not in keys]
    partitions = partitions or shuffle_partitions(left)
    looked_in = left if hot_from is None else hot_from
    tiers = salt_tiers(heavy_shares(looked_in, keys, max(1 / partitions, LEAST_SHARE)), partitions)
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *extra)
    same = F.lit(True)
    for key in keys:
        mine, other = F.col(key), F.col(f"__r_{key}")
        same = same & (mine.eqNullSafe(other) if null_safe else mine == other)
    if not tiers:
        return left.join(renamed, same, how).select(*left.columns, *extra)
    salts = _salts(keys, tiers)
    salted_left = left.withColumn(
        "__salt", F.when(salts > 1, F.pmod(row_spread(left), salts)).otherwise(0).cast("int")
    )
    copies = F.sequence(F.lit(0), _salts([f"__r_{k}" for k in keys], tiers) - 1)
    salted_right = renamed.withColumn("__r_salt", F.explode(copies))
    joined = salted_left.join(
        salted_right, same & (F.col("__salt") == F.col("__r_salt")), how
    )
    return joined.select(*left.columns, *extra)


def expand_left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """``left LEFT JOIN right`` where ``right`` may hold very many rows of one key.

    A left outer join cannot split its right side, so matches come from a salted inner join with
    the many-row side leading, and left rows without a match are added from an anti join.
    """
    extra = [c for c in right.columns if c not in keys]
    rest = [c for c in left.columns if c not in keys]
    matched = lookup_join(right, left, keys, partitions=partitions).select(*left.columns, *extra)
    present = right.select(*keys).distinct()
    alone = left.join(present, list(keys), "left_anti").select(*keys, *rest)
    return matched.unionByName(alone, allowMissingColumns=True)
