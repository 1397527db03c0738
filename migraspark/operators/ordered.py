"""Ordered computations without a one-task window.

``Window.orderBy`` without (or with a skewed) ``partitionBy`` sends a whole group to one task.
These operators range-partition on the order instead, so that the work is spread by the data's own
distribution, and stitch the partitions together with one small row per partition.

Where the first sort column is a number or a time, the ranges are fixed values from one pass of a
quantile sketch. A row then knows its range by itself, however often it is computed: the summaries
are partial aggregates of the input, and the rows are shuffled once. Other orders, and several sort
columns of which the first ties often, are range-partitioned by Spark's sample. Such a layout is
checkpointed, as a recomputed plan could draw other boundaries that no longer fit the summaries.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from migraspark.operators.skew import lookup_join, row_spread, shuffle_partitions
from migraspark.session import cut_lineage

SLOT = "__slot"
PID = "__pid"
TIE = "__tie"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


@dataclass(frozen=True)
class Key:
    """One sort column with its direction and NULL placement."""

    name: str
    descending: bool = False
    nulls_last: bool | None = None

    def backwards(self) -> Key:
        last = self.descending if self.nulls_last is None else self.nulls_last
        return replace(self, descending=not self.descending, nulls_last=not last)

    @property
    def expr(self) -> Column:
        column = F.col(self.name)
        last = self.descending if self.nulls_last is None else self.nulls_last
        if self.descending:
            return column.desc_nulls_last() if last else column.desc_nulls_first()
        return column.asc_nulls_last() if last else column.asc_nulls_first()


def asc(name: str, nulls_last: bool = False) -> Key:
    return Key(name, False, nulls_last)


def desc(name: str, nulls_last: bool = True) -> Key:
    return Key(name, True, nulls_last)


def lay_out(df: DataFrame, order: Sequence[Key], split_ties: bool = False) -> DataFrame:
    """Globally sorted rows, tagged with their partition and their place in it.

    Rows with equal sort values stay in one partition; ``split_ties`` adds a last sort value that
    differs between them, for inputs where very many rows may tie.
    """
    exprs = [key.expr for key in order]
    if split_ties:
        df = df.withColumn(TIE, row_spread(df))
        exprs.append(F.col(TIE))
    slotted = (
        df.repartitionByRange(*exprs)
        .sortWithinPartitions(*exprs)
        .drop(TIE)
        .withColumn(SLOT, F.monotonically_increasing_id())
    )
    return cut_lineage(slotted).withColumn(PID, F.shiftright(SLOT, _ROW_BITS))


def _row_in_partition() -> Column:
    return F.col(SLOT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


@dataclass(frozen=True)
class Layout:
    """Rows tagged with the number of their range, PID, and their order inside it, both ways."""

    rows: DataFrame
    order: list[Column]
    backwards: list[Column]
    stored: bool

    def window(self) -> WindowSpec:
        return Window.partitionBy(PID).orderBy(*self.order)

    def upto(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def onward(self) -> WindowSpec:
        """From a row to the end of its range, the end first.

        As a frame up to the row in the backward order it is a running one. A frame to
        ``unboundedFollowing`` is aggregated anew for every row, quadratic in the range.
        """
        window = Window.partitionBy(PID).orderBy(*self.backwards)
        return window.rowsBetween(Window.unboundedPreceding, 0)

    def place(self) -> Column:
        """The number of a row in its range, from 0."""
        if self.stored:
            return _row_in_partition()
        return (F.row_number().over(self.window()) - 1).cast("bigint")


_LEAF = 32


def _count_below(bounds: Sequence, column: Column, kind: T.DataType, inclusive: bool) -> Column:
    """How many of the sorted ``bounds`` are below ``column`` (or equal, if ``inclusive``)."""
    if len(bounds) <= _LEAF:
        total = F.lit(0)
        for bound in bounds:
            value = F.lit(bound).cast(kind)
            total = total + ((value <= column) if inclusive else (value < column)).cast("int")
        return total
    middle = len(bounds) // 2
    value = F.lit(bounds[middle]).cast(kind)
    above = (value <= column) if inclusive else (value < column)
    return F.when(above, _count_below(bounds[middle:], column, kind, inclusive) + middle).otherwise(
        _count_below(bounds[:middle], column, kind, inclusive)
    )


_SKETCHED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _fixed_ranges(df: DataFrame, order: Sequence[Key], split_ties: bool) -> Layout | None:
    """A layout by boundaries of the first sort column; None where they would not balance it.

    A value that fills several ranges is spread over them by a tie-breaking hash if nothing else is
    sorted by; NULLs likewise get as many ranges as their share asks for.
    """
    key = order[0]
    kind = df.schema[key.name].dataType
    if not isinstance(kind, _SKETCHED):
        return None
    parts = shuffle_partitions(df)
    share = [i / parts for i in range(1, parts)]
    accuracy = max(10_000, 20 * parts)
    wanted = F.array(*[F.lit(x) for x in share]) if share else F.array(F.lit(0.5))
    found = df.agg(
        F.percentile_approx(key.name, wanted, accuracy).alias("bounds"),
        F.count("*").alias("rows"),
        F.count(key.name).alias("known"),
    ).first()
    bounds = (found["bounds"] or []) if share else []
    tied = any(a == b for a, b in zip(bounds, bounds[1:]))
    missing = found["rows"] - found["known"]
    if tied and not (split_ties and len(order) == 1):
        return None
    rows, keys = df, list(order)
    if split_ties:
        rows = rows.withColumn(TIE, row_spread(rows))
        keys.append(asc(TIE))
    column = F.col(key.name)
    number = _count_below(bounds, column, kind, False)
    if tied:
        upper = _count_below(bounds, column, kind, True)
        number = number + F.pmod(F.col(TIE), upper - number + 1).cast("int")
    if key.descending:
        number = -number
    last = key.descending if key.nulls_last is None else key.nulls_last
    spread = -(-missing * parts // max(found["rows"], 1)) if split_ties and len(order) == 1 else 1
    aside = F.pmod(F.col(TIE), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
    outside = F.lit(2 * parts) + aside if last else F.lit(-2 * parts) - aside
    ranged = rows.withColumn(PID, F.when(column.isNull(), outside).otherwise(number))
    return Layout(ranged, [k.expr for k in keys], [k.backwards().expr for k in keys], False)


def _laid(df: DataFrame, order: Sequence[Key], split_ties: bool = False) -> Layout:
    fixed = _fixed_ranges(df, order, split_ties)
    if fixed is not None:
        return fixed
    return Layout(lay_out(df, order, split_ties), [asc(SLOT).expr], [desc(SLOT).expr], True)


def _offsets(laid: DataFrame, measure: Column, total: str | None) -> DataFrame:
    """Per partition the measure of all earlier partitions, and of all partitions as ``total``.

    One row per range partition, which is what makes the window and the broadcast of it safe.
    """
    sums = laid.groupBy(PID).agg(measure.alias("__n"))
    earlier = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    columns = [F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off")]
    if total is not None:
        columns.append(F.sum("__n").over(everywhere).alias(total))
    return F.broadcast(sums.select(PID, *columns))


def with_position(
    df: DataFrame,
    order: Sequence[Key],
    name: str = "position",
    start: int = 0,
    total: str | None = None,
) -> DataFrame:
    """Dense global row number, and the number of rows as ``total`` if that is named.

    Rows that tie on ``order`` keep an arbitrary but fixed order.
    """
    laid = _laid(df, order, split_ties=True)
    placed = laid.rows.withColumn("__within", laid.place())
    return placed.join(_offsets(laid.rows, F.count("*"), total), PID).withColumn(
        name, F.col("__off") + F.col("__within") + F.lit(start)
    ).drop(SLOT, PID, TIE, "__off", "__within")


def with_running_total(
    df: DataFrame,
    order: Sequence[Key],
    measure: str,
    name: str,
    inclusive: bool = True,
    total: str | None = None,
    split_ties: bool = True,
) -> DataFrame:
    """Global prefix sum of ``measure`` in ``order``, and its sum over all rows as ``total``.

    Rows that tie on ``order`` are added in an arbitrary but fixed order; ``split_ties`` may be
    switched off where no two rows tie.
    """
    laid = _laid(df, order, split_ties)
    summed = laid.rows.withColumn("__inside", F.sum(measure).over(laid.upto()))
    upto = F.col("__off") + F.col("__inside")
    if not inclusive:
        upto = upto - F.col(measure)
    return (
        summed.join(_offsets(laid.rows, F.sum(measure), total), PID)
        .withColumn(name, upto)
        .drop(SLOT, PID, TIE, "__off", "__inside")
    )


def _group_offsets(laid: DataFrame, groups: Sequence[str], *aggs: Column) -> DataFrame:
    """Per (partition, group) summary plus the group's ``__n`` total in earlier partitions.

    A group has at most one row per range partition here, however many rows it holds.
    """
    parts = laid.groupBy(PID, *groups).agg(*aggs)
    earlier = (
        Window.partitionBy(*groups).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    return parts.withColumnsRenamed({name: f"__p_{name}" for name in [PID, *groups, "__n"]})


def _same_part(groups: Sequence[str]) -> Column:
    condition = F.col(PID) == F.col(f"__p_{PID}")
    for name in groups:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__p_{name}"))
    return condition


def with_row_number(
    df: DataFrame, groups: Sequence[str], order: Sequence[Key], name: str = "row_number"
) -> DataFrame:
    """ROW_NUMBER per group for every row; a hot group spreads over many tasks."""
    laid = lay_out(df, [asc(g) for g in groups] + list(order), split_ties=True)
    parts = _group_offsets(
        laid,
        groups,
        F.count("*").alias("__n"),
        F.min(_row_in_partition()).alias("__first"),
    )
    number = F.col("__before") + _row_in_partition() - F.col("__first") + 1
    return laid.join(parts, _same_part(groups)).select(*df.columns, number.alias(name))


def rank_table(
    df: DataFrame, groups: Sequence[str], order: Sequence[Key], name: str = "rank"
) -> DataFrame:
    """RANK of every distinct (group, order value), from value counts rather than rows."""
    names = [key.name for key in order]
    counts = df.groupBy(*groups, *names).agg(F.count("*").alias("__n"))
    laid = lay_out(counts, [asc(g) for g in groups] + list(order))
    parts = _group_offsets(laid, groups, F.sum("__n").alias("__n"))
    inside = (
        Window.partitionBy(PID, *groups)
        .orderBy(SLOT)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = laid.withColumn("__local", F.sum("__n").over(inside) - F.col("__n"))
    rank = F.col("__before") + F.col("__local") + 1
    return local.join(parts, _same_part(groups)).select(
        *groups, *names, rank.cast("bigint").alias(name), F.col("__n").alias("rows")
    )


def top_ranked(
    df: DataFrame, groups: Sequence[str], key: Key, limit: int, name: str = "rank"
) -> DataFrame:
    """Rows whose RANK in their group is at most ``limit``, with the rank; all ties of the last one.

    Ranks come from the counts of the distinct values, of which every task keeps ``limit`` per group
    before they are sent on. The rows then meet the few values that are left, so rows that tie, be
    they half of the table, never come together in one task.
    """
    counts = df.groupBy(*groups, key.name).agg(F.count("*").alias("__n"))
    best = Window.partitionBy(*groups).orderBy(key.expr)
    better = best.rowsBetween(Window.unboundedPreceding, -1)
    leading = (
        counts.withColumn("__nth", F.row_number().over(best))
        .filter(F.col("__nth") <= limit)
        .withColumn(name, F.coalesce(F.sum("__n").over(better), F.lit(0)) + 1)
        .filter(F.col(name) <= limit)
    )
    names = [*groups, key.name]
    renamed = leading.select(*[F.col(c).alias(f"__r_{c}") for c in names], F.col(name).cast("bigint").alias(name))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return df.join(renamed, same).select(*df.columns, name)


def with_rank(
    df: DataFrame, groups: Sequence[str], order: Sequence[Key], name: str = "rank"
) -> DataFrame:
    """RANK per group for every row."""
    table = rank_table(df, groups, order, name).drop("rows")
    return lookup_join(df, table, [*groups, *[key.name for key in order]], null_safe=True)


def percent_rank_table(
    df: DataFrame, order: Sequence[Key], name: str = "percent_rank"
) -> DataFrame:
    """PERCENT_RANK of every distinct order value over all rows of ``df``."""
    names = [key.name for key in order]
    counts = df.groupBy(*names).agg(F.count("*").alias("__n"))
    totals = with_running_total(
        counts, order, "__n", "__upto", total="__all", split_ties=False
    )
    size, smaller = F.col("__all"), F.col("__upto") - F.col("__n")
    share = F.when(size > 1, smaller / (size - 1).cast("double")).otherwise(F.lit(0.0))
    return totals.select(*names, share.cast("double").alias(name))


def with_percent_rank(
    df: DataFrame, order: Sequence[Key], name: str = "percent_rank"
) -> DataFrame:
    table = percent_rank_table(df, order, name)
    return lookup_join(df, table, [k.name for k in order], null_safe=True)


def with_rolling_average(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Key],
    value: str,
    preceding: int,
    name: str,
) -> DataFrame:
    """AVG(value) OVER (PARTITION BY groups ORDER BY order ROWS n PRECEDING) for any group size.

    Rows are laid out by group and order. Each range is handed the last ``preceding`` rows before it,
    its halo, so that every frame lies inside one range; the halo is as many rows per range, however
    large the groups are, and the rows themselves are sent on once.
    """
    laid = lay_out(df, [asc(g) for g in groups] + list(order), split_ties=True)
    ranges = laid.groupBy(PID).agg(F.count("*").alias("__n"))
    earlier = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(PID, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    place = F.col("__start") + _row_in_partition()
    placed = laid.join(F.broadcast(starts), PID).select(*df.columns, PID, place.alias("__at"), F.lit(False).alias("__halo"))
    if preceding:
        back = F.explode(F.sequence(F.lit(1), F.lit(preceding)))
        handed = starts.select(F.col(PID).alias("__to"), "__start", back.alias("__back")).select(
            "__to", (F.col("__start") - F.col("__back")).alias("__at")
        )
        halo = placed.join(F.broadcast(handed), "__at").select(
            *df.columns, F.col("__to").alias(PID), "__at", F.lit(True).alias("__halo")
        )
        placed = placed.unionByName(halo)
    frame = Window.partitionBy(PID, *groups).orderBy("__at").rowsBetween(-preceding, 0)
    average = F.sum(value).over(frame).cast("double") / F.nullif(F.count(value).over(frame), F.lit(0))
    return placed.withColumn("__average", average).filter(~F.col("__halo")).select(
        *df.columns, F.col("__average").alias(name)
    )


def nearest_items(
    points: DataFrame, point_value: str, items: DataFrame, item_value: str
) -> DataFrame:
    """For every point, the item with the largest value <= it and the smallest value >= it.

    ``items`` must have distinct values. One merged sort replaces the pairwise band join: the
    output has one row per point, with structs ``below`` and ``above`` (NULL where none exists).
    """
    item_type = items.select(F.struct(*items.columns).alias("i")).schema["i"].dataType
    point_type = points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType
    merged = points.select(
        F.col(point_value).alias("__value"),
        F.lit(1).alias("__kind"),
        row_spread(points).alias("__spread"),
        F.struct(*points.columns).alias("__point"),
        F.lit(None).cast(item_type).alias("__item"),
    ).unionByName(
        items.select(
            F.col(item_value).alias("__value"),
            F.lit(0).alias("__kind"),
            F.lit(0).cast("bigint").alias("__spread"),
            F.lit(None).cast(point_type).alias("__point"),
            F.struct(*items.columns).alias("__item"),
        )
    )
    laid = _laid(merged, [asc("__value"), asc("__kind"), asc("__spread")])
    # In both orders the nearest item is the last one that the frame has met.
    nearest = F.last("__item", ignorenulls=True)
    scanned = laid.rows.withColumn("__below", nearest.over(laid.upto())).withColumn(
        "__above", nearest.over(laid.onward())
    )
    ends = _carried_over(laid.rows, "__value", {"__item": ("__from_lower", "__from_higher")})
    return (
        scanned.filter(F.col("__point").isNotNull())
        .join(ends, PID)
        .select(
            "__point.*",
            F.coalesce("__below", "__from_lower").alias("below"),
            F.coalesce("__above", "__from_higher").alias("above"),
        )
    )


def with_band_count(
    points: DataFrame,
    point_value: str,
    bands: DataFrame,
    low: str,
    high: str,
    name: str = "bands",
) -> DataFrame:
    """How many closed bands ``[low, high]`` contain each point, without forming the pairs.

    A sweep: every band adds one at ``low`` and removes one after ``high``; the running total at a
    point is the number of open bands.
    """
    point_type = points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType
    no_point = F.lit(None).cast(point_type).alias("__point")
    open_bands = bands.filter(F.col(low) <= F.col(high))
    at_point = points.select(
        F.col(point_value).alias("__value"),
        F.lit(1).alias("__kind"),
        row_spread(points).alias("__spread"),
        F.struct(*points.columns).alias("__point"),
        F.lit(0).cast("bigint").alias("__delta"),
    )

    def edges(value: str, kind: int, delta: int) -> DataFrame:
        changes = open_bands.groupBy(F.col(value).alias("__value")).agg(
            (F.count("*") * delta).alias("__delta")
        )
        return changes.select(
            "__value",
            F.lit(kind).alias("__kind"),
            F.lit(0).cast("bigint").alias("__spread"),
            no_point,
            "__delta",
        )

    merged = at_point.union(edges(low, 0, 1)).union(edges(high, 2, -1))
    swept = with_running_total(
        merged, [asc("__value"), asc("__kind"), asc("__spread")], "__delta", name, split_ties=False
    )
    return swept.filter(F.col("__point").isNotNull()).select("__point.*", name)


def _carried_over(
    rows: DataFrame, key: str, columns: dict[str, tuple[str | None, str | None]]
) -> DataFrame:
    """Per range and column the last value set before it and the first one set after it.

    Rows in which a column is set differ in ``key``, which sorts them. Only keys are aggregated, and
    of the rows only those few are picked whose values are carried.
    """
    set_at = {c: F.when(F.col(c).isNotNull(), F.col(key)) for c in columns}
    ends = rows.groupBy(PID).agg(
        *[
            end(set_at[c]).alias(f"__{side}_{i}")
            for i, c in enumerate(columns)
            for side, end in (("low", F.min), ("high", F.max))
        ]
    )
    lower = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.orderBy(F.col(PID).desc()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = []
    for i, names in enumerate(columns.values()):
        for name, at in (
            (names[0], F.last(f"__high_{i}", ignorenulls=True).over(lower)),
            (names[1], F.last(f"__low_{i}", ignorenulls=True).over(higher)),
        ):
            if name is not None:
                wanted.append((i, name, at))
    found = ends.select(PID, *[at.alias(f"__at_{name}") for _, name, at in wanted])
    for i, name, _ in wanted:
        column = list(columns)[i]
        # One row per range at most, with a key and no more.
        keys = F.broadcast(found.select(F.col(f"__at_{name}").alias("__at")).distinct())
        picked = (
            rows.filter(F.col(column).isNotNull())
            .select(F.col(key).alias("__at"), F.col(column).alias(name))
            .join(keys, "__at", "left_semi")
        )
        found = found.join(picked.withColumnRenamed("__at", f"__at_{name}"), f"__at_{name}", "left")
    return found.select(PID, *[name for _, name, _ in wanted])


def segments(starts: DataFrame, start: str, end: int | Column, carried: Sequence[str]) -> DataFrame:
    """Turn interval starts into segments: carry each column forward and add ``__width``.

    ``starts`` has one row per distinct start. A column that is NULL at a start keeps the value of
    the latest earlier start that has one.
    """
    laid = _laid(starts, [asc(start)])
    ends = _carried_over(laid.rows, start, {c: (f"__in_{c}", None) for c in carried})
    firsts = laid.rows.groupBy(PID).agg(F.min(start).alias("__first_start"))
    firsts = firsts.select(
        PID, F.lead("__first_start").over(Window.orderBy(PID)).alias("__next_pid_start")
    )
    scanned = laid.rows.select(
        PID,
        start,
        F.lead(start).over(laid.window()).alias("__next"),
        *[F.last(c, ignorenulls=True).over(laid.upto()).alias(c) for c in carried],
    ).join(ends.join(firsts, PID), PID)
    following = F.coalesce("__next", "__next_pid_start", F.lit(end) if isinstance(end, int) else end)
    return scanned.select(
        start,
        (following - F.col(start)).alias("__width"),
        *[F.coalesce(c, f"__in_{c}").alias(c) for c in carried],
    )
