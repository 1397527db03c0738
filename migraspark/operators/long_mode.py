"""Comparing any number of runs in one job, whatever their schemas, over a common form of rows.

A row becomes (run, hash of its key, array of its cells). Runs whose keys are unique on both sides
are joined by that hash. Runs that repeat a key are paired by position: their rows are sorted inside
the run, equal rows are folded to a row and its copies, and the two sides' intervals of copies are
cut into pieces on one axis for all such runs. Cells are only unfolded once rows are paired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migraspark.functions import normalize as N
from migraspark.operators.ordered import asc, segments, with_running_total
from migraspark.session import cut_lineage

CELL = "struct<column: string, is_key: boolean, number: double, text: string, numeric: boolean>"
KEY = ("k1", "k2")


def melt(df: DataFrame, run_id: int, keys: Sequence[str]) -> DataFrame:
    """One normalised export as (run_id, k1, k2, cells): a 128-bit hash of the key columns' text, and
    all columns in order. Without ``keys`` all rows have one key."""
    types = {f.name: f.dataType for f in df.schema}
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(c in keys).alias("is_key"),
                (
                    N.to_number(F.col(c), types[c])
                    if N.is_numeric(types[c])
                    else F.lit(None).cast("double")
                ).alias("number"),
                F.col(c).cast("string").alias("text"),
                F.lit(N.is_numeric(types[c])).alias("numeric"),
            )
            for c in df.columns
        ]
    ).cast(f"array<{CELL}>")
    key = [part for k in keys for part in (F.col(k).isNull(), F.col(k).cast("string"))]
    return df.select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.xxhash64(F.lit(1), *key).alias("k1"),
        F.xxhash64(F.lit(2), *key).alias("k2"),
        cells.alias("cells"),
    )


def run_facts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per run: rows of both sides and whether either repeats a key. Only hashes are shuffled."""
    keyed = source.select("run_id", *KEY, F.lit(True).alias("is_source")).unionAll(
        target.select("run_id", *KEY, F.lit(False).alias("is_source"))
    )
    counted = keyed.groupBy("run_id", *KEY).agg(
        F.count_if("is_source").alias("s"), F.count_if(~F.col("is_source")).alias("t")
    )
    return counted.groupBy("run_id").agg(
        F.sum("s").alias("source_rows"),
        F.sum("t").alias("target_rows"),
        (F.max(F.greatest("s", "t")) > 1).alias("repeats"),
    )


def _compared(cell: Column, other: Column, rtol: float, atol: float) -> Column:
    """How a cell of the source and its counterpart relate: name, mismatch, numeric difference."""
    x = F.coalesce(cell["number"], cell["text"].try_cast("double"))
    y = F.coalesce(other["number"], other["text"].try_cast("double"))
    numeric = cell["numeric"] | other["numeric"]
    equal = F.when(numeric, N.numbers_match(x, y, rtol, atol)).otherwise(
        N.texts_match(cell["text"], other["text"])
    )
    both = cell["column"].isNotNull() & other["column"].isNotNull()
    return F.struct(
        F.coalesce(cell["column"], other["column"]).alias("column"),
        (cell["column"].isNotNull() & ~both).alias("source_only"),
        (other["column"].isNotNull() & ~both).alias("target_only"),
        (both & ~equal).alias("bad"),
        F.when(both & ~equal & numeric, F.abs(x - y)).alias("gap"),
    )


def _cell_pairs(rtol: float, atol: float) -> Column:
    """The compared cells of a pair of rows: by place where the columns agree, else by name."""
    missing = F.lit(None).cast(CELL)
    source, target = (F.coalesce(c, F.array().cast(f"array<{CELL}>")) for c in ("src", "tgt"))
    names = [F.transform(c, lambda cell: cell["column"]) for c in (source, target)]
    by_place = F.transform(
        F.arrays_zip(source.alias("s"), target.alias("t")), lambda z: _compared(z["s"], z["t"], rtol, atol)
    )

    def named(cells: Column, cell: Column) -> Column:
        return F.coalesce(F.get(F.filter(cells, lambda d: d["column"] == cell["column"]), F.lit(0)), missing)

    by_name = F.concat(
        F.transform(source, lambda cell: _compared(cell, named(target, cell), rtol, atol)),
        F.transform(
            F.filter(target, lambda cell: ~F.array_contains(names[0], cell["column"])),
            lambda cell: _compared(missing, cell, rtol, atol),
        ),
    )
    return F.when(names[0] == names[1], by_place).otherwise(by_name)


def _by_key(source: DataFrame, target: DataFrame) -> DataFrame:
    left = source.select("run_id", *KEY, F.col("cells").alias("src"))
    right = target.select(*[F.col(c).alias(f"t_{c}") for c in ("run_id", *KEY)], F.col("cells").alias("tgt"))
    same = F.lit(True)
    for name in ("run_id", *KEY):
        same = same & (F.col(name) == F.col(f"t_{name}"))
    return left.join(right, same, "full_outer").select(
        F.coalesce("run_id", "t_run_id").alias("run_id"), "src", "tgt", F.lit(1).cast("bigint").alias("weight")
    )


def _by_position(source: DataFrame, target: DataFrame, rows: int) -> DataFrame:
    """Rows of runs with equally many on both sides, sorted and paired as ``reconcile`` does.

    As the sides have equally many rows in every run, the positions over all runs in order of their
    ids are positions inside each run too.
    """

    def placed(side: DataFrame, name: str) -> DataFrame:
        folded = side.groupBy("run_id", "cells").agg(F.count("*").alias("copies"))
        # Missing values last, numbers as numbers, as in an ordinary sort of the columns.
        place = F.transform(
            "cells",
            lambda c: F.struct(
                F.when(c["numeric"], c["number"].isNull()).otherwise(c["text"].isNull()),
                c["number"],
                F.when(~c["numeric"], c["text"]),
            ),
        )
        starts = with_running_total(
            folded.withColumn("place", place), [asc("run_id"), asc("place")], "copies", "start",
            inclusive=False, split_ties=False,
        )
        return starts.select("start", F.struct("run_id", "cells").alias(name))

    starts = cut_lineage(placed(source, "src").join(placed(target, "tgt"), "start", "full_outer"))
    pieces = segments(starts, "start", F.lit(rows).cast("bigint"), ["src", "tgt"])
    return pieces.select(
        F.col("src.run_id").alias("run_id"), F.col("src.cells").alias("src"), F.col("tgt.cells").alias("tgt"),
        F.col("__width").alias("weight"),
    )


def compare_melted(
    source: DataFrame, target: DataFrame, rtol: float = N.RTOL, atol: float = N.ATOL
) -> DataFrame:
    """Compare any number of runs in one job over ``melt`` of their sides, column by column.

    Use it for many small runs, and for very wide results: the plan does not grow with the number
    of columns. The rows of a run spread over all tasks. Returns run_id, column, source_only,
    target_only, mismatch_count and max_numeric_diff.

    Key columns are compared only in runs that repeat a key on a side, which go by position. Where
    the sides of such a run differ in rows nothing is paired: the surplus counts as rows of one side
    only and mismatch_count is NULL. What is known of each run, one row, goes through the driver.
    """
    runs = run_facts(source, target).collect()  # a row per run
    single = [r["run_id"] for r in runs if not r["repeats"]]
    even = [r["run_id"] for r in runs if r["repeats"] and r["source_rows"] == r["target_rows"]]
    uneven = {r["run_id"]: r["source_rows"] - r["target_rows"] for r in runs if r["run_id"] not in {*single, *even}}

    def of(side: DataFrame, ids: Sequence[int]) -> DataFrame:
        return side.where(F.col("run_id").isin(list(ids)))

    keyed = _by_key(of(source, single), of(target, single))
    by_key = keyed.withColumns(
        {c: F.filter(c, lambda cell: ~cell["is_key"]) for c in ("src", "tgt")}
    )
    pairs = by_key
    if even:
        rows = sum(r["source_rows"] for r in runs if r["run_id"] in even)
        pairs = pairs.unionByName(_by_position(of(source, even), of(target, even), rows))
    cells = pairs.select("run_id", "weight", F.inline(_cell_pairs(rtol, atol)))
    found = cells.groupBy("run_id", "column").agg(
        *[F.sum(F.when(F.col(c), F.col("weight")).otherwise(0)).alias(c) for c in ("source_only", "target_only")],
        F.sum(F.when(F.col("bad"), F.col("weight")).otherwise(0)).alias("mismatch_count"),
        F.max("gap").alias("max_numeric_diff"),
    )
    if not uneven:
        return found
    named = of(source, uneven).unionAll(of(target, uneven))
    columns = named.select("run_id", F.explode(F.transform("cells", lambda c: c["column"])).alias("column"))
    more = F.coalesce(*[F.when(F.col("run_id") == i, F.lit(n)) for i, n in uneven.items()]).cast("bigint")
    return found.unionByName(
        columns.distinct().select(
            "run_id", "column",
            F.greatest(more, F.lit(0)).alias("source_only"), F.greatest(-more, F.lit(0)).alias("target_only"),
            F.lit(None).cast("bigint").alias("mismatch_count"), F.lit(None).cast("double").alias("max_numeric_diff"),
        )
    )
