"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in the order of their size. Each is expected target/size
times in the mix; the running sum of these expectations, shifted by one random offset per source,
crosses an integer as often as the document is taken. Taking evenly along the order of sizes
keeps the words taken within two of the source's longest documents of its target.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from migraspark.llm.common import kept_table, word_count

WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST_COPIES = 2
SEED = "mix"


def targets(
    sizes: Sequence[tuple[str | None, int]],
    weights: Sequence[int] = WEIGHTS,
    percent: int = PERCENT,
    most: int = MOST_COPIES,
) -> list[tuple[str | None, int, float]]:
    """(source, size, target) per source.

    Sources by code point, NULL last, weigh ``weights`` in turn and share ``percent`` of all
    sizes. A target stops at ``most`` times its source's size; what is over goes to the others by
    weight. In the order of size per weight, the sources that stop come first.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weighted = [(s, n, weights[i % len(weights)]) for i, (s, n) in enumerate(ordered)]
    by_ratio = sorted(range(len(weighted)), key=lambda i: (weighted[i][1] / weighted[i][2], i))
    left = sum(n for _, n in sizes) * percent / 100
    weight_left = sum(w for _, _, w in weighted)
    result = [0.0] * len(weighted)
    for k, i in enumerate(by_ratio):
        _, n, w = weighted[i]
        if most * n * weight_left > left * w:
            for j in by_ratio[k:]:
                result[j] = weighted[j][2] * (left / weight_left)
            break
        result[i] = float(most * n)
        left, weight_left = left - most * n, weight_left - w
    return [(s, n, t) for (s, n, _), t in zip(weighted, result, strict=True)]


ORDER = ["_source", "_size", "_doc", "_tie"]


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of a row among those of its source in the partition, from 1."""
    seen: dict = {}
    for batch in batches:
        place = []
        for source in batch.column("_source").to_pylist():
            seen[source] = seen.get(source, 0) + 1
            place.append(seen[source])
        yield batch.append_column("_place", pa.array(place, pa.int64()))


def _mixed(
    docs: DataFrame,
    whole: bool,
    weights: Sequence[int],
    percent: int,
    most: int,
    seed: str,
) -> DataFrame:
    """All rows, as one struct _row if ``whole`` is asked for, with _doc, _source, _size, _total, _target, _copies."""
    rows = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole else []),
        F.col("doc_id").cast("long").alias("_doc"),
        F.col("source").cast("string").alias("_source"),
        word_count(F.col("text")).alias("_size"),
        F.xxhash64("text").alias("_tie"),
    )
    placed = (
        rows.repartitionByRange(*ORDER)
        .sortWithinPartitions(*ORDER)
        .withColumn("_part", F.spark_partition_id())
    )
    added = StructType().add("_place", "long")
    placed = placed.mapInArrow(_positions, StructType([*placed.schema.fields, *added.fields]))
    placed = kept_table(placed.drop("_tie"), "mix-order")
    per_part = placed.groupBy("_source", "_part").agg(
        F.max("_place").alias("rows"), F.sum("_size").alias("size")
    )
    counted = sorted(
        (tuple(r) for r in per_part.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1])
    )  # at most a row per source and one per partition
    sizes: dict = {}
    starts = []
    before: dict = {}
    for source, part, n, size in counted:
        starts.append((source, part, before.get(source, 0)))
        before[source] = before.get(source, 0) + n
        sizes[source] = sizes.get(source, 0) + size
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        targets(list(sizes.items()), weights, percent, most),
        "source string, _total bigint, _target double",
    )
    offsets = spark.createDataFrame(starts, "source string, part int, _before bigint")
    parts = offsets.alias("o").join(plan.alias("p"), F.expr("o.source <=> p.source")).select(
        "o.*", "_total", "_target"
    )
    text = F.concat(F.lit(f"{seed}:"), F.coalesce("_source", F.lit("")))
    offset = F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("double") / F.lit(float(2**20))
    rate = F.expr("CASE WHEN _total > 0 THEN _target / _total ELSE 0D END")
    last = F.col("_before") + F.col("_place")
    copies = F.floor(rate * last + offset) - F.floor(rate * (last - 1) + offset)
    named = parts.withColumnsRenamed({"source": "_of", "part": "_in"})
    met = placed.join(named, F.expr("_source <=> _of AND _part = _in"))
    return met.withColumn("_copies", copies.cast("long"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    percent: int = PERCENT,
    most: int = MOST_COPIES,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target and copies for every row of ``docs``.

    Size is the number of words, 0 for a NULL or empty text. Rows tie by doc_id (NULL first) and
    a hash of the text; full ties are equal rows. A NULL source is a source of its own. An empty
    table gives an empty result, a source of size 0 gets target 0 and no copies. Other columns
    are ignored. The table of sources, one row each, goes through the driver.

    The order is one range shuffle of (doc_id, source, size), whose partitions are numbered
    before they are counted, so a source with most of the rows is spread over many tasks.
    """
    return _mixed(docs, False, weights, percent, most, seed).selectExpr(
        "_doc AS doc_id",
        "_source AS source",
        "_size AS size",
        "_total AS source_size",
        "_target AS target",
        "_copies AS copies",
    )


def copies_of(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    percent: int = PERCENT,
    most: int = MOST_COPIES,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with every row as often as ``mix`` takes it, in the columns given, whatever their names."""
    mixed = _mixed(docs, True, weights, percent, most, seed).where("_copies > 0")
    repeat = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return mixed.select("_row", repeat).select("_row.*")
