"""Operators as filtering, repeating and placing stages over tables of documents.

All but the last return the columns they were given. The near-duplicate and decontamination stages
decide by row, under a key of their own, so a missing or repeated doc_id names no other row. Near
copies without a doc_id stay, as in ``near_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migraspark.llm.classifier import classify, train
from migraspark.llm.common import free_name, kept_table, table
from migraspark.llm.decontaminate import contaminated
from migraspark.llm.mixing import copies_of
from migraspark.llm.near_dedup import BROADCAST_IDS, near_duplicates
from migraspark.llm.sharding import assign_shards


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for every row, and its name; written, so that later uses see the same keys."""
    row = free_name(docs, "_row")
    return kept_table(docs.withColumn(row, F.monotonically_increasing_id()), "keyed-rows"), row


def _without(keyed: DataFrame, row: str, rows: DataFrame, label: str) -> DataFrame:
    """``keyed`` less the rows with the given keys (row); few keys travel to the documents."""
    rows = kept_table(rows.select(F.col("row").alias(row)).distinct(), label)
    gone = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    return keyed.join(gone, row, "left_anti").drop(row)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the table of labels, does not reject.

    Texts without lines, NULL ones included, score the share of good labels. Every row is judged
    alone, whatever its doc_id; an empty table gives an empty result, and columns of any name stay.
    """
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = free_name(docs, "score"), free_name(docs, "predicted")
    judged = classify(docs, model, names=names)
    return judged.where(F.col(names[1]) == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id, then text's hash.

    Rows that share a doc_id and differ in text stay apart. Rows without words are copies where
    doc_id and text are equal. Rows without a doc_id all stay. An empty table gives an empty result.
    """
    keyed, row = _keyed(docs)
    named = keyed.where("doc_id IS NOT NULL")
    found = near_duplicates(named.select(F.col(row).alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    light = named.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    empty = F.col("n_shingles") == 0
    group = ["component", "empty_id", "empty_hash"]
    grouped = kept_table(
        found.join(light, "row").select(
            F.struct("id", "hash", "row").alias("place"),
            F.when(~empty, F.col("component_id")).alias("component"),
            F.when(empty, F.col("id")).alias("empty_id"),
            F.when(empty, F.col("hash")).alias("empty_hash"),
        ),
        "near-duplicates",
    )
    first = grouped.groupBy(*group).agg(F.min("place").alias("place"))
    every = grouped.select(F.col("place.row").alias("row"))
    stays = kept_table(first.select(F.col("place.row").alias("row")), "first-copies")
    return _without(keyed, row, every.join(stays, "row", "left_anti"), "near-copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Rows without a text hold none; each row is judged alone, and an empty table gives an empty result.
    """
    keyed, row = _keyed(docs)
    rows = keyed.select(F.col(row).alias("doc_id"), "text")
    found = contaminated(rows, table(spark, sf_dir, "benchmark"))
    return _without(keyed, row, found.withColumnRenamed("doc_id", "row"), "contaminated")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A NULL source is a source of its own, a text without words has no size and is taken by the same
    draw as others. Repeated rows are drawn one by one; an empty table gives an empty result.
    """
    return copies_of(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their slot and shard, which replace columns of these names.

    Rows without a doc_id are placed by their text; an empty table gives an empty result.
    """
    return assign_shards(docs)
