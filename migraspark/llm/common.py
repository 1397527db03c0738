"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from migraspark.session import scratch_path

# Space, tab, line feed, vertical tab, form feed, carriage return: all else belongs to words.
SPACES = "\\x20\\x09-\\x0D"


# Texts go to Python workers in batches of so many rows and bytes at most. Spark's own ten thousand rows
# and 64 MB per batch, doubled while a buffer grows, are held outside the heap for every task.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to the above; smaller ones stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        given = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower())
        size = int(given[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[given[2]] if given else 0
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    Cuts the lineage on storage that outlives executors, and gives joins a plain scan, whose
    shuffle Spark may split when one key is hot.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once per row.

    A column used inside a lambda is computed again for every element; as the single element of
    an array it becomes a lambda variable.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order; a NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")
