"""SQL text files as a table of name and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migraspark.functions.text import ddl_table_name, strip_space

# File endings of SQL sources.
EXTENSIONS = (".sql", ".proc", ".txt")


def read_corpus(
    spark: SparkSession,
    folder: str,
    extensions: Sequence[str] = EXTENSIONS,
    nested: bool = False,
) -> DataFrame:
    """All files with one of the endings: trimmed text per file name, blank files left out.

    One row per file and many files per task; files below sub-folders only with ``nested``.
    """
    endings = ",".join(ending.lstrip(".") for ending in extensions)
    files = (
        spark.read.option("pathGlobFilter", f"*.{{{endings}}}")
        .option("recursiveFileLookup", nested)
        .text(folder, wholetext=True)
    )
    named = files.select(
        F.col("_metadata.file_name").alias("name"), strip_space(F.col("value")).alias("text")
    )
    return named.filter(F.col("text") != "").orderBy("name")


def read_ddl(spark: SparkSession, folder: str) -> DataFrame:
    """``*.sql`` files keyed by file stem, with the table each one creates."""
    files = read_corpus(spark, folder, (".sql",))
    stem = F.regexp_replace("name", r"\.sql\z", "")
    table = F.coalesce(ddl_table_name(F.col("text")), stem)
    return files.select(stem.alias("stem"), table.alias("table_name"), "text")
