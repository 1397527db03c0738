"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Results depend on the first: wall-clock values are read as UTC. The second is about speed: the
# JVM never compiles a method above 8000 bytes, which the fused code of a wide projection exceeds;
# with this limit Spark evaluates such a stage in smaller methods that are compiled.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the session settings the library relies on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where every task
    shares the driver's disk, falls back to a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif re.fullmatch(r"local(\[.*\])?", context.master):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="migraspark-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a table that a later step reads back."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once so every later use sees the same rows and layout."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
