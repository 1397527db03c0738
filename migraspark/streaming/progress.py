"""Run state kept up to date while progress patches arrive as files.

The newest values and the activity per run live in Spark's own streaming state: an aggregation per
key, whose size is bounded by the keys, which is restored from the checkpoint when a query starts
again, and which is read back with the ``statestore`` source. Entries that only collect are
appended to a table. Each part is a query of its own with its own checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from migraspark.operators.progress import (
    ACTIVITY,
    appended_entries,
    latest_activity,
    replaced_values,
    states_of,
)

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = ("state", "appended", "activity")


def read_events(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet"
) -> DataFrame:
    """A stream of event files; new files below ``folder`` are picked up as they appear."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def newest(patches: DataFrame) -> DataFrame:
    """The newest value per run and key of the keys that replace, as one struct (seq, value)."""
    return replaced_values(patches).groupBy("run_id", "key").agg(
        F.max(F.struct("seq", "value")).alias("newest")
    )


def keep_state(
    patches: DataFrame, base: str, available_now: bool = True, parts: Sequence[str] = PARTS
) -> list[StreamingQuery]:
    """Fold the stream into the named ``parts`` below ``base``; one query per part.

    ``state`` holds the newest value per run and key, ``appended`` the entries of collecting keys,
    ``activity`` what the step states follow from (only of patches that have nodes). Folds go by
    ``seq``, not by arrival, so late patches need no watermark. A batch repeated after a failure
    changes neither state nor table twice. The state is kept on the executors' disks by RocksDB,
    unless the session names another provider.
    """
    spark = patches.sparkSession
    queries = []
    for part in parts:
        if part == "activity" and not {"node", "node_status"} <= set(patches.columns):
            continue
        if part == "appended":
            rows = appended_entries(patches)
            writer = rows.writeStream.format("parquet").option("path", f"{base}/appended")
        else:
            rows = newest(patches) if part == "state" else latest_activity(patches)
            writer = rows.writeStream.format("noop").outputMode("update")
        writer = writer.option("checkpointLocation", f"{base}/checkpoint/{part}")
        if available_now:
            writer = writer.trigger(availableNow=True)
        before = spark.conf.get(STATE_PROVIDER)
        spark.conf.set(STATE_PROVIDER, ROCKSDB if "HDFSBacked" in before else before)
        try:
            queries.append(writer.start())  # the query keeps the settings it starts with
        finally:
            spark.conf.set(STATE_PROVIDER, before)
    if available_now:
        for query in queries:
            query.awaitTermination()
    return queries


def _stored(spark: SparkSession, base: str, part: str) -> DataFrame:
    """The keys and buffers of a part's aggregation, as of its last finished batch."""
    return spark.read.format("statestore").load(f"{base}/checkpoint/{part}")


def current_state(spark: SparkSession, base: str) -> DataFrame:
    """Newest value per run and key of all finished batches."""
    stored = _stored(spark, base, "state")
    (buffer,) = stored.schema["value"].dataType.fieldNames()
    return stored.select("key.run_id", "key.key", f"value.{buffer}.value", f"value.{buffer}.seq")


def current_entries(spark: SparkSession, base: str) -> DataFrame:
    """All stored entries of the collecting keys; they stay rows, as many as arrived."""
    return spark.read.parquet(f"{base}/appended").select("run_id", "key", "seq", "value")


def current_steps(spark: SparkSession, base: str) -> DataFrame:
    """The eight step states of every run stored so far. Patches without nodes leave none to read."""
    stored = _stored(spark, base, "activity")
    buffers = stored.schema["value"].dataType.fieldNames()
    parts = [F.col("value")[b].alias(n) for b, n in zip(buffers, ACTIVITY, strict=True)]
    return states_of(stored.select("key.run_id", *parts))
