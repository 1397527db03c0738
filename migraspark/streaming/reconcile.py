"""Reconcile runs as soon as both of their exports have arrived."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from migraspark.operators.reconcile import RunPair, reconcile_runs
from migraspark.sources.results import MANIFEST_SCHEMA, SIDES, export_path


def complete_runs(spark: SparkSession, base: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the runs whose second side has just arrived: a join of the manifest's two sides.

    Both sides wait in Spark's state, a run id per export, so the manifest is read once, as it
    grows. An export that is repeated makes its run complete again.
    """

    def side(name: str) -> DataFrame:
        rows = (
            spark.readStream.schema(MANIFEST_SCHEMA)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{base}/manifest")
        )
        return rows.where(F.col("side") == name).select(F.col("run_id").alias(f"{name}_run"))

    source, target = (side(name) for name in SIDES)
    joined = source.join(target, F.col("source_run") == F.col("target_run"))
    return joined.select(F.col("source_run").alias("run_id"))


def reconcile_arrivals(
    spark: SparkSession,
    base: str,
    runs_per_batch: int = 100,
    available_now: bool = True,
    file_format: str = "parquet",
    parallel: int = 4,
) -> StreamingQuery:
    """Watch the export manifest under ``base`` and write one result per complete run.

    Every export appends one manifest file, so a batch names few runs, and their ids are all that
    reaches the driver; ``parallel`` of them are compared at a time. A run that cannot be read or
    compared gets a failed result, and the stream goes on. A result folder belongs to its run and is
    overwritten, so a repeated batch or a repeated export leaves one result per run.
    """

    def compare(arrived: DataFrame, batch: int) -> None:
        session = arrived.sparkSession
        ids = sorted(row["run_id"] for row in arrived.distinct().collect())
        if not ids:
            return

        def opened(run_id: int, side: str) -> DataFrame:
            return session.read.format(file_format).load(export_path(base, run_id, side))

        pairs = [RunPair(i, None, *(partial(opened, i, side) for side in SIDES)) for i in ids]
        found = reconcile_runs(pairs, parallel=parallel, spark=session)
        found.withColumn("run", F.col("run_id")).write.mode("overwrite").partitionBy("run").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(f"{base}/results")

    writer = complete_runs(spark, base, runs_per_batch).writeStream.option(
        "checkpointLocation", f"{base}/stream_checkpoint"
    ).foreachBatch(compare)
    if not available_now:
        return writer.start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def results(spark: SparkSession, base: str) -> DataFrame:
    """All results written so far."""
    return spark.read.parquet(f"{base}/results").drop("run")
