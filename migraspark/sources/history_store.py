"""Run history on storage: a table of runs and an append-only table of patches."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migraspark.operators import history as H
from migraspark.sources.results import recover_folder, replace_folder


class HistoryStore:
    """One writer at a time; any number of readers. Opening a store counts as writing.

    Reading folds the patches into the runs. ``compact`` writes that fold back and empties the
    patches, which bounds what a read has to scan. The old runs are deleted last, opening the store
    settles a replacement that was interrupted, and applying a patch twice changes nothing, so a
    crash between any two steps loses no run.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.paths = {"migration_runs": f"{base}/runs", "patches": f"{base}/patches"}
        empty_runs = spark.createDataFrame([], H.RUN_SCHEMA)
        empty_patches = empty_runs.select("run_id", *H.PATCH_FIELDS).withColumns(
            {"seq": F.lit(0).cast("bigint"), "force_recon_ind": F.lit(False)}
        )
        self.generation_path = f"{base}/generation_runs"
        generations = spark.createDataFrame([], H.GENERATION_SCHEMA)
        generations.write.mode("append").parquet(self.generation_path)
        self._schemas = {
            "migration_runs": empty_runs.schema, "patches": empty_patches.schema,
        }
        for name, empty in (("migration_runs", empty_runs), ("patches", empty_patches)):
            recover_folder(spark, self.paths[name])
            empty.write.mode("append").parquet(self.paths[name])

    def _read(self, name: str) -> DataFrame:
        """Files of older versions lack newer columns; those are NULL."""
        return self.spark.read.schema(self._schemas[name]).parquet(self.paths[name])

    def runs(self) -> DataFrame:
        return H.apply_patches(self._read("migration_runs"), self._read("patches"))

    def log(self, batch: DataFrame, order: Sequence[str]) -> None:
        """Number the batch after the stored runs and append it."""
        numbered = H.log_runs(self._read("migration_runs"), batch, order)
        numbered.write.mode("append").parquet(self.paths["migration_runs"])

    def generations(self) -> DataFrame:
        return self.spark.read.schema(H.GENERATION_SCHEMA).parquet(self.generation_path)

    def log_generation(self, batch: DataFrame, order: Sequence[str]) -> None:
        """Number the batch of generated tables after the stored ones and append it."""
        stored = self.generations()
        numbered = H.log_generation(stored, batch, order)
        kinds = [F.col(f.name).cast(f.dataType).alias(f.name) for f in stored.schema]
        numbered.select(*kinds).write.mode("append").parquet(self.generation_path)

    def patch(self, patches: DataFrame) -> None:
        """Append partial updates; without a ``seq`` column the whole batch is newer than before."""
        known = [c for c in patches.columns if c in self._schemas["patches"].names]
        rows = patches.select(*known)
        if "seq" not in known:
            rows = rows.withColumn("seq", F.lit(time.time_ns()).cast("bigint"))
        for field in self._schemas["patches"]:
            if field.name not in rows.columns:
                value = F.lit(False) if field.name == "force_recon_ind" else F.lit(None)
                rows = rows.withColumn(field.name, value.cast(field.dataType))
        rows = rows.select(*self._schemas["patches"].names)
        rows.write.mode("append").parquet(self.paths["patches"])

    def compact(self) -> None:
        staged = self.paths["migration_runs"] + "__next"
        self.runs().write.mode("overwrite").parquet(staged)
        replace_folder(self.spark, staged, self.paths["migration_runs"])
        empty = self.spark.createDataFrame([], self._schemas["patches"])
        empty.write.mode("overwrite").parquet(self.paths["patches"])

    def clear(self) -> DataFrame:
        """Empty the history; returns how many rows each table had."""
        return H.clear(self.spark, self.paths)
