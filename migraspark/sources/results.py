"""Result sets and base tables on storage: read, export with a manifest row, load, report."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.operators.conform import conform
from migraspark.operators.reconcile import recon_summary

# Quotes are doubled inside quoted values, and blanks around a value belong to it.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
SIDES = ("source", "target")
MANIFEST_SCHEMA = (
    "run_id bigint, side string, schema_name string, row_count bigint, column_count int, "
    "columns array<string>, path string, exported_at timestamp"
)


def read_result(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A header CSV result set, split into tasks by bytes. Without a schema, types are inferred.

    Values with line breaks need ``multiline``, which reads a file in one task: write such CSV in many
    files, or export Parquet. Read without it, a row torn by a line break raises an error instead of
    giving two wrong rows.
    """
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", multiline).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def _write(df: DataFrame, path: str, file_format: str, rows_per_file: int) -> int:
    """Write and count in the same pass; returns rows written."""
    seen = Observation(f"rows_{uuid.uuid4().hex}")
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    writer = writer.option("maxRecordsPerFile", rows_per_file)
    if file_format == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(file_format).save(path)
    return int(seen.get["rows"])


def export_path(base: str, run_id: int, side: str) -> str:
    return f"{base}/{side}_results/{run_id}"


def export(
    df: DataFrame,
    run_id: int,
    side: str,
    base: str,
    schema_name: str = "",
    file_format: str = "parquet",
    exported_at: datetime | None = None,
    rows_per_file: int = 5_000_000,
) -> DataFrame:
    """Write one side's result and append its manifest row; returns that row."""
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}, got {side!r}")
    path = export_path(base, run_id, side)
    rows = _write(df, path, file_format, rows_per_file)
    record = (
        run_id, side, schema_name, rows, len(df.columns), df.columns, path,
        exported_at or datetime.now(),
    )
    row = df.sparkSession.createDataFrame([record], MANIFEST_SCHEMA)
    row.write.mode("append").parquet(f"{base}/manifest")
    return row


def manifest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/manifest")


def load(df: DataFrame, spec: T.StructType, path: str) -> int:
    """Conform to the declared schema and replace the table at ``path``; returns rows loaded.

    The rows go to a folder next to the table first and take its place when all are written, so a
    value that cannot be conformed leaves the old contents as they were. A replacement that was
    interrupted is settled first.
    """
    recover_folder(df.sparkSession, path)
    staged = f"{path}__loading"
    rows = _write(conform(df, spec), staged, "parquet", 5_000_000)
    replace_folder(df.sparkSession, staged, path)
    return rows


def replace_folder(spark: SparkSession, staged: str, path: str) -> None:
    """Put a completely written folder in the place of another.

    The old folder steps aside and is deleted last, so at any moment one complete copy exists;
    ``recover_folder`` finishes or takes back a replacement that was interrupted. This needs a file
    system whose rename is one step; where it is a copy, a crash inside the copy is not detected.
    """
    recover_folder(spark, path)
    system, old, aside = _folder_and_aside(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(staged)
    if system.exists(old) and not system.rename(old, aside):
        raise OSError(f"could not move {path} aside")
    try:
        if not system.rename(new, old):
            raise OSError(f"could not move {staged} to {path}")
    finally:
        recover_folder(spark, path)


def recover_folder(spark: SparkSession, path: str) -> None:
    """Settle an interrupted ``replace_folder``: the old contents return, unless the new are there."""
    system, current, aside = _folder_and_aside(spark, path)
    if not system.exists(aside):
        return
    if system.exists(current):
        system.delete(aside, True)
    elif not system.rename(aside, current):
        raise OSError(f"could not restore {path}")


def _folder_and_aside(spark: SparkSession, path: str):
    """File system, the folder itself, and the place it steps aside to while it is replaced."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    current = hadoop.Path(path)
    system = current.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, current, hadoop.Path(f"{path}__replaced")


def load_all(
    frames: Mapping[str, DataFrame], specs: Mapping[str, T.StructType], base: str
) -> DataFrame:
    """Load several tables; one row per table with the rows loaded."""
    loaded = [(name, load(df, specs[name], f"{base}/{name}")) for name, df in frames.items()]
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(loaded, "table_name string, rows_loaded bigint")


def to_report_json(results: DataFrame) -> DataFrame:
    """One JSON report per run."""
    return results.select("run_id", F.to_json(F.struct(*results.columns)).alias("report"))


def write_reports(results: DataFrame, base: str, compared_at: datetime | None = None) -> None:
    """Per-run reports as JSON lines, and next to them the totals with the runs and the reports' path.

    Both carry ``compared_at``, in ISO 8601; without one it is the time of this call in UTC.
    """
    at = compared_at or datetime.now(timezone.utc)
    stamped = results.withColumn("compared_at", F.lit(at.isoformat()))
    stamped.write.mode("overwrite").json(f"{base}/reports")
    recon_summary(results, at, f"{base}/reports").write.mode("overwrite").json(f"{base}/summary")
