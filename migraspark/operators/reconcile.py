"""Reconciling two result sets: align rows, compare columns with tolerance, give a verdict.

Inputs are lazy frames; at 100 TB they should be written tables (an export), because alignment
reads them two or three times. No data row reaches the driver: jobs return counts and one result
row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.functions import normalize as N
from migraspark.operators.history import verdict_patches
from migraspark.operators.ordered import asc, segments, with_running_total
from migraspark.session import cut_lineage

SCHEMA_COLUMN = "(schema)"
KEYS_COLUMN = "(keys)"
MISSING_EXPORT = "Missing source or target export - run the export step first"

DIFF_TYPE = (
    "struct<column: string, mismatch_count: bigint, max_numeric_diff: double, "
    "sample_mismatch: string>"
)
RESULT_COLUMNS = (
    "run_id", "source_file", "passed", "source_rows", "target_rows", "columns_match",
    "row_counts_match", "alignment", "message", "column_diffs",
)


# ---------------------------------------------------------------- row counts and schemas


def row_counts(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table on both sides; a table missing on one side counts as NULL there."""

    def count(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
        parts = [
            frame.agg(F.count("*").alias(name)).select(F.lit(table).alias("table_name"), name)
            for table, frame in tables.items()
        ]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionAll(part)
        return union

    joined = count(source, "source_rows").join(
        count(target, "target_rows"), "table_name", "full_outer"
    )
    matched = F.col("source_rows").eqNullSafe(F.col("target_rows"))
    return joined.withColumn("matched", matched)


def schema_match(source: DataFrame, target: DataFrame) -> bool:
    """Column names in order; types do not count."""
    return source.columns == target.columns


def schema_table(source: DataFrame, target: DataFrame) -> DataFrame:
    """Position by position: both names, whether they agree, and how many values each side has."""

    def side(frame: DataFrame, name: str) -> DataFrame:
        counts = frame.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(frame.columns)])
        rows = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(c).alias(f"{name}_column"),
                    F.col(f"c{i}").alias(f"{name}_values"),
                )
                for i, c in enumerate(frame.columns)
            ]
        )
        return counts.select(F.inline(rows))

    joined = side(source, "source").join(side(target, "target"), "position", "full_outer")
    return joined.withColumn("matched", F.col("source_column").eqNullSafe(F.col("target_column")))


# ---------------------------------------------------------------- normalising


def unique_names(df: DataFrame) -> DataFrame:
    """Columns in their order; one that repeats a name gets the first free ``name_1``, ``name_2``, ..."""
    taken: set[str] = set()
    names = []
    for name in df.columns:
        found, n = name, 0
        while found in taken or (n and found in df.columns):
            n += 1
            found = f"{name}_{n}"
        taken.add(found)
        names.append(found)
    return df if names == df.columns else df.toDF(*names)


def normalize(df: DataFrame) -> DataFrame:
    """Numbers as BIGINT or DOUBLE, dates as text, nested values as their leaves with paths, everything
    else as trimmed text.

    A text column with a date-like name becomes a date when any of its values parses; one
    aggregation answers that for all such columns.
    """
    types = {field.name: field.dataType for field in df.schema}
    maybe = [
        c for c in df.columns if isinstance(types[c], T.StringType) and N.looks_like_date(c)
    ]
    dated: set[str] = set()
    if maybe:
        probe = df.agg(*[F.max(N.parsed_timestamp(F.col(c)).isNotNull()).alias(c) for c in maybe])
        found = probe.first().asDict()
        dated = {c for c in maybe if found[c]}

    def rule(name: str) -> Column:
        column, data_type = F.col(name), types[name]
        if N.is_numeric(data_type):
            return N.numeric(column, data_type)
        if N.is_temporal(data_type):
            return N.temporal_text(column)
        if name in dated:
            return N.temporal_text(N.parsed_timestamp(column))
        if isinstance(data_type, T.StringType):
            return N.plain_text(column)
        if N.is_nested(data_type):
            return N.leaves(column, data_type)
        return N.plain_text(column.cast("string"))

    return df.select(*[rule(c).alias(c) for c in df.columns])


# ---------------------------------------------------------------- keys


def key_candidates(columns: Sequence[str]) -> list[list[str]]:
    """``order_id`` first, then all columns that are no measure if that leaves some out."""
    found = [["order_id"]] if "order_id" in columns else []
    rest = [c for c in columns if not N.is_measure(c)]
    if rest and len(rest) < len(columns):
        found.append(rest)
    return found


def key_profile(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per side: rows, and how often the most frequent key occurs. One shuffle of the keys."""
    sides = [
        frame.groupBy(*keys).agg(F.count("*").alias("__n")).agg(
            F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
            F.coalesce(F.max("__n"), F.lit(0)).alias("copies"),
        ).select(F.lit(name).alias("side"), "rows", "copies")
        for name, frame in (("source", source), ("target", target))
    ]
    return sides[0].unionAll(sides[1])


@dataclass(frozen=True)
class Profile:
    keys: list[str] | None
    source_rows: int
    target_rows: int


def infer_keys(source: DataFrame, target: DataFrame) -> Profile:
    """First candidate without a repeated key on either (normalised) side, and the row counts."""
    rows: dict[str, int] = {}
    for keys in key_candidates(source.columns):
        if not set(keys) <= set(target.columns):
            continue
        found = {r["side"]: r for r in key_profile(source, target, keys).collect()}
        rows = {side: found[side]["rows"] for side in found}
        if all(r["copies"] <= 1 for r in found.values()):
            return Profile(keys, rows["source"], rows["target"])
        if rows["source"] != rows["target"]:
            break
    if not rows:
        rows = {"source": source.count(), "target": target.count()}
    return Profile(None, rows["source"], rows["target"])


# ---------------------------------------------------------------- alignment


def full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe full outer join on ``keys`` with a ``side`` column telling who has the row."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumn(
        "__right", F.lit(True)
    )
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    joined = left.withColumn("__left", F.lit(True)).join(renamed, same, "full_outer")
    side = (
        F.when(F.col("__right").isNull(), "left_only")
        .when(F.col("__left").isNull(), "right_only")
        .otherwise("both")
    )
    return joined.select(
        *[
            F.when(F.col("__left").isNull(), F.col(f"__r_{k}")).otherwise(F.col(k)).alias(k)
            for k in keys
        ],
        *[c for c in left.columns if c not in keys],
        *[c for c in right.columns if c not in keys],
        side.alias("side"),
    )


def align_by_key(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns ``src`` and ``tgt`` (structs), ``at`` (the key) and ``weight`` (always one)."""
    left = source.select(*keys, F.struct(*source.columns).alias("src"))
    right = target.select(*keys, F.struct(*target.columns).alias("tgt"))
    return full_outer(left, right, keys).select(
        F.struct(*keys).alias("at"), "src", "tgt", "side", F.lit(1).cast("bigint").alias("weight")
    )


def _row_starts(df: DataFrame, name: str) -> DataFrame:
    """Distinct rows with the position of their first copy in the sorted side, and the copies."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    order = [asc(c, nulls_last=True) for c in df.columns]
    placed = with_running_total(
        counted, order, "__n", "__start", inclusive=False, split_ties=False
    )
    return placed.select("__start", F.struct(*df.columns).alias(name), F.col("__n").alias(f"{name}_n"))


def align_by_position(source: DataFrame, target: DataFrame, rows: int) -> DataFrame:
    """Pair the sorted sides row by row, in the shape of ``align_by_key``.

    Copies of a row stay folded: each pair stands for ``weight`` equal pairs starting at ``at``,
    so a row repeated a billion times is still one row here.
    """
    src, tgt = _row_starts(source, "src"), _row_starts(target, "tgt")
    starts = cut_lineage(src.join(tgt, "__start", "full_outer"))
    if starts.filter(F.col("src").isNull() | F.col("tgt").isNull()).isEmpty():
        # Both sides repeat the same rows equally often, so every start pairs whole runs of copies.
        paired = starts.withColumn("__width", F.col("src_n"))
    else:
        paired = segments(
            starts.drop("src_n", "tgt_n"), "__start", F.lit(rows).cast("bigint"), ["src", "tgt"]
        )
    return paired.select(
        F.col("__start").alias("at"),
        "src",
        "tgt",
        F.lit("both").alias("side"),
        F.col("__width").alias("weight"),
    )


# ---------------------------------------------------------------- comparing


def _verdicts(aligned: DataFrame, rtol: float, atol: float) -> list[tuple[str, Column, Column]]:
    """Per column: name, mismatch flag, and absolute numeric difference (NULL for text).

    Nested values differ if any leaf does; numbers inside have the tolerance too.
    """
    source_types = {f.name: f.dataType for f in aligned.schema["src"].dataType}
    target_types = {f.name: f.dataType for f in aligned.schema["tgt"].dataType}
    verdicts = []
    for name, source_type in source_types.items():
        x, y = F.col("src")[name], F.col("tgt")[name]
        target_type = target_types[name]
        if N.is_numeric(source_type) or N.is_numeric(target_type):
            x, y = N.to_number(x, source_type), N.to_number(y, target_type)
            mismatch = ~N.numbers_match(x, y, rtol, atol)
            verdicts.append((name, mismatch, F.abs(x - y)))
        elif _both_nested(source_type, target_type):
            apart = N.leaf_mismatches(x, y, rtol, atol)
            verdicts.append((name, F.size(apart) > 0, F.array_max(F.transform(apart, lambda d: d["gap"]))))
        else:
            verdicts.append((name, ~N.texts_match(x, y), F.lit(None).cast("double")))
    return verdicts


def _both_nested(source: T.DataType, target: T.DataType) -> bool:
    """Whether two normalised columns hold leaves."""
    return isinstance(source, T.ArrayType) and isinstance(target, T.ArrayType)


def _place(at: Column, aligned: DataFrame) -> Column:
    if isinstance(aligned.schema["at"].dataType, T.StructType):
        return F.concat(F.lit("key "), F.to_json(at))
    return F.concat(F.lit("row "), at.cast("string"))


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("NULL"))


def column_diffs(aligned: DataFrame, rtol: float = N.RTOL, atol: float = N.ATOL) -> DataFrame:
    """One row: rows only on one side, and the array of differing columns, in column order.

    A single aggregation with partial sums per task; nothing is grouped or sorted.
    """
    verdicts = _verdicts(aligned, rtol, atol)
    flagged = aligned.select(
        "at", "src", "tgt", "side", "weight",
        *[
            F.struct((mismatch & (F.col("side") == "both")).alias("bad"), gap.alias("gap"))
            .alias(f"v{i}")
            for i, (_, mismatch, gap) in enumerate(verdicts)
        ],
    )
    measures = [
        F.count_if(F.col("side") == "left_only").alias("source_only"),
        F.count_if(F.col("side") == "right_only").alias("target_only"),
    ]
    for i, (name, _, _) in enumerate(verdicts):
        bad, gap = F.col(f"v{i}.bad"), F.col(f"v{i}.gap")
        x, y = F.col("src")[name], F.col("tgt")[name]
        where = F.lit("")
        if _both_nested(*(aligned.schema[side].dataType[name].dataType for side in ("src", "tgt"))):
            first = F.get(N.leaf_mismatches(x, y, rtol, atol), F.lit(0))
            x, y, where = first["x"], first["y"], F.concat(F.lit(" at "), F.lit(name), first["path"])
        pair = F.struct(F.col("at"), x.alias("s"), y.alias("t"), where.alias("where"))
        measures += [
            F.coalesce(F.sum(F.when(bad, F.col("weight"))), F.lit(0)).alias(f"n{i}"),
            F.max(F.when(bad, gap)).alias(f"d{i}"),
            F.min_by(pair, F.when(bad, F.col("at"))).alias(f"s{i}"),
        ]
    totals = flagged.agg(*measures)
    diffs = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"n{i}").alias("mismatch_count"),
                F.col(f"d{i}").alias("max_numeric_diff"),
                F.when(
                    F.col(f"n{i}") > 0,
                    F.concat(
                        _place(F.col(f"s{i}.at"), aligned),
                        F.col(f"s{i}.where"),
                        F.lit(": source="),
                        _shown(F.col(f"s{i}.s")),
                        F.lit(" target="),
                        _shown(F.col(f"s{i}.t")),
                    ),
                ).alias("sample_mismatch"),
            )
            for i, (name, _, _) in enumerate(verdicts)
        ]
    )
    return totals.select(
        "source_only",
        "target_only",
        F.filter(diffs, lambda d: d["mismatch_count"] > 0).cast(f"array<{DIFF_TYPE}>").alias("diffs"),
    )


def _single_diff(column: str, text: Column) -> Column:
    return F.array(
        F.struct(
            F.lit(column).alias("column"),
            F.lit(1).cast("bigint").alias("mismatch_count"),
            F.lit(None).cast("double").alias("max_numeric_diff"),
            text.alias("sample_mismatch"),
        )
    ).cast(f"array<{DIFF_TYPE}>")


def _message(passed: Column) -> Column:
    """Pass first, then row counts, then the first three differing columns."""
    diffs = F.col("column_diffs")
    named = F.transform(
        F.slice(diffs, 1, 3),
        lambda d: F.concat(
            d["column"], F.lit(" ("), d["mismatch_count"].cast("string"), F.lit(" mismatches)")
        ),
    )
    more = F.when(
        F.size(diffs) > 3,
        F.concat(F.lit(", +"), (F.size(diffs) - 3).cast("string"), F.lit(" more")),
    ).otherwise("")
    rows = [F.col(c).cast("string") for c in ("source_rows", "target_rows")]
    return (
        F.when(
            passed,
            F.concat(F.lit("Reconciliation passed ("), rows[0], F.lit(" rows, all columns match)")),
        )
        .when(
            ~F.col("row_counts_match"),
            F.concat(F.lit("Row count mismatch: source="), rows[0], F.lit(", target="), rows[1]),
        )
        .when(
            F.size(diffs) > 0,
            F.concat(F.lit("Data mismatch: "), F.array_join(named, ", "), more),
        )
        .otherwise("Reconciliation failed")
    )


def _result(
    diffs: DataFrame,
    run_id: int,
    source_file: str | None,
    source_rows: int,
    target_rows: int,
    columns_match: bool,
    alignment: str,
) -> DataFrame:
    """The one result row from a one-row frame holding ``column_diffs``."""
    facts = diffs.select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.lit(source_file).cast("string").alias("source_file"),
        F.lit(source_rows).cast("bigint").alias("source_rows"),
        F.lit(target_rows).cast("bigint").alias("target_rows"),
        F.lit(columns_match).alias("columns_match"),
        F.lit(source_rows == target_rows).alias("row_counts_match"),
        F.lit(alignment).alias("alignment"),
        "column_diffs",
    )
    passed = (
        F.col("row_counts_match") & F.col("columns_match") & (F.size("column_diffs") == 0)
    )
    return facts.select(
        "*", passed.alias("passed"), _message(passed).alias("message")
    ).select(*RESULT_COLUMNS)


def _no_diffs(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.array().cast(f"array<{DIFF_TYPE}>").alias("column_diffs"))


def _key_type_clash(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> bool:
    def numbers(frame: DataFrame) -> list[bool]:
        return [N.is_numeric(frame.schema[k].dataType) for k in keys]

    return numbers(source) != numbers(target)


def reconcile(
    source: DataFrame,
    target: DataFrame,
    run_id: int = 0,
    source_file: str | None = None,
    rtol: float = N.RTOL,
    atol: float = N.ATOL,
) -> DataFrame:
    """Compare two result sets; returns one row with the verdict and the differing columns.

    Columns that repeat a name are told apart by ``unique_names``, in their order on each side.
    """
    spark = source.sparkSession
    source, target = unique_names(source), unique_names(target)
    if not schema_match(source, target):
        text = f"source columns={source.columns}; target columns={target.columns}"
        diffs = spark.range(1).select(_single_diff(SCHEMA_COLUMN, F.lit(text)).alias("column_diffs"))
        counts = source.count(), target.count()
        return _result(diffs, run_id, source_file, *counts, False, "none")
    src, tgt = normalize(source), normalize(target)
    profile = infer_keys(src, tgt)
    counts = profile.source_rows, profile.target_rows
    if counts[0] != counts[1]:
        return _result(_no_diffs(spark), run_id, source_file, *counts, True, "none")
    if profile.keys is None:
        aligned = align_by_position(src, tgt, counts[0])
        diffs = column_diffs(aligned, rtol, atol).select(F.col("diffs").alias("column_diffs"))
        return _result(diffs, run_id, source_file, *counts, True, "position")
    alignment = "keys: " + ", ".join(profile.keys)
    if _key_type_clash(src, tgt, profile.keys):
        text = F.lit(f"Key alignment failed on {profile.keys}: types differ between the sides")
        diffs = spark.range(1).select(_single_diff(KEYS_COLUMN, text).alias("column_diffs"))
        return _result(diffs, run_id, source_file, *counts, True, alignment)
    return _by_key(src, tgt, profile.keys, run_id, source_file, counts, rtol, atol)


def _by_key(
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    run_id: int,
    source_file: str | None,
    counts: tuple[int, int],
    rtol: float,
    atol: float,
) -> DataFrame:
    """The result row of normalised sides, or of those of their rows that may differ, by key."""
    found = column_diffs(align_by_key(src, tgt, keys), rtol, atol)
    text = F.concat(
        F.lit(f"Key alignment failed on {keys}: "),
        F.col("source_only").cast("string"),
        F.lit(" source-only rows, "),
        F.col("target_only").cast("string"),
        F.lit(" target-only rows"),
    )
    unmatched = (F.col("source_only") > 0) | (F.col("target_only") > 0)
    diffs = found.select(
        F.when(unmatched, _single_diff(KEYS_COLUMN, text))
        .otherwise(F.col("diffs"))
        .alias("column_diffs")
    )
    return _result(diffs, run_id, source_file, *counts, True, "keys: " + ", ".join(keys))


def explode_diffs(results: DataFrame) -> DataFrame:
    """Long form: one row per run and differing column."""
    return results.select("run_id", F.inline("column_diffs"))


# ---------------------------------------------------------------- many runs


def missing_sides(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """A failed result for every run that lacks one of its two exports."""
    present = manifest.groupBy("run_id").agg(
        F.max(F.col("side") == "source").alias("has_source"),
        F.max(F.col("side") == "target").alias("has_target"),
    )
    both = F.coalesce(F.col("has_source") & F.col("has_target"), F.lit(False))
    lacking = runs.select("run_id", "source_file").join(present, "run_id", "left").filter(~both)
    return lacking.select(
        "run_id",
        "source_file",
        F.lit(False).alias("passed"),
        F.lit(0).cast("bigint").alias("source_rows"),
        F.lit(0).cast("bigint").alias("target_rows"),
        F.lit(False).alias("columns_match"),
        F.lit(False).alias("row_counts_match"),
        F.lit("none").alias("alignment"),
        F.lit(MISSING_EXPORT).alias("message"),
        F.array().cast(f"array<{DIFF_TYPE}>").alias("column_diffs"),
    )


@dataclass(frozen=True)
class RunPair:
    """The two sides of a run. A side may be a function that opens it: then a side that cannot be
    opened fails this run alone."""

    run_id: int
    source_file: str | None
    source: DataFrame | Callable[[], DataFrame]
    target: DataFrame | Callable[[], DataFrame]

    def opened(self) -> tuple[DataFrame, DataFrame]:
        return tuple(side() if callable(side) else side for side in (self.source, self.target))


def failed_result(
    spark: SparkSession, run_id: int, source_file: str | None, error: Exception
) -> DataFrame:
    """A failed result for a run that could not be compared, with the first line of the error."""
    text = (str(error).strip().splitlines() or [""])[0][:500]
    facts = _result(_no_diffs(spark), run_id, source_file, 0, 0, False, "none")
    return facts.withColumns(
        {
            "row_counts_match": F.lit(False),
            "message": F.lit(f"Reconciliation error: {type(error).__name__}: {text}"),
        }
    )


def reconcile_runs(
    pairs: Sequence[RunPair],
    rtol: float = N.RTOL,
    atol: float = N.ATOL,
    parallel: int = 4,
    record: Callable[[DataFrame], None] | None = None,
    report_path: str | None = None,
    spark: SparkSession | None = None,
) -> DataFrame:
    """One result row per run. Runs have their own schemas, so each is its own set of jobs;
    ``parallel`` of them are submitted at a time. A run that raises has failed; the others go on.

    ``record`` is called once with the patches of all verdicts: ``HistoryStore.patch`` writes them
    into the history. ``spark`` defaults to the active session. No pairs give no rows.
    """
    spark = spark or SparkSession.getActiveSession()

    def one(pair: RunPair) -> DataFrame:
        try:
            source, target = pair.opened()
            result = reconcile(source, target, pair.run_id, pair.source_file, rtol, atol)
            return cut_lineage(result)
        except Exception as error:
            return cut_lineage(failed_result(spark, pair.run_id, pair.source_file, error))

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        results = list(pool.map(inheritable_thread_target(spark)(one), pairs))
    union = _result(_no_diffs(spark), 0, None, 0, 0, True, "none").limit(0)
    for result in results:
        union = union.unionByName(result)
    if record is not None:
        record(verdict_patches(union, report_path))
    return union


def recon_summary(
    results: DataFrame, compared_at: datetime | None = None, report_path: str | None = None
) -> DataFrame:
    """Totals over results; with the time of the comparison, where one is given, also the path of the
    reports and the runs themselves, by id.

    Each run was compared by jobs of its own, so a list of them is no larger than the work that was
    submitted.
    """
    totals = [
        F.count("*").alias("total_runs"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
    ]
    if compared_at is None:
        return results.agg(*totals)
    runs = F.array_sort(F.collect_list(F.struct(*RESULT_COLUMNS)))  # run_id comes first
    return results.agg(
        F.lit(compared_at.isoformat()).alias("compared_at"),
        F.lit(report_path).alias("report_path"),
        *totals,
        runs.alias("runs"),
    )


def executive_summary(results: DataFrame) -> DataFrame:
    """Run, label, status and row counts, by run id."""
    label = F.coalesce("source_file", F.concat(F.lit("run "), F.col("run_id").cast("string")))
    return results.select(
        "run_id",
        label.alias("sql_file"),
        F.when(F.col("passed"), "PASSED").otherwise("FAILED").alias("status"),
        "source_rows",
        "target_rows",
    ).orderBy("run_id")


# ---------------------------------------------------------------- gates and audits

# The platform pair that can be run on both sides.
SUPPORTED_PAIRS = (("teradata", "bigquery"),)


def prepare_status(
    runs: DataFrame,
    manifest: DataFrame,
    supported: Sequence[tuple[str, str]] = SUPPORTED_PAIRS,
) -> DataFrame:
    """What the export step made of every run: skipped, prepared (with row match) or failed."""
    exports = manifest.groupBy("run_id").agg(
        F.max(F.when(F.col("side") == "source", F.col("row_count"))).alias("source_rows"),
        F.max(F.when(F.col("side") == "target", F.col("row_count"))).alias("target_rows"),
    )
    pair = F.struct(
        F.lower(F.coalesce("source_type", F.lit(""))).alias("s"),
        F.lower(F.coalesce("target_type", F.lit(""))).alias("t"),
    )
    known = F.lit(False)
    for source_type, target_type in supported:
        known = known | ((pair["s"] == source_type) & (pair["t"] == target_type))

    def blank(column: str) -> Column:
        return F.coalesce(F.trim(F.col(column)), F.lit("")) == ""

    exported = F.col("source_rows").isNotNull() & F.col("target_rows").isNotNull()
    joined = runs.select(
        "run_id", "source_type", "target_type", "source_code", "generated_code"
    ).join(exports, "run_id", "left")
    status = (
        F.when(blank("source_code") | blank("generated_code"), "skipped")
        .when(~known, "skipped")
        .when(exported, "prepared")
        .otherwise("failed")
    )
    ready = F.col("recon_ind") == "prepared"
    return joined.withColumn("recon_ind", status).select(
        "run_id",
        "recon_ind",
        F.when(ready, F.col("source_rows")).alias("source_rows"),
        F.when(ready, F.col("target_rows")).alias("target_rows"),
        (ready & (F.col("source_rows") == F.col("target_rows"))).alias("passed"),
    ).withColumn("passed", F.coalesce("passed", F.lit(False)))


def audit_exports(runs: DataFrame, manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Problems of runs that claim both exports: lost file, row mismatch, stale verdict."""
    claimed = runs.filter(
        F.col("source_result_path").isNotNull() & F.col("target_result_path").isNotNull()
    ).select("run_id", "recon_passed")
    sides = manifest.groupBy("run_id").agg(
        F.max(F.col("side") == "source").alias("has_source"),
        F.max(F.col("side") == "target").alias("has_target"),
    )
    checked = results.select("run_id", "passed", "source_rows", "target_rows")
    joined = claimed.join(sides, "run_id", "left").join(checked, "run_id", "left")
    lost = ~F.coalesce(F.col("has_source") & F.col("has_target"), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(lost, "missing export"),
            F.when(~lost & (F.col("source_rows") != F.col("target_rows")), "row count mismatch"),
            F.when(~lost & (F.col("recon_passed") != F.col("passed")), "stale verdict"),
        )
    )
    return joined.select("run_id", F.explode(reasons).alias("reason"))
