"""A suite of named checks over tables, with outcomes as a table."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME_SCHEMA = (
    "test_id string, name string, category string, description string, status string, "
    "duration_ms double, message string, error string, skip_reason string"
)

# The order of categories, the skip reasons, and the pass message.
CATEGORIES = ("unit", "assets", "integration")
INTEGRATION_OFF = "integration tests disabled"
SLOW_OFF = "slow tests disabled"
MISSING = "missing env: "
ALL_PASSED = "All assertions passed."
ERROR_TAIL = 8


@dataclass(frozen=True)
class Check:
    """A named predicate on data, in one of four forms.

    ``violations`` is a function that returns a frame which must be empty. The others are about a
    ``table``, given by a function that opens it: ``violates`` is a condition that no row may meet,
    ``unique`` names columns whose values must not repeat, and ``refers`` maps columns to those of
    the table that ``known`` opens, where each of their values must exist (NULL refers to nothing).
    Checks on one table are compiled into one scan of it; they share the function that opens it.
    """

    test_id: str
    name: str
    category: str
    description: str
    violations: Callable[[SparkSession], DataFrame] | None = None
    requires: tuple[str, ...] = ()
    slow: bool = False
    table: Callable[[SparkSession], DataFrame] | None = None
    violates: Column | None = None
    unique: tuple[str, ...] = ()
    refers: tuple[tuple[str, str], ...] = ()
    known: Callable[[SparkSession], DataFrame] | None = None


def compiled(table: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    """One row: per condition how many rows meet it (n0, n1, ...) and one of them (r0, r1, ...)."""
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    flagged = table.select(row.alias("row"), *[c.alias(f"c{i}") for i, c in enumerate(conditions)])
    return flagged.agg(
        *[F.count_if(f"c{i}").alias(f"n{i}") for i in range(len(conditions))],
        *[F.any_value(F.when(F.col(f"c{i}"), F.col("row")), F.lit(True)).alias(f"r{i}") for i in range(len(conditions))],
    )


def repeated_values(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of ``columns`` that occur more than once, with their number of rows."""
    return table.groupBy(*columns).agg(F.count("*").alias("rows")).where("rows > 1")


def unknown_values(table: DataFrame, known: DataFrame, refers: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct values of the referring columns that ``known`` lacks: a value that very many rows
    share is one row before the two tables meet."""
    columns = [mine for mine, _ in refers]
    values = table.select(*columns).dropna().distinct()
    named = known.select(*[F.col(other).alias(mine) for mine, other in refers], F.lit(True).alias("__known"))
    # An anti join would be moved below the distinct, to all rows.
    met = values.join(named.distinct(), columns, "left")
    return met.filter(F.col("__known").isNull()).select(*columns)


def skip_reason(
    category: Column, slow: Column, missing: Column, integration: bool, include_slow: bool
) -> Column:
    """Category first, then speed, then prerequisites; NULL when the check runs."""
    return (
        F.when((category == "integration") & ~F.lit(integration), INTEGRATION_OFF)
        .when(slow & ~F.lit(include_slow), SLOW_OFF)
        .when(F.size(missing) > 0, F.concat(F.lit(MISSING), F.array_join(missing, ", ")))
    )


def _skipped(check: Check, integration: bool, slow: bool, available: Sequence[str]) -> str | None:
    if check.category == "integration" and not integration:
        return INTEGRATION_OFF
    if check.slow and not slow:
        return SLOW_OFF
    missing = [name for name in check.requires if name not in available]
    return MISSING + ", ".join(missing) if missing else None


def run_checks(
    spark: SparkSession,
    checks: Sequence[Check],
    integration: bool = False,
    slow: bool = False,
    available: Sequence[str] = (),
    parallel: int = 4,
) -> DataFrame:
    """One outcome row per check, in their order.

    Conditions on one table are one aggregation of it; if that fails, each of them runs alone, so an
    error stays with its check. Other checks are jobs of their own, ``parallel`` at a time, which stop
    at the first violating row.
    """
    skipped = {c.test_id: _skipped(c, integration, slow, available) for c in checks}
    running = [c for c in checks if skipped[c.test_id] is None]
    groups: dict[object, list[Check]] = {}
    for check in running:
        shared = check.violates is not None
        groups.setdefault(check.table if shared else check.test_id, []).append(check)

    def timed(group: Sequence[Check]) -> dict[str, tuple]:
        started = time.perf_counter()
        try:
            found = _violations(spark, group)
        except Exception as problem:
            if len(group) > 1:
                return {k: v for check in group for k, v in timed([check]).items()}
            spent = (time.perf_counter() - started) * 1000
            return {group[0].test_id: ("failed", spent, str(problem), traceback.format_exc())}
        spent = (time.perf_counter() - started) * 1000 / len(group)
        return {
            c.test_id: ("failed" if row else "passed", spent, f"violated by {row}" if row else ALL_PASSED, "")
            for c, row in zip(group, found, strict=True)
        }

    outcomes: dict[str, tuple] = {}
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for found in pool.map(inheritable_thread_target(spark)(timed), groups.values()):
            outcomes |= found
    rows = []
    for check in checks:
        facts = (check.test_id, check.name, check.category, check.description)
        reason = skipped[check.test_id]
        rows.append((*facts, *(("skipped", 0.0, "", "") if reason else outcomes[check.test_id]), reason or ""))
    return spark.createDataFrame(rows, OUTCOME_SCHEMA)


def _violations(spark: SparkSession, group: Sequence[Check]) -> list[dict | None]:
    """One violating row per check of a group, or None."""
    check = group[0]
    if check.violates is not None:
        found = compiled(check.table(spark), [c.violates for c in group]).first()
        return [found[f"r{i}"].asDict() if found[f"n{i}"] else None for i in range(len(group))]
    if check.unique:
        rows = repeated_values(check.table(spark), check.unique)
    elif check.refers:
        rows = unknown_values(check.table(spark), check.known(spark), check.refers)
    else:
        rows = check.violations(spark)
    first = rows.limit(1).collect()
    return [first[0].asDict() if first else None]


def suite_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("total"),
        *[
            F.count_if(F.col("status") == status).alias(status)
            for status in ("passed", "failed", "skipped")
        ],
    )


def category_counts(checks: DataFrame, order: Sequence[str] = CATEGORIES) -> DataFrame:
    """Checks per category in the fixed order; categories without checks are left out."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    counted = checks.filter(F.col("category").isin(*order)).groupBy("category")
    return counted.agg(F.count("*").alias("checks")).withColumn("place", place).orderBy("place")


def failure_digest(outcomes: DataFrame, tail: int = ERROR_TAIL) -> DataFrame:
    """Failed checks with the last lines of their error."""
    lines = F.split(F.regexp_replace("error", r"\n\z", ""), "\n")
    start = F.greatest(F.size(lines) - tail + 1, F.lit(1))
    last = F.when(F.coalesce("error", F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.slice(lines, start, tail)
    )
    return outcomes.filter(F.col("status") == "failed").select(
        "test_id", "name", "category", "message", last.alias("error_tail")
    )
