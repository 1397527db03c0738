"""Folding progress events into state. Events carry (run_id, seq, node, node_status, key, value).

Folds order by ``seq``, so an event that arrives late changes nothing that a newer one has set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The eight steps in order, and the keys that collect instead of replace.
STEPS = (
    "synthetic_data_generator",
    "environment_provisioner",
    "migration_intake",
    "migration_transpiler",
    "recon_preparer",
    "recon_comparator",
    "regression_runner",
    "documentation_generator",
)
APPENDED_KEYS = ("errors", "agent_log")
FEED_SIZE = 200


def replaced_values(patches: DataFrame) -> DataFrame:
    """The patches of keys that replace, a missing key included."""
    return patches.filter(~F.coalesce(F.col("key").isin(*APPENDED_KEYS), F.lit(False)))


def fold_state(patches: DataFrame) -> DataFrame:
    """Latest value per run and key, a missing key included. Pre-aggregated in every task."""
    return replaced_values(patches).groupBy("run_id", "key").agg(
        F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")
    )


def appended_entries(patches: DataFrame) -> DataFrame:
    """Entries of the collecting keys; ``seq`` is their order within a run. They stay rows: a list
    per run would gather a hot run in one task."""
    return patches.filter(F.col("key").isin(*APPENDED_KEYS)).select("run_id", "key", "seq", "value")


# What is kept per run: a bit for each completed step, and its newest (seq, step) in one number.
ACTIVITY = ("done", "newest")
_STEP_BITS = 4


def _of_step(values: Sequence[int], otherwise: int) -> Column:
    """The value of an event's node, by its place among the steps."""
    found = F.lit(otherwise)
    for step, value in zip(STEPS, values, strict=True):
        found = F.when(F.col("node") == step, F.lit(value)).otherwise(found)
    return found


def latest_activity(events: DataFrame) -> DataFrame:
    """Per run: the steps completed at all, and the latest ``seq`` with the place of its step.

    The latter fit into one BIGINT while ``seq`` is below 2**59, so the aggregation is one of two
    numbers that hashes, and its state is small; of equal ``seq`` the later step counts.
    """
    places = range(len(STEPS))
    done = F.when(F.col("node_status") == "complete", _of_step([1 << i for i in places], 0))
    place = _of_step(places, len(STEPS)).cast("bigint")
    return events.groupBy("run_id").agg(
        F.bit_or(F.coalesce(done, F.lit(0))).alias("done"),
        F.max(F.shiftleft(F.col("seq").cast("bigint"), _STEP_BITS).bitwiseOR(place)).alias("newest"),
    )


def step_states(events: DataFrame) -> DataFrame:
    """Eight rows per run: done when completed, active when it is the latest node, else pending."""
    return states_of(latest_activity(events))


def states_of(activity: DataFrame) -> DataFrame:
    """The eight rows per run from its activity."""
    active = F.col("newest").bitwiseAND(F.lit((1 << _STEP_BITS) - 1))
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(step).alias("node"),
                F.when(F.col("done").bitwiseAND(1 << i) != 0, "done")
                .when(active == i, "active")
                .otherwise("pending")
                .alias("state"),
            )
            for i, step in enumerate(STEPS)
        ]
    )
    return activity.select("run_id", F.inline(rows))


def recent_feed(events: DataFrame, size: int = FEED_SIZE) -> DataFrame:
    """Newest events per run, newest first; each input task keeps ``size`` per run at most."""
    newest = Window.partitionBy("run_id").orderBy(F.col("seq").desc())
    return events.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= size)


def step_durations(log: DataFrame, by: Sequence[str] = ("agent",)) -> DataFrame:
    """Time per agent, each entry rounded to a tenth of a millisecond first."""
    spent = F.round(F.col("duration_ms"), 1).cast("decimal(20,1)")
    return log.groupBy(*by).agg(
        F.count("*").alias("entries"),
        F.sum(spent).cast("double").alias("total_ms"),
        F.max(spent).cast("double").alias("longest_ms"),
    )
