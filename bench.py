"""Time the headline queries and print one JSON line.

Every query runs twice: ``queries`` holds the second run, when its code is compiled, and
``first_run`` the first one in the session.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, to time others
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession

from migraspark.catalog import load

HEADLINES = (
    "wq_1_customer_lifetime",
    "wq_2_product_price_match",
    "wq_3_lapsed_high_value",
    "wq_4_tier_contribution",
    "wq_5_regional_monthly",
    "wq_6_cohort_retention",
    "joi_03_band_join",
    "win_01_rank",
    "rec_09_align_by_position",
    "rec_13_verdict",
    "rec_15_compare_runs",
    "rec_15_long_mode",
    "rec_20_source_vs_target_run",
    "run_04_patch_run",
    "gen_12_provider_values",
    "gen_20_generate_table",
    "gen_20_generate_nested",
    "cnf_06_conform_by_name",
    "lin_04_lineage_edges",
    "txt_04_clean_sql",
    "prg_02_step_states",
    "str_01_stream_state",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("migraspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    queries = load()[0]
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINES
    run(spark.read.parquet(f"{folder}/orders.parquet"))  # start the executors
    first, seconds = {}, {}
    for timings in (first, seconds):
        for name in names:
            started = time.perf_counter()
            run(queries[name](spark, folder))
            timings[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
