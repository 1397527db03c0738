"""Which tables SQL texts read, and the lineage that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base tables, and words that may follow FROM or JOIN without being a table.
BASE_TABLES = ("customers", "orders", "products", "ecommerce")
NOT_TABLES = ("select", "where", "group", "order", "inner", "left", "right", "outer")

_NAME = r"[a-zA-Z_][\w$]*"
_QUALIFIED = rf"""\s+(?:[`"]?{_NAME}[`"]?\.)*[`"]?({_NAME})"""
FROM_PATTERN = rf"(?i)\bFROM{_QUALIFIED}"
JOIN_PATTERN = rf"(?i)\bJOIN{_QUALIFIED}"
CTE_PATTERN = rf"(?i)(?:\bWITH|,)\s*({_NAME})\s+AS\s*\("

DASH = "—"


def table_refs(text: Column) -> Column:
    """Sorted distinct table names read by a text; schema qualifiers are dropped."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(FROM_PATTERN), 1),
        F.regexp_extract_all(text, F.lit(JOIN_PATTERN), 1),
    )
    names = F.transform(found, F.lower)
    kept = F.filter(names, lambda name: ~name.isin(*NOT_TABLES))
    return F.array_sort(F.array_distinct(F.coalesce(kept, F.array().cast("array<string>"))))


def cte_names(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CTE_PATTERN), 1), F.lower)


def is_base(name: Column, base: Sequence[str] = BASE_TABLES) -> Column:
    return F.lower(name).isin(*base)


def run_inputs(runs: DataFrame, base: Sequence[str] = BASE_TABLES) -> DataFrame:
    """Per run the tables either text reads, and which of them are base tables.

    Arrays are built inside the row from its own two texts; nothing is shuffled.
    """
    inputs = F.array_sort(
        F.array_union(table_refs(F.col("source_sql")), table_refs(F.col("target_sql")))
    )
    return runs.withColumn("input_tables", inputs).withColumn(
        "base_tables", F.filter("input_tables", lambda name: is_base(name, base))
    )


def table_usage(runs: DataFrame, base: Sequence[str] = BASE_TABLES) -> DataFrame:
    """Long form: run, table, and whether it is a base table or only a CTE of the text."""
    ctes = F.array_union(cte_names(F.col("source_sql")), cte_names(F.col("target_sql")))
    listed = run_inputs(runs, base).withColumn(
        "__ctes", F.coalesce(ctes, F.array().cast("array<string>"))
    )
    # For a plain explode Spark adds a filter that would search the texts a second time.
    exploded = listed.select(
        "run_id", "__ctes", F.explode_outer("input_tables").alias("table_name")
    ).filter(F.col("table_name").isNotNull())
    return exploded.select(
        "run_id",
        "table_name",
        is_base(F.col("table_name"), base).alias("is_base"),
        F.array_contains("__ctes", F.col("table_name")).alias("is_cte"),
    )


def _run_node() -> Column:
    return F.concat(F.lit("migration_run_"), F.col("run_id").cast("string"))


def lineage_edges(runs: DataFrame, source_schema: str, target_schema: str) -> DataFrame:
    """``schema.table -> run`` for every input and ``run -> target.query_result`` once per run."""
    return run_inputs(runs).select(
        "run_id", F.inline_outer(_edges(source_schema, target_schema, ("src", "dst", "via")))
    )


def _edges(source_schema: str, target_schema: str, names: tuple[str, str, str]) -> Column:
    """All edges of a run as one array, so the texts are searched once."""
    start, end, via = names
    into = F.transform(
        F.col("input_tables"),
        lambda name: F.struct(
            F.concat(F.lit(f"{source_schema}."), name).alias(start),
            _run_node().alias(end),
            F.col("source_file").alias(via),
        ),
    )
    out = F.struct(
        _run_node().alias(start),
        F.lit(f"{target_schema}.query_result").alias(end),
        F.lit("generated_sql").alias(via),
    )
    return F.concat(into, F.array(out))


def usage_matrix(runs: DataFrame, base: Sequence[str] = BASE_TABLES) -> DataFrame:
    """Base tables and the runs that use them, one row per use; an unused table has one row with a
    dash. A list per table would gather a third of all runs in one task, rows do not."""
    uses = table_usage(runs, base).filter("is_base").select("table_name", "run_id")
    used = uses.select("table_name").distinct()
    every = runs.sparkSession.createDataFrame([(name,) for name in base], "table_name string")
    unused = every.join(used, "table_name", "left_anti").select(
        "table_name", F.lit(None).cast("bigint").alias("run_id")
    )
    rows = uses.unionByName(unused)
    shown = F.coalesce(F.col("run_id").cast("string"), F.lit(DASH))
    return rows.withColumn("used_by", shown)


def overview_rows(runs: DataFrame, shown: int = 4) -> DataFrame:
    """Run, its label and its first input tables with a mark for more."""
    tables = F.col("input_tables")
    head = F.array_join(F.slice(tables, 1, shown), ", ")
    text = F.when(F.size(tables) > shown, F.concat(head, F.lit(", …"))).otherwise(head)
    return run_inputs(runs).select(
        "run_id",
        F.coalesce("source_file", F.lit("-")).alias("source_file"),
        F.coalesce(F.nullif(text, F.lit("")), F.lit("-")).alias("tables_read"),
    )


def lineage_documents(runs: DataFrame, source_schema: str, target_schema: str) -> DataFrame:
    """One JSON document per run; written as JSON lines they are the whole lineage document."""
    document = F.struct(
        "run_id",
        "source_file",
        F.lit(source_schema).alias("source_schema"),
        F.lit(target_schema).alias("target_schema"),
        "input_tables",
        "base_tables",
        _edges(source_schema, target_schema, ("from", "to", "via")).alias("edges"),
    )
    return run_inputs(runs).select("run_id", F.to_json(document).alias("document"))
