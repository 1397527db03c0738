"""Logical tables of the workload, bound to the TPC-H-like test tables.

The workload reads ``customers``, ``orders`` and ``products``. A user passes their own frames with
those columns; this module builds them from the test tables, once as DataFrames and once as the
SQL text that the cross-check runs elsewhere.
"""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from migraspark.session import prepare_session
from migraspark.sources.tables import scan

AS_OF = date(2001, 8, 2)


class BaseTables(NamedTuple):
    customers: DataFrame
    orders: DataFrame
    products: DataFrame


def customers(spark: SparkSession, folder: str) -> DataFrame:
    nation = scan(spark, folder, "nation").select("n_nationkey", "n_name")
    days = (F.col("c_custkey") * 37 % 1200).cast("int")
    return (
        scan(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("first_name"),
            F.col("c_mktsegment").alias("last_name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("555-"), F.col("c_custkey").cast("string")).alias("phone"),
            F.col("c_mktsegment").alias("city"),
            F.col("n_name").alias("country"),
            F.date_add(F.lit(date(1995, 1, 1)), days).alias("signup_date"),
        )
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "F", "COMPLETED")
        .when(F.col("o_orderstatus") == "O", "DELIVERED")
        .otherwise("CANCELLED")
    )
    return scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
        status.alias("status"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(12,2)")
    factor = (1 + F.col("p_partkey") % 500).cast("decimal(5,0)")
    return scan(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        (price * factor).cast("decimal(12,2)").alias("price"),
    )


def base_tables(spark: SparkSession, folder: str) -> BaseTables:
    prepare_session(spark)
    return BaseTables(
        customers(spark, folder), orders(spark, folder), products(spark, folder)
    )


CUSTOMERS_SQL = """cust AS (
  SELECT c_custkey AS customer_id, c_name AS first_name, c_mktsegment AS last_name,
         lower(c_name) || '@example.com' AS email, '555-' || c_custkey AS phone,
         c_mktsegment AS city, n_name AS country,
         DATE '1995-01-01' + CAST(c_custkey * 37 % 1200 AS INTEGER) AS signup_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORDERS_SQL = """ord AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
         CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'DELIVERED'
              ELSE 'CANCELLED' END AS status
  FROM orders)"""

PRODUCTS_SQL = """prod AS (
  SELECT p_partkey AS product_id, p_name AS product_name,
         CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (1 + p_partkey % 500) AS DECIMAL(12,2)) AS price
  FROM part)"""

BASE_SQL = f"WITH {CUSTOMERS_SQL},\n{ORDERS_SQL},\n{PRODUCTS_SQL}"


# ---------------------------------------------------------------- run history, from the same tables
#
# Each order stands for one migration run, each order line for an export of one side, and each
# event for a later patch of a run. The expressions below are valid in Spark SQL and in the
# cross-check, so both sides read the same definition.

_SOURCE_CODE = (
    "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN '  ' "
    "ELSE 'SELECT customer_id FROM orders WHERE amount > ' || CAST(o_custkey AS STRING) END"
)
_GENERATED_CODE = (
    "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN NULL "
    "ELSE 'SELECT o.customer_id FROM orders o JOIN customers c ON o.customer_id = c.customer_id' END"
)
_RECON_IND = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'passed' WHEN '2-HIGH' THEN 'failed' "
    "WHEN '3-MEDIUM' THEN 'prepared' WHEN '4-NOT SPECIFIED' THEN 'skipped' END"
)

RUN_EXPRESSIONS = {
    "run_id": "o_orderkey + 1",
    "request_id": "'req_' || CAST(o_orderkey AS STRING)",
    "source_file": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL "
    "ELSE 'query_' || CAST(o_custkey AS STRING) || '.sql' END",
    "target_file": "'target_' || CAST(o_custkey AS STRING) || '.sql'",
    "target_file_path": "'out/target_' || CAST(o_custkey AS STRING) || '.sql'",
    "source_type": "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' "
    "THEN 'oracle' ELSE 'teradata' END",
    "target_type": "CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' "
    "THEN 'snowflake' ELSE 'bigquery' END",
    "output_format": "'target_sql_only'",
    "source_code": _SOURCE_CODE,
    "generated_code": _GENERATED_CODE,
    "status": "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' ELSE 'failed' END",
    "success": "o_orderstatus = 'F'",
    "error_message": "CASE WHEN o_orderstatus = 'P' THEN 'unexpected token' END",
    "error_type": "CASE WHEN o_orderstatus = 'P' THEN 'ParseError' END",
    "validation_passed": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus <> 'P' END",
    "validation_feedback": "CAST(NULL AS STRING)",
    "code_length_original": f"CAST(length({_SOURCE_CODE}) AS INT)",
    "code_length_generated": f"CAST(length({_GENERATED_CODE}) AS INT)",
    "processing_time_ms": "o_totalprice",
    "warnings": "CAST(NULL AS STRING)",
    "recon_ind": _RECON_IND,
    "source_schema": "'legacy'",
    "target_schema": "'modern'",
    "source_result_path": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') "
    "THEN 'exports/source/' || CAST(o_orderkey + 1 AS STRING) END",
    "target_result_path": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') "
    "THEN 'exports/target/' || CAST(o_orderkey + 1 AS STRING) END",
    "recon_passed": "CASE o_orderpriority WHEN '1-URGENT' THEN TRUE WHEN '2-HIGH' THEN FALSE END",
    "recon_result_path": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'report.md' END",
    "created_at": "o_orderdate",
}

MANIFEST_EXPRESSIONS = {
    "run_id": "l_orderkey + 1",
    "side": "CASE WHEN l_returnflag = 'N' THEN 'target' ELSE 'source' END",
    "row_count": "COUNT(*)",
}

PATCH_EXPRESSIONS = {
    "run_id": "user_id + 1",
    "seq": "event_id",
    "recon_ind": "CASE event_type WHEN 'purchase' THEN 'passed' WHEN 'error' THEN 'failed' END",
    "source_schema": "CAST(NULL AS STRING)",
    "target_schema": "CASE WHEN event_type = 'signup' THEN 'modern_v2' END",
    "source_result_path": "CASE WHEN event_type = 'view' "
    "THEN 'exports/source/' || CAST(event_id AS STRING) END",
    "target_result_path": "CASE WHEN event_type = 'click' "
    "THEN 'exports/target/' || CAST(event_id AS STRING) END",
    "recon_passed": "CASE event_type WHEN 'purchase' THEN TRUE WHEN 'error' THEN FALSE END",
    "recon_result_path": "CASE WHEN event_type IN ('purchase', 'error') "
    "THEN 'reports/' || CAST(event_id AS STRING) END",
}


def _listed(expressions: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in expressions.items()]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    prepare_session(spark)
    return scan(spark, folder, "orders").selectExpr(*_listed(RUN_EXPRESSIONS))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    lines = scan(spark, folder, "lineitem").selectExpr(*_listed(MANIFEST_EXPRESSIONS)[:2])
    return lines.groupBy("run_id", "side").agg(F.count("*").alias("row_count"))


def patches(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "events").selectExpr(*_listed(PATCH_EXPRESSIONS))


RUNS_CTE = f"runs AS (SELECT {', '.join(_listed(RUN_EXPRESSIONS))} FROM orders)"
MANIFEST_CTE = (
    f"manifest AS (SELECT {', '.join(_listed(MANIFEST_EXPRESSIONS))} FROM lineitem GROUP BY 1, 2)"
)
PATCHES_CTE = f"patches AS (SELECT {', '.join(_listed(PATCH_EXPRESSIONS))} FROM events)"
