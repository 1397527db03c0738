"""Schema reports and conforming rules over loosely typed copies of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.catalog import query
from migraspark.catalog.generate import (
    MAP_SLOTS_SQL,
    ROWS_SQL,
    SEED,
    TABLE,
    int_sql,
    spine,
    u_sql,
)
from migraspark.operators import conform as C
from migraspark.operators import generate as G
from migraspark.operators import schema as S
from migraspark.operators.generate import ColumnGen, TableSpec
from migraspark.plans.bindings import base_tables
from migraspark.sources.tables import scan


def _field(name: str, data_type: str) -> T.StructType:
    return T.StructType.fromDDL(f"{name} {data_type}")


# ---------------------------------------------------------------- schemas

DECLARED = "o_orderkey BIGINT NOT NULL, o_custkey BIGINT NOT NULL, o_note STRING, o_state STRING"


@query(
    "sch_01_table_spec",
    """WITH seen AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END
  AS o_custkey, NULLIF(o_orderstatus, 'P') AS o_state FROM orders)
SELECT 0 AS position, 'o_orderkey' AS column_name, 'bigint' AS type, FALSE AS nullable,
  TRUE AS "exists", COUNT(*) AS rows, COUNT(o_orderkey) AS present,
  COUNT(*) - COUNT(o_orderkey) AS violations FROM seen
UNION ALL SELECT 1, 'o_custkey', 'bigint', FALSE, TRUE, COUNT(*), COUNT(o_custkey),
  COUNT(*) - COUNT(o_custkey) FROM seen
UNION ALL SELECT 2, 'o_note', 'string', TRUE, FALSE, COUNT(*), 0, 0 FROM seen
UNION ALL SELECT 3, 'o_state', 'string', TRUE, TRUE, COUNT(*), COUNT(o_state), 0 FROM seen""",
)
def sch_01(spark, folder):
    spec = TableSpec.from_ddl_fields("orders", DECLARED)
    seen = scan(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("o_custkey"),
        F.nullif("o_orderstatus", F.lit("P")).alias("o_state"),
    )
    return S.spec_report(seen, spec.schema)


@query(
    "sch_02_nested_spec",
    f"""WITH sized AS (SELECT {int_sql("items", 1, 6, "length")} AS items,
  {u_sql("items", "null")} AS u FROM {ROWS_SQL}),
pairs AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT row_id, key FROM ({MAP_SLOTS_SQL})))
SELECT 'buyer.name' AS path, 'string' AS type, COUNT(*) AS present FROM orders
UNION ALL SELECT 'buyer.age', 'bigint', COUNT(*) FROM orders
UNION ALL SELECT 'items[].quantity', 'bigint', CAST(SUM(items) AS BIGINT) FROM sized WHERE u >= 0.25
UNION ALL SELECT 'items[].city', 'string', CAST(SUM(items) AS BIGINT) FROM sized WHERE u >= 0.25
UNION ALL SELECT 'notes{{key}}', 'string', n FROM pairs
UNION ALL SELECT 'notes{{value}}', 'string', n FROM pairs""",
)
def sch_02(spark, folder):
    spec = TableSpec.from_ddl_fields(
        TABLE,
        "buyer STRUCT<name: STRING, age: BIGINT> NOT NULL, "
        "items ARRAY<STRUCT<quantity: BIGINT, city: STRING>>, notes MAP<STRING, STRING> NOT NULL",
        {"items": ColumnGen(null_rate=0.25), "notes": ColumnGen(size_range=(2, 9))},
    )
    made = G.generate(spec, spine(spark, folder), SEED, as_json=False, portable=True)
    return S.nested_report(made, spec.schema)


@query(
    "sch_03_schema_catalog",
    """SELECT 'customers' AS table_name, COUNT(*) AS rows, 8 AS column_count,
  'customer_id, first_name, last_name, email, phone, city, country, signup_date' AS columns
FROM customer UNION ALL SELECT 'orders', COUNT(*), 5,
  'order_id, customer_id, order_date, amount, status' FROM orders
UNION ALL SELECT 'lineitem', COUNT(*), 11, 'l_orderkey, l_partkey, l_suppkey, l_linenumber, '
  || 'l_quantity, l_extendedprice, l_discount, l_tax, …' FROM lineitem""",
)
def sch_03(spark, folder):
    base = base_tables(spark, folder)
    lines = scan(spark, folder, "lineitem")
    return S.schema_catalog(
        {"customers": base.customers, "orders": base.orders, "lineitem": lines}
    )


# ---------------------------------------------------------------- conforming

MESSY_NUMBER_SQL = """CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR) || '.0'
  WHEN 'O' THEN ' ' || CAST(o_orderkey AS VARCHAR) ELSE 'n/a' END"""


def _messy_number():
    return (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), F.col("o_orderkey").cast("string")))
        .otherwise("n/a")
    )


@query(
    "cnf_01_conform_integer",
    f"""SELECT o_orderkey, CAST(TRY_CAST(trim({MESSY_NUMBER_SQL}) AS DOUBLE) AS BIGINT) AS quantity
FROM orders""",
)
def cnf_01(spark, folder):
    loose = scan(spark, folder, "orders").select("o_orderkey", _messy_number().alias("quantity"))
    return C.conform(loose, _field("quantity", "BIGINT"))


MESSY_TIME_SQL = """CASE event_type WHEN 'error' THEN 'not a date' WHEN 'view' THEN ''
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END"""


def _messy_time():
    return (
        F.when(F.col("event_type") == "error", "not a date")
        .when(F.col("event_type") == "view", "")
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )


@query(
    "cnf_02_conform_date",
    f"SELECT event_id, CAST(TRY_CAST({MESSY_TIME_SQL} AS TIMESTAMP) AS DATE) AS happened FROM events",
)
def cnf_02(spark, folder):
    loose = scan(spark, folder, "events").select("event_id", _messy_time().alias("happened"))
    return C.conform(loose, _field("happened", "DATE"))


@query(
    "cnf_03_conform_timestamp",
    f"""SELECT event_id, date_trunc('second', TRY_CAST({MESSY_TIME_SQL} AS TIMESTAMP)) AS happened
FROM events""",
)
def cnf_03(spark, folder):
    loose = scan(spark, folder, "events").select("event_id", _messy_time().alias("happened"))
    return C.conform(loose, _field("happened", "TIMESTAMP_NTZ"))


@query(
    "cnf_04_conform_numeric",
    """SELECT event_id, CAST(CAST(CASE WHEN event_type <> 'error' THEN value END AS DECIMAL(20,2))
  AS DOUBLE) AS price FROM events""",
)
def cnf_04(spark, folder):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    loose = scan(spark, folder, "events").select("event_id", text.alias("price"))
    conformed = C.conform(loose, _field("price", "DECIMAL(20,2)"))
    return conformed.withColumn("price", F.col("price").cast("double"))


@query(
    "cnf_05_conform_string",
    """SELECT doc_id, substr(text, 1, 20) AS title, lang, text AS body FROM documents""",
)
def cnf_05(spark, folder):
    texts = scan(spark, folder, "documents").select(
        "doc_id", F.col("text").alias("title"), "lang", F.col("text").alias("body")
    )
    return C.conform(texts, T.StructType.fromDDL("title VARCHAR(20), lang VARCHAR(10), body STRING"))


@query(
    "cnf_06_conform_by_name",
    f"""SELECT o_orderkey AS order_id,
  CAST(TRY_CAST(trim({MESSY_NUMBER_SQL}) AS DOUBLE) AS BIGINT) AS customer_id,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS order_date,
  CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 7 HOUR AS shipped_at,
  o_orderstatus AS note FROM orders""",
)
def cnf_06(spark, folder):
    day = F.col("o_orderdate").cast("date").cast("string")
    loose = scan(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        _messy_number().alias("customer_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "?").otherwise(day).alias("order_date"),
        F.concat(day, F.lit(" 07:00:00.9")).alias("shipped_at"),
        F.col("o_orderstatus").alias("note"),
    )
    return C.conform_by_name(loose)


@query(
    "cnf_07_conform_projection",
    """SELECT p_partkey, substr(p_name, 1, 4) AS p_name, CAST(p_size AS BIGINT) AS p_size, p_type
FROM part""",
)
def cnf_07(spark, folder):
    loose = scan(spark, folder, "part").select(
        "p_partkey", "p_name", F.col("p_size").cast("string").alias("p_size"), "p_type"
    )
    spec = T.StructType.fromDDL("p_size BIGINT, p_name VARCHAR(4), absent DATE")
    return C.conform(loose, spec)


@query(
    "cnf_08_null_canonical",
    """SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS value,
  NULLIF(event_type, 'view') AS event_type FROM events""",
)
def cnf_08(spark, folder):
    value = F.when(F.col("event_type") == "click", float("nan")).otherwise(F.col("value"))
    loose = scan(spark, folder, "events").select(
        "event_id", value.alias("value"), F.nullif("event_type", F.lit("view")).alias("event_type")
    )
    return C.null_canonical(loose)
