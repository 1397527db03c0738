"""Reconciliation operators over the orders table and changed copies of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from migraspark.catalog import query
from migraspark.functions import normalize as N
from migraspark.operators import diagnose as D
from migraspark.operators import long_mode as L
from migraspark.operators import reconcile as R
from migraspark.operators.hash_tree import reconcile_ranges
from migraspark.operators.schema import column_catalog
from migraspark.plans import bindings as B
from migraspark.plans.verify import verify
from migraspark.session import scratch_path
from migraspark.sources.tables import scan

# ---------------------------------------------------------------- the two sides


def orders(spark, folder):
    return B.orders(spark, folder).withColumn("amount", F.col("amount").cast("double"))


def repriced(df):
    """Large cancelled orders cost 500 more, small orders lose their status."""
    dear = (F.col("status") == "CANCELLED") & (F.col("amount") > 400000)
    return df.withColumns(
        {
            "amount": F.when(dear, F.col("amount") + 500).otherwise(F.col("amount")),
            "status": F.when(F.col("amount") < 20000, "").otherwise(F.col("status")),
        }
    )


def moved(df):
    """Very large orders get another id."""
    far = F.col("order_id") + 1_000_000_000
    return df.withColumn(
        "order_id", F.when(F.col("amount") > 490000, far).otherwise(F.col("order_id"))
    )


def shortened(df):
    return df.filter(F.col("amount") <= 490000)


def unkeyed(df):
    """Coarse columns without a usable key, full of equal rows."""
    return df.select(
        F.trunc("order_date", "MM").alias("order_date"),
        (F.floor(F.col("amount") / 10000) * 10000).cast("double").alias("amount"),
        "status",
    )


def unkeyed_changed(df):
    raised = F.when(F.col("amount") > 400000, F.col("amount") + 50000)
    return unkeyed(df.withColumn("amount", F.coalesce(raised, F.col("amount"))))


SIDES_SQL = f"""WITH {B.ORDERS_SQL},
src AS (SELECT order_id, customer_id, order_date, CAST(amount AS DOUBLE) AS amount, status FROM ord),
repriced AS (
  SELECT order_id, customer_id, order_date,
         CASE WHEN status = 'CANCELLED' AND amount > 400000 THEN amount + 500 ELSE amount END AS amount,
         CASE WHEN amount < 20000 THEN '' ELSE status END AS status FROM src),
moved AS (
  SELECT CASE WHEN amount > 490000 THEN order_id + 1000000000 ELSE order_id END AS order_id,
         customer_id, order_date, amount, status FROM src),
shortened AS (SELECT * FROM src WHERE amount <= 490000),
unkeyed AS (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_date,
         CAST(FLOOR(amount / 10000) * 10000 AS DOUBLE) AS amount, status FROM src),
unkeyed_changed AS (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_date,
         CAST(FLOOR((CASE WHEN amount > 400000 THEN amount + 50000 ELSE amount END) / 10000) * 10000
              AS DOUBLE) AS amount, status FROM src)"""


# ---------------------------------------------------------------- counts, schemas, measures


@query(
    "rec_01_row_count_recon",
    f"""{SIDES_SQL}, {B.PRODUCTS_SQL}
SELECT 'orders' AS table_name, (SELECT COUNT(*) FROM src) AS source_rows,
  (SELECT COUNT(*) FROM shortened) AS target_rows,
  (SELECT COUNT(*) FROM src) = (SELECT COUNT(*) FROM shortened) AS matched
UNION ALL SELECT 'products', COUNT(*), COUNT(*), TRUE FROM prod
UNION ALL SELECT 'customers', COUNT(*), NULL, FALSE FROM customer""",
)
def rec_01(spark, folder):
    base, source = B.base_tables(spark, folder), orders(spark, folder)
    return R.row_counts(
        {"orders": source, "products": base.products, "customers": base.customers},
        {"orders": shortened(source), "products": base.products},
    )


@query(
    "rec_02_schema_match",
    f"""{SIDES_SQL}
SELECT position, source_column, source_values, target_column, target_values,
  source_column IS NOT DISTINCT FROM target_column AS matched
FROM (SELECT UNNEST([0,1,2,3,4]) AS position,
             UNNEST(['order_id','customer_id','order_date','amount','status']) AS source_column,
             UNNEST([COUNT(order_id), COUNT(customer_id), COUNT(order_date), COUNT(amount),
                     COUNT(status)]) AS source_values FROM src)
FULL JOIN (SELECT UNNEST([0,1,2,3]) AS position,
             UNNEST(['order_id','order_date','amount','state']) AS target_column,
             UNNEST([COUNT(order_id), COUNT(order_date), COUNT(amount),
                     COUNT(NULLIF(status, ''))]) AS target_values FROM repriced) USING (position)""",
)
def rec_02(spark, folder):
    source = orders(spark, folder)
    target = repriced(source).select(
        "order_id", "order_date", "amount", F.nullif("status", F.lit("")).alias("state")
    )
    return R.schema_table(source, target)


def _columns_sql(table: str, source: str, columns: list[str]) -> str:
    hints = "|".join(N.MEASURE_HINTS)
    parts = [
        f"SELECT '{table}' AS table_name, {i} AS position, '{c}' AS column_name, "
        f"COUNT({c}) AS present, regexp_matches('{c}', '{hints}') AS is_measure FROM {source}"
        for i, c in enumerate(columns)
    ]
    return " UNION ALL ".join(parts)


CUSTOMER_COLUMNS = [
    "customer_id", "first_name", "last_name", "email", "phone", "city", "country", "signup_date",
]
ORDER_COLUMNS = ["order_id", "customer_id", "order_date", "amount", "status"]
PRODUCT_COLUMNS = ["product_id", "product_name", "price"]


@query(
    "rec_03_measure_hint",
    f"""{B.BASE_SQL} {_columns_sql("customers", "cust", CUSTOMER_COLUMNS)}
UNION ALL {_columns_sql("orders", "ord", ORDER_COLUMNS)}
UNION ALL {_columns_sql("products", "prod", PRODUCT_COLUMNS)}""",
)
def rec_03(spark, folder):
    base = B.base_tables(spark, folder)._asdict()
    catalog = column_catalog(base).withColumn("is_measure", N.measure_flag(F.col("column_name")))
    return catalog.select("table_name", "position", "column_name", "present", "is_measure")


@query(
    "rec_04_infer_keys",
    """SELECT 'o_orderkey' AS candidate, COUNT(*) AS occurring, MAX(n) AS copies FROM
  (SELECT COUNT(*) AS n FROM orders GROUP BY o_orderkey)
UNION ALL SELECT 'l_orderkey, l_linenumber', COUNT(*), MAX(n) FROM
  (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def rec_04(spark, folder):
    def profile(table, keys):
        counted = scan(spark, folder, table).groupBy(*keys).agg(F.count("*").alias("n"))
        return counted.agg(
            F.count("*").alias("occurring"), F.max("n").alias("copies")
        ).select(F.lit(", ".join(keys)).alias("candidate"), "occurring", "copies")

    return profile("orders", ["o_orderkey"]).unionAll(
        profile("lineitem", ["l_orderkey", "l_linenumber"])
    )


def folded(df):
    """One order id for all rows; month and status tell them apart."""
    rows = unkeyed(df).groupBy("order_date", "status").agg(F.count("*").alias("order_count"))
    return rows.select(F.lit(1).alias("order_id"), "order_date", "status", "order_count")


def halved(df):
    """Two orders to an id."""
    return df.withColumn("order_id", F.expr("order_id div 2"))


def _chosen_sql(case: str, sides: tuple[str, str], candidates: list[str]) -> str:
    once = " ".join(
        "WHEN "
        + " AND ".join(
            f"(SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {side} GROUP BY {keys})) = 1" for side in sides
        )
        + f" THEN '{keys}'"
        for keys in candidates
    )
    counts = [f"(SELECT COUNT(*) FROM {side})" for side in sides]
    return (
        f"SELECT '{case}' AS case_name, CASE {once} END AS keys, "
        f"{counts[0]} AS source_rows, {counts[1]} AS target_rows"
    )


ORDER_KEYS = ["order_id", "order_id, customer_id, order_date, status"]


@query(
    "rec_04_chosen_keys",
    f"""{SIDES_SQL}, folded AS (SELECT 1 AS order_id, order_date, status, COUNT(*) AS order_count
  FROM unkeyed GROUP BY order_date, status),
halved AS (SELECT order_id // 2 AS order_id, customer_id, order_date, amount, status FROM src)
{_chosen_sql("unique", ("src", "repriced"), ORDER_KEYS)}
UNION ALL {_chosen_sql("fallback", ("folded", "folded"), ["order_id", "order_id, order_date, status"])}
UNION ALL {_chosen_sql("target repeats", ("src", "halved"), ORDER_KEYS)}
UNION ALL {_chosen_sql("none", ("unkeyed", "unkeyed_changed"), ["order_date, status"])}""",
)
def rec_04_chosen(spark, folder):
    source = orders(spark, folder)
    cases = {
        "unique": (source, repriced(source)),
        "fallback": (folded(source), folded(source)),
        "target repeats": (source, halved(source)),
        "none": (unkeyed(source), unkeyed_changed(source)),
    }
    rows = []
    for case, (left, right) in cases.items():
        found = R.infer_keys(R.normalize(left), R.normalize(right))
        keys = None if found.keys is None else ", ".join(found.keys)
        rows.append(
            spark.range(1).select(
                F.lit(case).alias("case_name"),
                F.lit(keys).cast("string").alias("keys"),
                F.lit(found.source_rows).cast("bigint").alias("source_rows"),
                F.lit(found.target_rows).cast("bigint").alias("target_rows"),
            )
        )
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


# ---------------------------------------------------------------- normalising


@query(
    "rec_05_normalize_numeric",
    """SELECT l_orderkey, l_partkey, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS l_done FROM lineitem""",
)
def rec_05(spark, folder):
    price = F.when(F.col("l_returnflag") == "R", float("nan")).otherwise(F.col("l_extendedprice"))
    lines = scan(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        price.alias("l_extendedprice"),
        (F.col("l_linestatus") == "F").alias("l_done"),
    )
    return R.normalize(lines)


@query(
    "rec_06_normalize_datetime",
    f"""{SIDES_SQL} SELECT order_id,
  CASE WHEN status = 'CANCELLED' THEN '' ELSE strftime(order_date, '%Y-%m-%d') || ' 00:00:00' END
    AS order_date, trim('month ' || status) AS sales_month,
  strftime(order_date, '%Y-%m-%d') || ' 00:00:00' AS placed FROM src""",
)
def rec_06(spark, folder):
    day = F.col("order_date")
    text = F.when(F.col("status") == "CANCELLED", "unknown").otherwise(day.cast("string"))
    return R.normalize(
        orders(spark, folder).select(
            "order_id",
            text.alias("order_date"),
            F.concat(F.lit("month "), F.col("status")).alias("sales_month"),
            day.alias("placed"),
        )
    )


@query(
    "rec_07_normalize_string",
    f"""{SIDES_SQL} SELECT order_id, CASE status WHEN 'COMPLETED' THEN 'COMPLETED'
  WHEN 'DELIVERED' THEN '' ELSE 'none' END AS status FROM src""",
)
def rec_07(spark, folder):
    status = F.col("status")
    text = (
        F.when(status == "COMPLETED", F.concat(F.lit("  "), status, F.lit(" ")))
        .when((status == "DELIVERED") & (F.col("amount") > 250000), "None")
        .when(status == "DELIVERED", "<NA>")
        .otherwise("none")
    )
    return R.normalize(orders(spark, folder).select("order_id", text.alias("status")))


# ---------------------------------------------------------------- alignment


@query(
    "rec_08_align_by_key",
    f"""{SIDES_SQL} SELECT COALESCE(src.order_id, moved.order_id) AS order_id,
  CASE WHEN moved.order_id IS NULL THEN 'left_only' WHEN src.order_id IS NULL THEN 'right_only'
       ELSE 'both' END AS side, src.amount AS source_amount, moved.amount AS target_amount
FROM src FULL JOIN moved ON src.order_id IS NOT DISTINCT FROM moved.order_id""",
)
def rec_08(spark, folder):
    source = orders(spark, folder)
    aligned = R.align_by_key(R.normalize(source), R.normalize(moved(source)), ["order_id"])
    return aligned.select(
        "at.order_id",
        "side",
        F.col("src.amount").alias("source_amount"),
        F.col("tgt.amount").alias("target_amount"),
    )


PAIRS_SQL = f"""{SIDES_SQL},
a AS (SELECT *, ROW_NUMBER() OVER (ORDER BY order_date NULLS LAST, amount NULLS LAST, status
                                   NULLS LAST) AS rn FROM unkeyed),
b AS (SELECT *, ROW_NUMBER() OVER (ORDER BY order_date NULLS LAST, amount NULLS LAST, status
                                   NULLS LAST) AS rn FROM unkeyed_changed)"""


@query(
    "rec_09_align_by_position",
    f"""{PAIRS_SQL} SELECT strftime(a.order_date, '%Y-%m-%d') || ' 00:00:00' AS order_date,
  a.amount AS source_amount, b.amount AS target_amount, a.status AS source_status,
  b.status AS target_status, MIN(a.rn) - 1 AS first_position, COUNT(*) AS pairs
FROM a JOIN b USING (rn) GROUP BY 1, 2, 3, 4, 5""",
)
def rec_09(spark, folder):
    source = orders(spark, folder)
    one, two = R.normalize(unkeyed(source)), R.normalize(unkeyed_changed(source))
    aligned = R.align_by_position(one, two, one.count())
    return aligned.groupBy(
        F.col("src.order_date").alias("order_date"),
        F.col("src.amount").alias("source_amount"),
        F.col("tgt.amount").alias("target_amount"),
        F.col("src.status").alias("source_status"),
        F.col("tgt.status").alias("target_status"),
    ).agg(F.min("at").alias("first_position"), F.sum("weight").alias("pairs"))


# ---------------------------------------------------------------- comparing


@query(
    "rec_10_compare_numeric",
    """WITH pairs AS (SELECT o_orderkey,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS x,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.00005
       WHEN o_orderpriority = '1-URGENT' THEN CAST('inf' AS DOUBLE)
       WHEN o_orderstatus = 'O' THEN o_totalprice * 1.001 END AS y FROM orders)
SELECT o_orderkey, COALESCE(x = y, FALSE)
  OR COALESCE(isfinite(y) AND ABS(x - y) <= 1e-4 + 1e-4 * ABS(y), FALSE)
  OR (x IS NULL AND y IS NULL) AS matched FROM pairs""",
)
def rec_10(spark, folder):
    price = F.col("o_totalprice")
    x = F.when(F.col("o_orderpriority") != "5-LOW", price)
    y = (
        F.when(F.col("o_orderstatus") == "F", price * 1.00005)
        .when(F.col("o_orderpriority") == "1-URGENT", float("inf"))
        .when(F.col("o_orderstatus") == "O", price * 1.001)
    )
    matched = N.numbers_match(x, y, N.RTOL, N.ATOL)
    return scan(spark, folder, "orders").select("o_orderkey", matched.alias("matched"))


@query(
    "rec_11_compare_string",
    """WITH pairs AS (SELECT c_custkey, c_mktsegment AS x,
  CASE WHEN c_acctbal < 0 THEN 'NaN ' WHEN c_acctbal < 3000 THEN ' ' || c_mktsegment
       WHEN c_acctbal < 6000 THEN lower(c_mktsegment) ELSE NULL END AS y,
  CASE WHEN c_acctbal >= 8000 THEN '<na>' ELSE c_mktsegment END AS z FROM customer),
folded AS (SELECT c_custkey, CASE WHEN lower(trim(x)) IN ('', 'nan', 'none', '<na>') THEN ''
    ELSE trim(x) END AS x,
  CASE WHEN y IS NULL OR lower(trim(y)) IN ('', 'nan', 'none', '<na>') THEN '' ELSE trim(y) END AS y,
  CASE WHEN lower(trim(z)) IN ('', 'nan', 'none', '<na>') THEN '' ELSE trim(z) END AS z FROM pairs)
SELECT c_custkey, x = y AS segment_matches, y = z AS copies_match FROM folded""",
)
def rec_11(spark, folder):
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    y = (
        F.when(balance < 0, "NaN ")
        .when(balance < 3000, F.concat(F.lit(" "), segment))
        .when(balance < 6000, F.lower(segment))
    )
    z = F.when(balance >= 8000, "<na>").otherwise(segment)
    return scan(spark, folder, "customer").select(
        "c_custkey",
        N.texts_match(segment, y).alias("segment_matches"),
        N.texts_match(y, z).alias("copies_match"),
    )


DIFFS_SQL = f"""{PAIRS_SQL}, joined AS (
  SELECT s.order_id, s.amount AS sa, t.amount AS ta, s.status AS ss, t.status AS ts
  FROM src s JOIN repriced t ON s.order_id = t.order_id),
amount_bad AS (SELECT * FROM joined WHERE NOT (sa = ta OR ABS(sa - ta) <= 1e-4 + 1e-4 * ABS(ta))),
status_bad AS (SELECT * FROM joined WHERE ss <> ts)"""


@query(
    "rec_12_column_diffs",
    f"""{DIFFS_SQL} SELECT * FROM (
SELECT 1 AS run_id, 'status' AS "column", COUNT(*) AS mismatch_count,
  CAST(NULL AS DOUBLE) AS max_numeric_diff,
  'key {{"order_id":' || MIN(order_id) || '}}: source=' || arg_min(ss, order_id) || ' target='
    || arg_min(ts, order_id) AS sample_mismatch FROM status_bad
UNION ALL SELECT 1, 'amount', COUNT(*), MAX(ABS(sa - ta)),
  'key {{"order_id":' || MIN(order_id) || '}}: source=' || arg_min(sa, order_id) || ' target='
    || arg_min(ta, order_id) FROM amount_bad) WHERE mismatch_count > 0""",
)
def rec_12(spark, folder):
    source = orders(spark, folder)
    result = R.reconcile(source, repriced(source), run_id=1)
    diffs = R.explode_diffs(result)
    return diffs.withColumn("run_id", F.col("run_id").cast("int"))


@query(
    "rec_13_verdict",
    f"""{DIFFS_SQL}, facts AS (SELECT (SELECT COUNT(*) FROM src) AS n,
  (SELECT COUNT(*) FROM amount_bad) AS a, (SELECT COUNT(*) FROM status_bad) AS s)
SELECT 7 AS run_id, 'orders.sql' AS source_file, a + s = 0 AS passed, n AS source_rows,
  n AS target_rows, TRUE AS columns_match, TRUE AS row_counts_match,
  'keys: order_id' AS alignment,
  CASE WHEN a + s = 0 THEN 'Reconciliation passed (' || n || ' rows, all columns match)'
       ELSE 'Data mismatch: ' || concat_ws(', ',
         CASE WHEN a > 0 THEN 'amount (' || a || ' mismatches)' END,
         CASE WHEN s > 0 THEN 'status (' || s || ' mismatches)' END)
  END AS message FROM facts""",
)
def rec_13(spark, folder):
    source = orders(spark, folder)
    result = R.reconcile(source, repriced(source), run_id=7, source_file="orders.sql")
    return result.withColumn("run_id", F.col("run_id").cast("int")).drop("column_diffs")


RUNS_SQL = f"""{PAIRS_SQL}, facts AS (SELECT (SELECT COUNT(*) FROM src) AS n,
  (SELECT COUNT(*) FROM shortened) AS short,
  (SELECT COUNT(*) FROM src WHERE amount > 490000) AS far,
  (SELECT COUNT(*) FROM a JOIN b USING (rn) WHERE a.order_date <> b.order_date) AS pd,
  (SELECT COUNT(*) FROM a JOIN b USING (rn)
    WHERE NOT (a.amount = b.amount OR ABS(a.amount - b.amount) <= 1e-4 + 1e-4 * ABS(b.amount))) AS pa,
  (SELECT COUNT(*) FROM a JOIN b USING (rn) WHERE a.status <> b.status) AS ps)
SELECT 1 AS run_id, 'same.sql' AS source_file, TRUE AS passed, n AS source_rows, n AS target_rows,
  TRUE AS columns_match, TRUE AS row_counts_match, 'keys: order_id' AS alignment,
  'Reconciliation passed (' || n || ' rows, all columns match)' AS message FROM facts
UNION ALL SELECT 2, 'short.sql', short = n, n, short, TRUE, short = n,
  CASE WHEN short = n THEN 'keys: order_id' ELSE 'none' END,
  CASE WHEN short = n THEN 'Reconciliation passed (' || n || ' rows, all columns match)'
       ELSE 'Row count mismatch: source=' || n || ', target=' || short END FROM facts
UNION ALL SELECT 3, 'moved.sql', far = 0, n, n, TRUE, TRUE, 'keys: order_id',
  CASE WHEN far = 0 THEN 'Reconciliation passed (' || n || ' rows, all columns match)'
       ELSE 'Data mismatch: (keys) (1 mismatches)' END FROM facts
UNION ALL SELECT 4, 'renamed.sql', FALSE, n, n, FALSE, TRUE, 'none',
  'Data mismatch: (schema) (1 mismatches)' FROM facts
UNION ALL SELECT 5, NULL, pd + pa + ps = 0, n, n, TRUE, TRUE, 'position',
  CASE WHEN pd + pa + ps = 0 THEN 'Reconciliation passed (' || n || ' rows, all columns match)'
  ELSE 'Data mismatch: ' || concat_ws(', ',
    CASE WHEN pd > 0 THEN 'order_date (' || pd || ' mismatches)' END,
    CASE WHEN pa > 0 THEN 'amount (' || pa || ' mismatches)' END,
    CASE WHEN ps > 0 THEN 'status (' || ps || ' mismatches)' END)
  END FROM facts"""


def _pairs(spark, folder):
    source = orders(spark, folder)
    return [
        R.RunPair(1, "same.sql", source, source.withColumn("amount", F.col("amount") * 1.00001)),
        R.RunPair(2, "short.sql", source, shortened(source)),
        R.RunPair(3, "moved.sql", source, moved(source)),
        R.RunPair(4, "renamed.sql", source, source.withColumnRenamed("status", "state")),
        R.RunPair(5, None, unkeyed(source), unkeyed_changed(source)),
    ]


@query(
    "rec_13_bucket_verdict",
    f"""WITH results AS ({RUNS_SQL}) SELECT * FROM results WHERE run_id < 4
UNION ALL SELECT 5, 'noise.sql', passed, source_rows, target_rows, columns_match, row_counts_match,
  alignment, message FROM results WHERE run_id = 1""",
)
def rec_13_ranges(spark, folder):
    source = orders(spark, folder)
    pairs = [p for p in _pairs(spark, folder) if p.run_id < 4]
    noisy = source.withColumn("amount", F.col("amount") * F.lit(1 + 1e-13))
    pairs.append(R.RunPair(5, "noise.sql", source, noisy))
    results = [reconcile_ranges(p.source, p.target, p.run_id, p.source_file) for p in pairs]
    union = results[0]
    for result in results[1:]:
        union = union.unionByName(result)
    return union.withColumn("run_id", F.col("run_id").cast("int")).drop("column_diffs", "rows_compared")


def nested(df):
    """Orders with a map, a list of structs and JSON in a VARIANT."""
    return df.select(
        "order_id",
        F.create_map(F.lit("total"), F.col("amount"), F.lit("half"), F.col("amount") / 2).alias("sums"),
        F.array(F.struct("status", "amount"), F.struct(F.lit("x").alias("status"), F.lit(1.0).alias("amount"))).alias("parts"),
        F.parse_json(F.concat(F.lit('{"a": 1, "s": "'), "status", F.lit('"}'))).alias("doc"),
    )


def nested_changed(df):
    """Map entries and JSON fields in another order, numbers nudged; dear orders with another status inside."""
    near, status = F.col("amount") * 1.00001, F.col("status")
    raised = F.when(F.col("amount") > 400000, F.lit("RAISED")).otherwise(status)
    return df.select(
        "order_id",
        F.create_map(F.lit("half"), near / 2, F.lit("total"), near).alias("sums"),
        F.array(
            F.struct(raised.alias("status"), near.alias("amount")), F.struct(F.lit("x").alias("status"), F.lit(1.0).alias("amount"))
        ).alias("parts"),
        F.parse_json(F.concat(F.lit('{"s": "'), "status", F.lit('", "a": 1}'))).alias("doc"),
    )


@query(
    "rec_13_nested_verdict",
    f"""{SIDES_SQL}, facts AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (amount > 400000) AS bad,
  MIN(order_id) FILTER (amount > 400000) AS first, arg_min(status, order_id) FILTER (amount > 400000) AS status FROM src)
SELECT bad = 0 AS passed, n AS source_rows, 'keys: order_id' AS alignment,
  CASE WHEN bad = 0 THEN 'Reconciliation passed (' || n || ' rows, all columns match)'
    ELSE 'Data mismatch: parts (' || bad || ' mismatches)' END AS message,
  CASE WHEN bad > 0 THEN 'key {{"order_id":' || first || '}} at parts[0].status: source=' || status || ' target=RAISED' END AS sample
FROM facts""",
)
def rec_13_nested(spark, folder):
    source = orders(spark, folder)
    result = R.reconcile(nested(source), nested_changed(source))
    sample = F.get("column_diffs", F.lit(0))["sample_mismatch"]
    return result.select("passed", "source_rows", "alignment", "message", sample.alias("sample"))


@query(
    "rec_14_missing_side",
    f"""WITH {B.RUNS_CTE}, {B.MANIFEST_CTE}
SELECT run_id, source_file, FALSE AS passed, CAST(0 AS BIGINT) AS source_rows,
  CAST(0 AS BIGINT) AS target_rows, FALSE AS columns_match, FALSE AS row_counts_match,
  '{R.MISSING_EXPORT}' AS message
FROM runs WHERE (SELECT COUNT(DISTINCT side) FROM manifest m WHERE m.run_id = runs.run_id) < 2""",
)
def rec_14(spark, folder):
    found = R.missing_sides(B.runs(spark, folder), B.manifest(spark, folder))
    return found.drop("alignment", "column_diffs")


@query("rec_15_compare_runs", RUNS_SQL)
def rec_15(spark, folder):
    results = R.reconcile_runs(_pairs(spark, folder))
    return results.withColumn("run_id", F.col("run_id").cast("int")).drop("column_diffs")


@query(
    "rec_15_long_mode",
    f"""{DIFFS_SQL}, cells AS (
SELECT 1 AS run_id, 'amount' AS "column", 0 AS source_only, 0 AS target_only,
  (SELECT COUNT(*) FROM amount_bad) AS mismatch_count,
  (SELECT MAX(ABS(sa - ta)) FROM amount_bad) AS max_numeric_diff
UNION ALL SELECT 1, 'status', 0, 0, (SELECT COUNT(*) FROM status_bad), NULL
UNION ALL SELECT 1, 'customer_id', 0, 0, 0, NULL UNION ALL SELECT 1, 'order_date', 0, 0, 0, NULL
UNION ALL SELECT 2, c, far, far, 0, NULL
  FROM (SELECT UNNEST(['amount', 'status', 'customer_id', 'order_date']) AS c),
       (SELECT COUNT(*) AS far FROM src WHERE amount > 490000)
UNION ALL SELECT 3, 'order_date', 0, 0, COUNT(*) FILTER (a.order_date <> b.order_date), NULL FROM a JOIN b USING (rn)
UNION ALL SELECT 3, 'status', 0, 0, COUNT(*) FILTER (a.status <> b.status), NULL FROM a JOIN b USING (rn)
UNION ALL SELECT 3, 'amount', 0, 0, COUNT(*) FILTER (NOT near), MAX(ABS(a.amount - b.amount)) FILTER (NOT near)
  FROM (SELECT a.amount, b.amount AS other, a.amount = b.amount OR ABS(a.amount - b.amount) <= 1e-4 + 1e-4 * ABS(b.amount) AS near
        FROM a JOIN b USING (rn)) a, LATERAL (SELECT a.other AS amount) b
UNION ALL SELECT 4, c, far, 0, CASE WHEN far = 0 THEN 0 END, NULL
  FROM (SELECT UNNEST(['amount', 'status', 'order_date']) AS c),
       (SELECT COUNT(*) AS far FROM src WHERE amount > 490000))
SELECT run_id, "column", source_only, target_only, mismatch_count, max_numeric_diff FROM cells""",
)
def rec_15_long(spark, folder):
    base = orders(spark, folder)
    source = R.normalize(base)
    changed = R.normalize(repriced(base)), R.normalize(moved(base))
    left = L.melt(source, 1, ["order_id"]).unionAll(L.melt(source, 2, ["order_id"]))
    right = L.melt(changed[0], 1, ["order_id"]).unionAll(L.melt(changed[1], 2, ["order_id"]))
    # A run whose rows repeat, and one that repeats rows and lost some.
    coarse, raised = R.normalize(unkeyed(base)), R.normalize(unkeyed_changed(base))
    short = R.normalize(unkeyed(shortened(base)))
    left = left.unionAll(L.melt(coarse, 3, ["status"])).unionAll(L.melt(coarse, 4, []))
    right = right.unionAll(L.melt(raised, 3, ["status"])).unionAll(L.melt(short, 4, []))
    return L.compare_melted(left, right).withColumn("run_id", F.col("run_id").cast("int"))


@query(
    "rec_16_recon_totals",
    f"""WITH results AS ({RUNS_SQL}) SELECT COUNT(*) AS total_runs,
  COUNT(*) FILTER (passed) AS passed, COUNT(*) FILTER (NOT passed) AS failed FROM results""",
)
def rec_16(spark, folder):
    return R.recon_summary(R.reconcile_runs(_pairs(spark, folder)))


@query(
    "rec_17_rule_diagnosis",
    f"""WITH results AS ({RUNS_SQL}), facts AS ({DIFFS_SQL}
  SELECT (SELECT COUNT(*) FROM amount_bad) AS a, (SELECT MAX(ABS(sa - ta)) FROM amount_bad) AS d,
         (SELECT COUNT(*) FROM status_bad) AS s,
         (SELECT 'key {{"order_id":' || MIN(order_id) || '}}: source=' || arg_min(sa, order_id) || ' target='
            || arg_min(ta, order_id) FROM amount_bad) AS x,
         (SELECT 'key {{"order_id":' || MIN(order_id) || '}}: source=' || arg_min(ss, order_id) || ' target='
            || arg_min(ts, order_id) FROM status_bad) AS y)
SELECT run_id, CASE WHEN passed THEN 'All ' || source_rows || ' {D.EQUIVALENT}'
    WHEN NOT row_counts_match THEN 'The source has ' || source_rows || ' rows, the target ' || target_rows || '. {D.ROWS_DIFFER}'
    WHEN NOT columns_match THEN '{D.SCHEMA_DIFFERS}'
    WHEN message LIKE '%(keys)%' THEN '{D.CAUSES[D.KEY_COLUMNS]}' ELSE '{D.UNKNOWN}' END AS explanation,
  CASE WHEN message LIKE '%(keys)%' THEN '(keys): 1 row(s) differ, for example Key alignment failed on [''order_id'']: '
    || far || ' source-only rows, ' || far || ' target-only rows' END AS detail
FROM results, (SELECT COUNT(*) AS far FROM orders WHERE o_totalprice > 490000) WHERE run_id < 5
UNION ALL SELECT 9, '{D.CAUSES[D.ROLLING_COLUMNS]}' || ' ' || '{D.CAUSES[D.SHARE_COLUMNS]}',
  'pct_of_total_revenue: ' || a || ' row(s) differ (max numeric delta: ' || printf('%.6g', d)
  || '), for example ' || x || ', rolling_3mo_revenue: ' || s || ' row(s) differ, for example ' || y FROM facts""",
)
def rec_17(spark, folder):
    source = orders(spark, folder)
    names = {"amount": "pct_of_total_revenue", "status": "rolling_3mo_revenue"}
    pairs = [pair for pair in _pairs(spark, folder) if pair.run_id < 5]
    one, two = (df.withColumnsRenamed(names) for df in (source, repriced(source)))
    found = D.diagnose(R.reconcile_runs([*pairs, R.RunPair(9, None, one, two)]))
    return found.select(
        F.col("run_id").cast("int").alias("run_id"),
        F.array_join("explanations", " ").alias("explanation"),
        F.nullif(F.array_join("details", ", "), F.lit("")).alias("detail"),
    )


@query(
    "rec_18_prepare_gate",
    f"""WITH {B.RUNS_CTE}, {B.MANIFEST_CTE}, exported AS (
  SELECT run_id, MAX(row_count) FILTER (side = 'source') AS s,
         MAX(row_count) FILTER (side = 'target') AS t FROM manifest GROUP BY 1),
gated AS (SELECT runs.run_id, s, t,
  CASE WHEN COALESCE(trim(source_code), '') = '' OR COALESCE(trim(generated_code), '') = ''
         THEN 'skipped'
       WHEN source_type <> 'teradata' OR target_type <> 'bigquery' THEN 'skipped'
       WHEN s IS NOT NULL AND t IS NOT NULL THEN 'prepared' ELSE 'failed' END AS recon_ind
  FROM runs LEFT JOIN exported USING (run_id))
SELECT run_id, recon_ind, CASE WHEN recon_ind = 'prepared' THEN s END AS source_rows,
  CASE WHEN recon_ind = 'prepared' THEN t END AS target_rows,
  COALESCE(recon_ind = 'prepared' AND s = t, FALSE) AS passed FROM gated""",
)
def rec_18(spark, folder):
    return R.prepare_status(B.runs(spark, folder), B.manifest(spark, folder))


@query(
    "rec_19_export_audit",
    f"""WITH {B.RUNS_CTE}, {B.MANIFEST_CTE}, exported AS (
  SELECT run_id, MAX(row_count) FILTER (side = 'source') AS s,
         MAX(row_count) FILTER (side = 'target') AS t FROM manifest GROUP BY 1),
claimed AS (SELECT run_id, recon_passed, s, t FROM runs LEFT JOIN exported USING (run_id)
  WHERE source_result_path IS NOT NULL AND target_result_path IS NOT NULL)
SELECT run_id, 'missing export' AS reason FROM claimed WHERE s IS NULL OR t IS NULL
UNION ALL SELECT run_id, 'row count mismatch' FROM claimed WHERE s <> t
UNION ALL SELECT run_id, 'stale verdict' FROM claimed WHERE recon_passed <> (s = t)""",
)
def rec_19(spark, folder):
    manifest = B.manifest(spark, folder)
    sides = manifest.groupBy("run_id").agg(
        F.max(F.when(F.col("side") == "source", F.col("row_count"))).alias("source_rows"),
        F.max(F.when(F.col("side") == "target", F.col("row_count"))).alias("target_rows"),
    )
    results = sides.withColumn("passed", F.col("source_rows") == F.col("target_rows"))
    return R.audit_exports(B.runs(spark, folder), manifest, results)


SOURCE_TEXT = """-- spend per customer
SELECT customer_id, COUNT(order_id) AS total_orders, CAST(SUM(amount) AS DOUBLE) AS lifetime_spend
FROM {orders} WHERE status IN ('COMPLETED', 'SHIPPED', 'DELIVERED')
GROUP BY customer_id;"""
TARGET_TEXT = """SELECT customer_id, COUNT(order_id) AS total_orders,
  CAST(SUM(amount) AS DOUBLE) AS lifetime_spend
FROM {orders} WHERE status NOT IN ('CANCELLED', 'REFUNDED') AND amount < 495000
GROUP BY customer_id"""

# A result with a repeated column name.
TWICE_TEXT = "SELECT order_id, amount, status, amount FROM {orders}"


@query(
    "rec_20_source_vs_target_run",
    f"""WITH {B.ORDERS_SQL}, a AS (SELECT customer_id, COUNT(*) AS n, SUM(amount) AS spend FROM ord
  WHERE status IN ('COMPLETED', 'DELIVERED') GROUP BY 1),
b AS (SELECT customer_id, COUNT(*) AS n, SUM(amount) AS spend FROM ord
  WHERE status <> 'CANCELLED' AND amount < 495000 GROUP BY 1),
facts AS (SELECT (SELECT COUNT(*) FROM a) AS sn, (SELECT COUNT(*) FROM b) AS tn,
  (SELECT COUNT(*) FROM a JOIN b USING (customer_id) WHERE ABS(a.n - b.n) > 1e-4 + 1e-4 * b.n) AS dn,
  (SELECT COUNT(*) FROM a JOIN b USING (customer_id)
    WHERE ABS(a.spend - b.spend) > 1e-4 + 1e-4 * b.spend) AS ds)
SELECT 'spend.sql' AS source_file, sn AS source_rows, tn AS target_rows,
  sn = tn AND dn = 0 AND ds = 0 AS passed,
  CASE WHEN sn = tn AND dn = 0 AND ds = 0 THEN 'passed' ELSE 'failed' END AS recon_ind,
  CASE WHEN sn <> tn THEN 'Row count mismatch: source=' || sn || ', target=' || tn
       WHEN dn + ds = 0 THEN 'Reconciliation passed (' || sn || ' rows, all columns match)'
       ELSE 'Data mismatch: ' || concat_ws(', ',
         CASE WHEN dn > 0 THEN 'total_orders (' || dn || ' mismatches)' END,
         CASE WHEN ds > 0 THEN 'lifetime_spend (' || ds || ' mismatches)' END) END AS message FROM facts
UNION ALL SELECT 'broken.sql', 0, 0, FALSE, 'failed', 'Reconciliation error: AnalysisException' FROM facts
UNION ALL SELECT 'twice.sql', n, n, TRUE, 'passed', 'Reconciliation passed (' || n || ' rows, all columns match)'
FROM (SELECT COUNT(*) AS n FROM ord)""",
)
def rec_20(spark, folder):
    tables = {"orders": B.orders(spark, folder)}
    base = scratch_path(spark, "verify")
    texts = {
        "spend.sql": (SOURCE_TEXT, TARGET_TEXT),
        "broken.sql": (SOURCE_TEXT, "SELECT no_such_column FROM {orders}"),
        "twice.sql": (TWICE_TEXT, TWICE_TEXT),
    }
    done = [
        verify(spark, run_id, *sides, tables, tables, base, source_file=name)
        for run_id, (name, sides) in enumerate(texts.items(), start=11)
    ]
    result, patch = done[0].result, done[0].patch
    for more in done[1:]:
        result, patch = result.unionByName(more.result), patch.unionByName(more.patch)
    error = F.regexp_extract("message", "^(Reconciliation error: [A-Za-z]+)", 1)
    return result.join(patch.select("run_id", "recon_ind"), "run_id").select(
        "source_file", "source_rows", "target_rows", "passed", "recon_ind",
        F.coalesce(F.nullif(error, F.lit("")), "message").alias("message"),
    )
