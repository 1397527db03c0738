"""The relational operators of the workload, each as a small query over whole tables."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from migraspark.catalog import query
from migraspark.catalog.workload import (
    REGIONAL_CTES_SQL,
    TIER_BOUNDS,
    TIER_CTES_SQL,
    tier_sql,
)
from migraspark.operators import ordered, skew
from migraspark.operators.ordered import asc, desc
from migraspark.operators.reconcile import full_outer
from migraspark.plans import workload
from migraspark.plans.bindings import AS_OF, BASE_SQL, base_tables
from migraspark.plans.workload import ratio
from migraspark.sources.tables import scan

# ---------------------------------------------------------------- projection


@query(
    "prj_01_project_alias",
    f"""{BASE_SQL}, settled AS (
  SELECT customer_id AS buyer, order_id AS receipt, amount AS paid FROM ord
  WHERE status IN ('COMPLETED', 'SHIPPED', 'DELIVERED')),
totals AS (SELECT buyer, COUNT(receipt) AS receipts, SUM(paid) AS paid FROM settled GROUP BY buyer)
SELECT buyer AS customer_id, receipts AS total_orders, CAST(paid AS DOUBLE) AS lifetime_spend
FROM totals""",
)
def prj_01(spark, folder):
    settled = (
        base_tables(spark, folder)
        .orders.filter(F.col("status").isin(*workload.SETTLED))
        .select(
            F.col("customer_id").alias("buyer"),
            F.col("order_id").alias("receipt"),
            F.col("amount").alias("paid"),
        )
    )
    totals = settled.groupBy("buyer").agg(
        F.count("receipt").alias("receipts"), F.sum("paid").alias("paid")
    )
    return totals.select(
        F.col("buyer").alias("customer_id"),
        F.col("receipts").alias("total_orders"),
        F.col("paid").cast("double").alias("lifetime_spend"),
    )


@query(
    "prj_02_case_band",
    f"""{BASE_SQL}, priced AS (
  SELECT product_id, NULLIF(price, 900) AS price FROM prod)
SELECT product_id, {tier_sql("price")} AS price_tier FROM priced""",
)
def prj_02(spark, folder):
    products = base_tables(spark, folder).products
    price = F.nullif("price", F.lit(Decimal("900")))
    return products.select(
        "product_id", workload.price_tier(price, TIER_BOUNDS).alias("price_tier")
    )


@query(
    "prj_03_concat_null",
    f"""{BASE_SQL} SELECT customer_id,
  first_name || ' ' || NULLIF(last_name, 'BUILDING') AS full_name FROM cust""",
)
def prj_03(spark, folder):
    customers = base_tables(spark, folder).customers.withColumn(
        "last_name", F.nullif("last_name", F.lit("BUILDING"))
    )
    return customers.select("customer_id", workload.full_name().alias("full_name"))


@query(
    "prj_04_arithmetic",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  ABS(l_discount - l_tax) AS gap, l_quantity * 2 AS doubled,
  ROUND(l_extendedprice / NULLIF(l_quantity - 1, 0), 8) AS per_unit,
  ROUND(l_tax / NULLIF(l_discount, 0) * 100, 6) AS tax_pct FROM lineitem""",
)
def prj_04(spark, folder):
    per_unit = F.try_divide("l_extendedprice", F.col("l_quantity") - 1)
    return scan(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        (F.col("l_quantity") * 2).alias("doubled"),
        F.round(per_unit, 8).alias("per_unit"),
        F.round(F.try_divide("l_tax", "l_discount") * 100, 6).alias("tax_pct"),
    )


@query(
    "prj_05_cast_decimal",
    """SELECT o_orderkey, CAST(o_custkey AS DECIMAL(18,4)) AS exact_key,
  CAST(CAST(o_totalprice AS DECIMAL(18,4)) / 8 AS DOUBLE) AS eighth,
  CAST(o_custkey AS INTEGER) AS small_key FROM orders""",
)
def prj_05(spark, folder):
    return scan(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("decimal(18,4)").alias("exact_key"),
        (F.col("o_totalprice").cast("decimal(18,4)").cast("double") / 8).alias("eighth"),
        F.col("o_custkey").cast("int").alias("small_key"),
    )


@query(
    "prj_06_int_div",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_partkey * 4 // l_linenumber + 1 AS bucket FROM lineitem""",
)
def prj_06(spark, folder):
    bucket = F.call_function("div", F.col("l_partkey") * 4, F.col("l_linenumber")) + 1
    return scan(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", bucket.alias("bucket")
    )


# ---------------------------------------------------------------- dates


@query(
    "dat_01_month_trunc",
    f"""{BASE_SQL} SELECT order_id, CAST(date_trunc('month', order_date) AS DATE) AS sales_month
FROM ord""",
)
def dat_01(spark, folder):
    orders = base_tables(spark, folder).orders
    return orders.select("order_id", F.trunc("order_date", "MM").alias("sales_month"))


@query(
    "dat_02_add_months_pred",
    f"""{BASE_SQL} SELECT order_id, order_date FROM ord
WHERE order_date >= CAST(DATE '{AS_OF}' - INTERVAL 24 MONTH AS DATE)""",
)
def dat_02(spark, folder):
    since = F.add_months(F.lit(AS_OF), -24)
    orders = base_tables(spark, folder).orders
    return orders.filter(F.col("order_date") >= since).select("order_id", "order_date")


@query(
    "dat_03_date_diff",
    f"""{BASE_SQL} SELECT customer_id,
  date_diff('day', MIN(order_date), MAX(order_date)) AS tenure_days,
  date_diff('day', MAX(order_date), DATE '{AS_OF}') AS idle_days FROM ord GROUP BY customer_id""",
)
def dat_03(spark, folder):
    first, last = F.min("order_date"), F.max("order_date")
    return (
        base_tables(spark, folder)
        .orders.groupBy("customer_id")
        .agg(
            F.datediff(last, first).cast("bigint").alias("tenure_days"),
            F.datediff(F.lit(AS_OF), last).cast("bigint").alias("idle_days"),
        )
    )


# ---------------------------------------------------------------- filters

NULL_STATUS_SQL = f"""{BASE_SQL}, partly AS (
  SELECT order_id, NULLIF(status, 'DELIVERED') AS status, amount FROM ord)"""


def _orders_with_null_status(spark, folder):
    orders = base_tables(spark, folder).orders
    return orders.withColumn("status", F.nullif("status", F.lit("DELIVERED")))


@query(
    "flt_01_in_list",
    f"""{NULL_STATUS_SQL} SELECT order_id, status FROM partly
WHERE status IN ('COMPLETED', 'SHIPPED', 'DELIVERED')""",
)
def flt_01_in(spark, folder):
    orders = _orders_with_null_status(spark, folder)
    return orders.filter(F.col("status").isin(*workload.SETTLED)).select("order_id", "status")


@query(
    "flt_01_not_in",
    f"""{NULL_STATUS_SQL} SELECT order_id, status FROM partly
WHERE status NOT IN ('CANCELLED', 'REFUNDED')""",
)
def flt_01_not_in(spark, folder):
    orders = _orders_with_null_status(spark, folder)
    return orders.filter(~F.col("status").isin(*workload.VOIDED)).select("order_id", "status")


@query(
    "flt_02_range_pred",
    """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice BETWEEN 50000 AND 200000 AND o_custkey >= 3 AND o_orderkey > 10""",
)
def flt_02(spark, folder):
    return (
        scan(spark, folder, "orders")
        .filter(
            F.col("o_totalprice").between(50000, 200000)
            & (F.col("o_custkey") >= 3)
            & (F.col("o_orderkey") > 10)
        )
        .select("o_orderkey", "o_totalprice")
    )


@query(
    "flt_03_or_null",
    f"""{BASE_SQL}, seen AS (SELECT order_id,
  date_diff('day', NULLIF(order_date, DATE '1996-01-01'), DATE '{AS_OF}') AS idle FROM ord)
SELECT order_id, idle FROM seen WHERE idle > 90 OR idle IS NULL""",
)
def flt_03(spark, folder):
    seen = F.nullif("order_date", F.lit(date(1996, 1, 1)))
    idle = F.datediff(F.lit(AS_OF), seen).cast("bigint")
    orders = base_tables(spark, folder).orders.select("order_id", idle.alias("idle"))
    return orders.filter((F.col("idle") > 90) | F.col("idle").isNull())


@query(
    "flt_04_having",
    f"""{BASE_SQL} SELECT customer_id, CAST(SUM(amount) AS DOUBLE) AS revenue FROM ord
GROUP BY customer_id HAVING SUM(amount) > 2500000""",
)
def flt_04(spark, folder):
    revenue = base_tables(spark, folder).orders.groupBy("customer_id").agg(
        F.sum("amount").alias("revenue")
    )
    return revenue.filter(F.col("revenue") > 2500000).select(
        "customer_id", F.col("revenue").cast("double").alias("revenue")
    )


@query(
    "flt_05_qualify",
    f"""{BASE_SQL} SELECT customer_id, country, signup_date,
  RANK() OVER (PARTITION BY country ORDER BY signup_date ASC NULLS FIRST) AS signup_rank FROM cust
QUALIFY signup_rank <= 5""",
)
def flt_05(spark, folder):
    customers = base_tables(spark, folder).customers
    return ordered.top_ranked(customers, ["country"], asc("signup_date"), 5, "signup_rank").select(
        "customer_id", "country", "signup_date", "signup_rank"
    )


# ---------------------------------------------------------------- joins


@query(
    "joi_01_inner_equi",
    f"""{BASE_SQL} SELECT order_id, ord.customer_id, country, CAST(amount AS DOUBLE) AS amount
FROM cust JOIN ord ON cust.customer_id = ord.customer_id""",
)
def joi_01(spark, folder):
    base = base_tables(spark, folder)
    who = base.customers.select("customer_id", "country")
    joined = skew.lookup_join(base.orders, who, ["customer_id"])
    return joined.select(
        "order_id", "customer_id", "country", F.col("amount").cast("double").alias("amount")
    )


@query(
    "joi_02_left_outer_filtered",
    f"""{BASE_SQL} SELECT cust.customer_id, country, order_id, CAST(amount AS DOUBLE) AS amount
FROM cust LEFT JOIN ord ON cust.customer_id = ord.customer_id
 AND status IN ('COMPLETED', 'SHIPPED') AND amount > 400000""",
)
def joi_02(spark, folder):
    base = base_tables(spark, folder)
    wanted = base.orders.filter(
        F.col("status").isin("COMPLETED", "SHIPPED") & (F.col("amount") > 400000)
    ).select("customer_id", "order_id", F.col("amount").cast("double").alias("amount"))
    who = base.customers.select("customer_id", "country")
    return skew.expand_left_join(who, wanted, ["customer_id"])


@query(
    "joi_03_band_join",
    f"""{BASE_SQL} SELECT order_id, COUNT(product_id) AS products_in_band,
  CAST(MIN(ABS(amount - price)) AS DOUBLE) AS smallest_delta
FROM ord JOIN prod ON amount BETWEEN price * 0.85 AND price * 1.15
WHERE amount > 0 GROUP BY order_id""",
)
def joi_03(spark, folder):
    base = base_tables(spark, folder)
    bands = base.products.select(
        (F.col("price") * F.lit(Decimal("0.85"))).cast("decimal(18,4)").alias("low"),
        (F.col("price") * F.lit(Decimal("1.15"))).cast("decimal(18,4)").alias("high"),
    )
    points = base.orders.filter(F.col("amount") > 0).select(
        "order_id", F.col("amount").cast("decimal(18,4)").alias("amount")
    )
    amounts = points.select("amount").distinct()
    counted = ordered.with_band_count(amounts, "amount", bands, "low", "high", "products_in_band")
    prices = base.products.select(F.col("price").cast("decimal(18,4)").alias("price")).distinct()
    near = ordered.nearest_items(
        counted.filter(F.col("products_in_band") > 0), "amount", prices, "price"
    )

    def gap(side):
        price = F.col(f"{side}.price")
        low, high = price * F.lit(Decimal("0.85")), price * F.lit(Decimal("1.15"))
        return F.when(F.col("amount").between(low, high), F.abs(F.col("amount") - price))

    delta = F.least(gap("below"), gap("above"))
    matched = near.select("amount", "products_in_band", delta.cast("double").alias("smallest_delta"))
    return skew.lookup_join(points, matched, ["amount"]).drop("amount")


@query(
    "joi_04_derived_key_left",
    f"""{TIER_CTES_SQL} SELECT price_tier, price_quartile, products_in_tier, matching_orders,
  unique_buyers, CAST(revenue AS DOUBLE) AS tier_revenue, avg_order_in_tier FROM tiers""",
)
def joi_04(spark, folder):
    tiers = workload.tier_matches(*base_tables(spark, folder), TIER_BOUNDS)
    return tiers.withColumn("tier_revenue", F.col("tier_revenue").cast("double"))


@query(
    "joi_05_three_way",
    f"""{BASE_SQL}, matched AS (
  SELECT country, order_id, product_id, ABS(amount - price) AS delta
  FROM cust c JOIN ord o ON c.customer_id = o.customer_id
  JOIN prod ON amount BETWEEN price * 0.85 AND price * 1.15 WHERE amount > 0
  QUALIFY ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY ABS(amount - price), product_id) = 1)
SELECT country, COUNT(*) AS matches, COUNT(DISTINCT product_id) AS products,
  CAST(SUM(delta) AS DOUBLE) AS total_delta FROM matched GROUP BY country""",
)
def joi_05(spark, folder):
    matched = workload.match_orders_to_products(*base_tables(spark, folder))
    return matched.groupBy("country").agg(
        F.count("*").alias("matches"),
        F.count_distinct("product_id").alias("products"),
        F.sum("price_delta").cast("double").alias("total_delta"),
    )


@query(
    "joi_06_full_outer_nullsafe",
    f"""{BASE_SQL}, a AS (SELECT NULLIF(customer_id, 7) AS k, COUNT(*) AS n FROM ord
  WHERE order_date < DATE '1996-01-01' GROUP BY ALL),
b AS (SELECT NULLIF(customer_id, 7) AS k, COUNT(*) AS n FROM ord
  WHERE order_date >= DATE '2000-06-01' GROUP BY ALL)
SELECT COALESCE(a.k, b.k) AS customer_id, a.n AS early_orders, b.n AS late_orders,
  CASE WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""",
)
def joi_06(spark, folder):
    orders = base_tables(spark, folder).orders
    keyed = orders.withColumn("customer_id", F.nullif("customer_id", F.lit(7)))

    def count(condition, name):
        return keyed.filter(condition).groupBy("customer_id").agg(F.count("*").alias(name))

    early = count(F.col("order_date") < date(1996, 1, 1), "early_orders")
    late = count(F.col("order_date") >= date(2000, 6, 1), "late_orders")
    return full_outer(early, late, ["customer_id"])


# ---------------------------------------------------------------- aggregation


@query(
    "agg_01_basic_aggs",
    f"""{BASE_SQL} SELECT customer_id, COUNT(*) AS n, COUNT(NULLIF(status, 'CANCELLED')) AS settled,
  CAST(SUM(amount) AS DOUBLE) AS total, ROUND(CAST(SUM(amount) AS DOUBLE) / COUNT(amount), 6) AS mean,
  MIN(order_date) AS first_date, MAX(order_date) AS last_date FROM ord GROUP BY customer_id""",
)
def agg_01(spark, folder):
    return (
        base_tables(spark, folder)
        .orders.groupBy("customer_id")
        .agg(
            F.count("*").alias("n"),
            F.count(F.nullif("status", F.lit("CANCELLED"))).alias("settled"),
            F.sum("amount").cast("double").alias("total"),
            ratio(F.sum("amount"), F.count("amount")).alias("mean"),
            F.min("order_date").alias("first_date"),
            F.max("order_date").alias("last_date"),
        )
    )


@query(
    "agg_02_count_distinct",
    """SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS orders, COUNT(DISTINCT l_partkey) AS parts,
  COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""",
)
def agg_02(spark, folder):
    return (
        scan(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.count_distinct("l_orderkey").alias("orders"),
            F.count_distinct("l_partkey").alias("parts"),
            F.count_distinct("l_suppkey").alias("suppliers"),
        )
    )


@query(
    "agg_03_conditional_agg",
    """SELECT l_linestatus, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned,
  COUNT(*) FILTER (l_discount > 0.05) AS discounted,
  ROUND(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END)
        / COUNT(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS mean_returned
FROM lineitem GROUP BY l_linestatus""",
)
def agg_03(spark, folder):
    returned = F.col("l_returnflag") == "R"
    quantity = F.when(returned, F.col("l_quantity"))
    return (
        scan(spark, folder, "lineitem")
        .groupBy("l_linestatus")
        .agg(
            F.sum(F.when(returned, 1).otherwise(0)).alias("returned"),
            F.count_if(F.col("l_discount") > 0.05).alias("discounted"),
            ratio(F.sum(quantity), F.count(quantity)).alias("mean_returned"),
        )
    )


@query(
    "agg_04_group_by_expr",
    f"""{BASE_SQL} SELECT CAST(date_trunc('month', order_date) AS DATE) AS sales_month,
  COUNT(*) AS order_count FROM ord GROUP BY 1""",
)
def agg_04(spark, folder):
    month = F.trunc("order_date", "MM").alias("sales_month")
    return base_tables(spark, folder).orders.groupBy(month).agg(F.count("*").alias("order_count"))


@query(
    "agg_05_ratio_of_aggs",
    f"""{BASE_SQL} SELECT status,
  ROUND(CAST(SUM(amount) AS DOUBLE) / NULLIF(COUNT(DISTINCT customer_id), 0), 6) AS per_customer,
  ROUND(CAST(SUM(amount) AS DOUBLE)
        / NULLIF(COUNT(DISTINCT CASE WHEN status = 'COMPLETED' THEN customer_id END), 0), 6)
    AS per_completed FROM ord GROUP BY status""",
)
def agg_05(spark, folder):
    completed = F.when(F.col("status") == "COMPLETED", F.col("customer_id"))
    return (
        base_tables(spark, folder)
        .orders.groupBy("status")
        .agg(
            ratio(F.sum("amount"), F.count_distinct("customer_id")).alias("per_customer"),
            ratio(F.sum("amount"), F.count_distinct(completed)).alias("per_completed"),
        )
    )


# ---------------------------------------------------------------- windows


@query(
    "win_01_rank",
    f"""{BASE_SQL} SELECT order_id, status, order_date,
  RANK() OVER (PARTITION BY status ORDER BY order_date DESC NULLS LAST) AS recency FROM ord""",
)
def win_01(spark, folder):
    orders = base_tables(spark, folder).orders.select("order_id", "status", "order_date")
    return ordered.with_rank(orders, ["status"], [desc("order_date")], "recency")


@query(
    "win_02_percent_rank",
    f"""{BASE_SQL} SELECT order_id, ROUND(PERCENT_RANK() OVER (ORDER BY order_date), 6) AS share
FROM ord""",
)
def win_02(spark, folder):
    orders = base_tables(spark, folder).orders.select("order_id", "order_date")
    ranked = ordered.with_percent_rank(orders, [asc("order_date")], "share")
    return ranked.select("order_id", F.round("share", 6).alias("share"))


@query(
    "win_03_row_number",
    f"""{BASE_SQL} SELECT order_id, status,
  ROW_NUMBER() OVER (PARTITION BY status ORDER BY amount, order_id) AS place_in_status,
  ROW_NUMBER() OVER (ORDER BY amount, order_id) AS place FROM ord""",
)
def win_03(spark, folder):
    orders = base_tables(spark, folder).orders.select("order_id", "status", "amount")
    order = [asc("amount"), asc("order_id")]
    numbered = ordered.with_row_number(orders, ["status"], order, "place_in_status")
    return ordered.with_position(numbered, order, "place", start=1).drop("amount")


@query(
    "win_04_count_over_all",
    "SELECT p_partkey, COUNT(*) OVER () AS catalogue_size FROM part",
)
def win_04(spark, folder):
    parts = scan(spark, folder, "part").select("p_partkey")
    return parts.withColumn("catalogue_size", parts.select(F.count("*")).scalar())


@query(
    "win_05_agg_of_agg_total",
    f"""{BASE_SQL} SELECT customer_id, CAST(SUM(amount) AS DOUBLE) AS revenue,
  ROUND(CAST(SUM(amount) AS DOUBLE) / CAST(SUM(SUM(amount)) OVER () AS DOUBLE) * 100, 6) AS pct
FROM ord GROUP BY customer_id""",
)
def win_05(spark, folder):
    orders = base_tables(spark, folder).orders
    total = orders.select(F.sum("amount").cast("double")).scalar()
    revenue = orders.groupBy("customer_id").agg(F.sum("amount").cast("double").alias("revenue"))
    return revenue.withColumn("pct", F.round(F.try_divide("revenue", total) * 100, 6))


@query(
    "win_06_rolling_rows",
    f"""{REGIONAL_CTES_SQL} SELECT sales_month, country, city,
  ROUND(CAST(SUM(revenue) OVER w AS DOUBLE) / COUNT(revenue) OVER w, 6) AS rolling_3mo_revenue
FROM sales WINDOW w AS (PARTITION BY country ORDER BY sales_month, city
                        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def win_06(spark, folder):
    base = base_tables(spark, folder)
    sales = workload.regional_sales(base.customers, base.orders, AS_OF)
    order = [asc("sales_month"), asc("city")]
    rolled = ordered.with_rolling_average(sales, ["country"], order, "revenue", 2, "mean")
    return rolled.select(
        "sales_month", "country", "city", F.round("mean", 6).alias("rolling_3mo_revenue")
    )


@query(
    "win_07_quartile_bucket",
    f"""{BASE_SQL} SELECT product_id,
  (ROW_NUMBER() OVER (ORDER BY price NULLS FIRST, product_id) - 1) * 4 // COUNT(*) OVER () + 1
    AS price_quartile FROM prod""",
)
def win_07(spark, folder):
    quartiles = workload.price_quartiles(base_tables(spark, folder).products)
    return quartiles.select("product_id", "price_quartile")


@query(
    "top_01_top_n_per_group",
    f"""{BASE_SQL} SELECT order_id, status, CAST(amount AS DOUBLE) AS amount,
  RANK() OVER (PARTITION BY status ORDER BY amount DESC NULLS LAST) AS amount_rank FROM ord
QUALIFY amount_rank <= 25""",
)
def top_01(spark, folder):
    orders = base_tables(spark, folder).orders
    best = ordered.top_ranked(orders, ["status"], desc("amount"), 25, "amount_rank")
    return best.select(
        "order_id", "status", F.col("amount").cast("double").alias("amount"), "amount_rank"
    )


@query(
    "lim_01_head_n",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""",
)
def lim_01(spark, folder):
    newest = scan(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return newest.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)


@query(
    "srt_01_multi_key_sort",
    f"""{BASE_SQL} SELECT order_id, status, order_date, CAST(amount AS DOUBLE) AS amount,
  ROW_NUMBER() OVER (ORDER BY status, order_date DESC, amount DESC, order_id) AS place FROM ord
ORDER BY place""",
)
def srt_01(spark, folder):
    orders = base_tables(spark, folder).orders.select(
        "order_id", "status", "order_date", F.col("amount").cast("double").alias("amount")
    )
    order = [asc("status"), desc("order_date"), desc("amount"), asc("order_id")]
    return ordered.with_position(orders, order, "place", start=1)
