"""The six workload queries."""

from __future__ import annotations

from migraspark.catalog import query
from migraspark.plans import workload
from migraspark.plans.bindings import AS_OF, BASE_SQL, base_tables

TIER_BOUNDS = (50_000, 200_000, 400_000)
COHORT_MONTHS = 72
COHORT_MIN = 2

CUSTOMER_LIFETIME_SQL = f"""{BASE_SQL},
customer_metrics AS (
  SELECT customer_id, first_name, last_name, email, city, country, signup_date,
         COUNT(DISTINCT order_id) AS total_orders, SUM(amount) AS spend, COUNT(amount) AS n,
         MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date
  FROM cust JOIN ord USING (customer_id)
  WHERE status IN ('COMPLETED', 'SHIPPED', 'DELIVERED')
  GROUP BY ALL),
ranked AS (
  SELECT *, RANK() OVER (PARTITION BY country ORDER BY spend DESC NULLS LAST) AS rk,
         PERCENT_RANK() OVER (ORDER BY spend ASC NULLS FIRST) AS pr
  FROM customer_metrics)
SELECT customer_id, first_name || ' ' || last_name AS full_name, email, city, country, signup_date,
       total_orders, CAST(spend AS DOUBLE) AS lifetime_spend,
       ROUND(CAST(spend AS DOUBLE) / n, 6) AS avg_order_value, first_order_date, last_order_date,
       date_diff('day', first_order_date, last_order_date) AS customer_tenure_days,
       rk AS spend_rank_in_country, ROUND(pr, 6) AS spend_percentile
FROM ranked WHERE rk <= 10 ORDER BY country, rk"""

PRODUCT_PRICE_MATCH_SQL = f"""{BASE_SQL},
matched AS (
  SELECT c.customer_id, first_name, last_name, country, order_id, order_date,
         amount AS order_amount, status, product_id, product_name, price AS catalog_price,
         ABS(amount - price) AS price_delta,
         ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY ABS(amount - price), product_id) AS rn
  FROM cust c JOIN ord o ON c.customer_id = o.customer_id
  JOIN prod p ON amount BETWEEN price * 0.85 AND price * 1.15
  WHERE amount > 0)
SELECT * EXCLUDE (rn),
       CASE WHEN price_delta <= catalog_price * 0.05 THEN 'EXACT_MATCH'
            WHEN price_delta <= catalog_price * 0.10 THEN 'CLOSE_MATCH'
            ELSE 'TIER_MATCH' END AS match_quality
FROM matched WHERE rn = 1 ORDER BY country, order_date DESC, order_amount DESC"""

LAPSED_SQL = f"""{BASE_SQL},
customer_spend AS (
  SELECT c.customer_id, first_name, last_name, email, phone, city, country, signup_date,
         COUNT(order_id) AS lifetime_orders, SUM(amount) AS spend, COUNT(amount) AS n,
         MAX(order_date) AS last_order_date
  FROM cust c LEFT JOIN ord o ON c.customer_id = o.customer_id
       AND status IN ('COMPLETED', 'SHIPPED', 'DELIVERED')
  GROUP BY ALL),
ranked AS (
  SELECT *, date_diff('day', last_order_date, DATE '{AS_OF}') AS days_since_last_order,
         RANK() OVER (PARTITION BY country ORDER BY spend DESC NULLS LAST) AS rk
  FROM customer_spend WHERE spend >= 1000 AND lifetime_orders >= 3)
SELECT customer_id, first_name || ' ' || last_name AS full_name, email, phone, city, country,
       signup_date, lifetime_orders, CAST(spend AS DOUBLE) AS lifetime_spend,
       ROUND(CAST(spend AS DOUBLE) / n, 6) AS avg_order_value, last_order_date,
       days_since_last_order, rk AS country_spend_rank
FROM ranked WHERE (days_since_last_order > 90 OR last_order_date IS NULL) AND rk <= 25
ORDER BY lifetime_spend DESC, days_since_last_order DESC"""


def tier_sql(value: str) -> str:
    low, middle, high = TIER_BOUNDS
    return (
        f"CASE WHEN {value} < {low} THEN 'BUDGET' WHEN {value} BETWEEN {low} AND {middle} "
        f"THEN 'MID_RANGE' WHEN {value} BETWEEN {middle} AND {high} THEN 'PREMIUM' "
        "ELSE 'LUXURY' END"
    )


TIER_CTES_SQL = f"""{BASE_SQL},
product_tiers AS (
  SELECT product_id, {tier_sql("price")} AS price_tier,
         (ROW_NUMBER() OVER (ORDER BY price NULLS FIRST, product_id) - 1) * 4
           // COUNT(*) OVER () + 1 AS price_quartile
  FROM prod),
order_tiers AS (
  SELECT order_id, o.customer_id, amount, {tier_sql("amount")} AS order_tier
  FROM ord o JOIN cust c ON o.customer_id = c.customer_id
  WHERE status NOT IN ('CANCELLED', 'REFUNDED')),
-- The join of the two is many-to-many; each side is counted first and the sums multiplied out.
pt AS (
  SELECT price_tier, price_quartile, COUNT(*) AS n, COUNT(DISTINCT product_id) AS products_in_tier
  FROM product_tiers GROUP BY ALL),
ot AS (
  SELECT order_tier, COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT customer_id) AS buyers,
         SUM(amount) AS amount, COUNT(amount) AS amounts
  FROM order_tiers GROUP BY ALL),
tiers AS (
  SELECT price_tier, price_quartile, products_in_tier, COALESCE(orders, 0) AS matching_orders,
         COALESCE(buyers, 0) AS unique_buyers, CAST(amount AS DECIMAL(28,2)) * n AS revenue,
         ROUND(CAST(amount AS DOUBLE) / amounts, 6) AS avg_order_in_tier
  FROM pt LEFT JOIN ot ON price_tier = order_tier)"""

TIER_CONTRIBUTION_SQL = f"""{TIER_CTES_SQL}
SELECT price_tier, price_quartile, products_in_tier, matching_orders, unique_buyers,
       CAST(revenue AS DOUBLE) AS tier_revenue, avg_order_in_tier,
       ROUND(CAST(revenue AS DOUBLE) / CAST(SUM(revenue) OVER () AS DOUBLE) * 100, 6)
         AS pct_of_total_revenue
FROM tiers"""

REGIONAL_CTES_SQL = f"""{BASE_SQL},
sales AS (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS sales_month, country, city,
         COUNT(DISTINCT c.customer_id) AS active_customers, COUNT(order_id) AS order_count,
         COUNT(amount) AS amounts, SUM(amount) AS revenue
  FROM cust c JOIN ord o ON c.customer_id = o.customer_id
  WHERE order_date >= CAST(DATE '{AS_OF}' - INTERVAL 24 MONTH AS DATE)
    AND status NOT IN ('CANCELLED', 'REFUNDED')
  GROUP BY ALL HAVING SUM(amount) > 500)"""

REGIONAL_SQL = f"""{REGIONAL_CTES_SQL}
SELECT sales_month, country, city, active_customers, order_count,
       CAST(revenue AS DOUBLE) AS gross_revenue,
       ROUND(CAST(revenue AS DOUBLE) / amounts, 6) AS avg_order_amount,
       ROUND(CAST(revenue AS DOUBLE) / NULLIF(active_customers, 0), 6) AS revenue_per_customer,
       ROUND(CAST(SUM(revenue) OVER w AS DOUBLE) / COUNT(revenue) OVER w, 6)
         AS rolling_3mo_revenue
FROM sales
WINDOW w AS (PARTITION BY country ORDER BY sales_month, city
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
ORDER BY country, sales_month, gross_revenue DESC"""

COHORT_CTES_SQL = f"""{BASE_SQL},
cohort_base AS (
  SELECT c.customer_id, CAST(date_trunc('month', signup_date) AS DATE) AS signup_cohort, country,
         MIN(order_date) AS first_date, COUNT(order_id) AS order_count, SUM(amount) AS spend
  FROM cust c LEFT JOIN ord o ON c.customer_id = o.customer_id
       AND status IN ('COMPLETED', 'SHIPPED', 'DELIVERED')
  WHERE signup_date >= CAST(DATE '{AS_OF}' - INTERVAL {COHORT_MONTHS} MONTH AS DATE)
  GROUP BY ALL),
cohort_summary AS (
  SELECT signup_cohort, country, COUNT(*) AS cohort_size,
         COUNT(*) FILTER (order_count > 0) AS converted_customers,
         COUNT(*) FILTER (order_count >= 2) AS repeat_customers,
         ROUND(CAST(SUM(spend) AS DOUBLE) / NULLIF(COUNT(spend), 0), 6) AS avg_cohort_spend,
         ROUND(CAST(SUM(date_diff('day', signup_cohort, first_date)) AS DOUBLE)
               / NULLIF(COUNT(first_date), 0), 6) AS avg_days_to_first_order
  FROM cohort_base GROUP BY ALL)"""

COHORT_SQL = f"""{COHORT_CTES_SQL}
SELECT signup_cohort, country, cohort_size, converted_customers, repeat_customers,
       ROUND(CAST(CAST(converted_customers AS DECIMAL(18,4)) AS DOUBLE)
             / NULLIF(cohort_size, 0) * 100, 6) AS conversion_rate_pct,
       ROUND(CAST(CAST(repeat_customers AS DECIMAL(18,4)) AS DOUBLE)
             / NULLIF(converted_customers, 0) * 100, 6) AS repeat_rate_pct,
       avg_cohort_spend, avg_days_to_first_order,
       RANK() OVER (PARTITION BY signup_cohort ORDER BY converted_customers DESC)
         AS country_rank_in_cohort
FROM cohort_summary WHERE cohort_size >= {COHORT_MIN}"""


@query("wq_1_customer_lifetime", CUSTOMER_LIFETIME_SQL)
def wq_1(spark, folder):
    base = base_tables(spark, folder)
    return workload.customer_lifetime(base.customers, base.orders)


@query("wq_2_product_price_match", PRODUCT_PRICE_MATCH_SQL)
def wq_2(spark, folder):
    return workload.product_price_match(*base_tables(spark, folder))


@query("wq_3_lapsed_high_value", LAPSED_SQL)
def wq_3(spark, folder):
    base = base_tables(spark, folder)
    return workload.lapsed_high_value(base.customers, base.orders, AS_OF)


@query("wq_4_tier_contribution", TIER_CONTRIBUTION_SQL)
def wq_4(spark, folder):
    return workload.tier_contribution(*base_tables(spark, folder), TIER_BOUNDS)


@query("wq_5_regional_monthly", REGIONAL_SQL)
def wq_5(spark, folder):
    base = base_tables(spark, folder)
    return workload.regional_monthly(base.customers, base.orders, AS_OF)


@query("wq_6_cohort_retention", COHORT_SQL)
def wq_6(spark, folder):
    base = base_tables(spark, folder)
    return workload.cohort_retention(
        base.customers, base.orders, AS_OF, months=COHORT_MONTHS, min_size=COHORT_MIN
    )
