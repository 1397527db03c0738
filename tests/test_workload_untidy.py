"""The workloads on tables with repeated ids, NULLs and odd prices, against the plain SQL."""

from __future__ import annotations

import datetime
import random

import compare
import duckdb
import pytest

from migraspark.catalog import workload as W
from migraspark.plans import workload
from migraspark.plans.bindings import AS_OF, BASE_SQL

FRAMES_SQL = "WITH cust AS (SELECT * FROM c), ord AS (SELECT * FROM o), prod AS (SELECT * FROM p)"


def plain(sql: str) -> str:
    return sql.replace(BASE_SQL, FRAMES_SQL)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    start = datetime.date(1999, 1, 1)
    customers = []
    for i in range(120):
        row = (
            i % 90, f"F{i % 90}", None if i % 11 == 0 else f"L{i % 90}", f"e{i % 90}", f"p{i % 90}",
            f"city{i % 5}", "big" if i % 3 else f"land{i % 4}",
            None if i % 13 == 0 else start + datetime.timedelta(days=(i % 90) * 9),
        )
        customers.append(row)
        if i % 7 == 0:
            customers.append(row)
    statuses = [*workload.SETTLED, *workload.VOIDED, "PENDING", None]
    orders = [
        (
            i % 700, None if i % 19 == 0 else rng.randrange(0, 100),
            None if i % 41 == 0 else start + datetime.timedelta(days=rng.randrange(900)),
            None if i % 23 == 0 else round(rng.choice([rng.uniform(-20, 900), 250.0, 200.0]), 2),
            rng.choice(statuses),
        )
        for i in range(1000)
    ]
    products = [(i % 70, f"n{i % 70}", p) for i, p in enumerate(
        [None, 0.0, -5.0, 50.0, 200.0, 500.0, 250.0, 250.0] + [round(rng.uniform(-50, 800), 2) for _ in range(80)]
    )]
    schemas = (
        "customer_id int, first_name string, last_name string, email string, phone string, "
        "city string, country string, signup_date date",
        "order_id int, customer_id int, order_date date, amount double, status string",
        "product_id int, product_name string, price double",
    )
    frames = [
        spark.createDataFrame(rows, schema)
        for rows, schema in zip((customers, orders, products), schemas, strict=True)
    ]
    frames[1] = frames[1].withColumn("amount", frames[1].amount.cast("decimal(12,2)"))
    frames[2] = frames[2].withColumn("price", frames[2].price.cast("decimal(12,2)"))
    connection = duckdb.connect()
    for name, frame in zip("cop", frames, strict=True):
        connection.register(f"{name}_arrow", frame.toArrow())
        connection.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    return frames, connection


def test_customer_lifetime(tables):
    (c, o, _), connection = tables
    assert compare.differences(workload.customer_lifetime(c, o), plain(W.CUSTOMER_LIFETIME_SQL), connection) == []


def test_lapsed_high_value(tables):
    (c, o, _), connection = tables
    assert compare.differences(workload.lapsed_high_value(c, o, AS_OF), plain(W.LAPSED_SQL), connection) == []


def test_regional_monthly(tables):
    (c, o, _), connection = tables
    assert compare.differences(workload.regional_monthly(c, o, AS_OF), plain(W.REGIONAL_SQL), connection) == []


def test_cohort_retention(tables):
    (c, o, _), connection = tables
    found = workload.cohort_retention(c, o, AS_OF, months=W.COHORT_MONTHS, min_size=W.COHORT_MIN)
    assert compare.differences(found, plain(W.COHORT_SQL), connection) == []


def test_product_price_match(tables):
    (c, o, p), connection = tables
    keep = ["order_id", "product_id", "catalog_price", "price_delta", "match_quality"]
    found = workload.product_price_match(c, o, p).select(*keep)
    sql = f"SELECT {', '.join(keep)} FROM ({plain(W.PRODUCT_PRICE_MATCH_SQL)})"
    assert compare.differences(found, sql, connection) == []


NAIVE_TIERS = f"""{FRAMES_SQL},
product_tiers AS (
  SELECT product_id, CASE WHEN price < 50 THEN 'BUDGET' WHEN price BETWEEN 50 AND 200 THEN 'MID_RANGE'
    WHEN price BETWEEN 200 AND 500 THEN 'PREMIUM' ELSE 'LUXURY' END AS price_tier,
    (ROW_NUMBER() OVER (ORDER BY price NULLS FIRST, product_id) - 1) * 4 // COUNT(*) OVER () + 1
      AS price_quartile FROM prod),
order_tiers AS (
  SELECT o.*, CASE WHEN amount < 50 THEN 'BUDGET' WHEN amount BETWEEN 50 AND 200 THEN 'MID_RANGE'
    WHEN amount BETWEEN 200 AND 500 THEN 'PREMIUM' ELSE 'LUXURY' END AS order_tier
  FROM ord o JOIN cust c ON o.customer_id = c.customer_id
  WHERE status NOT IN ('CANCELLED', 'REFUNDED'))
SELECT price_tier, price_quartile, COUNT(DISTINCT product_id) AS products_in_tier,
  COUNT(DISTINCT order_id) AS matching_orders, COUNT(DISTINCT customer_id) AS unique_buyers,
  CAST(SUM(amount) AS DOUBLE) AS tier_revenue,
  ROUND(CAST(SUM(amount) AS DOUBLE) / COUNT(amount), 6) AS avg_order_in_tier,
  ROUND(CAST(SUM(amount) AS DOUBLE) / CAST(SUM(SUM(amount)) OVER () AS DOUBLE) * 100, 6)
    AS pct_of_total_revenue
FROM product_tiers LEFT JOIN order_tiers ON price_tier = order_tier
GROUP BY price_tier, price_quartile"""


def test_tier_contribution_equals_the_many_to_many_join(tables):
    (c, o, p), connection = tables
    assert compare.differences(workload.tier_contribution(c, o, p), NAIVE_TIERS, connection) == []
