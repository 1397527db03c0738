"""The six analytic workloads that both sides of a migration run.

Every function takes frames with the logical columns and returns one DataFrame. Money is summed as
DECIMAL and divided once as DOUBLE, so results do not depend on the order of rows.

Orders are pre-aggregated per customer before any join on ``customer_id``: a customer holding a
third of all orders then reaches the join as one row per map task.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from migraspark.operators.ordered import (
    Key,
    asc,
    desc,
    nearest_items,
    percent_rank_table,
    top_ranked,
    with_position,
    with_rolling_average,
)
from migraspark.operators.skew import lookup_join
from migraspark.session import cut_lineage

SETTLED = ("COMPLETED", "SHIPPED", "DELIVERED")
VOIDED = ("CANCELLED", "REFUNDED")


def ratio(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """One DOUBLE division, NULL on a zero denominator."""
    divided = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.round(divided, digits)


def full_name() -> Column:
    return F.concat("first_name", F.lit(" "), "last_name")


def _spend_per_customer(orders: DataFrame) -> DataFrame:
    """Settled orders folded to one row per customer."""
    return (
        orders.filter(F.col("status").isin(*SETTLED))
        .groupBy("customer_id")
        .agg(
            F.count_distinct("order_id").alias("distinct_orders"),
            F.count("order_id").alias("orders"),
            F.count("amount").alias("amounts"),
            F.sum("amount").alias("spend"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
    )


def customer_lifetime(
    customers: DataFrame, orders: DataFrame, top: int = 10, sort: bool = True
) -> DataFrame:
    """Lifetime value, tenure, rank in country (top ``top``) and spend percentile."""
    who = ["customer_id", "first_name", "last_name", "email", "city", "country", "signup_date"]
    joined = customers.select(*who).join(_spend_per_customer(orders), "customer_id")
    # Repeated customer rows multiply sums, not distinct counts; the keys are co-located already.
    metrics = cut_lineage(
        joined.groupBy(*who).agg(
            F.max("distinct_orders").alias("total_orders"),
            F.sum("spend").alias("lifetime_spend"),
            F.sum("amounts").alias("amounts"),
            F.min("first_order_date").alias("first_order_date"),
            F.max("last_order_date").alias("last_order_date"),
        )
    )
    leaders = top_ranked(metrics, ["country"], desc("lifetime_spend"), top, "spend_rank_in_country")
    percentiles = percent_rank_table(metrics, [asc("lifetime_spend")], "spend_percentile")
    percentiles = percentiles.withColumnRenamed("lifetime_spend", "spend_key")
    # Every leader's spend has a percentile; an inner join lets Spark broadcast the few leaders.
    result = leaders.join(
        percentiles, F.col("lifetime_spend").eqNullSafe(F.col("spend_key"))
    ).select(
        "customer_id",
        full_name().alias("full_name"),
        "email",
        "city",
        "country",
        "signup_date",
        "total_orders",
        F.col("lifetime_spend").cast("double").alias("lifetime_spend"),
        ratio(F.col("lifetime_spend"), F.col("amounts")).alias("avg_order_value"),
        "first_order_date",
        "last_order_date",
        F.datediff("last_order_date", "first_order_date")
        .cast("bigint")
        .alias("customer_tenure_days"),
        F.col("spend_rank_in_country").cast("bigint").alias("spend_rank_in_country"),
        F.round("spend_percentile", 6).alias("spend_percentile"),
    )
    return result.orderBy("country", "spend_rank_in_country") if sort else result


def match_orders_to_products(
    customers: DataFrame, orders: DataFrame, products: DataFrame
) -> DataFrame:
    """Each order with the catalogue price nearest to its amount, if within 15 %.

    ``price*0.85 <= amount <= price*1.15`` is an interval of prices around the amount, so the
    nearest matching price is the next one below or the next one above; no other pair is formed.
    It depends on the amount alone, so it is looked up once per distinct amount.
    """
    priced = (
        products.filter(F.col("price") > 0)
        .groupBy("price")
        .agg(F.min(F.struct("product_id", "product_name")).alias("product"))
    )
    paid = orders.filter(F.col("amount") > 0).select(
        "order_id", "customer_id", "order_date", F.col("amount").alias("order_amount"), "status"
    )
    near = nearest_items(paid.select("order_amount").distinct(), "order_amount", priced, "price")

    def candidate(side: str) -> Column:
        price = F.col(f"{side}.price")
        in_band = F.col("order_amount").between(
            price * F.lit(Decimal("0.85")), price * F.lit(Decimal("1.15"))
        )
        found = F.struct(
            F.abs(F.col("order_amount") - price).alias("price_delta"),
            F.col(f"{side}.product.product_id").alias("product_id"),
            F.col(f"{side}.product.product_name").alias("product_name"),
            price.alias("catalog_price"),
        )
        return F.when(in_band, found)

    best = F.least(candidate("below"), candidate("above"))
    matches = near.select("order_amount", best.alias("match")).filter(F.col("match").isNotNull())
    matched = lookup_join(paid, matches, ["order_amount"])
    who = customers.select("customer_id", "first_name", "last_name", "country")
    joined = lookup_join(matched, who, ["customer_id"], hot_from=paid)
    return joined.select(*[c for c in joined.columns if c != "match"], "match.*")


def product_price_match(
    customers: DataFrame, orders: DataFrame, products: DataFrame, sort: bool = True
) -> DataFrame:
    """Nearest catalogue price within 15 % of every order amount, with a quality band."""
    columns = [
        "customer_id", "first_name", "last_name", "country", "order_id", "order_date",
        "order_amount", "status", "product_id", "product_name", "catalog_price", "price_delta",
    ]
    matched = match_orders_to_products(customers, orders, products)
    # An order id may occur more than once; row_number = 1 is cut in every task before the shuffle.
    nearest = Window.partitionBy("order_id").orderBy("price_delta", "product_id", "customer_id")
    best = (
        matched.withColumn("place", F.row_number().over(nearest))
        .filter(F.col("place") == 1)
        .select(*columns)
    )
    delta, price = F.col("price_delta"), F.col("catalog_price")
    result = best.withColumn(
        "match_quality",
        F.when(delta <= price * F.lit(Decimal("0.05")), "EXACT_MATCH")
        .when(delta <= price * F.lit(Decimal("0.10")), "CLOSE_MATCH")
        .otherwise("TIER_MATCH"),
    )
    if not sort:
        return result
    return result.orderBy("country", F.desc("order_date"), F.desc("order_amount"))


def lapsed_high_value(
    customers: DataFrame,
    orders: DataFrame,
    as_of: date,
    min_spend: int = 1000,
    min_orders: int = 3,
    idle_days: int = 90,
    top: int = 25,
    sort: bool = True,
) -> DataFrame:
    """Customers with high lifetime spend and no recent order, best ranked per country."""
    who = [
        "customer_id", "first_name", "last_name", "email", "phone", "city", "country",
        "signup_date",
    ]
    spend = (
        customers.select(*who)
        .join(_spend_per_customer(orders), "customer_id", "left")
        .groupBy(*who)
        .agg(
            F.coalesce(F.sum("orders"), F.lit(0)).alias("lifetime_orders"),
            F.sum("spend").alias("lifetime_spend"),
            F.sum("amounts").alias("amounts"),
            F.max("last_order_date").alias("last_order_date"),
        )
        .filter((F.col("lifetime_spend") >= min_spend) & (F.col("lifetime_orders") >= min_orders))
    )
    ranked = (
        top_ranked(spend, ["country"], desc("lifetime_spend"), top, "country_spend_rank")
        .withColumn("days_since_last_order", F.datediff(F.lit(as_of), "last_order_date"))
        .filter((F.col("days_since_last_order") > idle_days) | F.col("last_order_date").isNull())
    )
    result = ranked.select(
        "customer_id",
        full_name().alias("full_name"),
        "email",
        "phone",
        "city",
        "country",
        "signup_date",
        "lifetime_orders",
        F.col("lifetime_spend").cast("double").alias("lifetime_spend"),
        ratio(F.col("lifetime_spend"), F.col("amounts")).alias("avg_order_value"),
        "last_order_date",
        F.col("days_since_last_order").cast("bigint").alias("days_since_last_order"),
        F.col("country_spend_rank").cast("bigint").alias("country_spend_rank"),
    )
    if not sort:
        return result
    return result.orderBy(F.desc("lifetime_spend"), F.desc("days_since_last_order"))


def price_tier(value: Column, bounds: tuple[int, int, int]) -> Column:
    """First matching band wins, so a shared bound belongs to the lower band; NULL is LUXURY."""
    low, middle, high = bounds
    return (
        F.when(value < low, "BUDGET")
        .when(value.between(low, middle), "MID_RANGE")
        .when(value.between(middle, high), "PREMIUM")
        .otherwise("LUXURY")
    )


def price_quartiles(products: DataFrame) -> DataFrame:
    """``(row_number - 1) * 4 / count + 1`` over the catalogue by price; not the same as ntile."""
    order: list[Key] = [asc("price"), asc("product_id")]
    placed = with_position(products.select("product_id", "price"), order, "place", total="size")
    quarter = F.call_function("div", F.col("place") * 4, F.col("size"))
    return placed.withColumn("price_quartile", (quarter + 1).cast("bigint")).drop("size")


def tier_matches(
    customers: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    bounds: tuple[int, int, int] = (50, 200, 500),
) -> DataFrame:
    """Product tiers and quartiles left-joined to the orders of the same tier.

    Tiers are many-to-many, so both sides are folded before they meet: the sum over all pairs is
    the tier's order sum times its number of products, and distinct counts carry over.
    """
    catalogue = (
        price_quartiles(products)
        .groupBy(price_tier(F.col("price"), bounds).alias("price_tier"), "price_quartile")
        .agg(
            F.count("*").alias("products"),
            F.count_distinct("product_id").alias("products_in_tier"),
        )
    )
    known = customers.groupBy("customer_id").agg(F.count("*").alias("copies"))
    kept = orders.filter(~F.col("status").isin(*VOIDED)).select(
        "order_id",
        "customer_id",
        "amount",
        price_tier(F.col("amount"), bounds).alias("order_tier"),
    )
    # Money and buyers only need one row per customer and tier; orders are needed for their ids.
    money = (
        kept.groupBy("customer_id", "order_tier")
        .agg(F.sum("amount").alias("amount"), F.count("amount").alias("amounts"))
        .join(known, "customer_id")
        .groupBy("order_tier")
        .agg(
            F.count("*").alias("unique_buyers"),
            F.sum(F.col("amount") * F.col("copies")).alias("amount_sum"),
            F.sum(F.col("amounts") * F.col("copies")).alias("amount_count"),
        )
    )
    placed = lookup_join(
        kept.select("order_id", "customer_id", "order_tier"),
        known.select("customer_id"),
        ["customer_id"],
    )
    counted = placed.groupBy("order_tier").agg(
        F.count_distinct("order_id").alias("matching_orders")
    )
    tiers = money.join(counted, "order_tier")
    return catalogue.join(tiers, F.col("price_tier") == F.col("order_tier"), "left").select(
        "price_tier",
        "price_quartile",
        "products_in_tier",
        F.coalesce("matching_orders", F.lit(0)).alias("matching_orders"),
        F.coalesce("unique_buyers", F.lit(0)).alias("unique_buyers"),
        (F.col("amount_sum").cast("decimal(28,2)") * F.col("products").cast("decimal(19,0)"))
        .cast("decimal(38,2)")
        .alias("tier_revenue"),
        ratio(F.col("amount_sum"), F.col("amount_count")).alias("avg_order_in_tier"),
    )


def tier_contribution(
    customers: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    bounds: tuple[int, int, int] = (50, 200, 500),
    sort: bool = True,
) -> DataFrame:
    """Price tier by quartile: orders, buyers, revenue and its share of the total."""
    tiers = tier_matches(customers, orders, products, bounds)
    # At most 4 tiers x 4 quartiles reach this window.
    total = F.sum("tier_revenue").over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.try_divide(F.col("tier_revenue").cast("double"), total.cast("double")) * 100
    result = tiers.withColumn("pct_of_total_revenue", F.round(share, 6)).withColumn(
        "tier_revenue", F.col("tier_revenue").cast("double")
    )
    return result.orderBy("price_quartile", "price_tier") if sort else result


def regional_sales(
    customers: DataFrame,
    orders: DataFrame,
    as_of: date,
    months: int = 24,
    min_revenue: int = 500,
) -> DataFrame:
    """Month x country x city sales above ``min_revenue``."""
    since = F.add_months(F.lit(as_of), -months)
    monthly = (
        orders.filter((F.col("order_date") >= since) & ~F.col("status").isin(*VOIDED))
        .groupBy("customer_id", F.trunc("order_date", "MM").alias("sales_month"))
        .agg(
            F.count("order_id").alias("orders"),
            F.count("amount").alias("amounts"),
            F.sum("amount").alias("amount"),
        )
    )
    return (
        customers.select("customer_id", "country", "city")
        .join(monthly, "customer_id")
        .groupBy("sales_month", "country", "city")
        .agg(
            F.count_distinct("customer_id").alias("active_customers"),
            F.sum("orders").alias("order_count"),
            F.sum("amounts").alias("amounts"),
            F.sum("amount").alias("revenue"),
        )
        .filter(F.col("revenue") > min_revenue)
    )


def regional_monthly(
    customers: DataFrame,
    orders: DataFrame,
    as_of: date,
    months: int = 24,
    min_revenue: int = 500,
    sort: bool = True,
) -> DataFrame:
    """Monthly regional revenue with a three-row rolling average per country.

    Rows of a country are ordered by month and city; the source text orders by month only, which
    leaves the frame undefined when a country has several cities.
    """
    sales = cut_lineage(regional_sales(customers, orders, as_of, months, min_revenue))
    rolled = with_rolling_average(
        sales, ["country"], [asc("sales_month"), asc("city")], "revenue", 2, "rolling_3mo_revenue"
    )
    result = rolled.select(
        "sales_month",
        "country",
        "city",
        "active_customers",
        "order_count",
        F.col("revenue").cast("double").alias("gross_revenue"),
        ratio(F.col("revenue"), F.col("amounts")).alias("avg_order_amount"),
        ratio(F.col("revenue"), F.col("active_customers")).alias("revenue_per_customer"),
        F.round("rolling_3mo_revenue", 6).alias("rolling_3mo_revenue"),
    )
    if not sort:
        return result
    return result.orderBy("country", "sales_month", F.desc("gross_revenue"))


def cohort_summary(
    customers: DataFrame, orders: DataFrame, as_of: date, months: int = 36
) -> DataFrame:
    """Signup month x country: size, conversions, repeats, spend and days to first order."""
    base = (
        customers.filter(F.col("signup_date") >= F.add_months(F.lit(as_of), -months))
        .select("customer_id", F.trunc("signup_date", "MM").alias("signup_cohort"), "country")
        .join(_spend_per_customer(orders), "customer_id", "left")
        .groupBy("customer_id", "signup_cohort", "country")
        .agg(
            F.min("first_order_date").alias("first_order_date"),
            F.coalesce(F.sum("orders"), F.lit(0)).alias("order_count"),
            F.sum("spend").alias("total_spend"),
        )
    )
    return base.groupBy("signup_cohort", "country").agg(
        F.count("*").alias("cohort_size"),
        F.count_if(F.col("order_count") > 0).alias("converted_customers"),
        F.count_if(F.col("order_count") >= 2).alias("repeat_customers"),
        ratio(F.sum("total_spend"), F.count("total_spend")).alias("avg_cohort_spend"),
        ratio(
            F.sum(F.datediff("first_order_date", "signup_cohort")), F.count("first_order_date")
        ).alias("avg_days_to_first_order"),
    )


def cohort_retention(
    customers: DataFrame,
    orders: DataFrame,
    as_of: date,
    months: int = 36,
    min_size: int = 5,
    sort: bool = True,
) -> DataFrame:
    """Conversion and repeat rates of signup cohorts, ranked by conversions within the cohort."""
    summary = cohort_summary(customers, orders, as_of, months).filter(
        F.col("cohort_size") >= min_size
    )
    # One row per country and cohort is left here, so a cohort's window is the list of countries.
    in_cohort = Window.partitionBy("signup_cohort").orderBy(F.desc("converted_customers"))

    def rate(part: str, whole: str) -> Column:
        share = F.col(part).cast("decimal(18,4)").cast("double") / F.nullif(
            F.col(whole), F.lit(0)
        )
        return F.round(share * 100, 6)

    result = summary.select(
        "signup_cohort",
        "country",
        "cohort_size",
        "converted_customers",
        "repeat_customers",
        rate("converted_customers", "cohort_size").alias("conversion_rate_pct"),
        rate("repeat_customers", "converted_customers").alias("repeat_rate_pct"),
        "avg_cohort_spend",
        "avg_days_to_first_order",
        F.rank().over(in_cohort).cast("bigint").alias("country_rank_in_cohort"),
    )
    if not sort:
        return result
    return result.orderBy(F.desc("signup_cohort"), F.desc("conversion_rate_pct"))
