"""Generated values over row ids that come from the test tables.

Every order key (or customer or part key) is a row id, so the work grows with the tables, and the
cross-check draws the same md5 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from migraspark.catalog import query
from migraspark.functions import values as V
from migraspark.functions.draws import Draw
from migraspark.operators import generate as G
from migraspark.operators.generate import ColumnGen, TableSpec
from migraspark.session import scratch_path
from migraspark.sources.history_store import HistoryStore
from migraspark.sources.tables import cores, scan, spread

SEED = G.DEFAULT_SEED
TABLE = "demo"


def spine(spark, folder, table="orders", key="o_orderkey"):
    return spread(scan(spark, folder, table).select((F.col(key) + 1).alias(G.ROW_ID)), cores(spark))


def draw(column):
    return Draw(SEED, TABLE, column, F.col(G.ROW_ID))


# ---------------------------------------------------------------- the same draws in SQL

ROWS_SQL = "(SELECT o_orderkey + 1 AS row_id FROM orders)"


def digits_sql(column: str, count: int, salt: str = "", slot: str = "", table: str = TABLE) -> str:
    name = f"{column}:{salt}" if salt else column
    tail = f" || '|' || {slot}" if slot else ""
    return f"substr(md5('{SEED}|{table}|{name}' || '|' || row_id{tail}), 1, {count})"


def u_sql(column: str, salt: str = "", slot: str = "", table: str = TABLE) -> str:
    number = f"CAST('0x' || {digits_sql(column, 12, salt, slot, table)} AS BIGINT)"
    return f"(CAST({number} AS DOUBLE) / {float(16**12)})"


def int_sql(column, low, high, salt="", slot="", table=TABLE) -> str:
    u = u_sql(column, salt, slot, table)
    return f"CAST(FLOOR({u} * {float(high - low)}) + {low} AS BIGINT)"


def pick_sql(column, pool: Sequence[str], salt="", slot="", table=TABLE) -> str:
    items = ", ".join(f"'{v}'" for v in pool)
    return f"([{items}])[{int_sql(column, 1, len(pool) + 1, salt, slot, table)}]"


def null_sql(column: str, rate: float, value: str, table: str = TABLE) -> str:
    return f"CASE WHEN {u_sql(column, 'null', table=table)} < {rate} THEN NULL ELSE {value} END"


def normal_sql(column: str, table: str = TABLE) -> str:
    radius = f"sqrt(-2.0 * ln(1.0 - {u_sql(column, 'radius', table=table)}))"
    angle = f"cos(6.283185307179586 * {u_sql(column, 'angle', table=table)})"
    return f"ROUND(500.0 + 150.0 * {radius} * {angle}, 2)"


def uniform_sql(column, low=0.0, high=1000.0, slot="", table=TABLE) -> str:
    return f"ROUND({float(low)} + {u_sql(column, slot=slot, table=table)} * {float(high - low)}, 2)"


def time_sql(column, start=V.DATE_RANGE[0], end=V.DATE_RANGE[1], table=TABLE) -> str:
    seconds = f"epoch(TIMESTAMP '{end}') - epoch(TIMESTAMP '{start}')"
    offset = f"CAST(FLOOR({u_sql(column, table=table)} * ({seconds})) AS BIGINT)"
    return f"(TIMESTAMP '{start}' + to_seconds({offset}))"


def status_sql(column, salt="status", slot="", table=TABLE) -> str:
    bound, text = 0.0, "CASE"
    for value, weight in zip(V.ORDER_STATUSES[:-1], V.ORDER_STATUS_WEIGHTS, strict=False):
        bound += weight
        text += f" WHEN {u_sql(column, salt, slot, table)} < {round(bound, 12)} THEN '{value}'"
    return f"{text} ELSE '{V.ORDER_STATUSES[-1]}' END"


def provider_sql(name: str, column: str, slot: str = "", table: str = TABLE) -> str:
    def pick(pool, salt):
        return pick_sql(column, pool, salt, slot, table)

    def number(low, high, salt):
        return int_sql(column, low, high, salt, slot, table)

    def block(size, salt):
        return f"lpad(CAST({number(0, 10**size, salt)} AS VARCHAR), {size}, '0')"

    first, last = pick(V.FIRST_NAMES, "first"), pick(V.LAST_NAMES, "last")
    city = pick(V.CITIES, "city")
    user = f"lower({first}) || lower({last}) || {number(1, 1000, 'number')}"
    uuid = digits_sql(column, 32, "uuid", slot, table)
    url = f"'https://' || {pick(V.WORDS, 'host')} || '.example.com/' || {pick(V.WORDS, 'path')}"
    phone = f"{block(3, 'area')} || '-' || {block(3, 'exchange')} || '-' || {block(4, 'line')}"
    return {
        "first_name": first,
        "last_name": last,
        "name": f"{first} || ' ' || {last}",
        "username": user,
        "email": f"{user} || '@example.com'",
        "city": city,
        "country": pick(V.COUNTRIES, "country"),
        "address": f"{number(1, 1000, 'house')} || ' ' || {pick(V.STREETS, 'street')} || ' St, ' "
        f"|| {city}",
        "phone": phone,
        "mobile": phone,
        "company": f"{last} || ' ' || {pick(V.COMPANY_ENDINGS, 'ending')}",
        "uuid": " || '-' || ".join(
            f"substr({uuid}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        ),
        "url": url,
        "website": url,
        "password": f"'p' || {digits_sql(column, 11, 'password', slot, table)}",
        "word": pick(V.WORDS, "word"),
        "words": f"{pick(V.WORDS, 'word1')} || ' ' || {pick(V.WORDS, 'word2')}",
        "order_status": status_sql(column, "status", slot, table),
    }[name]


def select_sql(**columns: str) -> str:
    listed = ", ".join(f"{text} AS {name}" for name, text in columns.items())
    return f"SELECT row_id, {listed} FROM {ROWS_SQL}"


# ---------------------------------------------------------------- spine and draws


@query("gen_01_row_spine", "SELECT UNNEST(range(1, (SELECT COUNT(*) + 1 FROM orders))) AS row_id")
def gen_01(spark, folder):
    return G.row_spine(spark, scan(spark, folder, "orders").count())


@query("gen_02_uniform_draw", select_sql(u=u_sql("price"), v=u_sql("price", "again")))
def gen_02(spark, folder):
    price = draw("price")
    return spine(spark, folder).select(
        G.ROW_ID, price.uniform().alias("u"), price.uniform("again").alias("v")
    )


@query(
    "gen_03_null_mask",
    select_sql(
        optional=null_sql("optional", 0.05, "row_id"),
        forced=null_sql("forced", 0.4, "row_id"),
        kept="row_id",
    ),
)
def gen_03(spark, folder):
    spec = TableSpec.from_ddl_fields(
        TABLE,
        "row_id BIGINT NOT NULL, optional BIGINT, forced BIGINT NOT NULL, kept BIGINT NOT NULL",
        {
            "row_id": ColumnGen(kind="key"),
            "optional": ColumnGen(kind="key"),
            "forced": ColumnGen(kind="key", null_rate=0.4),
            "kept": ColumnGen(kind="key"),
        },
    )
    return G.generate(spec, spine(spark, folder), SEED, portable=True)


def _columns(spark, folder, **columns):
    return spine(spark, folder).select(G.ROW_ID, *[c.alias(n) for n, c in columns.items()])


@query("gen_04_int_uniform", select_sql(a=int_sql("a", 0, 10000), b=int_sql("b", 1, 999999)))
def gen_04(spark, folder):
    return _columns(
        spark, folder, a=V.integer(draw("a")), b=V.integer(draw("b"), 1, 999999)
    )


@query("gen_05_decimal_normal", select_sql(amount=normal_sql("amount")))
def gen_05(spark, folder):
    return _columns(spark, folder, amount=V.decimal_normal(draw("amount")))


@query("gen_06_decimal_uniform", select_sql(a=uniform_sql("a"), b=uniform_sql("b", -50, 75)))
def gen_06(spark, folder):
    return _columns(
        spark, folder, a=V.decimal_uniform(draw("a")), b=V.decimal_uniform(draw("b"), -50, 75)
    )


@query(
    "gen_07_timestamp_uniform",
    select_sql(a=time_sql("a"), b=time_sql("b", "2020-02-01", "2020-03-01")),
)
def gen_07(spark, folder):
    return _columns(
        spark, folder,
        a=V.timestamp(draw("a")), b=V.timestamp(draw("b"), "2020-02-01", "2020-03-01"),
    )


@query("gen_08_bool_coin", select_sql(flag=f"{u_sql('flag')} < 0.5"))
def gen_08(spark, folder):
    return _columns(spark, folder, flag=V.coin(draw("flag")))


@query("gen_09_word_text", select_sql(note=provider_sql("word", "note")))
def gen_09(spark, folder):
    return _columns(spark, folder, note=V.word(draw("note")))


@query("gen_10_weighted_category", select_sql(status=status_sql("status")))
def gen_10(spark, folder):
    return _columns(spark, folder, status=V.order_status(draw("status")))


@query("gen_11_pool_category", select_sql(country=provider_sql("country", "country")))
def gen_11(spark, folder):
    return _columns(spark, folder, country=V.country(draw("country")))


PROVIDER_NAMES = V.EXACT_HINTS


@query(
    "gen_12_provider_values",
    select_sql(**{f"v_{n}": provider_sql(n, f"v_{n}") for n in PROVIDER_NAMES}),
)
def gen_12(spark, folder):
    return _columns(
        spark, folder, **{f"v_{n}": V.PROVIDERS[n](draw(f"v_{n}")) for n in PROVIDER_NAMES}
    )


@query(
    "udf_01_register_provider",
    """WITH ids AS (SELECT o_orderkey + 1 AS row_id FROM orders)
SELECT row_id, 'C' || row_id AS native, 'c' || reverse(CAST(row_id AS VARCHAR)) AS vectorised FROM ids""",
)
def udf_01(spark, folder):
    """Providers of the caller's own: one of built-in functions, one vectorised over Arrow batches."""

    @F.pandas_udf("string")
    def backwards(ids: pd.Series) -> pd.Series:
        return "c" + ids.astype(str).str[::-1]

    V.register_provider("coded", lambda draw: F.concat(F.lit("C"), draw.row.cast("string")))
    V.register_provider("backwards", lambda draw: backwards(draw.row))
    table = TableSpec.from_ddl_fields(
        "coded", "row_id BIGINT NOT NULL, native STRING NOT NULL, vectorised STRING NOT NULL",
        {"row_id": ColumnGen(kind="key"), "native": ColumnGen(provider="coded"),
         "vectorised": ColumnGen(provider="backwards")},
    )
    return G.generate(table, spine(spark, folder), SEED)


HINTED = {
    "contact_email": "email",
    "phone": "phone",
    "home_phone": "phone",
    "fname": "first_name",
    "lname": "last_name",
    "product_name": "name",
    "billing_address": "address",
    "city_id": "city",
    "country": "country",
    "company_title": "company",
    "site_url": "url",
    "status": "order_status",
    "row_guid": "uuid",
    "comment": "word",
}


@query(
    "gen_13_name_hint_dispatch",
    select_sql(
        **{n: null_sql(n, 0.05, provider_sql(p, n)) for n, p in HINTED.items()}
    ),
)
def gen_13(spark, folder):
    fields = ", ".join(f"{name} STRING" for name in HINTED)
    spec = TableSpec.from_ddl_fields(
        TABLE, f"row_id BIGINT NOT NULL, {fields}", {"row_id": ColumnGen(kind="key")}
    )
    return G.generate(spec, spine(spark, folder), SEED, portable=True)


@query(
    "gen_14_mapping_override",
    select_sql(
        email=null_sql("email", 0.05, provider_sql("uuid", "email")),
        city=null_sql("city", 0.05, provider_sql("word", "city")),
        score=null_sql("score", 0.0, int_sql("score", 1, 100)),
        price=null_sql("price", 0.2, uniform_sql("price", 5, 10)),
        due=null_sql("due", 0.05, f"CAST({time_sql('due', '2024-01-01', '2024-02-01')} AS DATE)"),
        company=null_sql("company", 0.5, provider_sql("company", "company")),
    ),
)
def gen_14(spark, folder):
    spec = TableSpec.from_ddl_fields(
        TABLE,
        "row_id BIGINT NOT NULL, email STRING, city STRING, score BIGINT NOT NULL, price DOUBLE, "
        "due DATE, company STRING",
        {
            "row_id": ColumnGen(kind="key"),
            "email": ColumnGen(provider="uuid", kind="numeric"),
            "city": ColumnGen(kind="text"),
            "score": ColumnGen(kind="numeric", minimum=1, maximum=100),
            "price": ColumnGen(kind="decimal", minimum=5, maximum=10, null_rate=0.2),
            "due": ColumnGen(kind="date", start_date="2024-01-01", end_date="2024-02-01"),
            "company": ColumnGen(null_rate=0.5),
        },
    )
    return G.generate(spec, spine(spark, folder), SEED, portable=True)


# ---------------------------------------------------------------- nested values


def _one(spark, folder, column, data_type, gen=ColumnGen()):
    declared = T.StructType.fromDDL(f"c {data_type}")["c"].dataType
    value = G.complex_value(draw(column), declared, gen)
    return spine(spark, folder).select(G.ROW_ID, value.alias(column))


@query(
    "gen_15_struct_gen",
    select_sql(
        name=provider_sql("name", "buyer.name"),
        age=int_sql("buyer.age", 0, 10000),
        balance=uniform_sql("buyer.balance"),
        tier=provider_sql("word", "buyer.tier"),
        active=f"{u_sql('buyer.active')} < 0.5",
    ),
)
def gen_15(spark, folder):
    shape = "STRUCT<name: STRING, age: BIGINT, balance: DOUBLE, tier: STRING, active: BOOLEAN>"
    return _one(spark, folder, "buyer", shape).select(G.ROW_ID, "buyer.*")


def _exploded_sql(column: str, bounds, salt: str, **values: str) -> str:
    size = int_sql(column, bounds[0], bounds[1] + 1, salt)
    listed = ", ".join(f"{text} AS {name}" for name, text in values.items())
    slots = f"SELECT row_id, UNNEST(range(1, {size} + 1)) AS slot FROM {ROWS_SQL}"
    return f"SELECT row_id, slot, {listed} FROM ({slots})"


@query(
    "gen_16_array_gen",
    _exploded_sql("tags", (0, 5), "length", tag=provider_sql("word", "tags", "slot")),
)
def gen_16(spark, folder):
    tags = _one(spark, folder, "tags", "ARRAY<STRING>", ColumnGen(length_range=(0, 5)))
    listed = tags.select(G.ROW_ID, F.posexplode("tags").alias("place", "tag"))
    return listed.select(G.ROW_ID, (F.col("place") + 1).cast("bigint").alias("slot"), "tag")


@query(
    "gen_17_array_of_struct_gen",
    _exploded_sql(
        "items", (1, 5), "length",
        quantity=int_sql("items.quantity", 0, 10000, slot="slot"),
        unit_price=uniform_sql("items.unit_price", slot="slot"),
        city=provider_sql("city", "items.city", "slot"),
    ),
)
def gen_17(spark, folder):
    shape = "ARRAY<STRUCT<quantity: BIGINT, unit_price: DOUBLE, city: STRING>>"
    items = _one(spark, folder, "items", shape)
    listed = items.select(G.ROW_ID, F.posexplode("items").alias("place", "item"))
    place = (F.col("place") + 1).cast("bigint").alias("slot")
    return listed.select(G.ROW_ID, place, "item.*")


MAP_SLOTS_SQL = _exploded_sql(
    "notes", (2, 9), "size",
    key=provider_sql("word", "notes.key", "slot"),
    value=provider_sql("word", "notes.value", "slot"),
)


@query(
    "gen_18_map_gen",
    f"""SELECT row_id, key, arg_max(value, slot) AS value FROM ({MAP_SLOTS_SQL})
GROUP BY row_id, key""",
)
def gen_18(spark, folder):
    notes = _one(spark, folder, "notes", "MAP<STRING, STRING>", ColumnGen(size_range=(2, 9)))
    return notes.select(G.ROW_ID, F.explode("notes").alias("key", "value"))


@query(
    "gen_19_json_encoding",
    select_sql(
        pair="'{\"city\":\"' || " + provider_sql("city", "pair.city") + " || '\",\"lucky\":' || "
        + int_sql("pair.lucky", 0, 10000) + " || '}'",
    ),
)
def gen_19(spark, folder):
    spec = TableSpec.from_ddl_fields(
        TABLE,
        "row_id BIGINT NOT NULL, pair STRUCT<city: STRING, lucky: BIGINT> NOT NULL",
        {"row_id": ColumnGen(kind="key")},
    )
    return G.generate(spec, spine(spark, folder), SEED, as_json=True, portable=True)


# ---------------------------------------------------------------- tables


def _customers_sql() -> str:
    def at(name, provider, size, rate=0.05):
        value = f"substr({provider_sql(provider, name, table='customers')}, 1, {size})"
        return f"{null_sql(name, rate, value, 'customers')} AS {name}"

    signup = f"CAST({time_sql('signup_date', table='customers')} AS DATE)"
    created = time_sql("created_at", table="customers")
    return f"""SELECT CAST(row_id AS INT) AS customer_id, {at("first_name", "first_name", 50)},
  {at("last_name", "last_name", 50)}, {at("email", "email", 100)}, {at("phone", "phone", 30)},
  {at("address", "address", 255, 0.02)}, {at("city", "city", 50)}, {at("country", "country", 50)},
  {null_sql("signup_date", 0.05, signup, "customers")} AS signup_date,
  {null_sql("created_at", 0.05, created, "customers")} AS created_at
FROM (SELECT c_custkey + 1 AS row_id FROM customer)"""


@query("gen_20_generate_table", _customers_sql())
def gen_20(spark, folder):
    rows = spine(spark, folder, "customer", "c_custkey")
    return G.generate(G.BASE_SPECS["customers"], rows, SEED, portable=True)


@query(
    "gen_20_generate_nested",
    f"""SELECT row_id AS order_id,
  {status_sql("status", table="ecommerce_orders")} AS status,
  {provider_sql("name", "customer.name", table="ecommerce_orders")} AS buyer,
  {provider_sql("city", "shipping_address.city", table="ecommerce_orders")} AS city,
  {int_sql("order_items", 1, 6, "length", table="ecommerce_orders")} AS items,
  {null_sql("tags", 0.05, int_sql("tags", 2, 6, "length", table="ecommerce_orders"), "ecommerce_orders")}
    AS tags FROM {ROWS_SQL}""",
)
def gen_20_nested(spark, folder):
    spec = TableSpec(
        G.NESTED_SPEC.name,
        G.NESTED_SPEC.fields,
        {**G.NESTED_SPEC.mappings, "order_id": ColumnGen(kind="key")},
    )
    made = G.generate(spec, spine(spark, folder), SEED, as_json=False, portable=True)
    return made.select(
        F.col("order_id").cast("bigint").alias("order_id"),
        "status",
        F.col("customer.name").alias("buyer"),
        F.col("shipping_address.city").alias("city"),
        F.size("order_items").cast("bigint").alias("items"),
        F.when(F.col("tags").isNotNull(), F.size("tags").cast("bigint")).alias("tags"),
    )


@query(
    "gen_21_generate_tables",
    """SELECT 2 AS run_id, 'customers' AS table_name, COUNT(*) AS row_count, 10 AS column_count, 42 AS seed,
  TRUE AS success, 'success' AS status, COUNT(*) AS stored FROM customer
UNION ALL SELECT 3, 'orders', COUNT(*), 6, 42, TRUE, 'success', COUNT(*) FROM orders
UNION ALL SELECT 4, 'products', COUNT(*), 4, 42, TRUE, 'success', COUNT(*) FROM part
UNION ALL SELECT 1, 'broken', NULL, NULL, 42, FALSE, 'failed', NULL""",
)
def gen_21(spark, folder):
    rows = {
        "customers": scan(spark, folder, "customer").count(),
        "orders": scan(spark, folder, "orders").count(),
        "products": scan(spark, folder, "part").count(),
    }
    broken = TableSpec.from_ddl_fields("broken", "a STRING", {"a": ColumnGen(provider="nobody")})
    base = scratch_path(spark, "generated")
    store = HistoryStore(spark, scratch_path(spark, "generation_history"))
    G.generate_tables(spark, [*G.BASE_SPECS.values(), broken], base, rows, SEED, record=store.log_generation)
    log = store.generations().withColumns(
        {"run_id": F.col("run_id").cast("int"), "row_count": F.col("row_count").cast("bigint")}
    )
    stored = [
        spark.read.parquet(f"{base}/{name}").agg(F.count("*").alias("stored")).select(
            F.lit(name).alias("table_name"), "stored"
        )
        for name in rows
    ]
    counted = stored[0].unionAll(stored[1]).unionAll(stored[2])
    return log.join(counted, "table_name", "left").select(
        "run_id", "table_name", "row_count", "column_count", "seed", "success", "status", "stored"
    )


@query(
    "gen_21_foreign_keys",
    "SELECT COUNT(*) AS customers, TRUE AS all_known, TRUE AS spread_out FROM customer",
)
def gen_21_keys(spark, folder):
    """Orders generated along with as many customers as the table has belong to all of those."""
    customers = scan(spark, folder, "customer").count()
    rows = {"customers": customers, "orders": scan(spark, folder, "orders").count()}
    base = scratch_path(spark, "generated")
    specs = [G.BASE_SPECS["customers"], G.BASE_SPECS["orders"]]
    G.generate_tables(spark, specs, base, rows, SEED)
    ids = spark.read.parquet(f"{base}/customers").select("customer_id").distinct()
    named = spark.read.parquet(f"{base}/orders").select("customer_id").dropna().distinct()
    met = named.join(ids.withColumn("known", F.lit(True)), "customer_id", "left")
    return met.agg(
        F.lit(customers).cast("bigint").alias("customers"),
        F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"),
        (F.count("*") > 0.8 * customers).alias("spread_out"),
    )


@query(
    "gen_22_table_profile",
    """SELECT 'part' AS table_name, (SELECT COUNT(*) FROM part) AS rows, 3 AS column_count,
  'p_partkey, p_name, p_size' AS columns,
  '["' || string_agg(replace('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name
    || '","p_size":' || p_size || '}', '"', '\\"'), '","' ORDER BY p_partkey) || '"]' AS first_rows
FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 3)""",
)
def gen_22(spark, folder):
    parts = scan(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    return G.table_profile(parts, "part", ["p_partkey"])
