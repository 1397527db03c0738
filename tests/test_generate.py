"""Generated data: same under any partitioning, with the declared rates, shares and shapes."""

from __future__ import annotations

import dataclasses

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from migraspark.functions import values as V
from migraspark.operators import generate as G
from migraspark.sources.history_store import HistoryStore
from migraspark.operators.generate import ColumnGen, TableSpec


def spec(fields, **mappings):
    return TableSpec.from_ddl_fields("t", fields, mappings)


def made(spark, table, rows=400, parts=3, **options):
    return G.generate(table, G.row_spine(spark, rows, parts), **options)


@pytest.mark.parametrize("portable", [True, False])
def test_partitioning_does_not_matter(spark, portable):
    tables = [
        made(spark, G.NESTED_SPEC, 200, parts, portable=portable).toPandas().to_dict("records")
        for parts in (1, 4, 13)
    ]
    assert tables[0] == tables[1] == tables[2]


def test_seed_and_table_name_matter(spark):
    table = spec("a BIGINT NOT NULL")
    one = made(spark, table, seed=1).collect()
    assert one != made(spark, table, seed=2).collect()
    other = TableSpec("u", table.fields)
    assert one != made(spark, other, seed=1).collect()


@pytest.mark.parametrize("portable", [True, False])
def test_null_rates(spark, portable):
    n = 20000
    table = spec(
        "a INT, b INT NOT NULL, c INT NOT NULL, d INT",
        c=ColumnGen(null_rate=0.3),
        d=ColumnGen(null_rate=0.0),
    )
    counts = made(spark, table, n, portable=portable).agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in "abcd"]
    ).first()
    for name, rate in (("a", 0.05), ("b", 0.0), ("c", 0.3), ("d", 0.0)):
        assert abs(counts[name] - n * rate) <= 4 * math.sqrt(n * rate * (1 - rate))


def test_status_shares(spark):
    n = 20000
    table = spec("status STRING NOT NULL")
    found = {r["status"]: r["count"] for r in made(spark, table, n).groupBy("status").count().collect()}
    assert set(found) == set(V.ORDER_STATUSES)
    for status, share in zip(V.ORDER_STATUSES, V.ORDER_STATUS_WEIGHTS, strict=True):
        assert abs(found[status] - n * share) <= 4 * math.sqrt(n * share * (1 - share))


def test_ranges_and_moments(spark):
    table = spec(
        "i INT NOT NULL, d DECIMAL(10,2) NOT NULL, f BOOLEAN NOT NULL, t TIMESTAMP_NTZ NOT NULL, "
        "x STRUCT<p: DECIMAL(10,2)> NOT NULL"
    )
    row = made(spark, table, 20000, as_json=False).agg(
        F.min("i"), F.max("i"), F.avg("d"), F.stddev("d"), F.avg(F.col("f").cast("int")),
        F.min("t").cast("string"), F.max("t").cast("string"), F.min("x.p"), F.max("x.p"),
    ).first()
    assert row[0] >= 0 and row[1] < 10000 and row[1] > 9900
    assert abs(float(row[2]) - 500) < 5 and abs(float(row[3]) - 150) < 5
    assert abs(row[4] - 0.5) < 0.02
    assert row[5] >= "2023-01-01" and row[6] < "2026-01-01"
    assert float(row[7]) >= 0 and float(row[8]) <= 1000


def test_precedence(spark):
    table = spec(
        "email STRING NOT NULL, city STRING NOT NULL, note STRING NOT NULL",
        email=ColumnGen(provider="uuid", kind="numeric"),
        city=ColumnGen(kind="numeric", minimum=3, maximum=5),
    )
    for row in made(spark, table, 50).collect():
        assert len(row["email"]) == 36 and row["city"] in ("3", "4") and row["note"] in V.WORDS


def test_hints():
    hinted = {
        "email": "email", "phone_id": "phone", "company": "company", "work_email": "email",
        "lname": "last_name", "product_name": "name", "username": "username", "status": "order_status",
        "country": "country", "origin_country": None, "website": "website", "record_guid": "uuid",
    }
    assert {name: V.hinted_provider(name) for name in hinted} == hinted


def test_interval_like_names_follow_their_type(spark):
    row = made(spark, spec("point DATE NOT NULL"), 1).first()
    assert row["point"].year in (2023, 2024, 2025)


def test_sizes_and_keys_of_nested_values(spark):
    table = spec(
        "tags ARRAY<STRING> NOT NULL, none ARRAY<INT> NOT NULL, notes MAP<STRING,STRING> NOT NULL",
        tags=ColumnGen(length_range=(2, 5)),
        none=ColumnGen(length_range=(0, 0)),
        notes=ColumnGen(size_range=(20, 20)),
    )
    rows = made(spark, table, 300, as_json=False).collect()
    assert {len(r["tags"]) for r in rows} == {2, 3, 4, 5}
    assert all(r["none"] == [] for r in rows)
    assert all(0 < len(r["notes"]) < 20 for r in rows)


def test_json_text(spark):
    row = made(spark, G.NESTED_SPEC, 5).first()
    assert set(json.loads(row["customer"])) == {"name", "email", "phone", "loyalty_tier"}
    assert 1 <= len(json.loads(row["order_items"])) <= 5


def test_registered_providers(spark):
    @F.pandas_udf("string")
    def shout(u: pd.Series) -> pd.Series:
        return "N" + (u * 10).astype(int).astype(str)

    V.register_provider("shout", lambda draw: shout(draw.uniform()))
    V.register_provider("plus", lambda draw: F.concat(F.lit("+"), draw.integer(0, 9).cast("string")))
    table = spec(
        "a STRING NOT NULL, b STRING NOT NULL",
        a=ColumnGen(provider="shout"), b=ColumnGen(provider="plus"),
    )
    for row in made(spark, table, 20).collect():
        assert row["a"][0] == "N" and row["b"][0] == "+"


def test_base_tables_join(spark):
    customers = made(spark, G.BASE_SPECS["customers"], 3000)
    orders = made(spark, G.BASE_SPECS["orders"], 12000)
    assert customers.select("customer_id").distinct().count() == 3000
    missing = orders.dropna(subset=["customer_id"]).join(customers, "customer_id", "left_anti")
    assert missing.count() == 0


def test_one_bad_table_does_not_stop_the_others(spark, tmp_path):
    bad = spec("a STRING", a=ColumnGen(kind="nonsense"))
    log = G.generate_tables(
        spark, [bad, G.BASE_SPECS["products"]], str(tmp_path), {"products": 7}
    ).collect()
    assert [(r["table_name"], r["success"], r["row_count"]) for r in log] == [
        ("t", False, None), ("products", True, 7),
    ]
    assert "nonsense" in log[0]["error_message"]
    assert spark.read.parquet(f"{tmp_path}/products").count() == 7


def test_references_follow_the_rows_the_table_gets(spark, tmp_path):
    """With orders alone asked for, customers get their default rows and orders name no others; an
    equal copy of the spec behaves alike."""
    copy = dataclasses.replace(G.BASE_SPECS["orders"])
    for k, specs in enumerate(([G.BASE_SPECS["customers"], G.BASE_SPECS["orders"]], [copy, G.BASE_SPECS["customers"]])):
        base = f"{tmp_path}/{k}"
        G.generate_tables(spark, specs, base, {"orders": 5000})
        customers = spark.read.parquet(f"{base}/customers")
        orders = spark.read.parquet(f"{base}/orders").dropna(subset=["customer_id"])
        assert customers.count() == G.ROWS_WHEN_UNSPECIFIED
        assert orders.join(customers, "customer_id", "left_anti").count() == 0
        assert orders.select("customer_id").distinct().count() > 900


def test_generation_history_is_appended(spark, tmp_path):
    store = HistoryStore(spark, f"{tmp_path}/history")
    bad = spec("a STRING", a=ColumnGen(kind="nonsense"))
    for k in range(2):
        G.generate_tables(
            spark, [G.BASE_SPECS["products"], bad], f"{tmp_path}/{k}", {"products": 3}, record=store.log_generation
        )
    found = sorted((r.run_id, r.table_name, r.status, r.row_count) for r in store.generations().collect())
    assert found == [
        (1, "products", "success", 3), (2, "t", "failed", None), (3, "products", "success", 3), (4, "t", "failed", None),
    ]


def test_overrides_from_a_file(spark, tmp_path):
    path = tmp_path / "overrides.json"
    path.write_text('{"column_mappings": {"n": {"kind": "numeric", "minimum": 5, "maximum": 6}, "w": {"length_range": [2, 3]}}}')
    found = G.read_overrides(spark, str(path))
    assert found == {"n": ColumnGen(kind="numeric", minimum=5, maximum=6), "w": ColumnGen(length_range=(2, 3))}
    table = G.TableSpec.from_ddl_fields("t", "n INT NOT NULL", {"n": found["n"]})
    assert {r["n"] for r in made(spark, table, 20).collect()} <= {5, 6}
    path.write_text('{"column_mappings": {"n": {"no_such_field": 1}}}')
    with pytest.raises(TypeError):
        G.read_overrides(spark, str(path))
