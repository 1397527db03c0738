"""The queries again on tables where one key, value and copy holds a third of the rows."""

from __future__ import annotations

import os
import shutil

import compare
import duckdb
import pytest

from migraspark.catalog import load
from migraspark.operators import skew

QUERIES, ORACLES = load()
CHANGED = {
    # a third of the orders belong to one customer, a third cost the same, a third share a day
    "orders": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey,
        o_orderstatus, CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice ELSE 4500.0 END AS o_totalprice,
        CASE WHEN o_orderkey % 3 = 2 THEN TIMESTAMP '2001-05-05' ELSE o_orderdate END AS o_orderdate,
        o_orderpriority FROM t""",
    # half of all customers live in one country
    "customer": """SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN CAST(3 AS INTEGER)
        ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM t""",
    # a third of the lines are copies of one
    "lineitem": """SELECT * FROM t UNION ALL
        SELECT t.* FROM (SELECT * FROM t LIMIT 1) t, range(3000)""",
    # a third of the events are of one user
    "events": """SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 5 ELSE user_id END AS user_id,
        event_type, value, props FROM t""",
}
NAMES = sorted(
    name for name in QUERIES
    if name.startswith(("wq_", "win_", "joi_", "agg_", "top_", "rec_0", "rec_1", "run_", "prg_", "str_01"))
)


@pytest.fixture(scope="module")
def skewed(tiny, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    connection = duckdb.connect()
    for table in compare.TABLES:
        source = os.path.join(tiny, f"{table}.parquet")
        copy = os.path.join(folder, f"{table}.parquet")
        if table in CHANGED:
            connection.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM read_parquet('{source}')")
            connection.execute(f"COPY ({CHANGED[table]}) TO '{copy}' (FORMAT parquet)")
        else:
            shutil.copyfile(source, copy)
    return folder


@pytest.fixture(scope="module")
def connection(skewed):
    return compare.connect(skewed)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, skewed, connection, monkeypatch, many_partitions):
    assert compare.differences(QUERIES[name](spark, skewed), ORACLES[name], connection) == []
