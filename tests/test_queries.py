"""Every query against its SQL in DuckDB, and what its plan may look like."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quern.oracles import ORACLES
from quern.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cells(row, order):
    return tuple("" if row[i] is None or isinstance(row[i], float) and math.isnan(row[i]) else round(float(row[i]), 4) if isinstance(row[i], (int, float)) and not isinstance(row[i], bool) else str(row[i]) for i in order)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = sorted(map(str, (cells(r, [got.columns.index(c) for c in sorted(columns)]) for r in got.collect())))
    b = sorted(map(str, (cells(r, [columns.index(c) for c in sorted(columns)]) for r in want.fetchall())))
    assert a == b


ODD_EVENTS = {
    "late in a slot": "SELECT * REPLACE (date_trunc('hour', ts) + to_microseconds(3599999000 + 100 * (event_id % 10)) AS ts) FROM events",
    "no type": "SELECT * REPLACE (CASE WHEN event_id % 7 > 0 THEN event_type END AS event_type) FROM events",
    "no rows": "SELECT * FROM events WHERE false",
}


@pytest.mark.parametrize("kind", ODD_EVENTS)
def test_slots_of_odd_events_equal_sql(spark, duck, tmp_path, kind):
    """half a millisecond before the next slot, rows of no type, and none."""
    duck.execute(f"COPY ({ODD_EVENTS[kind]}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    odd = duckdb.connect()
    odd.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES["hokusai_item_agg"](spark, str(tmp_path)).select("slot", "cells", "n", "col_sum")
    want = odd.execute(f"SELECT slot, cells, n, col_sum FROM ({ORACLES['hokusai_item_agg']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sketched_top_of_many_users_equals_sql(spark, tmp_path):
    """more users in a slot than twice the table's size."""
    odd = duckdb.connect()
    users = "SELECT i AS event_id, TIMESTAMP '2024-01-03' + to_hours(CAST(i % 160 AS INTEGER)) AS ts, hash(i) % 900 AS user_id, 'view' AS event_type FROM range(9000) t(i)"
    odd.execute(f"COPY (SELECT * REPLACE (CAST(user_id AS BIGINT) AS user_id) FROM ({users})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    odd.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES["topk_sketched"](spark, str(tmp_path)).select("key", "estimated_value", "lower_bound", "max")
    assert [tuple(r) for r in got.collect()] == odd.execute(f"SELECT key, estimated_value, lower_bound, max FROM ({ORACLES['topk_sketched']}) ORDER BY 2 DESC, 1").fetchall()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["scan_parquet"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
