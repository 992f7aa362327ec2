import math

import duckdb
import pytest

import __spark_entry__ as entry
from tradewind.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return float(f"{value:.9g}") if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    got, names = df.collect(), sorted(df.columns)
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    rows = lambda x: sorted(map(str, x))
    assert rows([plain(r[c]) for c in names] for r in got) == rows([plain(r[k]) for k in at] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_waste_terms_reads_all_days(spark, tmp_path):
    rows = [("2024-01-03 00:00:00", "click", 1, 40.0, 1), ("2024-01-10 00:00:00", "click", 1, 40.0, 1), ("2024-01-03 00:00:00", "click", 2, 90.0, 2), ("2024-01-20 00:00:00", "purchase", 2, 9.0, 2)]
    made = [f"(TIMESTAMP '{ts}', '{kind}', {user}, {value}, '{{\"k\": {k}}}')" for ts, kind, user, value, k in rows]
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {', '.join(made)}) t(ts, event_type, user_id, value, props)) TO '{tmp_path}/events.parquet'")
    got = QUERIES["waste_terms"](spark, str(tmp_path)).collect()
    assert [(r.search_term, r.clicks, r.spend, r.orders) for r in got] == [("term1", 2, 20, 0)]
