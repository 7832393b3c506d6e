"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from corpusloom.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else str(v) if isinstance(v, (list, dict)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
        return
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr) == want


def test_join_aliases_where_ids_are_aliases(spark, tmp_path):
    """Ids above a million are aliases of others too: each target that a key names counts, but none that is held out."""
    c = duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT * FROM (VALUES (1, 10), (1000001, 44), (2, 50), (1000002, 3), (3, 7), (1000003, 45), (4, NULL), (5, 1)) t(p_partkey, p_size)")
    c.execute("CREATE TABLE lineitem AS SELECT CAST(k AS BIGINT) AS l_partkey, CAST(n AS INTEGER) AS l_linenumber FROM (SELECT unnest([1, 2, 3, 4, 5, 1000001, 1000002, 1000003, NULL]) AS k), range(1, 4) r(n)")
    c.execute("ALTER TABLE part ALTER p_partkey TYPE BIGINT")
    for t in ("part", "lineitem"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = QUERIES["join_aliases"](spark, str(tmp_path)).select("n", "total").collect()
    assert [tuple(r) for r in got] == [tuple(map(int, r)) for r in c.execute(SQL["join_aliases"]).fetchall()]


@pytest.mark.parametrize("orders", ["SELECT o.* FROM o, range(6)", "SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN -o_totalprice WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS o_orderpriority, nullif(o_orderkey, 13) AS o_orderkey) FROM o"])
def test_budget_greedy_of_repeated_and_odd_orders(spark, tmp_path, orders):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW o AS SELECT * FROM read_parquet('{SF}/orders.parquet')")
    c.execute(f"CREATE TABLE orders AS {orders}")
    c.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in QUERIES["budget_greedy"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(c.execute(SQL["budget_greedy"]).fetchall(), key=repr)
