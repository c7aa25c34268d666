"""The search over all kinds of edges: odd tables, and what it writes."""

import uuid
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.plans import bindings, graph_queries, registry

NAME = "jn_06_bounded_subgraph"
DAY = datetime(2024, 1, 1)
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
COLUMNS = {
    "customer": "c_custkey long, c_name string, c_nationkey int", "supplier": "s_suppkey long, s_name string, s_nationkey int", "part": "p_partkey long, p_name string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "conversations": "conv_id long, turn long, role string, text string", "nation": "n_nationkey int, n_name string",
}


@pytest.fixture
def folder(tmp_path, monkeypatch):
    """What the query writes goes below ``shared``."""
    for module in (bindings, graph_queries):
        if hasattr(module, "shared_folder"):
            monkeypatch.setattr(module, "shared_folder", lambda t: f"{tmp_path}/shared/trace-{uuid.uuid4().hex}")
    return tmp_path


def found(spark, folder, tables):
    c = duckdb.connect()
    for name, columns in COLUMNS.items():
        spark.createDataFrame(tables.get(name, []), columns).coalesce(1).write.parquet(f"{folder}/in/{name}.parquet")
        c.execute(f"create view {name} as select * from '{folder}/in/{name}.parquet/*.parquet'")
    got = registry.queries()[NAME](spark, f"{folder}/in")
    cur = c.execute(registry.oracle_sql()[NAME])
    want = cur.fetchall()
    columns = [x[0] for x in cur.description]
    return got, sorted(map(str, map(tuple, got.select(*columns).collect()))), sorted(map(str, want))


def line(order, part, supplier, number, status, price=1.0):
    return (order, part, supplier, number, 1.0, float(price), 0.0, 0.0, "N", status, DAY)


def test_odd_tables(spark, folder):
    """Orders of two customers, of over a thousand lines, and without a number; customers and suppliers of two nations or of none."""
    order = lambda key, customer, priority="4-NOT SPECIFIED", day=0: (key, customer, "F", 1.0, DAY + timedelta(days=day), priority)
    tables = {
        "customer": [(1, "a", 0), (2, "b", 0), (2, "b", 1), (3, "c", None), (4, "d", 1), (5, "e", 7), (None, "f", 0)],
        "supplier": [(10, "s", 0), (10, "s", 1), (11, "s", 0), (12, "s", 1), (None, "s", 1), (13, "s", None), (14, "s", 0)],
        "orders": [order(5, 1), order(5, 2), order(6, 1, day=1), order(7, 4, "1-URGENT"), order(8, 4, day=1), order(None, 3), order(9, 77), order(-3, 5), order(-2, 5, day=1)],
        "lineitem": [line(5, k % 40, 10 + k % 5, k % 7, "OF"[k % 2], k) for k in range(1012)] + [line(6, 1, 14, 1, "F"), line(6, 2, 11, 2, "O"), line(7, 3, None, 1, "F"), line(7, 3, 12, 2, "O")]
        + [line(8, None, 10, 1, "O"), line(None, 4, 10, 1, "O"), line(8, 5, 10, 2, "F"), line(9, 5, 10, 2, "F"), line(-3, 5, 11, 1, "O"), line(-2, 5, 12, 1, "F"), line(-2, 6, 12, 2, "O")],
        "conversations": [(1, 0, "system", "x"), (1, 1, "user", "x"), (None, 2, "system", "x"), (4, None, "system", "x")],
    }
    _, got, want = found(spark, folder, tables)
    assert got == want and len(got) > 1000


def test_what_shared_nodes_lead_to_is_not_written_for_each_run(spark, folder):
    """400 runs of one definition with 600 skills: 240,000 rows come of 1,000."""
    tables = {
        "customer": [(k, "a", 3) for k in range(400)], "supplier": [(k, "s", 3) for k in range(600)],
        "orders": [(k, k, "F", 1.0, DAY, "4-NOT SPECIFIED") for k in range(400)], "lineitem": [line(k, k, 500 + k, 1, "OF"[k % 2]) for k in range(400)],
    }
    df, got, want = found(spark, folder, tables)
    assert got == want and len(got) > 240_000
    files = [str(p) for p in (folder / "shared").rglob("*.parquet")]
    assert 0 < sum(spark.read.parquet(p).count() for p in files) < 20_000
    assert df.where(F.col("node_kind") == 2).count() == 400 * 600 + 300
