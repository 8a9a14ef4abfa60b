"""The index of the star-schema tables: rows as SQL has them for odd tables, and by ways that carry little."""

from __future__ import annotations

import re

import duckdb
import pandas as pd
import pytest

from symloom.operators import resolve
from symloom.plans.queries import QUERIES
from symloom.plans.sql import using
from symloom.sources.projection import Projection, co_partitioned

DAY = pd.Timestamp("2024-01-01")
TABLES = {
    "region": pd.DataFrame({"r_regionkey": [0], "r_name": ["ASIA"]}),
    "nation": pd.DataFrame({"n_nationkey": [0, 1], "n_name": ["N0", "N1"], "n_regionkey": [0, 0]}),
    "customer": pd.DataFrame({"c_custkey": [0, 1, 2], "c_name": ["c0", "c1", "c1"], "c_nationkey": [0, 1, 1]}),
    "supplier": pd.DataFrame({"s_suppkey": [0, 1, 1, 3], "s_name": ["s0", "s1", "s1", "s0"]}),
    "part": pd.DataFrame({"p_partkey": [0, 1, 2, 2], "p_name": ["a b", "c", "d", "d"], "p_brand": ["Brand#1", "Brand#2", "Brand#1", "Brand#1"]}),
    "orders": pd.DataFrame({"o_orderkey": [0, 1, 2, 5, 7, 8], "o_custkey": [0, 1, 2, 99, 1, 1]}),
}
#: Line items without their order, customer, part or supplier, without a number, and twice; orders without any.
LINES = [(0, 0, 0, 0), (0, 0, 0, 0), (0, 1, 1, 1), (0, 2, 2, 3), (1, 3, 0, 1), (1, 3, 0, 1), (1, 4, 2, 0), (2, 5, 9, 0), (3, 1, 0, 0), (5, 1, 0, 0), (7, None, 1, 9), (7, 2, 1, 0), (None, 1, 1, 1), (2, 1, None, 1), (2, 1, 1, None)]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    lines = pd.DataFrame(LINES, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).astype("Int64")
    for name, frame in (TABLES | {"lineitem": lines.assign(l_quantity=1.0, l_extendedprice=2.0, l_shipdate=DAY)}).items():
        frame.to_parquet(at / f"{name}.parquet", coerce_timestamps="us")
    return str(at)


def test_odd_tables(spark, odd):
    con, p = duckdb.connect(), Projection(spark, odd)
    for t in [*TABLES, "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet')")
    for name in ("calls", "types"):
        wanted = con.execute(using(name, f"SELECT * FROM {name}"))
        columns = [d[0] for d in wanted.description]
        got = [tuple(r) for r in getattr(p, name).select(*columns).collect()]
        assert len(got) > 5 and sorted(map(str, got)) == sorted(map(str, wanted.fetchall()))


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_rows_go_to_names_once(spark):
    """Both phases of resolution take one exchange of the rows, beside one of each lookup."""
    p = Projection(spark, "/root/testdata/sf0.001")
    calls, names = p.calls, p.names
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with co_partitioned(spark):
            assert exchanges(resolve.calls(calls, names)) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_edges_are_counted_without_an_order(spark):
    """Edges are read from the resolved tables, and a filter on src reaches what is read."""
    p = Projection(spark, "/root/testdata/sf0.001")
    assert exchanges(p.edges) == 0
    assert re.search(r"Filter [^\n]*caller_symbol_id#\d+L = 1000000007", p.edges.where("src = 1000000007")._jdf.queryExecution().executedPlan().toString())


def test_a_second_run_takes_open_rows_only(spark):
    p = Projection(spark, "/root/testdata/sf0.001")
    plan = resolve.calls(p.resolved_calls, p.names)._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(callee_symbol_id)" in plan and "IsNotNull(callee_symbol_id)" in plan
    assert {r.newly_resolved for r in QUERIES["o30_second_run"](spark, "/root/testdata/sf0.001").collect()} == {0}
