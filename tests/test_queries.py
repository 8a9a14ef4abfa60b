"""Every query of the entry file against its SQL, at the smallest scale; and the entry file without the corpus operators."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

from symloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def text(x) -> str:
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in ORACLES:
        result = con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == sorted(tuple(text(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert got


def test_entry_without_the_corpus_operators(tmp_path):
    """Without their folders and the pipeline the entry file lists and runs the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(f"cp -r {root}/symloom {root}/__spark_entry__.py {tmp_path} && rm -rf {tmp_path}/symloom/llm", shell=True, check=True)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession

q, o = e.queries(), e.oracle_sql()
assert len(q) > 50 and set(o) < set(q) and not any(k.startswith("op") or k in ("pipeline", "warc_records") for k in q)
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() == 10 and q["o17_calls"](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "fine" in done.stdout, done.stderr
