"""The stages against plain versions of themselves, and the SQL of those that have it."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from symloom.llm import op3_pack, op4_quality, op8_secrets
from symloom.llm import queries as corpus
from tests.llm.common import documents, odd, prose
from tests.llm.test_operators import best_fit, groups, leaks, near_corpus

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]


@pytest.fixture
def folder(spark, tmp_path):
    docs = near_corpus() + [(3000 + i, "BUY!! NOW!! " * (4 + i)) for i in range(20)] + [(4000, prose(8, 70) + " " + prose(600, 30) + " " + prose(9, 40)), (4001, prose(10, 60) + " password=hunter2hunter2 " + prose(11, 40))] + odd()
    documents(spark, docs).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(600, 30)), (2, prose(601, 30))], "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(d, int(not (t or "").startswith("BUY")), 0) for d, t in docs if d is not None and d % 2 == 0]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    """Each stage on all that the one before kept, as plain code would do it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = op4_quality.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    keep = model.keep(model.judge(pa.array([t for _, t in rows], pa.string())), len(rows))
    rows = [r for r, k in zip(rows, keep) if k]
    assert not any((t or "").startswith("BUY") for _, t in rows)
    once = groups(rows, texts=True) + [(d, t) for d, t in rows if d is None or t is None]  # different texts of a doc_id are judged each
    found = {d for d, *_ in leaks(once, [(1, prose(600, 30)), (2, prose(601, 30))])}
    clean = [(d, t) for d, t in once if d not in found]
    assert found == {4000}
    clean = [(d, t.replace("password=hunter2hunter2", "[assigned_secret]") if t else t) for d, t in clean]
    want = best_fit([len(t.encode()) for _, t in clean if t], op3_pack.CAPACITY)
    got = corpus_pipeline.run(spark, folder).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r.length)
    assert Counter(map(sum, bins.values())) == want
    assert {r.doc_id for r in got} == {d for d, t in clean if t}


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_sql_says_the_same(spark):
    """The operators that SQL can express, over whole small tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    assert set(corpus.oracle_sql()) >= {"op1_decontaminate", "op5_hamming", "op8_secrets", "op9_suffix_dedup", "warc_records"}
    for name, sql in corpus.oracle_sql().items():
        df = corpus.queries()[name](spark, "/root/testdata/sf0.001")
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        text = lambda row: tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row)
        want = sorted(text(r[names.index(c)] for c in sorted(names)) for r in result.fetchall())
        assert sorted(text(r[c] for c in sorted(df.columns)) for r in df.collect()) == want, name
    assert op8_secrets.SQL
