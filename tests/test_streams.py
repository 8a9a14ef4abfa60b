"""The change stream, replayed."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from symloom.streaming import watch

CHANGES = [("a.rs", 0.0), ("a.rs", 0.1), ("a.rs", 0.5), ("b.rs", 0.1), (".git/HEAD", 0.1), ("x/target/y.rs", 0.2), ("x/node_modules/y.js", 0.2), ("c/../d.rs", 0.3), ("", 0.1)]


def changes(spark):
    return spark.createDataFrame(CHANGES, "path string, at double").select("path", F.timestamp_micros((F.col("at") * 1_000_000 + 1_700_000_000_000_000).cast("bigint")).alias("ts"))


def test_settling(spark):
    got = sorted((r.path, r.n) for r in watch.debounced(changes(spark)).collect())
    assert got == [("a.rs", 1), ("a.rs", 2), ("b.rs", 1), ("c/../d.rs", 1)]
    assert watch.batch_paths(changes(spark).where(watch.watched(F.col("path")))) == ["a.rs", "b.rs", "c/../d.rs"]


def test_stream(spark, tmp_path):
    rows = [r.asDict() | {"ts": r.ts.isoformat()} for r in changes(spark).collect()]
    source = tmp_path / "changes"
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))
    got = []
    watch.watch(stream, lambda paths, n: got.append(paths), str(tmp_path / "c"), once=True).awaitTermination(120)
    (source / "2.json").write_text('{"path": "later.rs", "ts": "2023-11-14T23:00:00"}\n')
    watch.watch(stream, lambda paths, n: got.append(paths), str(tmp_path / "c"), once=True).awaitTermination(120)
    assert {p for b in got for p in b} == {"a.rs", "b.rs", "c/../d.rs"}  # the last change waits for the watermark


def test_errors_end_the_stream_or_dont(spark, tmp_path):
    source = tmp_path / "changes"
    source.mkdir()
    (source / "1.json").write_text('{"path": "a.rs", "ts": "2023-11-14T22:00:00"}\n')
    (source / "2.json").write_text('{"path": "b.rs", "ts": "2023-11-14T23:00:00"}\n')
    stream = spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(source))

    def broken(paths, n):
        raise ValueError("no")

    watch.watch(stream, broken, str(tmp_path / "on"), once=True, stop_on_error=False).awaitTermination(120)
    with pytest.raises(Exception, match="no"):
        watch.watch(stream, broken, str(tmp_path / "off"), once=True).awaitTermination(120)


def test_a_stream_that_ends(spark, tmp_path):
    source = tmp_path / "changes"
    source.mkdir()
    (source / "1.json").write_text('{"path": "a.rs", "ts": "2023-11-14T22:00:00"}\n{"path": "b.rs", "ts": "2023-11-14T23:00:00"}\n')
    stream = watch.ended(spark.readStream.schema("path string, ts timestamp").json(str(source)), "2024-01-01 00:00:00")
    got = []
    watch.watch(stream, lambda paths, n: got.extend(paths), str(tmp_path / "c"), once=True).awaitTermination(120)
    assert sorted(got) == ["a.rs", "b.rs"]


def test_watching_a_tree(spark, tmp_path, monkeypatch):
    """What was there is taken in; then only what changes is looked at, and an idle tree is left alone."""
    import threading
    import time

    from symloom.index import Index
    from symloom.sources import discover
    from symloom.streaming.tree import watch_tree

    (tmp_path / "a.rs").write_text("fn a() {}\n")
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "gone.rs").write_text("fn gone() {}\n")
    ix = Index(spark, str(tmp_path))
    ix.init()
    seen, listings = [], []
    listing = discover.listed
    monkeypatch.setattr(discover, "listed", lambda *a: listings.append(1) or listing(*a))

    def change(summary) -> None:
        seen.append(summary)
        if len(seen) == 1:
            threading.Thread(target=edit).start()

    def edit() -> None:
        time.sleep(1.5)  # idle
        (tmp_path / "a.rs").write_text("fn a() {}\nfn b() {}\n")
        (tmp_path / "new").mkdir()
        (tmp_path / "new" / "c.rs").write_text("fn c() {}\n")
        (tmp_path / "new" / "notes.txt").write_text("none")
        (tmp_path / "old").rename(tmp_path.parent / "moved-away")

    watch_tree(ix, 200, None, change, 60)
    total = [sum(getattr(s, x) for s in seen[1:]) for x in ("changed", "new", "deleted")]
    assert (seen[0].new, total) == (2, [1, 1, 1]) and len(listings) == 1
    assert ix.find("a::b") and ix.find("new::c::c") and ix.find("gone") is None
