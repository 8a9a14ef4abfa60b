"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

The items are partitioned by their number of distinct shingles, class u holding sizes in (u/2, u]; those of at most TINY shingles are looked up
by each of their shingles instead, which misses none. For each other class every
document, whole, is covered by windows of 2u shingles that overlap by u, so an item that occurs in a run of words lies within
one window, and the Jaccard similarity of item and window has a floor that doesn't depend on the document's length. Each class
takes its own banding from that floor. What the bands find is verified against all shingles of the whole document.

Nulls: a null text has no words; a null doc_id or item_id is carried as null. Items with fewer words than a shingle have no
shingle and match nothing. Repeated rows count once; of rows that share a doc_id the highest containment stands. Other columns
of either table are not looked at. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.store import table
from symloom.llm.words import WORD_SQL, mix, shingles, shingles_of, slices, words

K, THRESHOLD, PERMS = 5, 0.6, 48
#: Items whose sketches are sent to the tasks at once; a larger benchmark is searched in as many passes as it takes.
ITEMS_AT_ONCE = 100_000
#: Items of at most so many distinct shingles are looked up by their shingles.
TINY = 4
#: Probability with which a band finds an item at the floor of its class.
RECALL = 0.995
SCHEMA = "doc_id bigint, item_id bigint, containment double"


def floor(threshold: float) -> float:
    """Jaccard similarity of a window of 2u shingles and an item of u/2 of which the threshold's share is in the window."""
    return threshold * 0.5 / (2 + 0.5 - threshold * 0.5)


def rows_per_band(jaccard: float, perms: int, recall: float = RECALL) -> int:
    """The longest bands that still reach the recall at that similarity; one row if none does."""
    return max((r for r in range(1, 9) if 1 - (1 - jaccard**r) ** (perms // r) >= recall), default=1)


def seeds(perms: int) -> np.ndarray:
    return mix(np.arange(1, perms + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Index:
    """Sketches of items by size class: for each class u, its rows per band and, for each band, sorted keys and their items."""

    def __init__(self, ids: list, texts: list, k: int, threshold: float, perms: int) -> None:
        self.ids, self.k, self.threshold, self.perms = ids, k, threshold, perms
        self.sets = [np.unique(shingles_of(t or "", k)) for t in texts]
        classes: dict[int, list[int]] = {}
        tiny = [i for i, s in enumerate(self.sets) if 0 < len(s) <= TINY]
        for i, s in enumerate(self.sets):
            if len(s) > TINY:
                classes.setdefault(1 << math.ceil(math.log2(len(s))), []).append(i)
        self.tiny = sorted_keys(np.concatenate([self.sets[i] for i in tiny]), np.repeat(tiny, [len(self.sets[i]) for i in tiny])) if tiny else None
        self.classes = []
        r = rows_per_band(floor(threshold), perms)
        for u, items in sorted(classes.items()):
            every, first = np.concatenate([self.sets[i] for i in items]), np.cumsum([0] + [len(self.sets[i]) for i in items[:-1]])
            mins = np.array([np.minimum.reduceat(every * a, first) for a in seeds(perms)])
            self.classes.append((u, r, [sorted_keys(key, np.array(items)) for key in band_keys(mins, r)]))

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For shingles of documents that begin at first: documents, items and exact containments of at least the threshold."""
        docs = np.flatnonzero(np.diff(first))
        if len(docs) == 0 or not (self.classes or self.tiny):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        size, begin = np.diff(first)[docs], first[:-1][docs]
        found = [met(self.tiny, hashes, np.repeat(np.arange(len(docs)), size))] if self.tiny else []
        levels = []
        for u, r, bands in self.classes:
            blocks = -(-size // u)
            at = np.concatenate([[0], np.cumsum(blocks)])
            owner = np.repeat(np.arange(len(docs)), blocks)
            inner = np.arange(at[-1]) - at[:-1][owner]
            levels.append((u, r, bands, owner, inner, at, np.concatenate([[False], owner[1:] == owner[:-1]])))
        rows: list[list[np.ndarray]] = [[] for _ in levels]
        for p, a in enumerate(seeds(self.perms) if levels else ()):
            values = hashes * a
            lower_u, lower, lower_at = 1, values, begin
            for n, (u, r, bands, owner, inner, at, joined) in enumerate(levels):
                lower = np.minimum.reduceat(lower, lower_at[owner] + inner * (u // lower_u))
                lower_u, lower_at = u, at[:-1]
                window = lower.copy()
                np.minimum(window[:-1], np.where(joined[1:], lower[1:], window[:-1]), out=window[:-1])
                rows[n].append(window)
                if len(rows[n]) == r:
                    if p // r < len(bands):
                        found.append(met(bands[p // r], next(iter(band_keys(np.array(rows[n]), r))), owner))
                    rows[n] = []
        out = []
        cached = (-1, None)
        for d, i in np.unique(np.concatenate(found), axis=0).tolist():
            if cached[0] != d:
                cached = (d, np.unique(hashes[begin[d] : begin[d] + size[d]]))
            share = np.isin(self.sets[i], cached[1], assume_unique=True).sum() / len(self.sets[i])
            if share >= self.threshold:
                out.append((docs[d], i, share))
        return tuple(np.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (int, int, float)))


def sorted_keys(key: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their items, and which leading 16 bits there are."""
    order = np.argsort(key, kind="stable")
    near = np.zeros(1 << 16, bool)
    near[key >> np.uint64(48)] = True
    return key[order], items[order], near


def met(keys: tuple[np.ndarray, np.ndarray, np.ndarray], mine: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct pairs (owner, item) that have a key in common."""
    key, items, near = keys
    hit = np.flatnonzero(near[mine >> np.uint64(48)])
    lo, hi = np.searchsorted(key, mine[hit]), np.searchsorted(key, mine[hit], side="right")
    on = hi > lo
    lo, n = lo[on], (hi - lo)[on]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(np.stack([np.repeat(owner[hit[on]], n), items[np.repeat(lo, n) + inner]], axis=1), axis=0).astype(np.int64)


def band_keys(mins: np.ndarray, r: int) -> Iterator[np.ndarray]:
    """For minima by permutation and set, one key a set for each full band of r permutations."""
    for b in range(len(mins) // r):
        key = np.zeros(mins.shape[1], np.uint64)
        for x in mins[b * r : (b + 1) * r]:
            key = mix(key ^ x)
        yield key


def indexes(benchmark: DataFrame, k: int, threshold: float, perms: int, at_once: int = ITEMS_AT_ONCE) -> Iterator[Index]:
    """The sketches of the benchmark, so many items at a time; each part holds other items and together they hold all."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    parts = max(1, -(-items.count() // at_once))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        if rows:
            yield Index([x.item_id for x in rows], [x.text for x in rows], k, threshold, perms)


def over_batches(task: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := task(part)) is not None:
                    yield out

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, perms: int = PERMS) -> DataFrame:
    """Rows (doc_id, item_id, containment) for each document that holds at least the threshold's share of an item's shingles.

    One pass over the documents without a shuffle of text; only what was found is grouped.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark, k, threshold, perms):
        sent = spark.sparkContext.broadcast(index)

        def task(part: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            index = sent.value
            d, i, share = index.search(*shingles(*words(part.column(1)), index.k))
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d, pa.int64())), pa.array([index.ids[x] for x in i], pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "containment"])

        found = own.mapInArrow(over_batches(task), SCHEMA)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    return out.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no benchmark item; rows are judged one by one, so a null doc_id is too."""
    spark, schema, place = docs.sparkSession, docs.schema, docs.columns.index("text")
    for index in indexes(benchmark, how.get("k", K), how.get("threshold", THRESHOLD), how.get("perms", PERMS)):
        sent = spark.sparkContext.broadcast(index)

        def task(part: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            d, _, _ = sent.value.search(*shingles(*words(part.column(place)), sent.value.k))
            keep = np.ones(part.num_rows, bool)
            keep[d] = False
            return part.filter(pa.array(keep))

        docs = docs.mapInArrow(over_batches(task), schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, text, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))) AS s FROM dw WHERE len(w) >= {K}),
its AS (SELECT DISTINCT item_id, text, unnest(list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' '))) AS s FROM iw WHERE len(w) >= {K}),
n AS (SELECT item_id, text, count(*) AS n FROM its GROUP BY item_id, text)
SELECT doc_id, item_id, max(c) AS containment FROM (
  SELECT ds.doc_id, its.item_id, its.text, count(*)::DOUBLE / any_value(n.n) AS c
  FROM ds JOIN its USING (s) JOIN n ON n.item_id IS NOT DISTINCT FROM its.item_id AND n.text = its.text
  GROUP BY ds.doc_id, its.item_id, its.text) WHERE c >= {THRESHOLD} GROUP BY doc_id, item_id
"""
