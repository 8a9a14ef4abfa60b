"""Repeated passages by merging shard Burrows-Wheeler transforms with iterative interleave refinement.

Texts are sequences of words. Shards get a suffix order and a Burrows-Wheeler transform each; the transforms are merged without sorting
suffixes again: the interleave of the shards starts as one block and is refined a word at a time. In step h every block holds the suffixes that agree in
their first h words; a suffix moves within its block by where the suffix that follows it stood before, which merges runs that each
shard has in order already. Where neighbours part in step h + 1 their common prefix is h words. Blocks of one suffix are settled and drop
out. What is still together after MIN_WORDS steps are the repeated intervals.

To spread the work, only what can repeat is merged, and where it can be compared: of every window of MIN_WORDS words the least
hash of its K-word runs is its anchor, so equal windows have equal anchors. Anchors that occur once are in no repeat. For the
others, the run of windows with that anchor is a segment; segments with the same anchor go to the same task, equal segments once. This
loses nothing: each window lies in exactly one segment, and all equal windows meet in one task. An anchor with more than TASK_SEGMENTS different
segments would make that task large: its windows are compared each by their hashes instead, which is as exact. A task takes its anchors in order and
merges so many at a time as have MERGE_WORDS words, so its memory is that of these, or of the largest anchor, and not of all it has.

Result: one row for each place of a passage of at least MIN_WORDS words that occurs in two documents or more: (doc_id, start_word, n_words,
first_doc_id); first_doc_id is the least doc_id with the passage. Copies of a whole text get one row each, the first one too.

Nulls: rows with a null doc_id or text take no part. Empty and short texts have no passage, very long ones are read whole. Passages that only one
document has, at several places, are reported with within=True; the query asks for those of several documents. Repeated rows count once; rows
that share a doc_id are one document with several texts. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.store import BROADCAST_IDS, drop_path, lookup, table, with_ids, written
from symloom.llm.words import WORD_SQL, mix, shingles, slices, words

MIN_WORDS, K = 50, 8
#: Segments that are merged in one task, and words of a shard.
TASK_SEGMENTS, SHARD_WORDS = 16_000, 262_144
#: Words that a task merges at once if no anchor has more; bytes of text that it takes apart at once.
MERGE_WORDS, TEXT_BYTES = 2 * SHARD_WORDS, 500_000
#: No document.
NONE = np.iinfo(np.int64).min


def windows(hashes: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts that begin at at: text, first window, windows, anchor hash. Windows count from the text's first word."""
    count = np.maximum(np.diff(at) - length + 1, 0)
    if not count.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    # runs of k words over all words; those that reach into the next text belong to no window
    gram = shingles(hashes, np.array([0, len(hashes)]), k)[0]
    span, least, have = length - k + 1, np.arange(len(gram)), 1
    while have < span:
        step = min(have, span - have)
        left, right = least[: len(least) - step], least[step:]
        least = np.where(gram[right] < gram[left], right, left)
        have += step
    owner = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    anchor = least[at[:-1][owner] + inner]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    return owner[first], inner[first], np.diff(np.append(first, len(owner))), gram[anchor[first]]


class Shard:
    """Suffix order and Burrows-Wheeler transform of some segments. Symbols are from 1; 0 ends a segment, and every end is a symbol of its own."""

    def __init__(self, segments: list[np.ndarray], number: int) -> None:
        size = np.array([len(s) + 1 for s in segments])
        end = np.cumsum(size) - 1
        n = int(size.sum())
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[end] = False
        text[inside] = np.concatenate(segments)
        rank = text + len(segments)
        rank[end] = np.arange(len(segments))
        order, step = np.argsort(rank, kind="stable"), 1
        while True:
            new = np.ones(n, np.int64)
            r = rank[order]
            if step == 1:
                new[1:] = r[1:] != r[:-1]
            else:
                key = keyed[order]
                new[1:] = key[1:] != key[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all():
                break
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:]
            keyed = rank * n + after  # a suffix that step leads out of its segment is settled by then
            order = np.argsort(keyed, kind="stable")
            step *= 2
        # kept in 32 bits each, as many shards are held at once
        self.segment = (np.repeat(np.arange(len(segments)), size)[order] + number).astype(np.int32)
        self.offset = (order - np.repeat(end - size + 1, size)[order]).astype(np.int32)
        before = order - 1
        starts = self.offset == 0
        self.bwt = np.where(starts, 0, text[before]).astype(np.int32)


def merge(shards: list[Shard], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merged order of all rows of the shards (numbered end to end), the common prefix of each with the one before it (most: so many
    words or more), and, of those still in a block with others, row and block."""
    base = np.cumsum([0] + [len(s.bwt) for s in shards])
    n = int(base[-1])
    kind = np.int32 if n < 2**31 else np.int64
    # from the transforms alone: a row's first symbol, and the row of the suffix that follows
    follow = np.concatenate([(np.argsort(s.bwt, kind="stable") + b).astype(kind) for s, b in zip(shards, base)])
    first = np.concatenate([np.sort(s.bwt, kind="stable") for s in shards])
    place, lcp = np.zeros(n, kind), np.full(n, most, np.int32)
    lcp[:1] = 0
    active = np.argsort(first, kind="stable").astype(kind)
    ends = int((first == 0).sum())
    key = first[active]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (key[1:] == 0)
    new[:ends] = True
    del first, key
    at = np.arange(n, dtype=kind)
    place[active] = np.maximum.accumulate(np.where(new, at, kind(0)))
    lcp[at[new]] = 0
    settled = active.copy()  # rows by place
    depth = 1
    while True:
        alone = new & np.append(new[1:], True)
        active, at = active[~alone], at[~alone]
        if depth >= most or not len(active):
            break
        now = place[active]
        key = now.astype(np.int64) * n
        key += place[follow[active]]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        del order
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        del key
        parted = new.copy()
        parted[1:] &= now[1:] == now[:-1]  # places of blocks are as before: only within them rows move
        parted[0] = False
        lcp[at[parted]] = depth
        place[active] = np.maximum.accumulate(np.where(new, at, kind(0)))
        settled[at] = active
        depth += 1
    return settled, lcp, active, place[active]


def repeats(segments: list[np.ndarray], low: np.ndarray, high: np.ndarray, many: np.ndarray, length: int, within: bool = False, shard_words: int = SHARD_WORDS) -> list[tuple[int, int, int, int]]:
    """Runs (segment, first window, windows, least document) of windows that two documents have, or with within of those at two places. low and
    high are the least and greatest document with the segment's text, many says whether it is at several places."""
    symbols = np.unique(np.concatenate(segments), return_inverse=True)[1].astype(np.int32) + np.int32(1)
    cut = np.cumsum([0] + [len(s) for s in segments])
    own = [symbols[a:b] for a, b in zip(cut, cut[1:])]
    shards, a = [], 0
    while a < len(own):
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + shard_words)))
        shards.append(Shard(own[a:b], a))
        a = b
    _, _, row, block = merge(shards, length)
    segment = np.concatenate([s.segment for s in shards])[row]
    offset = np.concatenate([s.offset for s in shards])[row]
    count = np.array([len(s) for s in segments]) - length + 1
    base = np.cumsum(count) - count
    best = np.repeat(np.where((low < high) | (within & many), low, NONE), count)
    if len(row):
        new = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        lo, hi = np.minimum.reduceat(low[segment], new), np.maximum.reduceat(high[segment], new)
        each = np.diff(np.append(new, len(block)))
        best[base[segment] + offset] = np.repeat(np.where((lo < hi) | within, lo, NONE), each)
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), count)
    edge = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])))
    size = np.diff(np.append(edge, len(best)))
    on = best[edge] != NONE
    return list(zip(owner[edge][on].tolist(), (edge - base[owner[edge]])[on].tolist(), size[on].tolist(), best[edge][on].tolist()))


def whole_anchors(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in the order of their anchors as tables of whole anchors: of up to so many words, or one anchor that has more."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([*kept, batch])
        anchor = t.column("anchor").to_numpy()
        end = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1  # the last anchor may go on in the next batch
        size = np.cumsum(np.append(0, pa.compute.binary_length(t.column("words")).to_numpy().astype(np.int64) // 4))
        begin = 0
        while len(end) and size[-1] - size[begin] > most:
            i = max(0, int(np.searchsorted(size[end], size[begin] + most, "right")) - 1)
            yield t.slice(begin, int(end[i]) - begin)
            begin, end = int(end[i]), end[i + 1 :]
        kept = t.slice(begin).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def merged(batches: Iterable[pa.RecordBatch], length: int, within: bool, most: int = MERGE_WORDS) -> Iterator[pa.RecordBatch]:
    """Runs (anchor, c, first, n, least) of repeated windows in segments that come in the order of their anchors."""
    for t in whole_anchors(batches, most):
        body = [np.frombuffer(x, np.uint32) for x in t.column("words").to_pylist()]
        rows = repeats(body, t.column("low").to_numpy(), t.column("high").to_numpy(), t.column("n").to_numpy() > 1, length, within)
        if rows:
            segment, first, n, least = (np.array(x) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(t.column("anchor").to_numpy()[segment]), pa.array(t.column("c").to_numpy()[segment]), pa.array(first), pa.array(n), pa.array(least)], ["anchor", "c", "first", "n", "least"])


def texts_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (node, h, text), equal texts once under the least doc_id, h being a hash of the text; and (doc_id, node, h) for texts of several documents."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    own = own.withColumn("digest", F.unhex(F.md5("text")))
    digests, _ = written(own.select("doc_id", "digest"), "digests")
    shared, _ = written(digests.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "node", "last"), "shared")
    h = F.xxhash64("digest").alias("h")
    rows, _ = written(lookup(digests, shared, "digest").groupBy("doc_id", "node", "last", h).agg(F.count("*").alias("n")), "copies")
    copies = rows.where("node <> last").select("doc_id", "node", "h")
    gone = copies.where("doc_id <> node").select("doc_id", "h")  # a document's other texts stay
    texts = with_ids(own.select("doc_id", h, "text"), gone, ["doc_id", "h"], "left_anti", BROADCAST_IDS // 2)
    again, _ = written(rows.where("n > 1").select("doc_id", "h"), "again")
    if not again.isEmpty():  # repeated rows
        once = with_ids(texts, again, ["doc_id", "h"], "left_semi", BROADCAST_IDS // 2).groupBy("doc_id", "h").agg(F.first("text").alias("text"))
        texts = with_ids(texts, again, ["doc_id", "h"], "left_anti", BROADCAST_IDS // 2).unionAll(once)
    return texts.select(F.col("doc_id").alias("node"), "h", "text"), copies


def compared(once: DataFrame, length: int, within: bool) -> DataFrame:
    """Runs of repeated windows in segments of anchors that have too many of them for a task, as merged ones give them: each window alone, by two hashes
    of its words. Equal windows are combined before they are shuffled, so a passage in any number of surroundings costs a row a task."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "words", TEXT_BYTES):
                body = part.column(2)
                size = np.asarray(pa.compute.binary_length(body), np.int64) // 4
                flat = np.frombuffer(b"".join(body.to_pylist()), np.uint32).astype(np.uint64)
                at = np.concatenate([[0], np.cumsum(size)])
                one, first = shingles(mix(flat + np.uint64(1)), at, length)
                two, _ = shingles(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at, length)
                owner = np.repeat(np.arange(len(size)), np.diff(first))
                take = lambda i: part.column(i).take(pa.array(owner))
                inner = np.arange(len(owner)) - first[:-1][owner]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), take(0), take(1), pa.array(inner), take(3), take(4), take(5)], ["one", "two", "anchor", "c", "first", "low", "high", "n"])

    windows_, _ = written(once.select("anchor", "c", "words", "low", "high", "n").mapInArrow(cut, "one bigint, two bigint, anchor bigint, c bigint, first bigint, low bigint, high bigint, n bigint"), "windows")
    found = windows_.groupBy("one", "two").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.sum("n").alias("places"))
    found, _ = written(found.where("places > 1" if within else "least < most").select("one", "two", "least"), "equal-windows")
    return lookup(windows_, found, ["one", "two"], limit=BROADCAST_IDS // 2).select("anchor", "c", "first", F.lit(1).cast("bigint").alias("n"), "least")


def repeated_passages(docs: DataFrame, length: int = MIN_WORDS, k: int = K, task_segments: int = TASK_SEGMENTS, within: bool = False, hot: int | None = None) -> DataFrame:
    """Rows (doc_id, start_word, n_words, first_doc_id). With within also those of passages that one document has at several places; hot is the number
    of segments from which an anchor's windows are compared each."""
    texts, copies = texts_of(docs)

    def anchors(batches):
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                doc, lo, _, anchor = windows(*words(part.column(2)), length, k)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(lo.astype(np.int32))], ["anchor", "node", "h", "lo"])

    found, path = written(texts.mapInArrow(anchors, "anchor bigint, node bigint, h bigint, lo int"), "anchors")
    common, _ = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "common")
    wanted, _ = written(with_ids(found, common, "anchor", "left_semi").groupBy("node", "h").agg(F.collect_list("lo").alias("los")), "wanted")
    drop_path(docs.sparkSession, path)
    some = with_ids(texts, wanted.select("node").distinct(), "node", "left_semi").join(wanted, ["node", "h"])

    def cut(batches):
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                hashes, at = words(part.column(2))
                doc, lo, n, anchor = windows(hashes, at, length, k)
                los = part.column(3)
                of = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.list_value_length(los), np.int64))
                keep = np.isin(doc << 32 | lo, of << 32 | np.asarray(los.flatten()).astype(np.int64))
                doc, lo, n, anchor = doc[keep], lo[keep], n[keep], anchor[keep]
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                begin = at[doc] + lo
                body = [short[b : b + m].tobytes() for b, m in zip(begin.tolist(), (n + length - 1).tolist())]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(lo.astype(np.int32)), pa.array(body, pa.binary())], ["anchor", "node", "h", "lo", "words"])

    segments = some.select("node", "h", "text", "los").mapInArrow(cut, "anchor bigint, node bigint, h bigint, lo int, words binary")
    segments, _ = written(segments.withColumn("c", F.xxhash64("words", F.lit(1))), "segments")
    # equal segments of an anchor once, combined before they are shuffled
    once, _ = written(segments.groupBy("anchor", "c").agg(F.first("words").alias("words"), F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")), "once")
    full, _ = written(once.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > (hot or task_segments)).select("anchor"), "full-anchors")
    usual, extra = once, None
    if not full.isEmpty():
        usual, extra = with_ids(once, full, "anchor", "left_anti"), compared(with_ids(once, full, "anchor", "left_semi"), length, within)
    tasks = max(1, -(-once.count() // task_segments))

    ordered = usual.repartition(tasks, "anchor").sortWithinPartitions("anchor").select("anchor", "c", "words", "low", "high", "n")
    runs = ordered.mapInArrow(lambda batches: merged(batches, length, within), "anchor bigint, c bigint, first bigint, n bigint, least bigint")
    runs, _ = written(runs if extra is None else runs.unionAll(extra), "runs")
    places = segments.select("anchor", "c", "node", "h", "lo").join(runs, ["anchor", "c"]).select("node", "h", (F.col("lo") + F.col("first")).alias("at"), "n", "least")
    w = Window.partitionBy("node", "h").orderBy("at")
    islands = places.withColumn("new", F.when((F.lag(F.col("at") + F.col("n")).over(w) == F.col("at")) & (F.lag("least").over(w) == F.col("least")), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    passages = islands.groupBy("node", "h", "island").agg(F.min("at").alias("start_word"), (F.sum("n") + (length - 1)).alias("n_words"), F.first("least").alias("first_doc_id"))
    rows = passages.select(F.col("node").alias("doc_id"), F.col("start_word").cast("bigint").alias("start_word"), F.col("n_words").cast("bigint").alias("n_words"), "first_doc_id")

    def sizes(batches):
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(words(part.column(2))[1]))], ["node", "h", "n_words"])

    whole = with_ids(texts, copies.select("node").distinct(), "node", "left_semi").mapInArrow(sizes, "node bigint, h bigint, n_words bigint").where(F.col("n_words") >= length)
    whole = copies.join(whole, ["node", "h"]).select("doc_id", F.lit(0).cast("bigint").alias("start_word"), "n_words", F.col("node").alias("first_doc_id"))
    return rows.unionAll(whole).distinct()


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH t AS (SELECT text, min(doc_id) AS node, max(doc_id) AS last, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY text),
g AS (SELECT text, node, unnest(list_transform(range(0, len(w) - {MIN_WORDS - 1}), lambda i: struct_pack(i := i, s := md5(array_to_string(w[i + 1:i + {MIN_WORDS}], ' ')))), recursive := true) FROM t WHERE len(w) >= {MIN_WORDS}),
l AS (SELECT s, min(node) AS least FROM g GROUP BY s HAVING min(node) < max(node)),
r AS (SELECT text, node, i, least, i - row_number() OVER (PARTITION BY text, least ORDER BY i) AS run FROM g JOIN l USING (s))
SELECT node AS doc_id, min(i)::BIGINT AS start_word, (count(*) + {MIN_WORDS - 1})::BIGINT AS n_words, least AS first_doc_id FROM r GROUP BY text, node, least, run
UNION SELECT d.doc_id, 0, len(w)::BIGINT, node FROM documents d JOIN t USING (text) WHERE node < last AND len(w) >= {MIN_WORDS} AND d.doc_id IS NOT NULL
"""
