"""Near-duplicate detection: ProbMinHash signatures of weighted shingles, banding, exact verification.

A document is the multiset of its 3-word shingles, weighted by their counts. ProbMinHash gives each shingle a Poisson process with a rate of
its weight; arrivals fall on random registers, a register keeps its first arrival, and a shingle stops as soon as its next
arrival comes after the latest of the registers. Two documents agree in a register with a probability of their probability
Jaccard similarity J_P. Registers go into bands; documents that share a band are candidates, and J_P is computed exactly from
the shingles of both texts before they count as near duplicates.

Every candidate pair is either verified or already within one group: first each member of a band is compared with the least member of its
candidate component, then, as long as that unites much, with the least one of another group, and at last all members of a band that are still in
different groups with each other, block by block. There is no cap on any. Equal texts are one node from the start, so thousands of exact
copies cost one signature, and bands are never gathered: their least members come from combined aggregates.

Nulls: a null text isn't compared with anything; a row with a null doc_id can't be named and is in no group. Empty texts are equal texts.
Texts of 1 or 2 words have one shingle, the whole text; texts without words are compared by equality only. Very long texts are signed whole.
Different texts of one doc_id are in groups of their own. Of a group the text with the least (doc_id, digest) stays, so ties are settled.
Other columns are not looked at in the query and carried in the stage. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.store import BROADCAST_IDS, drop_path, lookup, table, with_ids, written
from symloom.llm.words import SLICE_ROWS, cuts, mix, shingles, slices, words

K, REGISTERS, ROWS, THRESHOLD = 3, 90, 3, 0.45
#: Nodes of a block where all pairs of a band that are in different groups meet.
BLOCK = 512


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def weighted(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) and their counts, in order of documents and shingles; shingles keep 51 bits of their hash, beside 13 of the document."""
    assert len(first) <= 2 * SLICE_ROWS + 1
    key = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first)) << np.uint64(51)
    key |= hashes >> np.uint64(13)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> np.uint64(51)).astype(np.int64), key[at] & np.uint64((1 << 51) - 1), np.diff(np.append(at, len(key)))


def signatures(hashes: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """A row of registers for each document: the shingle that arrived first in each; 0 where a document has none."""
    n = len(first) - 1
    best, who = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    doc, shingle, count = weighted(hashes, first)
    rate, state, time = count.astype(np.float64), shingle.copy(), np.zeros(len(doc))
    while len(doc):
        # the next arrival of every shingle whose process still matters
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(uniform(state)) / rate
        latest = best.reshape(n, registers).max(axis=1)
        on = time < latest[doc]
        doc, shingle, rate, state, time = doc[on], shingle[on], rate[on], state[on], time[on]
        at = doc * registers + ((mix(state ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, at, time)
        won = time == best[at]
        who[at[won]] = shingle[won]
    return who.reshape(n, registers)


def similarity(a: str, b: str, k: int = K) -> float:
    """Probability Jaccard of the shingle counts of two texts."""
    h, first = shingles(*words(pa.array([a, b], pa.string())), k, short=True)
    return float(pair_similarity(h, first)[0])


def pair_similarity(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """J_P of documents 0 and 1, 2 and 3, and so on: the sum over shared shingles x of 1 / sum_y max(a_y / a_x, b_y / b_x)."""
    doc, shingle, count = weighted(hashes, first)
    n = (len(first) - 1) // 2
    pair, side = doc // 2, doc % 2
    order = np.lexsort((side, shingle, pair))
    pair, side, shingle, count = pair[order], side[order], shingle[order], count[order].astype(np.float64)
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (shingle[1:] != shingle[:-1])
    key = np.cumsum(new) - 1
    a, b = np.zeros(key[-1] + 1 if len(key) else 0), np.zeros(key[-1] + 1 if len(key) else 0)
    a[key[side == 0]], b[key[side == 1]] = count[side == 0], count[side == 1]
    of, out = pair[new], np.zeros(n)
    cut = np.searchsorted(of, np.arange(n + 1))
    for p in range(n):
        x, y = a[cut[p] : cut[p + 1]], b[cut[p] : cut[p + 1]]
        both = (x > 0) & (y > 0)
        if both.any():
            # max(a_y / a_x, b_y / b_x) is a_y / a_x where a_y / b_y >= a_x / b_x: sort by that ratio, then prefix sums
            ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
            o = np.argsort(ratio, kind="stable")
            ca, cb, r = np.concatenate([[0], np.cumsum(x[o])]), np.concatenate([[0], np.cumsum(y[o])]), ratio[o]
            i = np.searchsorted(r, ratio[both])
            out[p] = (1 / ((ca[-1] - ca[i]) / x[both] + cb[i] / y[both])).sum()
    return out


def bands(texts: DataFrame, k: int, registers: int, rows: int) -> DataFrame:
    """Rows (band, node) for nodes with texts: a band is a hash of its number and its registers."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                h, first = shingles(*words(part.column(1)), k, short=True)
                some = np.diff(first) > 0
                sign = signatures(h, first, registers)[some]
                node = part.column(0).to_numpy(zero_copy_only=False)[some]
                for b in range(registers // rows):
                    key = np.full(len(sign), b + 1, np.uint64)
                    for j in range(b * rows, (b + 1) * rows):
                        key = mix(key ^ sign[:, j])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], ["band", "node"])

    return texts.select("node", "text").mapInArrow(run, "band bigint, node bigint")


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b), with their J_P, that reach the threshold; a text is moved only if it is in a pair."""
    needed, path = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    some, text_path = written(with_ids(texts, needed, "node", "left_semi"), "needed-texts")
    sides = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            sizes = [np.asarray(pa.compute.binary_length(batch.column(j)), np.int64) for j in (2, 3)]
            for i, j in cuts(sizes[0] + sizes[1]):
                part = batch.slice(i, j - i)
                both = pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(np.arange(2 * (j - i)).reshape(2, -1).T.ravel()))
                value = pair_similarity(*shingles(*words(both), k, short=True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(value)], ["a", "b", "similarity"]).filter(pa.array(value >= threshold))

    found, _ = written(sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "verified")
    drop_path(pairs.sparkSession, path)
    drop_path(pairs.sparkSession, text_path)
    return found


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for all nodes of the edges (a, b): label is the least node of the component.

    Large-star and small-star steps in turn, each pair written to the shared folder, until all edges lead to the least node of their component; the
    rounds grow with the logarithm of the longest path. The least neighbour of a node is an aggregate that is combined before it is shuffled,
    and joined back to the edges: the neighbours of a hub never meet in one task.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not starred(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large-star: a greater neighbour's edge goes to the least neighbour
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: what a node has left is linked to its least
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after, after_path = written(small, "edges")
        drop_path(spark, path)
        now, path = after, after_path
    return labelled(now.select(F.col("v").alias("a"), F.col("u").alias("b")))


def starred(edges: DataFrame) -> bool:
    """Whether each node of the edges (u, v) that has an edge to a smaller one has one only, and none leads to it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def labelled(stars: DataFrame) -> DataFrame:
    """Rows (node, label) for the nodes of stars (a, b): b has one a, the least node of its component."""
    return stars.select(F.col("b").alias("node"), F.col("a").alias("label")).unionAll(stars.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def split_bands(band: DataFrame, group: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows (band, node, label, lo) of the bands whose nodes are in more than one group, a node in no group being one of its own; how many
    there are, and at most how many pairs."""
    own, _ = written(lookup(band.select("band", "node"), group, "node", "left").select("band", "node", F.coalesce("label", F.col("node")).alias("label")), "labelled")
    mixed, _ = written(own.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "lo", "n"), "mixed")
    n, pairs = mixed.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    return lookup(own, mixed.select("band", "lo"), "band"), n or 0, int(pairs or 0) // 2


def blockwise(split: DataFrame, block: int) -> DataFrame:
    """The pairs (a, b) of a band whose labels differ. A band's nodes are in blocks of about so many, and pairs of blocks meet, so no
    task holds a whole band and no key of the join has more than two blocks."""
    sizes, _ = written(split.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    own = lookup(split.select("band", "node", "label"), sizes, "band").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = own.select("band", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), F.col("node").alias("a"), F.col("label").alias("label_a"))
    right = own.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"), F.col("mine").alias("other"), F.col("node").alias("b"), F.col("label").alias("label_b"))
    return left.join(right, ["band", "mine", "other"]).where("a < b AND label_a <> label_b").select("a", "b").distinct()


def texts_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (doc_id, digest, node, text), repeated ones once, and (digest, node): the node of a text is its doc_id. Of a doc_id with different texts
    each is a node of its own, numbered by a hash; these are rows (node, doc_id, digest) of the third table, None if there are none."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("digest", F.unhex(F.md5("text")))
    digests, _ = written(own.select("doc_id", "digest"), "digests")
    repeated, _ = written(digests.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("n")).where("n > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("several")), "repeated")
    if repeated.isEmpty():
        return own.select("doc_id", "digest", F.col("doc_id").alias("node"), "text"), digests.select("digest", F.col("doc_id").alias("node")), None
    hashed = F.xxhash64("doc_id", "digest")
    node = F.when(F.col("several"), hashed).otherwise(F.col("doc_id")).alias("node")
    numbered = lookup(own, repeated, "doc_id", "left").select("doc_id", "digest", node, "text")
    nodes, _ = written(lookup(digests, repeated, "doc_id", "left").select("digest", node).distinct(), "nodes")
    ids = repeated.select("doc_id")
    once = with_ids(numbered, ids, "doc_id", "left_semi").groupBy("doc_id", "digest", "node").agg(F.first("text").alias("text"))
    named, _ = written(lookup(digests, repeated.where("several"), "doc_id").select(hashed.alias("node"), "doc_id", "digest").distinct(), "named")
    return with_ids(numbered, ids, "doc_id", "left_anti").unionAll(once), nodes, None if named.isEmpty() else named


def groups(docs: DataFrame, k: int = K, registers: int = REGISTERS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, digest, keep_id): a text that goes, and the doc_id of the one that stays of its group, that with the least (doc_id, digest).
    digest is null where all texts of the doc_id are equal."""
    every, nodes, named = texts_of(docs)
    shared, _ = written(nodes.groupBy("digest").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least <> last").select("digest", "least"), "shared")
    copies, _ = written(lookup(nodes, shared, "digest", limit=BROADCAST_IDS // 2).where("node <> least").select("least", "node").distinct(), "copies")
    texts = with_ids(every, copies.select("node"), "node", "left_anti").select("node", "text")
    signed, _ = written(bands(texts, k, registers, rows), "signed")
    common, _ = written(signed.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("band", "a"), "common")
    band, _ = written(lookup(signed, common, "band"), "bands")
    star = band.where("a <> node").select("a", F.col("node").alias("b")).distinct()
    candidate, _ = written(components(star), "candidates")
    edges = verified(candidate.where("label <> node").select(F.col("label").alias("a"), F.col("node").alias("b")), texts, k, threshold)
    group, _ = written(labelled(edges), "groups")  # a pair has the least node of its candidates
    split, left, pairs = split_bands(band, group)
    while pairs > 8 * left:
        # a pass with a new centre for each band: its least node outside the group of its least label
        centre, _ = written(split.where("label <> lo").groupBy("band").agg(F.min(F.struct("node", "label")).alias("c")).select("band", F.col("c.node").alias("c"), F.col("c.label").alias("of")), "centres")
        near = lookup(split.select("band", "node", "label"), centre, "band").where("label <> of").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        edges, _ = written(edges.select("a", "b").unionAll(verified(near, texts, k, threshold).select("a", "b")), "edges")
        group, _ = written(components(edges), "groups")
        before = left
        split, left, pairs = split_bands(band, group)
        if left > 0.8 * before:
            break
    edges = edges.select("a", "b")
    if left:  # what is still apart: all pairs of a band that are in different groups
        rest, _ = written(blockwise(split, BLOCK), "pairs")
        edges = edges.unionAll(verified(rest, texts, k, threshold).select("a", "b"))
    found = components(edges.unionAll(copies.select(F.col("least").alias("a"), F.col("node").alias("b"))))
    none = F.lit(None).cast("binary")
    if named is None:
        return found.where("node <> label").select(F.col("node").alias("doc_id"), none.alias("digest"), F.col("label").alias("keep_id"))
    member, _ = written(lookup(found, named, "node", "left", BROADCAST_IDS // 2).select("label", F.coalesce("doc_id", F.col("node")).alias("doc_id"), "digest"), "members")
    kept, _ = written(member.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("kept")), "kept")
    goes = lookup(member, kept, "label", limit=BROADCAST_IDS // 2).where(~F.struct("doc_id", "digest").eqNullSafe(F.col("kept")))
    return goes.select("doc_id", "digest", F.col("kept.doc_id").alias("keep_id"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """Rows (doc_id, keep_id): a text of doc_id is one of a group of near duplicates of which keep_id, the least doc_id, stays and has no row of its own."""
    return groups(docs, **how).where("doc_id <> keep_id").select("doc_id", "keep_id").distinct()


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, less the texts that are near duplicates of one that stays.

    Different texts of a doc_id are judged each. Of rows with the same doc_id and text the least by their other columns stays; rows with a null
    doc_id or a null text stay.
    """
    gone, _ = written(groups(docs, **how).select("doc_id", "digest").distinct(), "removed")
    kept = with_ids(docs, gone.where("digest IS NULL").select("doc_id"), "doc_id", "left_anti")
    digest = F.unhex(F.md5(F.col("text").cast("string")))
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", digest.alias("digest"))
    twice, _ = written(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    names, alone = docs.columns, with_ids(kept, twice, "doc_id", "left_anti")
    rest = with_ids(kept.where("text IS NOT NULL"), twice, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("id"), digest.alias("of"))
    parts = gone.where("digest IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("digest").alias("of"))
    once = with_ids(rest, parts, ["id", "of"], "left_anti", BROADCAST_IDS // 2).groupBy("id", "of").agg(F.min("row").alias("row")).select("row.*")
    return alone.unionAll(with_ids(kept.where("text IS NULL"), twice, "doc_id", "left_semi")).unionAll(once)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = None
