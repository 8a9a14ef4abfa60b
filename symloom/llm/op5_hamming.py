"""Exact top-k search by incremental multi-index hashing over binary codes.

A vector's code has a bit for the sign of each component. Codes are cut into segments of 16 bits, and each segment has an index
from its value to the codes that have it. A query looks up its own segments, then all values one bit away, then two, a segment after
another. With radius r done in the first j + 1 of m segments and r - 1 in the others, every code within distance m r + j has been met
(were it not, all its segments would be further than that), so a query stops as soon as its kth verified distance is covered. Ties
at the kth distance go to the smaller id, which is why those with just that distance must be covered too.

Codes are indexed in blocks, and each block of queries meets each block of codes once: a block of codes is sent as often as there are blocks of
queries, which are large, and the queries stream past the index. The k best of the blocks are merged. Equal codes are asked for
once, and of more than k + 1 equal ones those with the least ids are indexed, so that frequent codes cost no more than others and no
result is lost. A vector isn't its own neighbour.

Nulls: a null vector or vec_id takes no part; a null component, NaN or missing one is bit 0. Vectors that are equal are neighbours at distance 0.
Of rows that share a vec_id one stays (the least code). With fewer than k others there are fewer rows. Other columns are not looked at. An
empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.store import table, written

K, SEGMENT = 10, 16
#: The query's set of vectors to ask for: those whose id is divisible by this, against all.
EVERY = 50
#: Codes and queries that meet in a task; with few queries, so many a task at least.
BLOCK, QUERIES, LEAST_QUERIES = 2_000_000, 1_000_000, 256
#: Candidates that are verified at once.
AT_ONCE = 4_000_000


def codes(vectors: DataFrame, bits: int) -> DataFrame:
    """Rows (vec_id, code): bit i of the code, an array of 64-bit words, says whether component i is above 0."""
    words = []
    for w in range(0, bits, 64):
        word = F.lit(0).cast("bigint")
        for i in range(w, min(bits, w + 64)):
            x = F.get("embedding", F.lit(i))
            word = word.bitwiseOR(F.shiftleft(F.when((x > 0) & ~F.isnan(x), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), i - w))
        words.append(word)
    some = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return some.select("vec_id", F.array(*words).alias("code")).groupBy("vec_id").agg(F.min("code").alias("code"))


class MultiIndex:
    """An index of one block of codes by each segment."""

    def __init__(self, ids: np.ndarray, code: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, self.code = ids[order], code[order]
        self.parts = np.ascontiguousarray(self.code).view(np.uint16).reshape(len(ids), -1)
        self.index = []
        for s in self.parts.T:
            self.index.append((np.argsort(s, kind="stable").astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << SEGMENT))])))

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and distances of the k nearest codes of the block, ties to the smaller id."""
        parts = np.ascontiguousarray(code).view(np.uint16).reshape(len(code), -1)
        m = parts.shape[1]
        far = 64 * code.shape[1] + 1
        # of the block, so ids and places are in the same order: the best so far as distance x size + place
        size = np.int64(len(self.ids))
        best = np.full((len(code), k), far * size, np.int64)
        todo = np.arange(len(code))
        for radius in range(SEGMENT + 1):
            masks = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(SEGMENT), radius)], np.uint16)
            for j in range(m):
                order, offset = self.index[j]
                step = max(1, AT_ONCE // max(1, len(masks) * (1 + len(order) // (1 << SEGMENT))))
                for a in range(0, len(todo), step):
                    q = todo[a : a + step]
                    value = (parts[q, j][:, None] ^ masks).ravel()
                    lo, n = offset[value], offset[value.astype(np.int64) + 1] - offset[value]
                    some = n > 0
                    lo, n, who = lo[some], n[some], np.repeat(q, len(masks))[some]
                    for b, c in self.runs(n):
                        self.verify(code, best, who[b:c], lo[b:c], n[b:c], order, size, k)
                covered = radius * m + j
                todo = todo[best[todo, k - 1] // size > covered]
                if not len(todo):
                    break
            if not len(todo):
                break
        at, rank = np.nonzero(best < far * size)
        return at, self.ids[best[at, rank] % size], best[at, rank] // size

    @staticmethod
    def runs(n: np.ndarray):
        group = np.cumsum(n) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
        return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]

    def verify(self, code, best, who, lo, n, order, size, k) -> None:
        first = np.cumsum(n) - n
        place = order[np.repeat(lo - first, n) + np.arange(n.sum())].astype(np.int64)
        who = np.repeat(who, n)
        distance = np.bitwise_count(self.code[place] ^ code[who]).sum(axis=1, dtype=np.int64)
        key = distance * size + place
        on = key < best[who, k - 1]
        who, key = who[on], key[on]
        if not len(who):
            return
        touched, at = np.unique(who, return_inverse=True)
        # with the k best so far: order by query and key, drop what was met before, keep k
        who = np.concatenate([at, np.repeat(np.arange(len(touched)), k)])
        key = np.concatenate([key, best[touched].ravel()])
        o = np.lexsort((key, who))
        who, key = who[o], key[o]
        full = self.code.shape[1] * 64 + 1
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1]) | (key[1:] == full * size)
        who, key = who[new], key[new]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        on = rank < k
        best[touched[who[on]], rank[on]] = key[on]


def least_ids(code_rows: DataFrame, n: int) -> DataFrame:
    """The n rows of each code with the least ids: of more equal codes no other is among the nearest n - 1 of anything. Each task keeps n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    return code_rows.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def top_k(vectors: DataFrame, k: int = K, bits: int | None = None, every: int = 1, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """Rows (vec_id, rank, neighbor_id, distance): the k nearest codes of each vector whose id is divisible by every, among all vectors."""
    spark = vectors.sparkSession
    bits = bits or vectors.where("embedding IS NOT NULL").agg(F.max(F.size("embedding"))).first()[0] or 64
    own, _ = written(codes(vectors, bits), "codes")
    width = -(-bits // 64)
    indexed, _ = written(least_ids(own, k + 1), "indexed")
    wanted = own.where(F.col("vec_id") % every == 0)
    asked, _ = written(wanted.select("code").distinct(), "asked")
    n, m = indexed.count(), asked.count()
    blocks, parts = max(1, -(-n // block)), max(1, -(-m // queries), min(spark.sparkContext.defaultParallelism, -(-m // LEAST_QUERIES)))
    # every block of codes meets every part of the queries once, in a task of their own: codes first, then the queries stream past their index
    code_b, query_p = F.pmod(F.xxhash64("code", "vec_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = indexed.select("vec_id", "code", code_b.alias("b"), each(parts).alias("p"))
    right = asked.select(F.lit(None).cast("bigint").alias("vec_id"), "code", query_p.alias("p"), each(blocks).alias("b")).select("vec_id", "code", "b", "p")
    met = left.unionAll(right).withColumn("task", (F.col("b") * parts + F.col("p")).cast("int")).repartitionById(blocks * parts, "task").sortWithinPartitions(F.col("vec_id").isNull())

    def run(batches):
        ids, code, index = [], [], None
        for batch in batches:
            words = np.asarray(batch.column(1).flatten()).astype(np.int64).view(np.uint64).reshape(-1, width)
            known = np.asarray(batch.column(0).is_valid())
            ids.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            code.append(words[known])
            if known.all():
                continue
            if index is None:
                index = MultiIndex(np.concatenate(ids), np.concatenate(code))
            asks = words[~known]
            for a in range(0, len(asks) if len(index.ids) else 0, 4096):
                at, near, distance = index.search(asks[a : a + 4096], k + 1)
                of = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(asks[a : a + 4096][at].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([of, pa.array(near), pa.array(distance)], ["code", "neighbor_id", "distance"])

    found = met.select("vec_id", "code").mapInArrow(run, "code array<bigint>, neighbor_id bigint, distance bigint")
    # k + 1 rows a block at most; a query is among its own nearest and goes
    nearest = found.groupBy("code").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))), 1, k + 1).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("vec_id")), 1, k)
    rows = wanted.join(nearest, "code").select("vec_id", F.posexplode(others).alias("rank", "x"))
    return rows.select("vec_id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def op5_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=EVERY)


SQL = f"""
WITH c AS (SELECT vec_id, min(code) AS code FROM (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 AND NOT isnan(embedding[i]) THEN '1' ELSE '0' END) AS l, array_to_string(l, '')::BIT AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL) GROUP BY vec_id),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, bit_count(xor(a.code, b.code))::BIGINT AS distance FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
SELECT vec_id, rank, neighbor_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM p) WHERE rank <= {K}
"""
