"""LM scoring by context-tree weighting: how many bits a text's bytes take under a model of the whole corpus.

A byte is eight binary decisions, most significant bit first; each decision (a prefix of the byte) has a context tree over the DEPTH
bytes before it. Every node holds how often its decision went either way, over all documents. Krichevsky-Trofimov estimates of
the nodes are mixed over all depths: P_w = (P_e + prod P_w(children)) / 2, so a node's own estimate has the weight
P_e / (P_e + prod P_w(children)) and the rest goes to the deeper context. The counts are those of runs of DEPTH + 1 bytes, gathered from every
document; trees are weighted in parallel by the last two bytes of the context and joined at depth 1 and the root, of which there are few; each
run then has a code length, and a text's score is the sum over its bytes.

Nulls: a null or empty text has 0 bytes, 0 bits and a null rate; a null doc_id is carried. Rows that are repeated are counted and scored
each. A text begins in a context of zero bytes; very long ones are read whole. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.store import drop_path, table, written
from symloom.llm.words import flat, slices

DEPTH = 5
#: Runs of a task, and runs that are weighed at once unless more share their last two context bytes.
TASK_RUNS, WEIGHED = 2_000_000, 500_000
#: Runs whose code lengths are sent to every task (12 bytes each), the most frequent ones; documents are joined with the others by run, and
#: those are rare, so what is shuffled is a small part of the corpus however large the model.
BROADCAST_RUNS = 20_000_000
SCHEMA = "doc_id bigint, n_bytes bigint, bits double, bits_per_byte double"


def runs(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the number made of the depth bytes before it and itself, lowest; and where texts begin."""
    body, at = flat(texts, lower=False)
    code = body.astype(np.uint64)
    place = np.arange(len(body)) - np.repeat(at[:-1], np.diff(at))
    for d in range(1, depth + 1):
        before = np.zeros(len(body), np.uint64)
        before[d:] = body[:-d] if d < len(body) + 1 else 0
        before[place < d] = 0
        code |= before << np.uint64(8 * d)
    return code.view(np.int64), at


def stirling(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: ln Gamma of 0.5, 1, 1.5, ...; most counts are small.
_GAMMA = stirling(np.arange(1, 1 << 13) / 2)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of halves of whole numbers."""
    at = (2 * x).astype(np.int64) - 1
    out = _GAMMA[np.minimum(at, len(_GAMMA) - 1)]
    large = np.flatnonzero(at >= len(_GAMMA)) if at.ndim == 1 else None
    if large is None:
        return np.where(at < len(_GAMMA), out, stirling(x))
    out[large] = stirling(x[large])
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


def own_weight(log_e: np.ndarray, log_children: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(log_children - log_e, -700, 700)))


def weigh(code: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs with all that share their last two context bytes: each run's eight probabilities by its nodes of depth 2 and more; and, by last byte
    x 256 + decision, which of them there are, and the zeros, ones and sum of ln P_w of their nodes of depth 2.

    In order of a context and the byte every node of the context's trees is a range, whatever the decision, so a level is sorted once.
    """
    byte, context = code & 255, code >> 8
    n = len(code)
    order, tops = [], []
    for d in range(2, depth + 1):
        key = (context & ((1 << (8 * d)) - 1)) << 8 | byte
        order.append(np.argsort(key))
        tops.append(key[order[-1]])
    probability = np.zeros((n, 8))
    upper = np.zeros((4, 1 << 16))
    for j in range(8):
        q = below = None
        for d in range(depth, 1, -1):
            o = order[d - 2]
            of_sorted = tops[d - 2] >> (8 - j)
            new = np.ones(n, bool)
            new[1:] = of_sorted[1:] != of_sorted[:-1]
            first = np.flatnonzero(new)
            one = ((tops[d - 2] >> (7 - j)) & 1).astype(bool)
            weight = count[o]
            ones = np.add.reduceat(np.where(one, weight, 0), first)
            zeros = np.add.reduceat(weight, first) - ones
            of = np.empty(n, np.int64)
            of[o] = np.cumsum(new) - 1
            log_e = log_kt(zeros, ones)
            bit = ((byte >> (7 - j)) & 1).astype(bool)
            estimate = (np.where(bit, ones[of], zeros[of]) + 0.5) / (zeros + ones + 1)[of]
            if below is None:
                log_w, q = log_e, estimate
            else:
                some, child_w = below
                children = np.bincount(of[some], weights=child_w, minlength=len(first))
                own = own_weight(log_e, children)[of]
                log_w = np.logaddexp(log_e, children) - np.log(2)
                q = own * estimate + (1 - own) * q
            some = o[first]  # a run of each node
            below = (some, log_w)
        node = (context[some] & 255) << 8 | (1 << j) | (byte[some] >> (8 - j))
        for row, values in zip(upper, (1.0, zeros, ones, log_w)):
            row += np.bincount(node, weights=np.broadcast_to(values, node.shape), minlength=1 << 16)
        probability[:, j] = q
    some = np.flatnonzero(upper[0])
    return probability, some, upper[1:, some]


def counted(docs: DataFrame, depth: int) -> DataFrame:
    """Rows (run, n) over all bytes of all documents."""

    def run(batches):
        # sorted codes and counts so far, merged when they have grown enough
        code, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for part in slices(batch):
                waiting.append(np.unique(runs(part.column(0), depth)[0], return_counts=True))
                size += len(waiting[-1][0])
                if size > max(1_000_000, len(code)):
                    code, n = merged([(code, n), *waiting])
                    waiting, size = [], 0
        code, n = merged([(code, n), *waiting])
        for a in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[a : a + 100_000]), pa.array(n[a : a + 100_000])], ["run", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(code)).astype(np.int64)


def code_lengths(docs: DataFrame, depth: int = DEPTH, task_runs: int = TASK_RUNS) -> DataFrame:
    """The model: rows (run, n, bits), how often a run occurs and the code length of its last byte after the bytes before it."""
    assert 2 <= depth <= 6  # a run is a number of 7 bytes at most

    def trees(batches):
        """Runs come in order of their last two context bytes; so many as share them are weighed at once, a few such groups together."""
        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= WEIGHED:
                code, n = (np.concatenate(x) for x in zip(*waiting))
                last = code >> 8 & 0xFFFF
                cut = int(np.flatnonzero(last[1:] != last[:-1])[-1] + 1) if (last[1:] != last[:-1]).any() else 0
                if cut:
                    yield from tree(code[:cut], n[:cut])
                waiting, size = [(code[cut:], n[cut:])], len(code) - cut
        if size:
            yield from tree(*(np.concatenate(x) for x in zip(*waiting)))

    def tree(code, n):
        p, some, upper = weigh(code, n.astype(np.float64), depth)
        for a in range(0, len(code), 20_000):
            values = pa.array(p[a : a + 20_000].astype(np.float32).ravel())
            own = len(code[a : a + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(code[a : a + own]), pa.array(n[a : a + own]), pa.ListArray.from_arrays(pa.array(np.arange(own + 1, dtype=np.int32) * 8), values), pa.nulls(own, pa.list_(pa.float64()))], ["run", "n", "p", "upper"])
        three = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * 3), pa.array(upper.T.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.list_(pa.float32())), three], ["run", "n", "p", "upper"])

    counts, path = written(counted(docs, depth), "runs")
    tasks = max(1, -(-counts.count() // task_runs))
    last = F.shiftright("run", 8).bitwiseAND(0xFFFF)
    rows, _ = written(counts.repartition(tasks, last).sortWithinPartitions(last).mapInArrow(trees, "run bigint, n bigint, p array<float>, upper array<double>"), "trees")
    drop_path(docs.sparkSession, path)
    # nodes of depth 1, by last byte and decision: 65,280 at most, whatever the corpus
    known = np.zeros((3, 1 << 16))
    for r in rows.where("upper IS NOT NULL").groupBy("run").agg(*[F.sum(F.col("upper")[i]).alias(f"u{i}") for i in range(3)]).collect():
        known[:, r.run] = r[1:]
    known = known.reshape(3, 256, 256)
    log_e = log_kt(known[0], known[1])
    own, estimate = own_weight(log_e, known[2]), (known[:2] + 0.5) / (known[0] + known[1] + 1)
    log_w = np.where(known[0] + known[1] > 0, np.logaddexp(log_e, known[2]) - np.log(2), 0)
    root = np.array([known[0].sum(axis=0), known[1].sum(axis=0), log_w.sum(axis=0)])
    log_e = log_kt(root[0], root[1])
    own_0, estimate_0 = own_weight(log_e, root[2]), (root[:2] + 0.5) / (root[0] + root[1] + 1)

    def finish(batches):
        for batch in batches:
            code = batch.column(0).to_numpy()
            p = batch.column(2).flatten().to_numpy().reshape(-1, 8).astype(np.float64)
            bits, last = np.zeros(len(code)), code >> 8 & 255
            for j in range(8):
                d, bit = (1 << j) | ((code & 255) >> (8 - j)), (code >> (7 - j)) & 1
                q = own[last, d] * estimate[bit, last, d] + (1 - own[last, d]) * p[:, j]
                bits -= np.log2(own_0[d] * estimate_0[bit, d] + (1 - own_0[d]) * q)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits.astype(np.float32))], ["run", "n", "bits"])

    return written(rows.where("p IS NOT NULL").select("run", "n", "p").mapInArrow(finish, "run bigint, n bigint, bits float"), "code-lengths")[0]


def least_frequency(model: DataFrame, most: int) -> int:
    """The least power of two such that at most so many runs are that frequent."""
    by_size = sorted(map(tuple, model.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()), reverse=True)  # 64 rows at most
    total, least = 0, 64
    for b, n in by_size:
        total += n
        if total > most:
            break
        least = b
    return 1 << least


def score(docs: DataFrame, model: DataFrame, depth: int = DEPTH, most: int = BROADCAST_RUNS) -> DataFrame:
    """Rows (doc_id, n_bytes, bits, bits_per_byte), one a row of docs, for a model over these documents; a run that the model has never seen takes 8 bits."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = model.count()
    frequent = model if size <= most else model.where(F.col("n") >= F.lit(min(least_frequency(model, most), 2**63 - 1)))
    t = frequent.select("run", "bits").toArrow()
    order = np.argsort(t.column(0).to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast((t.column(0).to_numpy()[order], t.column(1).to_numpy()[order]))

    def known(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths by the table that was sent, and which runs it has."""
        runs_, bits = sent.value
        if not len(runs_):
            return np.full(len(code), 8.0), np.zeros(len(code), bool)
        order = np.argsort(code)  # in order, lookups stay near each other
        i = np.empty(len(code), np.int64)
        i[order] = np.minimum(np.searchsorted(runs_, code[order]), len(runs_) - 1)
        hit = runs_[i] == code
        return np.where(hit, bits[i], np.float32(8)).astype(np.float64), hit

    if size <= most:

        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    code, at = runs(part.column(1), depth)
                    total = np.concatenate([[0], np.cumsum(known(code)[0])])
                    total, n = total[at[1:]] - total[at[:-1]], np.diff(at)
                    rate = pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0).round(6), mask=n == 0)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(total.round(3)), rate], ["doc_id", "n_bytes", "bits", "bits_per_byte"])

        return own.mapInArrow(run, SCHEMA)

    def parts(batches):
        """For each row its bits from the table in one row without a run, and its other runs."""
        for batch in batches:
            for part in slices(batch):
                code, at = runs(part.column(1), depth)
                each, hit = known(code)
                total = np.concatenate([[0], np.cumsum(np.where(hit, each, 0))])
                whole = total[at[1:]] - total[at[:-1]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.int64()), pa.array(whole)], ["row", "run", "n", "bits"])
                owner = np.repeat(np.arange(part.num_rows), np.diff(at))[~hit]
                rare = code[~hit]
                order = np.lexsort((rare, owner))
                owner, rare = owner[order], rare[order]
                new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (rare[1:] != rare[:-1]))) if len(owner) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[new])), pa.array(rare[new]), pa.array(np.diff(np.append(new, len(owner)))), pa.nulls(len(new), pa.float64())], ["row", "run", "n", "bits"])

    # every row by its own number, so repeated rows and null ids stay apart; the numbers are fixed by writing them
    rows, _ = written(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    found, _ = written(rows.select("row", "text").mapInArrow(parts, "row bigint, run bigint, n bigint, bits double"), "found")
    rest = found.where("run IS NOT NULL").select("row", "run", "n").join(model.select("run", F.col("bits").alias("each")), "run", "left").select("row", (F.col("n") * F.coalesce(F.col("each"), F.lit(8.0)).cast("double")).alias("bits"))
    sums = found.where("run IS NULL").select("row", "bits").unionAll(rest).groupBy("row").agg(F.sum("bits").alias("bits"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return rows.select("doc_id", "row", n.alias("n_bytes")).join(sums, "row").select("doc_id", "n_bytes", F.round("bits", 3).alias("bits"), F.when(F.col("n_bytes") > 0, F.round(F.col("bits") / F.col("n_bytes"), 6)).alias("bits_per_byte"))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, code_lengths(docs))


SQL = None
