"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

A document's length is its UTF-8 bytes. Longer ones than the capacity are cut into pieces of the full capacity, each a bin of
its own that needs no plan, and a rest. Rests and short documents go, longest first, into the open bin with the least remaining room that
still takes them. Pieces of one length are interchangeable, so the plan needs only how many there are of each length: the driver's
work and memory depend on the capacity, never on the number of documents, and the packing is the exact global one. Pieces
take their places in the plan by their rank among pieces of their length.

Nulls: a null or empty text has length 0 and is in no bin. A null doc_id is packed like any other. Repeated rows are packed as often
as they occur; equal ones are interchangeable. Of pieces of one length those of smaller doc_ids come first within a part; parts go by the
number of the row, so no doc_id, null or frequent, makes one of them large. Other columns are not looked at. An empty table gives no bins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.store import table, written

CAPACITY = 8192
#: Pieces of one length, or documents with full pieces, that a task numbers, about; the parts of a frequent length follow their count.
RANKED = 1_000_000


class SegmentTree:
    """Which remaining capacities have open bins; finds the least one of at least a given size in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            now = self.open[2 * i] | self.open[2 * i + 1]
            if self.open[i] == now:
                break
            self.open[i] = now

    def tightest(self, size: int) -> int:
        """The least open capacity of at least size, or -1."""
        i = size + self.leaves
        if self.open[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Best-fit decreasing for so many pieces of each length.

    Runs (length, first rank, pieces, first bin, pieces a bin, position in the bin, offset in the bin): the piece with rank
    first + i goes into bin first bin + i div pieces a bin, as its (position + i mod pieces a bin)-th. Bins with equal room are
    kept as (first bin, how many, pieces so far), so equal pieces are placed in one step: they fill one bin after another.
    """
    tree, rooms, bins, runs = SegmentTree(capacity), {}, 0, []

    def push(room: int, group: tuple[int, int, int]) -> None:
        rooms.setdefault(room, []).append(group)
        tree.set(room, True)

    for length in sorted((x for x in counts if x > 0 and counts[x] > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = capacity, capacity // length
                group = (bins, -(-left // each), 0)
                bins += group[1]
            else:
                group = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            first, many, position = group
            each = room // length
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            took = full * each + rest
            runs.append((length, rank, took, first, each, position, capacity - room))
            used = full + (rest > 0)
            if full:
                push(room - each * length, (first, full, position + each))
            if rest:
                push(room - rest * length, (first + full, 1, position + rest))
            if used < many:
                push(room, (first + used, many - used, position))
            rank += took
            left -= took
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """Rows (bin_id, position, bin_offset, doc_id, piece, piece_start, length), lengths in UTF-8 bytes. Full pieces have the first bins."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint")
    # lengths once, beside the ids and a number for the row: the text is read once and goes no further
    sizes, _ = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("size")).where("size > 0").withColumn("row", F.monotonically_increasing_id()), "pack")
    whole, rest = F.floor(F.col("size") / capacity).cast("bigint"), (F.col("size") % capacity).cast("bigint")
    full, n_full = full_pieces(sizes.where(F.col("size") >= capacity).select("doc_id", "row", whole.alias("n")), capacity, ranked)
    last = sizes.select("doc_id", "row", whole.alias("piece"), rest.alias("length")).where("length > 0")
    return full.unionAll(rests(last, capacity, ranked, n_full))


def full_pieces(docs: DataFrame, capacity: int, ranked: int) -> tuple[DataFrame, int]:
    """The full pieces of documents (doc_id, row, n), each in a bin of its own, and how many there are. Documents are numbered, not pieces."""
    n_docs = docs.count()
    buckets = max(1, -(-n_docs // ranked))
    own = docs.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("bigint"))
    at, rows = 0, []
    for bucket, n in sorted(map(tuple, own.groupBy("bucket").agg(F.sum("n")).collect())):
        rows.append((bucket, at))
        at += n
    base = docs.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["bucket", "base"]).astype("int64"), "bucket bigint, base bigint")
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1))
    placed = own.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(base), "bucket")  # a row for RANKED documents
    each = placed.select("doc_id", (F.col("base") + F.col("before")).alias("first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("piece"))
    zero = F.lit(0).cast("bigint")
    return each.select((F.col("first") + F.col("piece")).alias("bin_id"), zero.alias("position"), zero.alias("bin_offset"), "doc_id", "piece", (F.col("piece") * capacity).cast("bigint").alias("piece_start"), F.lit(capacity).cast("bigint").alias("length")), at


def rests(pieces: DataFrame, capacity: int, ranked: int, first_bin: int) -> DataFrame:
    """Best-fit decreasing for pieces (doc_id, row, piece, length) of less than the capacity; bins count from first_bin."""
    spark = pieces.sparkSession
    ints = lambda rows, names: spark.createDataFrame(pd.DataFrame(rows, columns=names).astype("int64"), ", ".join(f"{x} bigint" for x in names))
    # at most capacity - 1 rows, whatever the number of documents
    totals = dict(map(tuple, pieces.groupBy("length").count().collect()))
    parts = ints([(x, -(-n // ranked)) for x, n in totals.items()], ["length", "parts"])
    own = pieces.join(F.broadcast(parts), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("parts")).cast("bigint"))
    # a row a length, and one for each RANKED pieces
    counted = sorted(map(tuple, own.groupBy("length", "bucket").count().collect()))
    runs: dict[int, list] = {}
    for run in plan(totals, capacity):
        runs.setdefault(run[0], []).append(run)
    rows, before = [], (None, 0)
    for length, bucket, n in counted:
        at = before[1] if before[0] == length else 0
        before = (length, at + n)
        for _, rank, took, first, each, position, offset in runs[length]:
            lo, hi = max(at, rank), min(at + n, rank + took)
            if lo < hi:
                rows.append((length, bucket, lo - at, hi - at, first_bin + first, each, position, offset, at - rank))
    places = ints(rows, ["length", "bucket", "lo", "hi", "first", "each", "place", "offset", "shift"])
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "row")) - 1
    p, q = own.withColumn("rank", rank.cast("bigint")).alias("p"), places.alias("q")
    i = F.col("p.rank") + F.col("q.shift")
    return p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.rank") >= F.col("q.lo")) & (F.col("p.rank") < F.col("q.hi"))).select(
        (F.col("q.first") + F.floor(i / F.col("q.each"))).cast("bigint").alias("bin_id"),
        (F.col("q.place") + i % F.col("q.each")).cast("bigint").alias("position"),
        (F.col("q.offset") + (i % F.col("q.each")) * F.col("p.length")).cast("bigint").alias("bin_offset"),
        "p.doc_id", "p.piece", (F.col("p.piece") * F.lit(capacity).cast("bigint")).alias("piece_start"), F.col("p.length").alias("length"),
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


SQL = None
