"""Dense ids over a total order without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.shared import stored

_LOCAL_BITS = 33  # of monotonically_increasing_id: the partition lies above them


def dense_ids(df: DataFrame, order: list, name: str = "id", start: int = 1, ranged: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df with start, start + 1, ... in the order of some columns, which must be a total one for ids to be deterministic.

    Rows are range-partitioned and sorted, and kept with their place in their partition; one count a partition then gives the offsets.
    ranged: df lies in ranges of the first of the columns already. keep: its columns that are wanted, if not all.
    """
    at = (df if ranged else df.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = stored(at.select(*keep, "_at") if keep else at, "ids")
    part = F.shiftright("_at", _LOCAL_BITS)
    sizes = sorted(map(tuple, kept.groupBy(part.alias("p")).count().collect()))  # one row a partition
    offsets, before = [], start
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    spark = df.sparkSession
    table = spark.createDataFrame(offsets, "_p bigint, _offset bigint")
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return kept.join(F.broadcast(table), part == F.col("_p")).withColumn(name, F.col("_offset") + local).drop("_at", "_p", "_offset")
