"""The change stream: paths that changed, settled for a while, in batches that update the index.

Settling is by event time (session windows with the debounce as gap), where a watcher of one machine goes by the clock: replaying a stream gives
the same batches. A session is handed on once the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symloom.shared import stored

IGNORED = ["__pycache__", "node_modules", "target"]
DEBOUNCE = "200 milliseconds"


def watched(path: Column) -> Column:
    """Whether changes of a relative path count: no part of it is hidden or holds generated files."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return (path != "") & ~F.exists(parts, lambda x: x.isin(IGNORED) | (F.startswith(x, F.lit(".")) & ~x.isin(".", "..")))


def debounced(events: DataFrame, gap: str = DEBOUNCE, path: str = "path", ts: str = "ts", late: str | None = None) -> DataFrame:
    """Rows (path, first, last, n): runs of changes of a path with less than the gap between them. late: the watermark of a stream, which events of
    paths that aren't watched move on too: one with an empty path says that it got late."""
    e = events.withWatermark(ts, late or gap) if events.isStreaming else events
    # with the time in it the condition stays above the watermark
    e = e.where(F.when(F.col(ts).isNotNull(), watched(F.col(path))).otherwise(False))
    grouped = e.groupBy(F.session_window(ts, gap).alias("w"), F.col(path).alias("path"))
    return grouped.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n")).select("path", "first", "last", "n")


def ended(events: DataFrame, after: str, ts: str = "ts") -> DataFrame:
    """A stream of events (path, ts) that ends, with an event of no path at a time after all others, so that the last runs leave too."""
    spark = events.sparkSession
    last = stored(spark.sql(f"SELECT '' AS path, TIMESTAMP '{after}' AS {ts}"), "end")
    return events.select("path", ts).unionByName(spark.readStream.schema(last.schema).parquet(last.inputFiles()[0].rpartition("/")[0]))


def batch_paths(batch: DataFrame) -> list[str]:
    """The distinct paths of a batch in order: what a callback is given."""
    return [r.path for r in batch.select("path").distinct().orderBy("path").collect()]


def watch(events: DataFrame, on_batch: Callable[[list[str], int], None], checkpoint: str, gap: str = DEBOUNCE, once: bool = False, stop_on_error: bool = True, every: str = "500 milliseconds") -> StreamingQuery:
    """Calls back with the settled paths of each batch. With stop_on_error an error in the callback ends the stream, else it is logged and the stream goes on."""

    def each(batch: DataFrame, number: int) -> None:
        paths = batch_paths(batch)
        if not paths:
            return
        try:
            on_batch(paths, number)
        except Exception as e:  # the update verb keeps watching whatever an update runs into
            if stop_on_error:
                raise
            print(f"watch: {e}", flush=True)

    writer = debounced(events, gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
