"""Where intermediate tables go, and joins whose broadcast side is measured first."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one bigint column that may be broadcast (some 100 MB as a hash relation); above it, joins shuffle.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        set_ = "file://" + os.path.join(tempfile.gettempdir(), f"symloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", set_)
    return set_.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path of its own below the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/symloom/{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cuts lineage with a Parquet table in the shared folder: lost executors cost no recomputation of what came before."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def with_ids(df: DataFrame, ids: DataFrame, column: str | list[str], how: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join of df on an id column or several; ids (columns of those names, already written) is broadcast only if it has at most limit rows."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), column, how)


def lookup(df: DataFrame, unique: DataFrame, key: str | list[str], how: str = "inner", limit: int = BROADCAST_IDS) -> DataFrame:
    """df joined with a written table of unique keys, which is broadcast if it has at most limit rows; else the join splits df's hot keys as it runs."""
    small = unique.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(unique) if small else unique, key, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
