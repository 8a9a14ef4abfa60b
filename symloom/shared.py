"""Where intermediate and cached tables go."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a folder of our own where that is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"symloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own below the shared folder, deleted when scratch() is left, else with the driver's JVM."""
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    fs, at = _fs(spark, path)
    fs.deleteOnExit(at)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are stored within when it is left: for work whose result lies elsewhere by then, again and again in one session."""
    token = _scope.set([])
    try:
        yield
    finally:
        for path in _scope.get():
            remove(spark, path)
        _scope.reset(token)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: what comes after doesn't depend on any executor's memory."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # of this machine's files no checksums are kept beside them: others write them too
    return fs.getRawFileSystem() if fs.getScheme() == "file" else fs, at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Moves a file to a name that no file has."""
    fs, at = _fs(spark, old)
    return fs.rename(at, _fs(spark, new)[1])


def modified(spark: SparkSession, path: str) -> float | None:
    """When a file was written last, in seconds; None if there is none."""
    fs, at = _fs(spark, path)
    return fs.getFileStatus(at).getModificationTime() / 1000 if fs.exists(at) else None


def names(spark: SparkSession, folder: str) -> list[str]:
    """Of the files in a folder; none if there is no such folder."""
    fs, at = _fs(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    fs.mkdirs(at.getParent())
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
