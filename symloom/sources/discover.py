"""Source trees as tables.

Spark's own file listing passes over names that begin with an underscore or a dot, which source trees have for good reasons; so folders are
listed, and files read, by tasks of ours, with whatever file system the root's scheme names.
"""

from __future__ import annotations

import hashlib
import os

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.sources.ignore import Ignore
from symloom.sources.registry import with_language
from symloom.shared import stored

IGNORE_FILE = ".gitignore"
_LISTED = "path string, size_bytes bigint, modified_at bigint"
_READ = "path string, language string, content binary, content_hash binary, size_bytes bigint, modified_at bigint"
_TASK_BYTES = 16_000_000


def local_path(root: str) -> str | None:
    """A root of this machine's files as a plain path."""
    if root.startswith("file:"):
        return "/" + root.removeprefix("file:").lstrip("/")
    return None if "://" in root else os.path.abspath(root)


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    local = local_path(root)
    return (pafs.LocalFileSystem(), local) if local is not None else pafs.FileSystem.from_uri(root)


def _hidden(path: str) -> bool:
    return any(x.startswith(".") for x in path.split("/"))


def _walk(root: str, folder: str, recursive: bool, rules: Ignore) -> list[tuple[str, int, int]]:
    """Files below a folder, relative to the root: (path, size, mtime). Links aren't followed, hidden and ignored folders not entered."""
    local, out = local_path(root), []
    if local is not None:
        todo = [folder]
        while todo:
            at = todo.pop()
            with os.scandir(os.path.join(local, at)) as entries:
                for e in entries:
                    path = f"{at}/{e.name}" if at else e.name
                    if e.is_dir(follow_symlinks=False):
                        if recursive and not e.name.startswith(".") and not rules.ignored(path + "/x"):
                            todo.append(path)
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat()
                        out.append((path.replace("\\", "/"), s.st_size, int(s.st_mtime)))
        return out
    fs, base = _open(root)
    base = base.rstrip("/")
    for info in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=recursive)):
        if info.type == pafs.FileType.File:
            out.append((info.path.removeprefix(base).lstrip("/"), info.size, int(info.mtime.timestamp()) if info.mtime else 0))
    return out


def files_below(root: str, folder: str) -> list[tuple[str, int, int]]:
    """Files below a folder of the root, whatever its name, by the driver: (path, size, mtime)."""
    return _walk(root, folder, True, Ignore({}))


def _bytes(root: str, path: str) -> bytes | None:
    fs, base = _open(root)
    try:
        with fs.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
            return f.read()
    except FileNotFoundError:
        return None


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, size_bytes, modified_at) of all files below a root but in hidden folders; each folder at the top is a task's to list."""
    fs, base = _open(root)
    top = fs.get_file_info(pafs.FileSelector(base))
    rules = Ignore({"": (_bytes(root, IGNORE_FILE) or b"").decode("utf-8", "replace")})
    folders = sorted(i.base_name for i in top if i.type == pafs.FileType.Directory and not i.base_name.startswith(".") and not rules.ignored(i.base_name + "/x"))

    def run(batches):
        for frame in batches:
            for folder, deep in zip(frame.folder, frame.deep):
                yield pd.DataFrame(_walk(root, folder, bool(deep), rules), columns=["path", "size_bytes", "modified_at"])

    # links to folders at the top are no folders of this tree
    local = local_path(root)
    folders = [f for f in folders if local is None or not os.path.islink(os.path.join(local, f))]
    table = spark.createDataFrame([("", False), *[(f, True) for f in folders]], "folder string, deep boolean")
    return table.repartition(max(1, min(len(folders) + 1, 4 * spark.sparkContext.defaultParallelism)), "folder").mapInPandas(run, _LISTED)


def read(files: DataFrame, root: str, content: bool = True) -> DataFrame:
    """Files (path, language, size_bytes, modified_at) with their content and its hash, or the hash alone; one that has gone in between has no row."""
    names = ["path", "language", *(["content"] if content else []), "content_hash", "size_bytes", "modified_at"]

    def run(batches):
        for frame in batches:
            for r in frame.itertuples(index=False):  # a file at a time: a batch of large ones needn't fit
                data = _bytes(root, r.path)
                if data is not None:
                    yield pd.DataFrame([(r.path, r.language, *([data] if content else []), hashlib.sha256(data).digest(), len(data), r.modified_at)], columns=names)

    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(1, min(100_000, -(-int(total) // _TASK_BYTES)))
    return files.select("path", "language", "size_bytes", "modified_at").repartition(tasks, "path").mapInPandas(run, _READ if content else _READ.replace("content binary, ", ""))


def ignore_rules(listed: DataFrame, root: str) -> Ignore:
    """The rules of a tree's ignore files, which are few and small and come to the driver."""
    paths = [r.path for r in listed.where(F.substring_index("path", "/", -1) == IGNORE_FILE).select("path").collect()]
    return Ignore({p.rpartition("/")[0]: (_bytes(root, p) or b"").decode("utf-8", "replace") for p in paths})


def rules_above(root: str, paths: list[str]) -> Ignore:
    """The rules of the ignore files that some paths are subject to; no folder is listed."""
    folders = {"", *("/".join(p.split("/")[:i]) for p in paths for i in range(1, p.count("/") + 1))}
    found = {f: _bytes(root, f"{f}/{IGNORE_FILE}".lstrip("/")) for f in folders}
    return Ignore({f: b.decode("utf-8", "replace") for f, b in found.items() if b is not None})


def listed(spark: SparkSession, root: str, extensions: dict[str, str] | None = None) -> DataFrame:
    """Rows (path, language, size_bytes, modified_at) of the files of registered languages below a root.

    Hidden files and folders and what ignore files name are left out; paths are relative with forward slashes.
    """
    fs, base = _open(root)
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no folder {root}")
    every = stored(listing(spark, root), "listing")
    rules = ignore_rules(every, root)
    found = with_language(every.where(~F.exists(F.split("path", "/", -1), lambda x: F.startswith(x, F.lit(".")))), extensions)
    if rules.rules:

        @F.pandas_udf("boolean")
        def ignored(paths: pd.Series) -> pd.Series:
            return paths.map(rules.ignored)

        found = found.where(~ignored("path"))
    return found.select("path", "language", "size_bytes", "modified_at")


def discover(spark: SparkSession, root: str, extensions: dict[str, str] | None = None) -> DataFrame:
    """Rows (path, language, content, content_hash, size_bytes, modified_at) of what listed() finds; names are looked at before contents are read."""
    return read(listed(spark, root, extensions), root)


def named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Some paths as listed() would have them, without a look at ignore rules."""
    return with_language(spark.createDataFrame([(p, 0, None) for p in paths], _LISTED)).select("path", "language", "size_bytes", "modified_at")


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Contents of some paths below the root; what is missing has no row."""
    return read(named(spark, paths), root)
