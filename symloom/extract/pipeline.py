"""Files to records: one pass over whole files in Arrow batches, a record a file with a list for each table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from symloom.extract import registry
from symloom.extract.record import OWNERS, Found
from symloom.schema import EXTRACTED, struct

#: Records in a batch.
ROWS = 10_000


def extract_text(content: bytes, language: str, path: str, more=None, more_modules=None) -> Found:
    """What one file holds; a language without an extractor holds nothing."""
    read = registry.extractor(language, more)
    return read(content.decode("latin-1"), registry.module_path(path, language, more_modules)) if read else Found()


def records_of(content: bytes, language: str, path: str, kind: str, more=None, more_modules=None) -> Iterator[list[dict]]:
    """The records of one kind in one file, piece by piece; those whose symbol isn't known yet come last, those of strangers are left out."""
    pieces = registry.pieces(language, content.decode("latin-1"), registry.module_path(path, language, more_modules), more)
    own, waiting = set(), []
    for found in pieces:
        rows = getattr(found, kind)
        if kind in OWNERS:
            own.update(s["qualified_name"] for s in found.symbols)
            waiting += (r for r in rows if r[OWNERS[kind]] not in own)
            rows = [r for r in rows if r[OWNERS[kind]] in own]
        yield rows
    yield [r for r in waiting if r[OWNERS[kind]] in own]


def records(files: DataFrame, kind: str) -> DataFrame:
    """One row a record of a kind (symbols, refs, calls, imports or types) with its file's path, of files (path, language, content).

    A file that is large leaves its task piece by piece, so neither it as a whole nor records of other kinds are held beside its text.
    """
    more, modules = registry.registered()
    kinds = struct(EXTRACTED)[kind].dataType.elementType
    schema = T.StructType([T.StructField("path", T.StringType()), *kinds.fields])
    arrow, most = to_arrow_schema(schema), ROWS

    def run(batches):
        for batch in batches:
            for path, language, content in zip(*(batch.column(c) for c in ("path", "language", "content"))):
                path = path.as_py()
                for rows in records_of(content.as_py(), language.as_py(), path, kind, more, modules):
                    for k in range(0, len(rows), most):
                        yield pa.RecordBatch.from_pylist([r | {"path": path} for r in rows[k : k + most]], schema=arrow)

    return files.select("path", "language", "content").mapInArrow(run, schema)


def extract(files: DataFrame) -> DataFrame:
    """Records of files (path, language, content, content_hash, size_bytes, modified_at).

    Files are read where they lie in their partitions, so no content is shuffled. An error in an extractor fails the job: nothing is left out silently.
    """
    more, modules = registry.registered()
    names = struct(EXTRACTED).names

    def run(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                found = extract_text(bytes(r.content), r.language, r.path, more, modules)
                rows.append((r.path, r.language, r.content_hash, r.size_bytes, r.modified_at, found.symbols, found.refs, found.calls, found.imports, found.types))
            yield pd.DataFrame(rows, columns=names)

    wanted = files.select("path", "language", "content", "content_hash", F.col("size_bytes").cast("bigint").alias("size_bytes"), F.col("modified_at").cast("bigint").alias("modified_at"))
    return wanted.mapInPandas(run, EXTRACTED)
