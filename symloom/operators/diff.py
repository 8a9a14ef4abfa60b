"""What changed between an index and the files of now, and how the tables follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.schema import OWNED

HASH_BYTES = 32


def well_formed(hash_: Column) -> Column:
    """Whether a stored hash has its full length; a damaged one says nothing about its file."""
    return F.octet_length(hash_) == HASH_BYTES


def file_diff(stored: DataFrame, current: DataFrame, full_length: int = HASH_BYTES) -> DataFrame:
    """Rows (path, state): unchanged, changed, new or deleted, by content_hash alone. One full outer join on the path.

    A file whose stored hash is damaged counts as new. full_length: of a hash in the form in which both sides have it.
    """
    s = stored.select("path", F.col("content_hash").alias("old"))
    c = current.select("path", F.col("content_hash").alias("now"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "deleted").when(F.col("old").isNull() | (F.octet_length("old") != full_length), "new").when(F.col("old") == F.col("now"), "unchanged").otherwise("changed")
    return s.join(c, "path", "full").select("path", state.alias("state"))


def summary(diff: DataFrame) -> DataFrame:
    """One row (unchanged, changed, new, deleted, to_extract, is_empty)."""
    n = lambda s: F.count_if(F.col("state") == s)
    return diff.agg(n("unchanged").alias("unchanged"), n("changed").alias("changed"), n("new").alias("new"), n("deleted").alias("deleted"), (n("changed") + n("new")).alias("to_extract"), (n("changed") + n("new") + n("deleted") == 0).alias("is_empty"))


def without_files(tables: dict[str, DataFrame], gone: DataFrame, compat_cascade: bool = False) -> dict[str, DataFrame]:
    """The tables without the files whose path is in gone, and without what hangs on them.

    Rows of other files that point to a symbol that goes lose the pointer and can be resolved again; with compat_cascade they go too, but for
    imports, which only lose it.
    """
    ids = tables["files"].join(gone.select("path").distinct(), "path", "left_semi").select("file_id")
    out = {"files": tables["files"].join(ids, "file_id", "left_anti")}
    lost = tables["symbols"].join(ids, "file_id", "left_semi").select(F.col("id").alias("_lost"))
    out["symbols"] = tables["symbols"].join(ids, "file_id", "left_anti")
    for name, column in (("refs", "symbol_id"), ("calls", "callee_symbol_id"), ("types", "target_symbol_id")):
        rows = tables[name].join(ids, "file_id", "left_anti")
        out[name] = pointing(rows, column, lost, drop=compat_cascade)
    imports = tables["imports"].join(ids, "file_id", "left_anti")
    imports = pointing(imports, "resolved_symbol_id", lost)
    out["imports"] = pointing(imports, "resolved_file_id", ids.select(F.col("file_id").alias("_lost")))
    return out


def pointing(rows: DataFrame, column: str, lost: DataFrame, drop: bool = False) -> DataFrame:
    """rows whose pointer is among lost without the pointer, or without them. Rows that have none stay where they are: a join would send them all to one task."""
    none, rows = rows.where(F.col(column).isNull()), rows.where(F.col(column).isNotNull())
    on = rows[column] == lost["_lost"]
    if drop:
        return rows.join(lost, on, "left_anti").unionAll(none)
    names = rows.columns
    hit = rows.join(lost, on, "left")
    return none.unionAll(hit.select(*[F.when(F.col("_lost").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in names]))


def upsert(tables: dict[str, DataFrame], batch: dict[str, DataFrame], gone: DataFrame, compat_cascade: bool = False) -> dict[str, DataFrame]:
    """The tables with the batch's files in the place of those with the same path, and without those in gone."""
    replaced = batch["files"].select("path").unionAll(gone.select("path"))
    kept = without_files(tables, replaced, compat_cascade)
    return {name: kept[name].unionByName(batch[name], allowMissingColumns=True) for name in ["files", *OWNED]}


def next_ids(tables: dict[str, DataFrame]) -> dict[str, int]:
    """One more than the greatest id of each table."""
    return {name: (tables[name].agg(F.max("file_id" if name == "files" else "id")).first()[0] or 0) + 1 for name in ["files", *OWNED]}
