"""From extracted records to the flat tables: ids, bindings within a file, and the rules that the tables keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.operators.ids import dense_ids
from symloom.shared import stored
from symloom.schema import CALLS, FILES, IMPORTS, REFS, SYMBOLS, TABLES, TYPES, struct


class Rejected(ValueError):
    """Rows that break a rule of the tables; nothing of the batch is loaded."""


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl)])


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def bind_parents(symbols: DataFrame) -> DataFrame:
    """parent_symbol_id from parent_qualified_name, within the file and in whatever order symbols come; null where the file has no such symbol."""
    own = symbols.groupBy(F.col("file_id").alias("_f"), F.col("qualified_name").alias("_q")).agg(F.min("id").alias("parent_symbol_id"))
    s = symbols.drop("parent_symbol_id")
    return s.join(own, (s["file_id"] == own["_f"]) & (s["parent_qualified_name"] == own["_q"]), "left").drop("_f", "_q")


def bind_owner(rows: DataFrame, symbols: DataFrame, qname: str, into: str) -> DataFrame:
    """into: the id of the file's symbol with that qualified name. Rows without one keep null; must_be_bound() rejects them."""
    own = symbols.groupBy(F.col("file_id").alias("_f"), F.col("qualified_name").alias("_q")).agg(F.min("id").alias(into))
    r = rows.drop(into)
    return r.join(own, (r["file_id"] == own["_f"]) & (r[qname] == own["_q"]), "left").drop("_f", "_q")


def must_be_bound(rows: DataFrame, column: str, what: str) -> None:
    bad = rows.where(F.col(column).isNull()).limit(3).collect()
    if bad:
        raise Rejected(f"{what} without its symbol, such as {bad[0].asDict()}")


def flatten(extracted: DataFrame, first_ids: dict[str, int] | None = None, strict: bool = False, now: int | None = None) -> dict[str, DataFrame]:
    """The six tables of a batch of extracted files; ids follow path and place in the file, from first_ids on.

    Equal paths are always rejected; equal qualified names in a file are with strict, else the first stays.
    """
    first = dict.fromkeys(TABLES, 1) | (first_ids or {})
    extracted = stored(extracted, "extracted")  # six tables are made of it
    twice = duplicates(extracted, ["path"]).limit(1).collect()
    if twice:
        raise Rejected(f"path {twice[0].path} occurs {twice[0].n} times")
    stamp = F.lit(now).cast("bigint") if now is not None else F.unix_timestamp().cast("bigint")
    files = dense_ids(extracted.select("path", "language", "content_hash", "size_bytes", "modified_at"), ["path"], "file_id", first["files"]).withColumn("indexed_at", stamp)
    out = {"files": _shaped(files, FILES)}
    with_id = extracted.join(files.select("path", "file_id"), "path")

    def rows(column: str) -> DataFrame:
        return with_id.select("file_id", F.posexplode(column).alias("_pos", "_x")).select("file_id", "_pos", "_x.*")

    symbols = rows("symbols")
    if strict:
        bad = duplicates(symbols, ["file_id", "qualified_name"]).limit(1).collect()
        if bad:
            raise Rejected(f"qualified name {bad[0].qualified_name} occurs {bad[0].n} times in a file")
    else:
        symbols = unique_first(symbols, ["file_id", "qualified_name"], ["_pos"])
    # files are in order of paths, so (file_id, place) is the order of paths and places
    symbols = dense_ids(symbols, ["file_id", "_pos"], "id", first["symbols"])
    out["symbols"] = _shaped(bind_parents(symbols), SYMBOLS)
    for table, column, qname, into, ddl in (("calls", "calls", "caller_qualified_name", "caller_symbol_id", CALLS), ("types", "types", "owner_qualified_name", "symbol_id", TYPES)):
        bound = bind_owner(dense_ids(rows(column), ["file_id", "_pos"], "id", first[table]), symbols, qname, into)
        must_be_bound(bound, into, table)
        out[table] = _shaped(bound, ddl)
    out["refs"] = _shaped(dense_ids(rows("refs"), ["file_id", "_pos"], "id", first["refs"]), REFS)
    out["imports"] = _shaped(dense_ids(rows("imports"), ["file_id", "_pos"], "id", first["imports"]), IMPORTS)
    return out


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table_name, n_rows)."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out
