"""Names to symbols: left lookup joins in which the symbol with the lowest id wins.

Lookup tables are grouped down to one row a key first, so a hot name on the looking side never multiplies rows, and AQE can split it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.shared import stored


def by_qualified_name(symbols: DataFrame) -> DataFrame:
    """Rows (key, symbol_id, file_id): for each qualified name its lowest-id symbol and that symbol's file."""
    return symbols.groupBy(F.col("qualified_name").alias("key")).agg(F.min("id").alias("found_id"), F.min_by("file_id", "id").alias("found_file"))


def by_local_name(symbols: DataFrame) -> DataFrame:
    """Rows (key_file, key, local_id): for each name in a file its lowest-id symbol."""
    return symbols.groupBy(F.col("file_id").alias("key_file"), F.col("name").alias("key")).agg(F.min("id").alias("local_id"))


@dataclass(frozen=True)
class Names:
    """Both lookups over the same symbols, for several tables that are resolved by them; stored, they are made once."""

    qualified: DataFrame
    local: DataFrame


def names(symbols: DataFrame) -> Names:
    return Names(stored(by_qualified_name(symbols), "qualified-names"), stored(by_local_name(symbols), "local-names"))


def phase_qualified(rows: DataFrame, symbols: DataFrame | Names, raw: str, into: str) -> DataFrame:
    """Fills the symbol where the raw name is a qualified name anywhere; what is filled already stays."""
    if into not in rows.columns:
        rows = rows.withColumn(into, F.lit(None).cast("bigint"))
    look = (symbols.qualified if isinstance(symbols, Names) else by_qualified_name(symbols)).select("key", "found_id")
    return rows.join(look, rows[raw] == look["key"], "left").withColumn(into, F.coalesce(into, "found_id")).drop("key", "found_id")


def phase_local(rows: DataFrame, symbols: DataFrame | Names, raw: str, into: str) -> DataFrame:
    """Fills what is still empty where the raw name is the name of a symbol of the same file."""
    look = symbols.local if isinstance(symbols, Names) else by_local_name(symbols)
    on = (rows[raw] == look["key"]) & (rows["file_id"] == look["key_file"]) & rows[into].isNull()
    return rows.join(look, on, "left").withColumn(into, F.coalesce(into, "local_id")).drop("key", "key_file", "local_id")


def _both(rows: DataFrame, symbols: DataFrame | Names, raw: str, into: str) -> DataFrame:
    return _open(rows, into, lambda r: phase_local(phase_qualified(r, symbols, raw, into), symbols, raw, into))


def _open(rows: DataFrame, into: str, look_up: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What look_up makes of the rows that have no symbol yet; others take no part in it, in whatever number they are."""
    if into not in rows.columns:
        return look_up(rows)
    found = look_up(rows.where(F.col(into).isNull()))
    return found.unionByName(rows.where(F.col(into).isNotNull()))


def calls(rows: DataFrame, symbols: DataFrame | Names) -> DataFrame:
    return _both(rows, symbols, "callee_raw_name", "callee_symbol_id")


def types(rows: DataFrame, symbols: DataFrame | Names) -> DataFrame:
    return _both(rows, symbols, "target_raw_name", "target_symbol_id")


def refs(rows: DataFrame, symbols: DataFrame | Names) -> DataFrame:
    return _both(rows, symbols, "raw_name", "symbol_id")


def imports(rows: DataFrame, symbols: DataFrame | Names) -> DataFrame:
    """Symbol and file of an import, both from the same lowest-id symbol with that qualified name."""
    known = "resolved_symbol_id" in rows.columns
    for c in ("resolved_symbol_id", "resolved_file_id"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("bigint"))
    look = symbols.qualified if isinstance(symbols, Names) else by_qualified_name(symbols)
    if known:
        return _open(rows, "resolved_symbol_id", lambda r: _imported(r, look))
    return _imported(rows, look)


def _imported(rows: DataFrame, look: DataFrame) -> DataFrame:
    joined = rows.join(look, rows["raw_path"] == look["key"], "left")
    return joined.withColumn("resolved_file_id", F.when(F.col("found_id").isNotNull(), F.col("found_file")).otherwise(F.col("resolved_file_id"))).withColumn("resolved_symbol_id", F.coalesce("resolved_symbol_id", "found_id")).drop("key", "found_id", "found_file")


def resolvable(rows: DataFrame, symbols: DataFrame, raw: str) -> DataFrame:
    """Rows whose raw name is the qualified name of a symbol."""
    return rows.join(symbols.select(F.col("qualified_name").alias(raw)), raw, "left_semi").select(*rows.columns)


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, resolved, unresolved), one a table of calls, types, refs and imports."""
    column = {"calls": "callee_symbol_id", "types": "target_symbol_id", "refs": "symbol_id", "imports": "resolved_symbol_id"}
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count(column[name]).alias("resolved"), F.count_if(F.col(column[name]).isNull()).alias("unresolved")).select(F.lit(name).alias("table_name"), "resolved", "unresolved")
        out = one if out is None else out.unionAll(one)
    return out
