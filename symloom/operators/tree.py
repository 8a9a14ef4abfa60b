"""Symbols and files rolled up over directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions.paths import levels
from symloom.operators.graph import decorated, top_by
from symloom.operators.verbs import with_counts

TOP_SYMBOLS = 5


def normal_scope(scope: str | None) -> str:
    return (scope or "").strip("/")


def in_scope(path: Column, scope: str | None) -> Column:
    """Whether a path is the scope or lies below it; a prefix test that reaches the scan."""
    root = normal_scope(scope)
    return (path == root) | F.startswith(path, F.lit(root + "/")) if root else F.lit(True)


def rollup(files: DataFrame, symbols: DataFrame, scope: str | None = None, depth: int = 2) -> DataFrame:
    """Rows (dir, file_count, symbol_count) for the scope and every directory up to depth below it; each counts all that lies below."""
    root = normal_scope(scope)
    per_file = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    f = files.where(in_scope(F.col("path"), scope)).join(per_file, "file_id", "left").select(F.explode(levels(F.col("path"), root, depth)).alias("dir"), F.coalesce("n", F.lit(0)).alias("n"))
    return f.groupBy("dir").agg(F.count("*").alias("file_count"), F.sum("n").cast("bigint").alias("symbol_count"))


def histogram(files: DataFrame, symbols: DataFrame, scope: str | None = None, depth: int = 2) -> DataFrame:
    """Rows (dir, kind, n), n symbols of the kind in and below the directory; counted a file first, so the explode sees few rows."""
    per_file = symbols.groupBy("file_id", "kind").agg(F.count("*").alias("n"))
    f = files.where(in_scope(F.col("path"), scope)).select("file_id", levels(F.col("path"), normal_scope(scope), depth).alias("dirs"))
    return per_file.join(f, "file_id").select(F.explode("dirs").alias("dir"), "kind", "n").groupBy("dir", "kind").agg(F.sum("n").cast("bigint").alias("n"))


def hottest(files: DataFrame, symbols: DataFrame, calls: DataFrame, scope: str | None = None, depth: int = 2, most: int = TOP_SYMBOLS) -> DataFrame:
    """Rows (dir, rank, id, qualified_name, caller_count): the most called symbols whose files fold into exactly that directory."""
    own = F.element_at(levels(F.col("path"), normal_scope(scope), depth), -1)
    s = decorated(symbols, files).where(in_scope(F.col("path"), scope)).select("id", "qualified_name", own.alias("dir"))
    return top_by(with_counts(s, calls), ["dir"], [F.desc("caller_count"), "qualified_name", "id"], most).select("dir", "rank", "id", "qualified_name", "caller_count")


def build(files: DataFrame, symbols: DataFrame, calls: DataFrame, scope: str | None = None, depth: int = 2) -> dict:
    """The tree as nested dicts {path, files, symbols, kinds, top, children}; its size is the number of directories shown."""
    root = normal_scope(scope)
    nodes = {r.dir: {"path": r.dir, "files": r.file_count, "symbols": r.symbol_count, "kinds": [], "top": [], "children": []} for r in rollup(files, symbols, scope, depth).collect()}
    if not nodes:
        return {"path": root, "files": 0, "symbols": 0, "kinds": [], "top": [], "children": []}
    for r in sorted(histogram(files, symbols, scope, depth).collect(), key=lambda r: (-r.n, r.kind)):
        nodes[r.dir]["kinds"].append((r.kind, r.n))
    places = decorated(symbols, files).select("id", "kind", "path", "start_line")
    for r in hottest(files, symbols, calls, scope, depth).join(places, "id").orderBy("dir", "rank").collect():
        nodes[r.dir]["top"].append(r.asDict())
    for path in sorted(nodes):
        if path != root:
            above = path.rpartition("/")[0]
            nodes[above if above in nodes else root]["children"].append(nodes[path])
    return nodes[root]
