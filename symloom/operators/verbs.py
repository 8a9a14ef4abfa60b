"""What the read verbs answer, for all symbols or sites at once; one symbol is a filter that Catalyst pushes below windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.text import byte_slice, fitting_lines, lines, strictly_inside
from symloom.operators.graph import enclosing, top_by
from symloom.operators.ids import dense_ids

CALLERS, IMPORTS, HARD_LIMIT, BYTES_PER_TOKEN = 3, 16, 10_000, 4
#: Neighbours from which on those of one symbol are more than one task's.
HOT = 2_000_000


def with_counts(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """Rows with an id, and caller_count: call rows, not distinct callers."""
    n = calls.where("callee_symbol_id IS NOT NULL").groupBy(F.col("callee_symbol_id").alias("id")).agg(F.count("*").alias("n"))
    return rows.join(n, "id", "left").withColumn("caller_count", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")


def caller_counts(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Rows (id, caller_count) for every symbol."""
    return with_counts(symbols.select("id"), calls)


def call_sites(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (id, callee_symbol_id, caller, caller_path, site_path, line, col) of resolved calls: who calls, and where both lie."""
    caller = symbols.join(files, "file_id").select(F.col("id").alias("caller_symbol_id"), F.col("qualified_name").alias("caller"), F.col("path").alias("caller_path"))
    site = files.select("file_id", F.col("path").alias("site_path"))
    return calls.where("callee_symbol_id IS NOT NULL").join(caller, "caller_symbol_id").join(site, "file_id").select("id", "callee_symbol_id", "caller", "caller_path", "site_path", "line", "col")


def first_callers(calls: DataFrame, most: int = CALLERS) -> DataFrame:
    """Rows (callee_symbol_id, rank, caller_symbol_id): distinct callers with the lowest ids."""
    pairs = calls.where("callee_symbol_id IS NOT NULL").select("callee_symbol_id", "caller_symbol_id").distinct()
    return top_by(pairs, ["callee_symbol_id"], ["caller_symbol_id"], most)


def neighbourhood(edges: DataFrame, symbols: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Rows (id, bucket, position, neighbor_id): one-hop neighbours, once for each kind, in order of qualified names.

    Buckets are parents, children, callees, types and imports. Calls go to callees in either direction, since edges have none. places: rows (id, place) of
    every symbol in order of qualified name and id, which are narrower than names where all symbols are asked for. Neighbours of a symbol that
    everything uses are put in order by ranges, so they are no single task's; others in one window.
    """
    names = symbols.select("id", "qualified_name")
    names = names.withColumn("place", F.col("qualified_name")) if places is None else names.join(places, "id")
    e = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor_id"), "kind_rank")
    named = lambda rows, key, *more: rows.join(names.select(F.col("id").alias(key), *more), key)
    up = named(named(e.where("kind_rank = 0"), "id", F.col("qualified_name").alias("own")), "neighbor_id", F.col("qualified_name").alias("other"), "place")
    up = up.select("id", "neighbor_id", F.when(strictly_inside(F.col("own"), F.col("other")), 0).otherwise(1).alias("b"), "place")
    rest = named(e.where("kind_rank > 0"), "neighbor_id", "place").select("id", "neighbor_id", (F.col("kind_rank") + 1).alias("b"), "place")
    both = up.unionAll(rest)
    if hot := _hot(e):
        apart = F.col("id").isin(hot)
        found = _by_window(both.where(~apart)).unionAll(_by_ranges(both.where(apart)))
    else:
        found = _by_window(both)
    bucket = F.element_at(F.array(*map(F.lit, ["children", "parents", "callees", "types", "imports"])), F.col("b") + 1)
    return found.select("id", bucket.alias("bucket"), "position", "neighbor_id")


def _hot(e: DataFrame) -> list[int]:
    """Symbols with some HOT neighbours or more, by every 64th pair; which they are says only how their neighbours are put in order."""
    some = e.where(F.xxhash64("id", "neighbor_id") % 64 == 0)
    return [r.id for r in some.groupBy("id").count().where(F.col("count") >= HOT // 64).collect()]


def _by_window(rows: DataFrame) -> DataFrame:
    """Rows (id, b, place, neighbor_id) once each, with their position in each (id, b)."""
    w = Window.partitionBy("id", "b").orderBy("place", "neighbor_id")
    at = rows.withColumns({"position": F.dense_rank().over(w).cast("bigint") - 1, "_again": F.lag("neighbor_id").over(w) == F.col("neighbor_id")})
    return at.where("_again IS NULL OR NOT _again").select("id", "b", "position", "neighbor_id")


def _by_ranges(rows: DataFrame) -> DataFrame:
    at = dense_ids(rows.distinct(), ["id", "b", "place", "neighbor_id"], "at")
    first = at.groupBy("id", "b").agg(F.min("at").alias("first"))
    return at.join(first, ["id", "b"]).select("id", "b", (F.col("at") - F.col("first")).alias("position"), "neighbor_id")


def directed_calls(calls: DataFrame) -> DataFrame:
    """Rows (id, bucket, neighbor_id) with calls told apart: callers and callees."""
    c = calls.where("callee_symbol_id IS NOT NULL AND callee_symbol_id <> caller_symbol_id").select("caller_symbol_id", "callee_symbol_id").distinct()
    return c.select(F.col("caller_symbol_id").alias("id"), F.lit("callees").alias("bucket"), F.col("callee_symbol_id").alias("neighbor_id")).unionAll(c.select(F.col("callee_symbol_id").alias("id"), F.lit("callers").alias("bucket"), F.col("caller_symbol_id").alias("neighbor_id")))


def sites(calls: DataFrame, refs: DataFrame, symbols: DataFrame, files: DataFrame, limit: int = 20, dedup_calls: bool = False) -> DataFrame:
    """Rows (target_id, position, caller_id, kind, path, line, col, truncated): for every symbol the places where it is used.

    Calls come first, by caller and line; other uses fill up to the limit, by the symbol that they lie in and line. What is kept is then ordered by
    caller (none last), path and line; truncated says whether there were more.
    """
    limit = min(limit, HARD_LIMIT)
    c = calls.where("callee_symbol_id IS NOT NULL").join(symbols.select(F.col("id").alias("caller_symbol_id")), "caller_symbol_id").select(F.col("callee_symbol_id").alias("target_id"), F.lit(0).alias("part"), F.col("caller_symbol_id").alias("caller_id"), F.lit("call").alias("kind"), "file_id", "line", "col", "id")
    r = refs.where("symbol_id IS NOT NULL")
    if dedup_calls:
        r = r.where("kind <> 'call'")
    within = enclosing(r.select(F.col("id").alias("site_id"), "file_id", "line"), symbols)
    r = r.join(within, r["id"] == within["site_id"], "left").select(F.col("symbol_id").alias("target_id"), F.lit(1).alias("part"), F.col("enclosing_id").alias("caller_id"), "kind", "file_id", "line", "col", "id")
    order = ["part", F.asc_nulls_first("caller_id"), "line", "id"]
    kept = top_by(c.unionAll(r), ["target_id"], order, limit + 1)
    kept = kept.withColumn("n", F.max("rank").over(Window.partitionBy("target_id"))).where(F.col("rank") <= limit)
    kept = kept.join(files.select("file_id", "path"), "file_id")
    final = Window.partitionBy("target_id").orderBy(F.asc_nulls_last("caller_id"), "path", "line", "rank")
    return kept.select("target_id", (F.row_number().over(final).cast("bigint") - 1).alias("position"), "caller_id", "kind", "path", "line", "col", (F.col("n") > limit).alias("truncated"))


def body(contents: DataFrame, start: str, stop: str, column: str = "content") -> DataFrame:
    """contents with the column body, the text of bytes [start, stop)."""
    return contents.withColumn("body", byte_slice(F.col(column), F.col(start), F.col(stop)))


def within_budget(df: DataFrame, text: str, signature: str, budget: int | Column) -> DataFrame:
    """df with kept (the lines that fit) and truncated: a token is 4 bytes, the signature and its newline come off first."""
    most = (F.lit(budget) if isinstance(budget, int) else budget).cast("bigint") * BYTES_PER_TOKEN
    taken = F.coalesce(F.octet_length(signature) + 1, F.lit(0))
    parts = lines(F.col(text))
    n = fitting_lines(F.col("_lines"), F.greatest(most - taken, F.lit(0)))  # of the column: a text is split once
    return df.withColumn("_lines", parts).withColumn("_n", n).withColumn("kept", F.slice("_lines", F.lit(1), F.col("_n"))).withColumn("truncated", F.col("_n") < F.size("_lines")).drop("_lines", "_n")


def file_imports(imports: DataFrame, most: int = IMPORTS) -> DataFrame:
    """Rows (file_id, rank, raw_path): the first imports of each file by line and id."""
    return top_by(imports.select("file_id", "line", "id", "raw_path"), ["file_id"], ["line", "id"], most).select("file_id", "rank", "raw_path")


def slices(asked: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """For asked (site_id, path, line) the symbol that a slice shows: (site_id, file_id, enclosing_id); sites without file or symbol are left out."""
    on = asked.join(files.select("file_id", "path"), "path")
    found = enclosing(on.select("site_id", "file_id", "line"), symbols).where("enclosing_id IS NOT NULL")
    return on.select("site_id", "file_id").join(found, "site_id")


def by_file(rows: DataFrame) -> DataFrame:
    """Rows (position, path, id) of rows (path, start_line, id): within each file by start line."""
    return top_by(rows, ["path"], ["start_line", "id"], 2**31 - 1, "position").select((F.col("position") - 1).alias("position"), "path", "id")
