"""The undirected multigraph over symbols, and which symbol a line lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ["parent", "call", "type", "import"]


def directed(symbols: DataFrame, calls: DataFrame, types: DataFrame, imports: DataFrame, of_imports: DataFrame | None = None) -> DataFrame:
    """Rows (a, b, kind, kind_rank, row_id, top_id): one for each resolved row, in its own direction; an import leaves from every top symbol of its file.

    of_imports: import_edges(symbols, imports) where that is stored.
    """
    none = F.lit(0).cast("bigint")

    def part(df: DataFrame, a: str, b: str, rank: int, row: str = "id", top=none) -> DataFrame:
        return df.where(F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(KINDS[rank]).alias("kind"), F.lit(rank).alias("kind_rank"), F.col(row).alias("row_id"), top.alias("top_id"))

    return part(symbols, "id", "parent_symbol_id", 0).unionAll(part(calls, "caller_symbol_id", "callee_symbol_id", 1)).unionAll(part(types, "symbol_id", "target_symbol_id", 2)).unionAll(part(import_edges(symbols, imports) if of_imports is None else of_imports, "top", "resolved_symbol_id", 3, top=F.col("top")))


def import_edges(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Each resolved import once for every symbol of its file that has no parent: (id, file_id, top, resolved_symbol_id)."""
    top = symbols.where("parent_symbol_id IS NULL").select("file_id", F.col("id").alias("top"))
    return imports.where("resolved_symbol_id IS NOT NULL").select("id", "file_id", "resolved_symbol_id").join(top, "file_id")


def edges(symbols: DataFrame, calls: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows (src, dst, kind, kind_rank, row_id, top_id), each edge in both directions, none to itself; (kind_rank, row_id, top_id) is the order of neighbours."""
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return directed(symbols, calls, types, imports).select(both.alias("e"), "kind", "kind_rank", "row_id", "top_id").select("e.src", "e.dst", "kind", "kind_rank", "row_id", "top_id")


def both_ways(directed_rows: DataFrame) -> DataFrame:
    """As edges, of stored directed rows: they are read twice, so that a filter on src reaches what is read."""
    rest = ["kind", "kind_rank", "row_id", "top_id"]
    return directed_rows.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest).unionAll(directed_rows.select(F.col("b").alias("src"), F.col("a").alias("dst"), *rest))


def decorated(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path and language of their file."""
    return symbols.join(files.select("file_id", "path", "language"), "file_id")


def breakdown(edge_rows: DataFrame) -> DataFrame:
    """Edges by kind."""
    return edge_rows.groupBy("kind").agg(F.count("*").alias("edges"))


def enclosing(sites: DataFrame, symbols: DataFrame, key: str = "site_id") -> DataFrame:
    """For sites (key, file_id, line) the smallest symbol of the file whose lines hold the line, ties to the lowest id: (key, enclosing_id), null if none.

    A symbol of n lines stands in the one or two cells of 2^ceil(log2 n) lines that it touches, and a site asks one cell of each size in use:
    an equi-join whatever the shape of the intervals, where file and range alone would compare all sites of a file with all its symbols.
    """
    size = F.col("end_line").cast("bigint") - F.col("start_line") + 1
    level = F.ceil(F.log2(size.cast("double"))).cast("int")
    spans = symbols.where("end_line >= start_line").select("file_id", F.col("id").alias("enclosing_id"), "start_line", "end_line", level.alias("level"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
    spans = spans.withColumn("cell", F.explode(F.array_distinct(F.array(cell("start_line"), cell("end_line")))))
    used = sorted(r[0] for r in spans.select("level").distinct().collect())  # 32 at most
    if not used:
        return sites.select(key, F.lit(None).cast("bigint").alias("enclosing_id"))
    asked = sites.select(key, "file_id", "line").withColumn("level", F.explode(F.array(*map(F.lit, used)))).withColumn("cell", cell("line"))
    hit = asked.join(spans, ["file_id", "level", "cell"]).where("line BETWEEN start_line AND end_line")
    best = hit.groupBy(key).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), F.col("enclosing_id"))).alias("m")).select(key, F.col("m.enclosing_id").alias("enclosing_id"))
    return sites.select(key).join(best, key, "left")


def module_dependencies(edge_rows: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """How many directed edges lead from directory to directory: (from_dir, to_dir, kind, edges)."""
    from symloom.functions.paths import directory

    where = decorated(symbols, files).select(F.col("id").alias("sid"), directory(F.col("path")).alias("dir"))
    left = where.select(F.col("sid").alias("a"), F.col("dir").alias("from_dir"))
    right = where.select(F.col("sid").alias("b"), F.col("dir").alias("to_dir"))
    return edge_rows.join(left, "a").join(right, "b").groupBy("from_dir", "to_dir", "kind").agg(F.count("*").alias("edges"))


def top_by(df: DataFrame, partition: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; the limit is pushed below the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("bigint")).where(F.col(rank) <= n)
