"""From text to symbols: seeds of a question, and the symbols that a name may mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.text import ascii_lower, name_score, tokens
from symloom.operators.graph import decorated
from symloom.shared import stored

MAX_SEEDS = 16
#: Texts that are looked for within names in one scan, and letters of the runs by which more are joined.
SCANNED, RUN = 64, 3
TIERS = ["qualified name", "name", "suffix", "part"]


class Ambiguous(ValueError):
    """A name that means more than one symbol; candidates are (id, qualified_name, kind, path, start_line, language)."""

    def __init__(self, query: str, candidates: list) -> None:
        self.query, self.candidates = query, candidates
        langs = {c.language for c in candidates}
        note = " across languages" if len(langs) > 1 else ""
        listed = "\n".join(f"  - {c.qualified_name} ({c.kind}) {c.path}:{c.start_line}" for c in candidates[:10])
        more = f"\n  ... and {len(candidates) - 10} more" if len(candidates) > 10 else ""
        super().__init__(f"'{query}' is ambiguous{note}: {len(candidates)} symbols\n{listed}{more}")


def question_tokens(questions: DataFrame, column: str) -> DataFrame:
    """Questions with their words exploded: every other column, position (from 0) and token."""
    keep = [c for c in questions.columns if c != column]
    return questions.select(*keep, F.posexplode(tokens(F.col(column))).alias("position", "token"))


def scored(symbols: DataFrame, question: str) -> DataFrame:
    """Symbols with a score above 0 for the question; one scan, no join."""
    words = symbols.sparkSession.range(1).select(tokens(F.lit(question)).alias("t")).first().t  # once, not once a symbol
    lower = symbols.withColumns({"_name": ascii_lower(F.col("name")), "_qualified": ascii_lower(F.col("qualified_name"))})
    return lower.withColumn("score", name_score(F.col("_name"), F.col("_qualified"), words)).where("score > 0").drop("_name", "_qualified")


def seeds(symbols: DataFrame, question: str, most: int = MAX_SEEDS) -> DataFrame:
    """Rows (position, id, score), the best first: higher score, then shorter name in bytes, then lower id. A top-k that keeps k rows a task."""
    top = scored(symbols, question).select("id", "score", F.octet_length("name").alias("n")).orderBy(F.desc("score"), "n", "id").limit(most)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "n", "id")).cast("bigint") - 1).select("position", "id", "score")


def candidates(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """For each text of queries (column q) the symbols of its first tier that has any: (q, tier, id).

    The two tiers of equality are hash joins. What they leave open is looked for within names: a few texts in one scan with the texts broadcast, more of
    them by joins on a run of letters that a text and the names with it share.
    """
    q = queries.select(F.trim("q").alias("q")).where("q <> ''").distinct()
    s = symbols.select("id", "qualified_name", "name")
    full = q.join(s, q["q"] == s["qualified_name"]).select("q", F.lit(0).alias("tier"), "id")
    bare = q.join(s, q["q"] == s["name"]).select("q", F.lit(1).alias("tier"), "id")
    equal = full.unionAll(bare)
    open_ = stored(q.join(equal.select("q").distinct(), "q", "left_anti"), "open")
    every = equal.unionAll(_within(s, open_))
    first = F.min("tier").over(Window.partitionBy("q"))
    return every.withColumn("first", first).where("tier = first").select("q", "tier", "id")


def _within(symbols: DataFrame, texts: DataFrame, at_once: int | None = None) -> DataFrame:
    """Rows (q, tier, id) of symbols whose qualified name has a text of texts (q, a stored table) in it."""
    at_once = SCANNED if at_once is None else at_once
    suffix = F.endswith("qualified_name", F.concat(F.lit("::"), "q")) | F.endswith("qualified_name", F.concat(F.lit("."), "q"))
    out = lambda pairs: pairs.select("q", F.when(suffix, 2).otherwise(3).alias("tier"), "id")
    few = texts if texts.limit(at_once + 1).count() <= at_once else texts.where(F.length("q") < RUN)
    found = out(symbols.join(F.broadcast(few), F.contains("qualified_name", F.col("q"))))  # at_once texts, or as many as there are of fewer than RUN letters
    if few is texts:
        return found
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (RUN - 1)), lambda i: F.substr(F.col(c), i, F.lit(RUN))))
    has = stored(symbols.where(F.length("qualified_name") >= RUN).select("id", "qualified_name", F.explode(runs("qualified_name")).alias("run")), "runs")
    n = has.groupBy("run").agg(F.count("*").alias("n"))
    # each text by the run of it that the fewest names have; one that no name has rules it out
    each = texts.where(F.length("q") >= RUN).select("q", F.explode(runs("q")).alias("run")).join(n, "run", "left")
    rarest = each.groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("m")).where("m.n > 0").select("q", F.col("m.run").alias("run"))
    return found.unionAll(out(has.join(rarest, "run").where(F.contains("qualified_name", F.col("q")))))


def ambiguous(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (name, candidates, cross_language) of the names that more than one symbol has."""
    return decorated(symbols, files).groupBy("name").agg(F.count("*").alias("candidates"), (F.count_distinct("language") > 1).alias("cross_language")).where("candidates > 1")


def find(symbols: DataFrame, files: DataFrame, text: str, path: str | None = None) -> int | None:
    """The id of the symbol that a text means, None if there is none; with a path, only symbols of that file count. Raises Ambiguous."""
    text = text.strip()
    if not text:
        return None
    queries = symbols.sparkSession.createDataFrame([(text,)], "q string")
    found = candidates(symbols, queries).join(symbols, "id").join(files.select("file_id", "path", "language"), "file_id")
    listed = lambda x: x.select("id", "qualified_name", "kind", "path", "start_line", "language").orderBy("id").limit(10_001).collect()
    rows = listed(found)
    if path is not None and len(rows) > 1:
        # of more candidates than are listed, those of the file may be any
        rows = listed(found.where(F.col("path") == path)) if len(rows) > 10_000 else [r for r in rows if r.path == path]
    if not rows:
        return None
    if len(rows) > 1:
        raise Ambiguous(text, rows)
    return rows[0].id
