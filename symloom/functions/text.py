"""Column functions with byte lengths and ASCII-only case, as the index's names are compared."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a question that are compiled into the scan of names.
SPELLED_OUT = 64
#: Question words that say nothing about a symbol.
STOPWORDS = sorted(
    "all and any are but can could does find for from get had has have how into let not set should show tell that the this use used uses was were what where which will with would you".split()
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokens(question: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """The distinct words of a question in order: of letters, digits, _ : and ., trimmed of : and ., 3 bytes or more, no stop words."""
    raw = F.split(ascii_lower(question), r"[^\p{IsAlphabetic}\p{N}_:.]+", -1)
    trimmed = F.transform(raw, lambda t: F.regexp_replace(t, r"^[:.]+|[:.]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda t: (F.octet_length(t) >= 3) & ~t.isin(stopwords)))


def name_score(name: Column, qualified: Column, words: list[str]) -> Column:
    """100 a word that is the name, 30 a word in it, 10 more a word in the qualified name; name and qualified as ascii_lower has them."""
    one = lambda t: F.when(name == t, 100).when(F.contains(name, t), 30).otherwise(0) + F.when(F.contains(qualified, t), 10).otherwise(0)
    if len(words) <= SPELLED_OUT:  # compiled into the scan
        return functools.reduce(lambda a, b: a + b, [one(F.lit(t)) for t in words], F.lit(0))
    return F.aggregate(F.array(*map(F.lit, words)), F.lit(0), lambda acc, t: acc + one(t))


def lines(text: Column) -> Column:
    """The lines of a text: each newline ends one, with a carriage return before it; nothing after the last newline is no line."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fitting_lines(parts: Column, remaining: Column) -> Column:
    """How many lines, from the first, fit: each costs its bytes and one more, and the first that doesn't fit ends it."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.octet_length(line) + 1
        fits = acc["on"] & (used <= remaining)
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("on"))

    return F.aggregate(parts, start, step, lambda acc: acc["n"])


def byte_slice(content: Column, start: Column, stop: Column) -> Column:
    """The text of bytes [start, stop) of UTF-8 content; empty if the range is empty, reaches past the end or cuts a character."""
    size = F.octet_length(content)
    # a continuation byte has the bits 10xxxxxx; a range may begin or end only before another kind of byte
    def cuts(at: Column) -> Column:
        return (at < size) & F.substring(F.hex(F.substring(content, (at + 1).cast("int"), F.lit(1))), 1, 1).isin("8", "9", "A", "B")

    good = (start >= 0) & (stop > start) & (stop <= size) & ~cuts(start) & ~cuts(stop)
    return F.when(F.coalesce(good, F.lit(False)), F.decode(F.substring(content, (start + 1).cast("int"), (stop - start).cast("int")), "UTF-8")).otherwise("")


def strictly_inside(prefix: Column, full: Column) -> Column:
    """Whether a qualified name continues another after a separator."""
    return (F.octet_length(prefix) > 0) & (F.startswith(full, F.concat(prefix, F.lit("::"))) | F.startswith(full, F.concat(prefix, F.lit("."))))
