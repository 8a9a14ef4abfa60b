"""Small tables with everything that can be odd about rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators use inside, as columns of the table.
CLASHING = "node string, label string, band string, a string, b string, run string, n string, size string, spots string, rank string, bin_id string, digest string, h string, keep string, start string, text_a string, d string, s string"


def documents(spark, rows, clashing: bool = False):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] is not None else None) for r in rows]
    if not clashing:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([r + ("x",) * len(CLASHING.split(",")) for r in full], SCHEMA + ", " + CLASHING)


def words(seed: int, n: int, size: int = 400) -> list[str]:
    r = random.Random(seed)
    lexicon = ["".join(random.Random(i * 7 + 1).choices("abcdefghijklmnopqrstuvwxyz", k=3 + i % 6)) for i in range(size)]
    return r.choices(lexicon, k=n)


def prose(seed: int, n: int) -> str:
    return " ".join(words(seed, n))


def odd(n: int = 0) -> list[tuple]:
    """Null ids and texts, empty and blank texts, repeated rows, a very long text."""
    long = prose(99, 30_000)
    return [(None, prose(1, 80)), (None, None), (901 + n, None), (902 + n, ""), (903 + n, ""), (904 + n, " \n\t"), (905 + n, "é"), (906 + n, prose(2, 90)), (906 + n, prose(2, 90)), (907 + n, prose(2, 90)), (908 + n, long)]
