"""Language identification by cross-parsing entropy: suffix automata of labelled text, one a language.

A text is parsed greedily into the longest pieces that occur in a language's labelled text; the language that needs the fewest pieces,
normalised to pieces x log2(labelled bytes) / bytes of the text, wins. The automaton of each language is completed to a table: where a
piece can go no further, the piece is counted and the next one begins with that byte (a byte that the language has never seen is a
piece of its own). All texts of a batch are then parsed side by side, for all languages at once, a byte each step.

Of a text, labelled or not, letters count (lower-cased, non-ASCII characters included); whatever lies between them is one space.
Texts are parsed whole, whatever their length: segments are parsed side by side and then joined, see Parser.parse(). Labelled text is a
bounded sample: labelled texts are cut into pieces of CHARS characters, from beginning to end, and DOCS pieces a language are chosen by a hash
of doc_id and the piece's number, at most one of a text as long as there are enough texts. No text is left out for its length.

Nulls: a null or empty text, or one without letters, has a null language; rows without lang are classified and not learned from; a null
doc_id is carried. Of languages that tie the first in the alphabet wins. Repeated rows are classified each and learned from once. Other columns
are not looked at. An empty table gives no rows, and without labelled text every language is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.llm.store import table
from symloom.llm.words import flat, slices

#: Pieces of labelled text a language and their characters; bytes of a segment.
DOCS, CHARS, SEGMENT = 16, 4096, 1024
#: Bytes times languages that are parsed at once.
PARSED = 8_000_000
#: Languages whose tables are sent at once (some 15 MB each); more are parsed in further passes over the documents.
AT_ONCE = 16


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts as they are parsed, end to end, and where they begin."""
    body, at = flat(texts)
    letter = _LETTER[body]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte after a letter stays, as a space
    first = at[(at > 0) & (at < len(body))]
    keep[first] = letter[first]
    count = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, body, np.uint8(32))[keep], count[at]


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return go


class Parser:
    """Completed tables of some languages, end to end; an entry is 4 x (next row's place) + pieces that end here."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.languages = sorted(texts)
        joined = {x: b"\0".join(texts[x]) for x in self.languages}
        used = sorted(set().union(*map(set, joined.values())) - {0})
        self.symbol = np.zeros(256, np.int64)  # 0: a byte that no language has
        self.symbol[used] = np.arange(1, len(used) + 1)
        width, tables, self.start, base = len(used) + 1, [], [], 0
        self.scale = np.array([np.log2(max(2, len(joined[x]))) for x in self.languages])
        for x in self.languages:
            go = automaton(joined[x])
            first = np.full(width, base * 4 + 1, np.int64)
            for c, s in go[0].items():
                if c:
                    first[self.symbol[c]] = (base + s * width) * 4
            # a missing step ends the piece; the byte begins the next one, or is a piece of its own
            out = np.tile(first + 1, (len(go), 1))
            for s, steps in enumerate(go):
                for c, to in steps.items():
                    if c:
                        out[s, self.symbol[c]] = (base + to * width) * 4
            out[0] = first
            tables.append(out.ravel())
            self.start.append(base)
            base += out.size
        self.table = np.concatenate(tables).astype(np.int32 if base * 4 < 2**31 else np.int64) if tables else np.zeros(0, np.int32)

    def pieces(self, texts: pa.Array, segment: int = SEGMENT, most: int = PARSED) -> tuple[np.ndarray, np.ndarray]:
        """Pieces by language and text, and the texts' bytes. Of a text that is longer than is parsed at once the state is carried on."""
        body, at = letters(texts)
        out = np.zeros((len(self.languages), len(at) - 1), np.int64)
        most = max(segment, most // max(1, len(self.languages)) // segment * segment)
        a, last = 0, np.array(self.start, np.int64)
        while a < len(body):
            i = int(np.searchsorted(at, a, side="right")) - 1
            b = min(a + most, len(body))
            if b < len(body):  # texts that fit are parsed in one go
                j = int(np.searchsorted(at, b, side="right")) - 1
                b = int(at[j]) if at[j] > a else b
            j = int(np.searchsorted(at, b, side="left"))
            n, ends = self.parse(self.symbol[body[a:b]], np.clip(at[i : j + 1], a, b) - a, last, segment)
            out[:, i:j] += n
            if at[j] > b:
                last = ends
            else:
                last = np.array(self.start, np.int64)
                out[:, j - 1] += ends != last
            a = b
        return out, np.diff(at)

    def parse(self, symbols: np.ndarray, at: np.ndarray, first: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that end within each text, by language, and the states in which the last text ends; the first text begins in the states first.

        A text's segments are parsed side by side, each as if a piece began with it. Then each is parsed again from where the one before
        it really ends, until both parses are in the same state, from which on they are the same; and so on until no segment's beginning changes.
        """
        n, start, size = len(self.languages), np.array(self.start, np.int64), np.diff(at)
        parts = -(-size // segment)
        owner = np.repeat(np.arange(len(size)), parts)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[:-1][owner] + inner * segment
        length = np.minimum(segment, at[1:][owner] - begin)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        begin, length = begin[order], length[order]
        longest = int(length[0]) if len(length) else 0
        width = np.searchsorted(-length, -np.arange(longest), side="left")  # segments longer than t
        entry = np.repeat(start[:, None], len(begin), axis=1)
        if len(begin):
            entry[:, place[0]] = first
        state, ended = entry.copy(), np.zeros((n, len(begin)), np.int64)
        path = []  # what each step looked up
        for t in range(longest):
            w = width[t]
            step = self.table[state[:, :w] + symbols[begin[:w] + t]]
            path.append(step)
            ended[:, :w] += step & 3
            state[:, :w] = step >> 2
        follows = np.flatnonzero(inner > 0)  # in order of texts and segments
        while len(follows):
            now = state[:, place[follows - 1]]
            language, which = np.nonzero(now != entry[:, place[follows]])
            if not len(language):
                break
            column = place[follows[which]]
            mine = now[language, which]
            entry[language, column] = mine
            l, c = language, column
            for t in range(longest):
                on = length[c] > t
                if not on.all():
                    state[l[~on], c[~on]] = mine[~on]
                    l, c, mine = l[on], c[on], mine[on]
                if not len(l):
                    break
                step, old = self.table[mine + symbols[begin[c] + t]], path[t][l, c]
                path[t][l, c] = step
                ended[l, c] += (step & 3).astype(np.int64) - (old & 3)
                apart = (step >> 2) != (old >> 2)
                l, c, mine = l[apart], c[apart], (step >> 2)[apart].astype(np.int64)
            else:
                state[l, c] = mine
        total = np.zeros((n, len(size)), np.int64)
        some = np.flatnonzero(size)
        last = np.cumsum(parts)[some] - 1
        for x in range(n):
            total[x] = np.bincount(owner, weights=ended[x, place], minlength=len(size))
            total[x, some[:-1]] += state[x, place[last[:-1]]] != start[x]  # the piece that a text ends in
        return total, state[:, place[last[-1]]] if len(some) else first


def labelled(docs: DataFrame, pieces: int = DOCS, chars: int = CHARS) -> dict[str, list[bytes]]:
    """The bounded sample of labelled texts."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text <> ''")
    # of each text the piece whose hash is least comes first: its others are only taken where texts are few
    light = own.select("doc_id", "lang", F.md5("text").alias("h"), F.ceil(F.length("text") / chars).cast("bigint").alias("n"))
    each = light.select("doc_id", "lang", "h", F.posexplode(F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.xxhash64("doc_id", "h", i).alias("key"), i.alias("piece")))), 1, pieces)).alias("turn", "p"))
    each = each.select("doc_id", "lang", "h", "turn", "p.piece", "p.key").withColumn("part", F.pmod("key", F.lit(64)))
    # the best of each language, kept down in parts first: a few rows a part meet in one task
    first = F.struct("turn", "key", "doc_id", "h", "piece")
    some = each.distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(first))).where(F.col("r") <= pieces)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(first))).where(F.col("r") <= pieces).select("doc_id", "lang", "h", "piece")
    on = ["lang", "h"]  # a null doc_id is learned from as well
    rows = own.withColumn("h", F.md5("text")).join(F.broadcast(best.withColumnRenamed("doc_id", "of")), on).where(F.col("doc_id").eqNullSafe(F.col("of"))).select("lang", "doc_id", "piece", F.substring("text", (F.col("piece") * chars + 1).cast("int"), F.lit(chars)).alias("text")).distinct().collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, r.piece, r.text)):
        out.setdefault(r.lang, []).append(letters(pa.array([r.text]))[0].tobytes())
    return {x: t[:pieces] for x, t in out.items()}


def identify(docs: DataFrame, texts: dict[str, list[bytes]], segment: int = SEGMENT) -> DataFrame:
    """Rows (doc_id, language, pieces, score), one a row of docs: the winner, its pieces and its normalised pieces."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("bigint").alias("pieces"), F.lit(None).cast("double").alias("score"))
    names = sorted(texts)
    for a in range(0, len(names), AT_ONCE):
        sent = docs.sparkSession.sparkContext.broadcast(Parser({x: texts[x] for x in names[a : a + AT_ONCE]}))

        def run(batches, sent=sent):
            parser = sent.value
            for batch in batches:
                for part in slices(batch, most=4_000_000):
                    n, size = parser.pieces(part.column(1), segment)
                    value = n * parser.scale[:, None] / np.maximum(size, 1)
                    win = value.argmin(axis=0)
                    each = np.arange(len(size))
                    best = value[win, each].round(6)
                    before = part.column(4).to_pandas().fillna(np.inf).to_numpy(np.float64)
                    new = (best < before) & (size > 0)
                    language = [parser.languages[w] if x else old for w, x, old in zip(win, new, part.column(2).to_pylist())]
                    pieces = [int(n[w, i]) if x else old for i, (w, x, old) in enumerate(zip(win, new, part.column(3).to_pylist()))]
                    score = np.where(new, best, before)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(language, pa.string()), pa.array(pieces, pa.int64()), pa.array(score, mask=np.isinf(score))], ["doc_id", "text", "language", "pieces", "score"])

        own = own.mapInArrow(run, "doc_id bigint, text string, language string, pieces bigint, score double")
    return own.select("doc_id", "language", "pieces", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, labelled(docs))


SQL = None
