"""Quality classifier: nearest-neighbour voting on labelled latent-semantic vectors.

Terms of a document are its lower-cased words, the beginnings of longer ones, its runs of symbols, and binned shares of capitals, symbols, repeated words,
digits and word lengths. For each label (quality, toxicity), the terms that go with it are weighted by their log-odds, and a truncated SVD
of the labelled documents' term matrix gives a latent space. The labelled vectors are broadcast, and for every document the cosines with
all of them are computed exactly, block by block; its K nearest, with all that tie with the Kth, vote by similarity.

The labelled rows are a bounded sample (SAMPLE a class, chosen by a hash of doc_id), so the broadcast doesn't grow with the data.

Nulls: a null text counts as empty; labels with a null are not used; of several labels for a doc_id the worst counts, and of several texts
the least is learned from. A labelled document of the sample is one of its own neighbours when it is judged. Empty texts are judged by their bins like
others, very long ones whole. Rows that are repeated are judged each. Without labelled documents, or if all have the same label,
that vote is null and rejects nothing. An empty table gives no rows. Other columns are carried in a stage and ignored in the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.store import table
from symloom.llm.words import _WORD, cuts, flat, mix, powers, slices, span_hashes, spans

#: Labelled rows a class, terms, latent dimensions, neighbours.
SAMPLE, TERMS, DIMS, K = 1000, 1024, 64, 15
#: How far a term's shares in the two classes must lie apart, in standard errors; the constant component of every vector.
LEAST_Z, CONSTANT = 3.0, 2.0
#: Lengths in bytes of the word beginnings that are terms too: words of one stem share them, whatever their endings.
BEGINNINGS = (4, 5, 6, 7, 8)
SCHEMA = "doc_id bigint, p_quality double, p_toxic double, keep boolean"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = ~_WORD & ~_SPACE
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (document, term hash), with repetitions."""
    raw, raw_at = flat(texts, lower=False)
    body, at = flat(texts)
    n = len(at) - 1
    starts, ends = spans(body, at)
    word = span_hashes(body, starts, ends)
    of_word = np.searchsorted(at, starts, side="right") - 1
    s0, s1 = spans(raw, raw_at, _SYMBOL)
    symbol = mix(span_hashes(raw, s0, s1) ^ np.uint64(7))
    of_symbol = np.searchsorted(raw_at, s0, side="right") - 1
    words_in = np.maximum(np.bincount(of_word, minlength=n), 1)
    per = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    between = lambda c: c[raw_at[1:]] - c[raw_at[:-1]]
    length = np.maximum(np.diff(raw_at), 1)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (of_word[1:] == of_word[:-1])
    shares = [between(per(_UPPER[raw])) / length, np.bincount(of_symbol, minlength=n) / words_in, between(per(_SYMBOL[raw])) / length, np.bincount(of_word[again], minlength=n) / words_in, between(per(_DIGIT[raw])) / length, np.minimum(np.diff(at) / words_in, 40) / 40]
    of_beginning, beginning = beginnings(body, starts, ends)
    docs, hashes = [of_word, of_symbol, of_word[of_beginning]], [word, symbol, beginning]
    for j, share in enumerate(shares):
        docs.append(np.arange(n))
        hashes.append(mix((np.minimum(share, 1) * 12).round().astype(np.uint64) + np.uint64(1000 * (j + 1))))
    return np.concatenate(docs), np.concatenate(hashes)


def beginnings(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...] = BEGINNINGS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first bytes of words that are longer than so many, and which word each is of."""
    size, sums = ends - starts, np.zeros(len(starts), np.uint64)
    of, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    power = powers(max(lengths) + 1)
    at = np.flatnonzero(size > min(lengths))
    for j in range(max(lengths)):
        at = at[size[at] > j]
        sums[at] += (body[starts[at] + j].astype(np.uint64) + np.uint64(1)) * power[j]
        if j + 1 in lengths:
            long = at[size[at] > j + 1]
            of.append(long)
            hashes.append(mix(sums[long] ^ np.uint64(0x5851F42D4C957F2D * (j + 1) % 2**64)))
    return np.concatenate(of), np.concatenate(hashes)


def term_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (document, term hash) without repetitions, a slice of the texts at a time."""
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in cuts(np.array([len(t) for t in texts], np.int64), 300_000):
        d, h = terms(pa.array(texts[a:b], pa.string()))
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        docs.append(d[new] + a)
        hashes.append(h[new])
    return np.concatenate(docs), np.concatenate(hashes)


class Space:
    """The latent space of one label: terms that go with it, the projection, and the labelled vectors.

    Every vector has a constant component besides, so documents without any of the terms are near those that have none either.
    """

    def __init__(self, docs: np.ndarray, hashes: np.ndarray, y: np.ndarray, n_terms: int, dims: int) -> None:
        self.y = y.astype(np.float32)
        vocabulary, t = np.unique(hashes, return_inverse=True)
        n1, n0 = y.sum(), (1 - y).sum()
        p1 = (np.bincount(t, weights=y[docs], minlength=len(vocabulary)) + 0.5) / (n1 + 1)
        p0 = (np.bincount(t, weights=1 - y[docs], minlength=len(vocabulary)) + 0.5) / (n0 + 1)
        p = (p1 * n1 + p0 * n0) / (n1 + n0)
        z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        chosen = np.sort(np.lexsort((vocabulary, -z))[:n_terms])
        chosen = chosen[z[chosen] >= LEAST_Z]
        self.vocabulary, self.weight = vocabulary[chosen], np.abs(np.log(p1 / p0))[chosen].astype(np.float32)
        self.near = np.zeros(1 << 16, bool)
        self.near[self.vocabulary >> np.uint64(48)] = True
        matrix = self.matrix(docs, hashes, len(y))
        values, vectors = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
        self.projection = vectors[:, np.argsort(-values)[:dims]].astype(np.float32)
        self.vectors = self.latent(matrix)

    def matrix(self, docs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.vocabulary)), np.float32)
        if len(self.vocabulary):
            hit = np.flatnonzero(self.near[hashes >> np.uint64(48)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[hit]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == hashes[hit]
            out[docs[hit[same]], at[same]] = 1
        return out * self.weight

    def latent(self, matrix: np.ndarray) -> np.ndarray:
        x = np.concatenate([matrix @ self.projection, np.full((len(matrix), 1), CONSTANT, np.float32)], axis=1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def vote(self, own: np.ndarray, k: int, block: int = 512) -> np.ndarray:
        """The share of the label among the k nearest labelled vectors and all that tie with the kth, weighted by similarity."""
        out, k = np.zeros(len(own)), min(k, len(self.vectors))
        for a in range(0, len(own), block):
            near = own[a : a + block] @ self.vectors.T
            kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k : near.shape[1] - k + 1]
            weight = np.where(near >= kth - 1e-5, np.maximum(near, 1e-6), 0)
            out[a : a + block] = weight @ self.y / weight.sum(axis=1)
        return out


class Model:
    """A space for each label; judge() gives the votes for texts."""

    def __init__(self, texts: list, quality: np.ndarray, toxic: np.ndarray, n_terms: int = TERMS, dims: int = DIMS, k: int = K) -> None:
        self.k = k
        docs, hashes = term_sets(texts)
        self.spaces = [None if len(y) == 0 or y.min() == y.max() else Space(docs, hashes, y, n_terms, dims) for y in (quality, toxic)]

    def judge(self, texts: pa.Array) -> list[np.ndarray | None]:
        """Votes for quality and toxicity; None for a label that the labelled documents don't tell."""
        docs, hashes = terms(texts)
        return [None if s is None else s.vote(s.latent(s.matrix(docs, hashes, len(texts))), self.k) for s in self.spaces]

    def keep(self, votes: list[np.ndarray | None], n: int) -> np.ndarray:
        quality, toxic = votes
        return np.ones(n, bool) & (True if quality is None else quality >= 0.5) & (True if toxic is None else toxic < 0.5)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most sample rows (doc_id, text, quality, toxic) of each class."""
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    parts = [one.where((F.col("quality") == q) & (F.col("toxic") == t)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1) for t in (0, 1)]
    chosen = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # 4 x sample rows at most, whatever number of rows a doc_id has
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "quality", "toxic")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, sample).toPandas().sort_values("doc_id")
    return Model(rows.text.tolist(), rows.quality.to_numpy(), rows.toxic.to_numpy())


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, p_quality, p_toxic, keep), one for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                votes = sent.value.judge(part.column(1))
                keep = sent.value.keep(votes, part.num_rows)
                columns = [pa.nulls(part.num_rows, pa.float64()) if v is None else pa.array(v.round(6)) for v in votes]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(keep)], ["doc_id", "p_quality", "p_toxic", "keep"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the votes don't reject."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(sent.value.keep(sent.value.judge(part.column(place)), part.num_rows)))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fitted(docs, table(spark, sf_dir, "labels")))


SQL = None
