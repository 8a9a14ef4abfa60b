"""Words and shingles of whole Arrow batches as numpy arrays, without a Python object per word.

A word is a longest run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
Hashes have 64 bits; equality of hashes stands for equality of words and shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same definition of a word for DuckDB.
WORD_SQL = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Text bytes, and rows, that are taken through numpy at once; a longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 4096

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64) * 2, _BASE))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and the n + 1 places where texts begin; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes of text."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    for a, b in cuts(sizes, most):
        yield batch.slice(a, b - a)


def cuts(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) with about so many bytes and at most SLICE_ROWS rows."""
    group = np.cumsum(sizes.astype(np.int64)) // most
    rows = np.arange(len(sizes)) // SLICE_ROWS
    at = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(rows) != 0)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(at, at[1:]) if b > a)


def spans(body: np.ndarray, at: np.ndarray, table: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of the table's kind, cut where texts begin."""
    inside = table[body]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = at[(at > 0) & (at < len(body))]
    if len(body):
        before[0] = after[-1] = False
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = ends - starts
    if len(n) == 0:
        return np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], n)
    values = (body[np.repeat(starts, n) + place].astype(np.uint64) + np.uint64(1)) * powers(int(n.max()))[place]
    return mix(np.add.reduceat(values, first[:-1]) + n.astype(np.uint64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the n + 1 places in them where texts begin."""
    body, at = flat(texts)
    starts, ends = spans(body, at)
    return span_hashes(body, starts, ends), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of a text, and where each text's begin; with short, a text of 1 to k - 1 words is one shingle."""
    n = np.diff(at)
    if len(hashes) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    count = np.maximum(n - k + 1, 0)
    if short:
        count[(n > 0) & (n < k)] = 1
    first = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(at[:-1], count) + np.arange(first[-1]) - np.repeat(first[:-1], count)
    total = np.zeros(first[-1], np.uint64)
    limit = np.repeat(at[1:], count) if short else None
    for j in range(k):
        total *= np.uint64(0xD6E8FEB86659FD93)
        if short:
            ok = begin + j < limit
            total[ok] += hashes[begin[ok] + j]
        else:
            total += hashes[begin + j]
    return mix(total), first


def shingles_of(text: str, k: int, short: bool = False) -> np.ndarray:
    return shingles(*words(pa.array([text], pa.string())), k, short)[0]
