"""Vectorised word and shingle hashing over Arrow text columns: whole batches as byte arrays, no Python object per word.

Words are runs without ASCII white space (`[^\\x20\\x09-\\x0D]+`); lower-casing touches A-Z only. Hashes are 64-bit, the same in
every process. Memory follows `CHUNK` bytes of text at a time, or one document where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
PIECE = 1 << 18
#: Bytes of words that are hashed at a time: their sums stay in a core's cache.
SUMMED = 1 << 16
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: For words without punctuation: all of ASCII but letters and digits.
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE, SHINGLE_BASE = 0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4F


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LETTERS_LOWER = LETTERS[LOWER]


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(PIECE * 2, 1 << max(0, n - 1).bit_length()))


class Chunk(NamedTuple):
    """Some rows of a batch: texts as one byte array; `offsets` has one more entry than rows."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a chunk in order: row within the chunk, first byte, end byte, hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Rows of a string column in chunks of about `size` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    raw = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, at, data = raw.buffers()
    offsets = np.frombuffer(at, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    a = 0
    while a < len(raw):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield Chunk(a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def chunk_of(texts: list[str | None]) -> Chunk:
    """A few texts of the driver as one chunk."""
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(r) for r in raw], dtype=np.int64)])
    return Chunk(0, np.frombuffer(b"".join(raw), np.uint8), offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of data[start:end] for ordered spans that do not overlap."""
    out, letters, a = np.empty(len(start), np.uint64), LETTERS_LOWER if lower else LETTERS, 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + SUMMED, "right")))
        s, e = start[a:b] - start[a], end[a:b] - start[a]
        up, down = powers(int(e[-1]))
        total, terms = np.zeros(int(e[-1]) + 1, np.uint64), letters.take(data[start[a] : end[b - 1]])
        terms *= up[: e[-1]]
        np.cumsum(terms, out=total[1:])
        sums = total.take(e)
        sums -= total.take(s)
        sums *= down.take(s)
        sums += (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out[a:b] = mixed(sums)
        a = b
    return out


def words(chunk: Chunk, lower: bool, white: np.ndarray = WHITE) -> Words:
    n, edges = len(chunk.data), chunk.offsets
    # a table over bytes is several times faster than numpy's indexing by them
    ink = np.frombuffer(chunk.data.tobytes().translate((~white).tobytes()), bool) if n else np.zeros(0, bool)
    first, last = ink.copy(), ink.copy()
    if n:
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        at = edges[:-1][edges[:-1] < n]
        first[at] = ink[at]
        at = edges[1:][edges[1:] > 0] - 1
        last[at] = ink[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(edges) - 1), np.diff(np.searchsorted(start, edges)))
    return Words(row, start, end, span_hashes(chunk.data, start, end, lower))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which beats numpy's hashing here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin; one more entry than rows."""
    return np.searchsorted(row, np.arange(rows + 1))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n hashes in sequence (across rows too: the caller leaves those out)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(m, np.uint64), 1
    for k in range(n):
        out += hashes[k : k + m] * np.uint64(factor)
        factor = factor * SHINGLE_BASE % (1 << 64)
    return mixed(out)


def shingle_sets(chunk: Chunk, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles, lower-cased; fewer words make one shingle; none: empty."""
    w = words(chunk, lower=True)
    bounds, grams = row_bounds(w.row, len(chunk.offsets) - 1), ngram_hashes(w.hash, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            yield distinct(grams[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(w.hash[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)
