"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of BLOCK words; two following blocks are a passage. Passages are TF-IDF vectors over hashed words (the
document frequencies cover all passages of all documents) and a randomised SVD, computed over a distributed matrix of passages,
gives the whitened latent space. Its rows are all passages of all documents and of the benchmark, each as often as it occurs; a text's
last block is a row of its own as well.
Every passage of every document is projected and compared with all benchmark passages by cosine, as matrix products; items of at most
SHORT words with single blocks as well. Besides, whoever has SEED words of an item in sequence, or the whole of an item of fewer than
LEAST_WORDS words, is a candidate whatever the cosine, so that verbatim items are never lost. Candidates are then checked word by
word: the longest common subsequence of the item with the text around the passage, and whether the item's answer (a column `answer`,
else its last sentence) is there as well.

Scale: the corpus is read twice (terms, search) without a shuffle of texts. Terms are written as two bytes a word; frequencies and the
POWER + 1 products of the SVD read those. The benchmark is the stated query set: it is broadcast in blocks
of at most ITEMS items, one pass for each block, the documents written in between; the index is broadcast once. Sums of fixed size
(document frequencies, moments of the SVD) are added up by slices of features, so the driver receives one copy whatever the number of
tasks; a product runs in a task a core, since each sends a matrix of fixed size.

Nulls and edges: null or empty texts and items match nothing; items of fewer than LEAST_WORDS words are only found whole (with other
words in between only where the cosine leads there), and those of fewer than LEAST_REMOVED words are reported but take no document out of the
pipeline; repeated items match each; repeated documents give a row each; null ids ride along; extra columns are not read or ride along; empty tables
give no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import textops
from wardline.llm.shared import append, cut, documents, drop, partitions, release, small_batches, table

BLOCK, FEATURES, RANK, EXTRA, POWER = 16, 1 << 15, 128, 8, 2
#: Least weight of a term, also of one that every block has.
FLOOR = 0.1
SLICE = 1 << 10
#: Terms whose sums travel together.
SENT = 32
#: Passages that are multiplied at a time.
MULTIPLIED = 1 << 13
#: Most rows that are added up to one before those of the same term are added up.
SPAN = 32
#: So many times the sample are looked at, for its distinct passages.
SPARE = 8
COSINE = 0.3
#: Items of at most so many words are compared with single blocks as well; words in sequence that make an item a candidate by themselves.
SHORT, SEED = 24, 5
#: Share of an item's words in sequence that is proof, and that is proof together with the answer.
SURE, LIKELY, ANSWERED = 0.7, 0.6, 0.8
#: Words that an answer needs to count.
ANSWER_WORDS = 3
LEAST_WORDS, ITEMS = 8, 2048
#: Items of fewer words are said everywhere ("the" would empty a corpus): they are reported, but remove no document.
LEAST_REMOVED = 8
PIECE = 1024
#: Blocks whose words are added up at a time: their vectors stay in a core's cache.
GATHERED = 512
#: Bytes of text whose words are counted or sampled at a time, and words whose terms are counted at a time.
COUNTED, COUNTED_WORDS = 1 << 18, 1 << 16
#: Bytes of text that are matched at a time: latent vectors and signatures take some twenty times as much.
MATCHED = 1 << 19
Batches = Iterator[pa.RecordBatch]


def plain_words(chunk: textops.Chunk) -> textops.Words:
    """Words without punctuation, lower-cased."""
    return textops.words(chunk, lower=True, white=textops.NO_WORD)


def blocks(w: textops.Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each block, its row, and each row's first block (one more entry than rows)."""
    bounds = textops.row_bounds(w.row, rows)
    within = np.arange(len(w.row)) - bounds[w.row] if len(w.row) else np.zeros(0, np.int64)
    start = np.flatnonzero(within % BLOCK == 0)
    row = w.row[start]
    return start, row, np.searchsorted(row, np.arange(rows + 1))


def term(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FEATURES)).view(np.int64)


def _terms(batches: Batches) -> Batches:
    """The terms of each text's words in order, two bytes each; texts without words give no row."""
    for batch in batches:
        for chunk in textops.chunks(batch.column(0), COUNTED):
            w, rows = plain_words(chunk), len(chunk.offsets) - 1
            bounds = textops.row_bounds(w.row, rows).astype(np.int64)
            kept = np.append(True, bounds[1:] > bounds[:-1])
            raw = pa.py_buffer(term(w.hash).astype(np.uint16)), pa.py_buffer(bounds[kept] * 2)
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(kept.sum()) - 1, [None, raw[1], raw[0]])
            yield pa.RecordBatch.from_arrays([out.cast(pa.binary())], names=["terms"])


def terms_of(df: DataFrame) -> DataFrame:
    return df.select("text").mapInArrow(_terms, "terms binary")


def term_blocks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms of a batch of rows, each block's first one (one more entry than blocks), and whether the next block is of the same row."""
    if not len(column):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros(0, bool)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    t = np.frombuffer(data, np.uint16)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint16)
    n = -(-np.diff(at) // BLOCK)
    row = np.repeat(np.arange(len(column)), n)
    start = (at[:-1] - at[0] - (np.cumsum(n) - n) * BLOCK)[row] + np.arange(len(row)) * BLOCK
    return t, np.append(start, len(t)), np.append(row[1:] == row[:-1], False)[: len(row)]


def _document_frequencies(batches: Batches) -> Batches:
    total, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        t, start, _ = term_blocks(batch.column(0))
        for a in range(0, len(start) - 1, COUNTED_WORDS // BLOCK):
            edges = start[a : a + COUNTED_WORDS // BLOCK + 1]
            block = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            total += np.bincount(textops.distinct(block * FEATURES + t[edges[0] : edges[-1]]) % FEATURES, minlength=FEATURES)
            n += len(edges) - 1
    if n:
        slices = range(0, FEATURES, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array([a // SLICE for a in slices], pa.int32()), pa.array([total[a : a + SLICE].tobytes() for a in slices], pa.binary())], names=["slice", "m"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.append(np.zeros(SLICE - 1, np.int64), n).tobytes()], pa.binary())], names=["slice", "m"])


def _added(kind: type) -> Callable[[Batches], Batches]:
    """Sums by slice of one partition, in a single row: the numbers of the slices and their sums, one after another."""

    def run(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, kind)
                total[k] = total[k] + part if k in total else part.copy()
        if total:
            keys, sums = np.array(list(total), np.int32).tobytes(), np.concatenate(list(total.values())).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([keys], pa.binary()), pa.array([sums], pa.binary())], names=["slices", "sums"])

    return run


def sum_slices(parts: DataFrame, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slice, m) rows added up by slice over all tasks: numbers of slices and a matrix of their sums, a partition at a time."""
    n = partitions(parts.sparkSession)
    rows = parts.repartition(n, "slice").mapInArrow(_added(kind), "slices binary, sums binary").collect()
    while rows:  # what has been read is let go
        keys, sums = rows.pop()
        keys = np.frombuffer(keys, np.int32)
        yield keys, np.frombuffer(sums, kind).reshape(len(keys), -1)


def frequencies(terms: DataFrame) -> tuple[np.ndarray, float]:
    """log(blocks / blocks with the term) and FLOOR: above 0 for every term, so that no passage is a zero vector, however hot; and the blocks."""
    n, df = 1.0, np.zeros((FEATURES // SLICE, SLICE))
    for keys, sums in sum_slices(terms.mapInArrow(_document_frequencies, "slice int, m binary"), np.int64):
        df[keys[keys >= 0]] = sums[keys >= 0]
        n = float(sums[keys < 0].sum()) or n
    df = df.reshape(-1)
    return (np.log((n + 1) / (df + 1)) + FLOOR).astype(np.float32), n


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    return frequencies(terms_of(docs))[0]


def block_vectors(w: textops.Words, start: np.ndarray, basis: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent vectors of the blocks and their squared TF-IDF lengths, GATHERED blocks at a time."""
    out, norm = np.zeros((len(start), basis.shape[1]), np.float32), np.zeros(len(start), np.float32)
    t, stop = term(w.hash), np.append(start[1:], len(w.hash))
    one = np.empty((min(GATHERED, len(start)), basis.shape[1]), np.float32)
    for a in range(0, len(start), GATHERED):
        b = min(a + GATHERED, len(start))
        total, word = out[a:b], one[: b - a]
        # word by word of all blocks at once: several times faster than adding up each block's rows; blocks without a k-th word add 0
        for k in range(BLOCK):
            at = start[a:b] + k
            lacks = np.flatnonzero(at >= stop[a:b])
            at[lacks] = 0
            np.take(basis, t[at], axis=0, out=word, mode="clip")
            word[lacks] = 0
            total += word
        norm[a:b] = np.add.reduceat(idf[t[start[a] : stop[b - 1]]] ** 2, start[a:b] - start[a])
    return out, norm


def passages(vectors: np.ndarray, norms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each block and the next of its row; unit by TF-IDF length; with the last block of longer rows left out, its number."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    follows = np.zeros(len(row), bool)
    follows[:-1] = row[1:] == row[:-1]
    alone = np.zeros(len(row), bool)
    alone[first[:-1][np.diff(first) == 1]] = True
    which = np.flatnonzero(follows | alone)
    second = np.where(follows[which], which + 1, which)
    both, more = vectors[which], np.flatnonzero(follows[which])
    both[more] += vectors[second[more]]
    length = np.sqrt(norms[which] + norms[second] * follows[which])
    both /= np.maximum(length, 1e-6)[:, None]
    return both, which


def _sparse(idf: np.ndarray) -> Callable[[Batches], Batches]:
    """Passages of texts as rows of (pick, term, weight), of unit length: those whose hash `pick` of all their words is under `share`."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            share = batch.column(1).to_numpy()
            for chunk in textops.chunks(batch.column(0), COUNTED):
                rows = len(chunk.offsets) - 1
                w = plain_words(chunk)
                start, row, _ = blocks(w, rows)
                if not len(start):
                    continue
                # a passage ends with the next block of its row, and the pick depends on words and their order only
                stop = np.append(start[1:], len(w.row))
                end = stop.copy()
                end[:-1] = np.where(row[1:] == row[:-1], stop[1:], stop[:-1])
                place = (np.arange(len(w.row)) - np.repeat(start, stop - start)).astype(np.uint64)
                sums = np.add.reduceat(textops.mixed(w.hash + place * np.uint64(textops.SHINGLE_BASE)), start)
                follows = np.append(row[1:] == row[:-1], False)
                second = np.where(follows, np.append(sums[1:], np.uint64(0)), np.uint64(0))
                pick = textops.mixed(sums + textops.mixed(second + np.uint64(textops.BASE)))
                out_p, out_t, out_w = [], [], []
                for k in np.flatnonzero((pick >> np.uint64(11)).astype(float) / 2.0**53 < share[chunk.first + row]):
                    t, n = np.unique(term(w.hash[start[k] : end[k]]), return_counts=True)
                    x = idf[t] * n
                    out_p.append(pick[k : k + 1].view(np.int64)[0])
                    out_t.append(t.astype(np.int32))
                    out_w.append((x / np.sqrt((x * x).sum())).astype(np.float32))
                if out_t:
                    yield pa.RecordBatch.from_arrays([pa.array(out_p, pa.int64()), pa.array(out_t, pa.list_(pa.int32())), pa.array(out_w, pa.list_(pa.float32()))], names=["pick", "t", "w"])

    return run


def row_sums(source: np.ndarray, index: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows index[first : first + size] of `source` for every group; GATHERED groups at a time, k-th rows of all at once."""
    order = np.argsort(-size, kind="stable")
    out = np.empty((len(first), source.shape[1]), source.dtype)
    word, sums = (np.empty((min(GATHERED, len(first)), source.shape[1]), source.dtype) for _ in range(2))
    for a in range(0, len(first), GATHERED):
        here = order[a : a + GATHERED]
        at, n, total = first[here], size[here], sums[: len(here)]
        source.take(index[at], axis=0, out=total, mode="clip")
        # groups are in order of their sizes, so those with a k-th row come first
        for k, m in enumerate(np.searchsorted(-n, -np.arange(int(n[0])), "left").tolist()):
            if k:
                source.take(index[at[:m] + k], axis=0, out=word[:m], mode="clip")
                total[:m] += word[:m]
        out[here] = total
    return out


def sums_by_term(rows: np.ndarray, index: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and for each the sum of its rows: those rows[index] whose place in `t` has it; SPAN to one, until one is left."""
    order = np.argsort(t, kind="stable")
    t, index = t[order], index[order]
    while True:
        begin = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        count = np.diff(np.append(begin, len(t)))
        spans = -(-count // SPAN)
        group = np.repeat(np.arange(len(begin)), spans)
        first = begin[group] + (np.arange(len(group)) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN
        rows = row_sums(rows, index, first, np.minimum(SPAN, (begin + count)[group] - first))
        t, index = t[begin][group], np.arange(len(group))
        if len(group) == len(begin):
            return t, rows


def passage_lengths(t: np.ndarray, start: np.ndarray, follows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared TF-IDF lengths of the passages that begin with each block; `weight` is squared by term.

    A term of n occurrences counts n * n times: once for each of them and twice for each pair, and pairs are at most so many words apart.
    """
    own, block = np.add.reduceat(weight[t], start[:-1]), np.repeat(np.arange(len(follows)), np.diff(start))
    at = [np.flatnonzero(t[:-apart] == t[apart:]) for apart in range(1, 2 * BLOCK)]
    to = np.concatenate([x + apart for apart, x in enumerate(at, 1)])
    at = np.concatenate(at)
    lo, x = block[at], 2.0 * weight[t[at]]
    gap = block[to] - lo
    own += np.bincount(lo, x * (gap == 0), len(own))
    both = np.bincount(lo, x * ((gap == 1) & follows[lo]), len(own))
    return own + both + np.append(own[1:], 0.0) * follows


def add_next(rows: np.ndarray, following: np.ndarray, but: np.ndarray) -> None:
    """Add to each row the one that follows it, but to those numbered `but`."""
    kept = rows[but]
    rows += following
    rows[but] = kept


def _multiply(sent: Callable[[], tuple[np.ndarray, np.ndarray]], twice: bool) -> Callable[[Batches], Batches]:
    """Over rows of terms, whose passages are the unit rows of A: A'(A basis) by SENT terms, or (A basis)'(A basis).

    `sent` gives the basis with its rows times their terms' weights, and the squared weights. A'(A basis) lacks a factor of the
    weights, which the caller puts in.
    """

    def run(batches: Batches) -> Batches:
        release()  # what earlier steps left in this worker
        basis, weight = sent()
        total, some = np.zeros(basis.shape if twice else (basis.shape[1],) * 2, np.float32 if twice else float), False
        for batch in batches:
            words, starts, follow = term_blocks(batch.column(0))
            some = some or len(follow) > 0
            for a in range(0, len(follow), MULTIPLIED):
                # the block after the last passage's first is read with it
                b = min(a + MULTIPLIED, len(follow))
                more = int(follow[b - 1])
                start, follows = starts[a : b + 1 + more] - starts[a], np.append(follow[a:b], np.zeros(more, bool))
                t = words[starts[a] : starts[b + more]]
                length = passage_lengths(t, start, follows, weight)
                y = row_sums(basis, t, start[:-1], np.diff(start))
                add_next(y[:-1], y[1:], ends := np.flatnonzero(~follows[:-1]))
                y *= (1 / (length if twice else np.sqrt(length))).astype(np.float32)[:, None]
                if more:
                    y[-1] = 0
                if twice:
                    add_next(y[:0:-1], y[-2::-1], len(y) - 2 - ends)
                    keys, sums = sums_by_term(y, np.repeat(np.arange(len(follows)), np.diff(start)), t)
                    total[keys] += sums
                else:
                    for c in range(0, len(y), PIECE):
                        total += y[c : c + PIECE].T @ y[c : c + PIECE]
        if some:
            parts = total.reshape(-1, SENT * basis.shape[1] if twice else total.size)
            for a in range(0, len(parts), PIECE // 8):
                part = parts[a : a + PIECE // 8]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array([x.tobytes() for x in part], pa.binary())], names=["slice", "m"])

    return run


def orthonormal(basis: np.ndarray) -> None:
    """Make the columns orthonormal, in place, by the eigenvectors of their Gram matrix; slices of rows, so that no copy is held.

    Directions that the columns do not have become zero columns. The second turn removes what rounding leaves of the first.
    """
    for _ in range(2):
        gram = np.zeros((basis.shape[1],) * 2)
        for a in range(0, len(basis), SLICE):
            part = basis[a : a + SLICE].astype(float)
            gram += part.T @ part
        values, vectors = np.linalg.eigh(gram)
        turn = vectors * np.where(values > 1e-12 * max(values[-1], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        for a in range(0, len(basis), SLICE):
            basis[a : a + SLICE] = basis[a : a + SLICE].astype(float) @ turn


def latent_basis(terms: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors of the matrix of all passages of `terms`, by the randomised range finder with power iterations.

    Each is divided by its singular value: directions that all passages share would otherwise make all of them alike. The driver
    holds one single-precision matrix of FEATURES x (rank + EXTRA) and what one task sent.
    """
    context, size = terms.sparkSession.sparkContext, rank + EXTRA
    weight = idf.astype(float) ** 2
    # each task sends sums of fixed size: their number follows the cores, not the table
    rows = terms.coalesce(max(1, context.defaultParallelism))

    def send(basis: np.ndarray) -> Broadcast:
        return context.broadcast((basis * idf[:, None], weight))

    basis = np.random.default_rng(7_919).standard_normal((FEATURES, size), np.float32)
    for _ in range(POWER):
        sent = send(basis)
        basis[:] = 0
        for keys, sums in sum_slices(rows.mapInArrow(_multiply(lambda s=sent: s.value, True), "slice int, m binary"), np.float32):
            basis.reshape(-1, SENT * size)[keys] = sums
        basis *= idf[:, None]
        sent.destroy()
        release()
        orthonormal(basis)
    sent = send(basis)
    moment = np.zeros((size, size))
    for _, sums in sum_slices(rows.mapInArrow(_multiply(lambda: sent.value, False), "slice int, m binary"), float):
        moment += sums.reshape(size, size)
    sent.destroy()
    values, vectors = np.linalg.eigh(moment)
    values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
    # directions that the rows do not have stay zero
    turn = vectors * np.where(values > 1e-6 * max(values[0], 1e-12), 1 / np.sqrt(np.maximum(values, 1e-12)), 0.0)
    out = np.zeros((FEATURES, rank), np.float32)
    for a in range(0, FEATURES, SLICE):
        out[a : a + SLICE] = basis[a : a + SLICE] @ turn
    return out


class Items(NamedTuple):
    """Some benchmark items: latent passages with their item, words and answer words as hashes."""

    ids: list
    vectors: np.ndarray
    owner: np.ndarray
    words: list[list[int]]
    answers: list[list[int]]


def words_of(texts: list[str | None]) -> list[list[int]]:
    chunk = textops.chunk_of(texts)
    w = plain_words(chunk)
    bounds = textops.row_bounds(w.row, len(texts))
    return [w.hash[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def answer_of(text: str) -> str:
    """What follows the last question mark, else the last sentence."""
    parts = [p for p in re.split(r"\?\s*", text) if p.strip()] if "?" in text else [p for p in re.split(r"(?<=[.!])\s+", text) if p.strip()]
    return parts[-1] if parts else ""


def project(texts: list[str | None], basis: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit latent vectors of all passages of the texts, and whose they are."""
    w = plain_words(textops.chunk_of(texts))
    start, row, first = blocks(w, len(texts))
    z, which = passages(*block_vectors(w, start, basis, idf), first)
    return unit(z), row[which]


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)


def common(masks: dict[int, int], size: int, region: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: masks has the places of each word in the item."""
    full = (1 << size) - 1
    v = full
    for x in region:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(words):
        out[x] = out.get(x, 0) | 1 << i
    return out


MATCHES = "array<struct<item_id:bigint,lcs:double,answer:double,cosine:double>>"


class Seeds(NamedTuple):
    """Hashes of runs of n words, sorted, each with an item that has it; `bits` tells by the upper bits who may be among them."""

    n: int
    hashes: np.ndarray
    item: np.ndarray
    bits: np.ndarray


SEED_BITS = 20


def seeds_of(words: list[list[int]]) -> list[Seeds]:
    """Runs of words that make an item a candidate, by their length."""
    runs: dict[int, set[tuple[int, int]]] = {}
    for i, w in enumerate(words):
        n = len(w) if len(w) < LEAST_WORDS else SEED
        if n:
            runs.setdefault(n, set()).update((h, i) for h in textops.ngram_hashes(np.array(w, np.uint64), n).tolist())
    out = []
    for n, pairs in sorted(runs.items()):
        hashes = np.array([h for h, _ in sorted(pairs)], np.uint64)
        bits = np.zeros(1 << SEED_BITS, bool)
        bits[hashes >> np.uint64(64 - SEED_BITS)] = True
        out.append(Seeds(n, hashes, np.array([i for _, i in sorted(pairs)]), bits))
    return out


def seeded(w: textops.Words, seeds: list[Seeds]) -> Iterator[tuple[int, int]]:
    """(word, item) of all places where a run of an item begins."""
    for s in seeds:
        grams = textops.ngram_hashes(w.hash, s.n)
        at = np.flatnonzero(s.bits[grams >> np.uint64(64 - SEED_BITS)])
        at = at[w.row[at] == w.row[at + s.n - 1]]
        lo, hi = np.searchsorted(s.hashes, grams[at], "left"), np.searchsorted(s.hashes, grams[at], "right")
        for k in np.flatnonzero(hi > lo):
            for j in range(lo[k], hi[k]):
                yield int(at[k]), int(s.item[j])


#: Bits of the signatures that all pairs are held against, and of those for the pairs that are left.
SIGNATURE, FINE = 512, 1024


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int, bits: int = SIGNATURE) -> np.ndarray:
    """A bit by word, of `bits` bits, for each of n owners."""
    out = np.zeros((n, bits // 64), np.uint64)
    bounds = np.searchsorted(owner, np.arange(0, n + PIECE, PIECE))
    for k, a in enumerate(range(0, n, PIECE)):
        here, b = slice(bounds[k], bounds[k + 1]), min(n, a + PIECE)
        own = np.zeros((b - a, bits), bool)
        own[owner[here] - a, (hashes[here] >> np.uint64(20)) % np.uint64(bits)] = True
        out[a:b] = np.packbits(own, axis=1).view(np.uint64)
    return out


class Spread:
    """Unions of the signatures from `reach` blocks before to `reach + 2` behind a block, within its row.

    A run of blocks is covered by two runs of the greatest power of two that fits, so unions are taken by doubling; the doubled
    signatures serve every reach.
    """

    def __init__(self, held: np.ndarray, row: np.ndarray) -> None:
        self.levels, self.begin, self.end = [held], np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right") - 1

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            level = last.copy()
            level[:-step] |= last[step:]
            self.levels.append(level)
        return self.levels[k]

    def around(self, block: np.ndarray, reach: np.ndarray | int) -> np.ndarray:
        lo, hi = np.maximum(block - reach, self.begin[block]), np.minimum(block + reach + 2, self.end[block])
        size, out = hi - lo + 1, np.empty((len(block), self.levels[0].shape[1]), np.uint64)
        for k in range(int(size.max(initial=0)).bit_length()):
            has = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            if len(has):
                level = self._level(k)
                out[has] = level.take(lo[has], axis=0) | level.take(hi[has] - (1 << k) + 1, axis=0)
        return out


def bits_set(x: np.ndarray) -> np.ndarray:
    """Number of bits by row of 64-bit words, whose number is a multiple of 8: eight counts are added up in one word."""
    counts, pairs = np.bitwise_count(x).view(np.uint64), np.uint64(0x00FF00FF00FF00FF)
    sums = (((counts & pairs) + (counts >> np.uint64(8) & pairs)) * np.uint64(0x0001000100010001)) >> np.uint64(48)
    return sums.sum(axis=1, dtype=np.int64) if sums.shape[1] > 1 else sums[:, 0].view(np.int64)


class Regions:
    """Whether the text around a block can hold enough of an item; what it lacks is made once for each reach that the pairs have."""

    def __init__(self, w: textops.Words, start: np.ndarray, row: np.ndarray, sizes: np.ndarray, marks: dict[int, np.ndarray]) -> None:
        self.w, self.row, self.marks = w, row, marks
        self.owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(w.row))))
        self.reach = -(-sizes // BLOCK)
        #: Most words of each item that may be lacking.
        self.most = sizes - np.ceil(LIKELY * sizes).astype(np.int64)
        self.own: dict[int, Spread] = {}
        self.lacking: dict[int, np.ndarray] = {}

    def _spread(self, bits: int) -> Spread:
        if bits not in self.own:
            self.own[bits] = Spread(signatures(self.w.hash, self.owner, len(self.row), bits), self.row)
        return self.own[bits]

    def _lacks(self, block: np.ndarray, item: np.ndarray, bits: int) -> np.ndarray:
        """Bits that the text around each pair's block doesn't have, a row for each pair."""
        n, reach = len(self.row), self.reach[item]
        if bits != SIGNATURE:
            # few pairs are left: only the blocks that they have
            key = reach * n + block
            some = textops.distinct(key)
            return (~self._spread(bits).around(some % n, some // n)).take(np.searchsorted(some, key), axis=0)
        kinds = np.flatnonzero(np.bincount(reach)).tolist()
        for r in kinds:
            if r not in self.lacking:
                self.lacking[r] = ~self._spread(bits).around(np.arange(n), r)
        if len(kinds) == 1:
            return self.lacking[kinds[0]].take(block, axis=0)
        out = np.empty((len(block), bits // 64), np.uint64)
        for r in kinds:
            here = np.flatnonzero(reach == r)
            out[here] = self.lacking[r].take(block[here], axis=0)
        return out

    def possible(self, block: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Places of the pairs whose region, rounded up to blocks, may have enough of the item: never less than what `judge` takes."""
        left = np.arange(len(block))
        for bits, marks in self.marks.items():
            if len(left):
                # a bit that the region lacks is at least one word of the item that it lacks
                lacks = self._lacks(block[left], item[left], bits)
                lacks &= marks.take(item[left], axis=0)
                left = left[bits_set(lacks) <= self.most[item[left]]]
        return left


def _matcher(basis: np.ndarray, idf: np.ndarray, items: Items) -> Callable[[pa.Array], list[list[tuple]]]:
    masks, answers = [masks_of(w) for w in items.words], [masks_of(w) for w in items.answers]
    sets, times = [set(w) for w in items.words], [Counter(w) for w in items.words]
    seeds = seeds_of(items.words)
    short = np.flatnonzero(np.array([len(w) <= SHORT for w in items.words], bool)[items.owner]) if len(items.owner) else np.zeros(0, np.int64)
    of_item = [np.flatnonzero(items.owner == i) for i in range(len(items.words))]

    sizes = np.array([len(x) for x in items.words], np.int64)
    flat, whose = np.array([x for y in items.words for x in y], np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    marks = {bits: signatures(flat, whose, len(sizes), bits) for bits in (SIGNATURE, FINE)}

    def judge(i: int, region: list[int]) -> tuple[float, float] | None:
        words = items.words[i]
        # words of the item that the region lacks cannot be in the sequence
        lacks = sets[i].difference(region)
        if len(words) - len(lacks) < LIKELY * len(words) or len(words) - sum(times[i][x] for x in lacks) < LIKELY * len(words):
            return None
        lcs = common(masks[i], len(words), region) / len(words)
        if lcs < LIKELY:
            return None
        answer = common(answers[i], len(items.answers[i]), region) / len(items.answers[i]) if len(items.answers[i]) >= ANSWER_WORDS else 0.0
        whole = lcs == 1.0 if len(words) < LEAST_WORDS else lcs >= SURE or answer >= ANSWERED
        return (lcs, answer) if whole else None

    def near(z: np.ndarray, which: np.ndarray, vectors: np.ndarray, owner: np.ndarray, regions: Regions, into: dict[tuple[int, int], float]) -> None:
        """Cosines of at least COSINE, the greatest by (block, item), of possible pairs."""
        for a in range(0, len(z), PIECE):
            cos = z[a : a + PIECE] @ vectors.T
            at = np.flatnonzero(cos >= COSINE)
            p = at // len(vectors)  # numpy's divmod is several times slower
            q = at - p * len(vectors)
            fit = regions.possible(which[a + p], owner[q])
            p, q = p[fit], q[fit]
            for block, i, c in zip(which[a + p].tolist(), owner[q].tolist(), cos[p, q].tolist(), strict=True):
                if c > into.get((block, i), 0.0):
                    into[block, i] = c

    def matches(texts: pa.Array) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for chunk in textops.chunks(texts, MATCHED):
            rows, w = len(chunk.offsets) - 1, plain_words(chunk)
            start, row, first = blocks(w, rows)
            bounds = textops.row_bounds(w.row, rows)
            best: list[dict[int, tuple]] = [{} for _ in range(rows)]
            if len(start) and len(items.vectors):
                vectors, norms = block_vectors(w, start, basis, idf)
                z, which = passages(vectors, norms, first)
                z = unit(z)
                candidates: dict[tuple[int, int], float] = {}
                regions = Regions(w, start, row, sizes, marks)
                near(z, which, items.vectors, items.owner, regions, candidates)
                if len(short):
                    near(unit(vectors / np.sqrt(norms)[:, None]), np.arange(len(start)), items.vectors[short], items.owner[short], regions, candidates)
                for at, i in seeded(w, seeds):
                    block = int(np.searchsorted(start, at, "right")) - 1
                    if (block, i) not in candidates:
                        passage = int(np.searchsorted(which, block, "right")) - 1
                        candidates[block, i] = float((items.vectors[of_item[i]] @ z[passage]).max()) if len(of_item[i]) else 0.0
                pairs = np.array([*candidates], np.int64).reshape(-1, 2)
                of, at, size = row[pairs[:, 0]], start[pairs[:, 0]], sizes[pairs[:, 1]]
                region = np.stack([of, np.maximum(bounds[of], at - size), np.minimum(bounds[of + 1], at + 2 * BLOCK + size)], axis=1)
                for (_, i), cosine, (r, lo, hi) in zip(candidates, candidates.values(), region.tolist(), strict=True):
                    if best[r].get(i, (0.0,))[0] == 1.0:
                        continue
                    found = judge(i, w.hash[lo:hi].tolist())
                    if found and found > best[r].get(i, (0.0, 0.0, 0.0))[:2]:
                        best[r][i] = (*found, cosine)
            out += [[(items.ids[i], *m) for i, m in sorted(b.items())] for b in best]
        return out

    return matches


class Index(NamedTuple):
    basis: np.ndarray
    idf: np.ndarray


def picked(docs: DataFrame, benchmark: DataFrame, idf: np.ndarray, sample: int, n: float | None = None) -> DataFrame:
    """(pick, t, w) of all distinct benchmark passages and of `sample` distinct others, those of least pick: a written table.

    `n` is the number of blocks of all documents, counted here if not given. This is for looking at a table: the latent space is
    made of all passages (`build`).
    """
    sent = docs.sparkSession.sparkContext.broadcast(idf)
    # only to leave out early what is far from the least picks
    share = min(1.0, SPARE * sample / max(1.0, frequencies(terms_of(docs))[1] if n is None else n))

    def rows(df: DataFrame, share: float) -> DataFrame:
        found = df.select("text", F.lit(share).alias("share")).mapInArrow(lambda batches: _sparse(sent.value)(batches), "pick long, t array<int>, w array<float>")
        return found.groupBy("pick").agg(F.first("t").alias("t"), F.first("w").alias("w"))

    some = cut(rows(docs, float(share)), "latent-sample")
    # pick's upper half is negative as a number: the order only has to be the same everywhere, and is that of the unsigned number;
    # picks alone are ranked, their rows come in by a join
    least = some.select("pick").orderBy(F.col("pick") < 0, "pick").limit(sample)
    found = cut(rows(benchmark, 1.0).unionByName(some.join(least, "pick", "left_semi")).repartition(partitions(docs.sparkSession)), "latent-passages")
    drop(some)
    sent.destroy()
    return found


def build(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Index:
    """Document frequencies over all documents; the latent space from all passages of documents and benchmark."""
    small_batches(docs.sparkSession)
    terms = cut(terms_of(docs), "latent-terms")
    idf = frequencies(terms)[0]
    basis = latent_basis(terms.unionByName(terms_of(benchmark)), idf, rank)
    drop(terms)
    release()
    return Index(basis, idf)


def item_blocks(benchmark: DataFrame, index: Index) -> Iterator[Items]:
    """The benchmark in blocks of at most ITEMS items, by ranges of a hash of the item."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    n = max(1, -(-rows.count() * 5 // (ITEMS * 4)))
    for k in range(n):
        got = rows.where(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {k}")).orderBy("item_id", "text").collect()
        texts = [r["text"] for r in got]
        vectors, owner = project(texts, *index)
        answers = [r["answer"] if r["answer"] is not None else answer_of(r["text"] or "") for r in got]
        yield Items([r["item_id"] for r in got], vectors, owner, words_of(texts), words_of(answers))


def _finder(index: Broadcast, items: Broadcast) -> Callable[[pa.RecordBatch], list[pa.Array]]:
    made: dict[int, Callable] = {}
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("cosine", pa.float64())]))

    def find(batch: pa.RecordBatch) -> list[pa.Array]:
        if 0 not in made:
            made[0] = _matcher(*index.value, items.value)
        found = made[0](batch.column(batch.schema.get_field_index("text")))
        return [pa.array([[dict(zip(("item_id", "lcs", "answer", "cosine"), m, strict=True)) for m in row] for row in found], kind)]

    return find


def matched(docs: DataFrame, benchmark: DataFrame, name: str = "matches") -> DataFrame:
    """`docs` (text, ...) with the matches of each document, an array by item.

    The index is sent once. Each block of items is a pass of its own: between two of them the documents are written, so that no
    stage holds the items of two blocks, however large the benchmark.
    """
    index = build(docs, benchmark)
    context = docs.sparkSession.sparkContext
    sent_index = context.broadcast(tuple(index))
    out, columns, written = docs, [], None
    for k, items in enumerate(item_blocks(benchmark, index)):
        if k:
            out = cut(out, "latent-matches")
            if written is not None:
                drop(written)
            written = out
        columns.append(f"_{name}_{k}")
        out = append(out, f"{columns[-1]} {MATCHES}", _finder(sent_index, context.broadcast(items)))
    return out.withColumn(name, F.concat(*columns)).drop(*columns)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_REMOVED) -> DataFrame:
    """`docs` without those that hold an item of at least `least_words` words; shorter ones are in `matched` and remove nothing."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"))
    found = matched(docs, benchmark.where(size >= least_words), "_matches")
    return found.where(F.size("_matches") == 0).select(*docs.columns)


def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = matched(docs, table(spark, sf_dir, "benchmark")).where(F.size("matches") > 0)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.lcs", "m.answer", "m.cosine")
