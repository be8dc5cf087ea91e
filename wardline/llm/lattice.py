"""Language-model scoring by a subword lattice: the probability of a text is the sum over all its segmentations into pieces.

The pieces and their scores are an existing vocabulary (a file that is a parameter; it is not trained here). Scores weight the
pieces: log-probabilities as they are; merge ranks, as BPE vocabularies have them, by Zipf's law. The corpus model starts from
those weights and moves them towards the pieces' expected counts over all segmentations of all training words (forward-backward,
one step of expectation-maximisation, the existing weights as pseudo-counts). A word's log-probability is then the marginal from
the log-space forward recursion over its bytes, a document's the sum over its words and one end.

Pieces never cross white space, so that the lattice of a document is the chain of its words' lattices, and each different word of
the corpus is scored once:

1. Words are counted per Arrow chunk, then by one map-side combined aggregation: the table of all words, with counts in training
   and overall.
2. Expected piece counts and word marginals are computed over that table, in batches of words of one length.
3. The FREQUENT most frequent words (a few MB) are broadcast; a document sums over those itself. Its other words meet the word
   table in one equi-join. Both ways give the same sums.

Byte pieces cover every byte, so no text has probability zero. Nulls and edges: null text is empty, one end token; equal rows are
scored each; null ids count as empty text for the fold; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import textops
from wardline.llm.shared import crc_mod, cut, documents

FOLDS, HELD_OUT = 5, 1
#: Words broadcast to score documents without a join: at most so many (24 bytes each).
FREQUENT = 1 << 18
ZIPF_SHIFT = 2.7
WORD_CHUNK = textops.CHUNK * 4
Batches = Iterator[pa.RecordBatch]


class Vocabulary(NamedTuple):
    """Pieces as sorted 64-bit hashes of their bytes, a word's start being the byte 0x20; log-probabilities; the end's."""

    hashes: np.ndarray
    logp: np.ndarray
    end: float
    longest: int


def piece_hash(cumulated: np.ndarray, down: np.ndarray, start: int, end: int) -> np.ndarray:
    span = np.atleast_1d(cumulated[..., end] - cumulated[..., start])
    return span * down[start] + np.uint64((end - start) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _cumulated(data: np.ndarray) -> np.ndarray:
    up, _ = textops.powers(data.shape[-1])
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    np.cumsum(textops.LETTERS[data] * up[: data.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def vocabulary_from(pieces: list[tuple[bytes, float]], end: float) -> Vocabulary:
    """Weights (not logs) per piece and for the end; equal pieces add up, all become one distribution."""
    _, down = textops.powers(1)
    total, weight = end + sum(w for _, w in pieces), {}
    for p, w in pieces:
        h = int(piece_hash(_cumulated(np.frombuffer(p, np.uint8)), down, 0, len(p))[0])
        weight[h] = weight.get(h, 0.0) + w
    hashes = np.array(sorted(weight), np.uint64)
    return Vocabulary(hashes, np.log([weight[int(h)] / total for h in hashes]), math.log(end / total), max(len(p) for p, _ in pieces))


def vocabulary(path: str | None = None) -> Vocabulary:
    """A SentencePiece model's pieces and scores; by default that of the installed public vocabularies."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    n = model.get_piece_size()
    scores = [model.get_score(i) for i in range(n)]
    ranks = all(s == int(s) for s in scores)
    weight = lambda s: 1 / (ZIPF_SHIFT - s) if ranks else math.exp(s)
    pieces = []
    for i in range(n):
        if model.is_byte(i):
            pieces.append((bytes([int(model.id_to_piece(i)[3:5], 16)]), weight(-float(n)) if ranks else weight(scores[i])))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            text = model.id_to_piece(i).replace("▁", " ")
            if " " not in text[1:]:  # a word has one start
                pieces.append((text.encode(), weight(scores[i])))
    return vocabulary_from(pieces, weight(-float(n)) if ranks else min(w for _, w in pieces))


def _lookup(v: Vocabulary, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length as rows of bytes: piece number and log-probability by [row, end, length - 1]; -inf where there is none."""
    n, size = data.shape
    most = min(size, v.longest)
    cumulated, (_, down) = _cumulated(data), textops.powers(size)
    which, logp = np.zeros((n, size + 1, most), np.int32), np.full((n, size + 1, most), -np.inf)
    for end in range(1, size + 1):
        for k in range(1, min(end, most) + 1):
            h = piece_hash(cumulated, down, end - k, end)
            at = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
            which[:, end, k - 1] = at
            logp[:, end, k - 1] = np.where(v.hashes[at] == h, v.logp[at], -np.inf)
    return which, logp


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe[:, None]).sum(axis=1))


def forward(logp: np.ndarray) -> np.ndarray:
    """Log marginals of all prefixes, [row, end]."""
    n, ends, most = logp.shape
    out = np.full((n, ends), -np.inf)
    out[:, 0] = 0.0
    for end in range(1, ends):
        k = min(end, most)
        out[:, end] = _logsum(out[:, end - k : end][:, ::-1] + logp[:, end, :k])
    return out


def backward(logp: np.ndarray) -> np.ndarray:
    n, ends, most = logp.shape
    out = np.full((n, ends), -np.inf)
    out[:, -1] = 0.0
    for start in range(ends - 2, -1, -1):
        k = min(ends - 1 - start, most)
        reach = np.arange(1, k + 1)
        out[:, start] = _logsum(out[:, start + reach] + logp[:, start + reach, reach - 1])
    return out


def by_length(words: list[bytes], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, their bytes with the start as rows), all of one length, some at a time."""
    size = np.array([len(w) for w in words])
    for s in np.unique(size):
        who = np.flatnonzero(size == s)
        step = max(1, most // (int(s) + 1))
        for a in range(0, len(who), step):
            some = who[a : a + step]
            yield some, np.frombuffer(b"".join(b" " + words[i] for i in some), np.uint8).reshape(len(some), -1)


def word_logps(v: Vocabulary, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's marginal over all segmentations."""
    out = np.zeros(len(words))
    for who, data in by_length(words):
        out[who] = forward(_lookup(v, data)[1])[:, -1]
    return out


def expected_counts(v: Vocabulary, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, weighted by the words' counts."""
    out = np.zeros(len(v.hashes))
    for who, data in by_length(words):
        which, logp = _lookup(v, data)
        before, after = forward(logp), backward(logp)
        most = logp.shape[2]
        for end in range(1, logp.shape[1]):
            k = min(end, most)
            use = np.exp(before[:, end - k : end][:, ::-1] + logp[:, end, :k] + after[:, end][:, None] - before[:, -1][:, None])
            out += np.bincount(which[:, end, :k].ravel(), (use * counts[who][:, None]).ravel(), minlength=len(out))
    return out


def adapted(v: Vocabulary, expected: np.ndarray, ends: float) -> Vocabulary:
    """The existing distribution as one pseudo-count per piece, plus the expected counts."""
    pseudo = float(len(v.hashes))
    total = pseudo + expected.sum() + ends
    return v._replace(logp=np.log((np.exp(v.logp) * pseudo + expected) / total), end=math.log((math.exp(v.end) * pseudo + ends) / total))


def _count_words(batches: Batches) -> Batches:
    names = ["hash", "word", "c", "n"]
    for batch in batches:
        train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for chunk in textops.chunks(batch.column(1), WORD_CHUNK):
            w = textops.words(chunk, lower=True)
            if not len(w.hash):
                continue
            h, first, which, n = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
            c = np.bincount(which, train[chunk.first + w.row], minlength=len(h)).astype(np.int64)
            raw = textops.LOWER[chunk.data].tobytes()
            word = [raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(word, pa.binary()), pa.array(c), pa.array(n.astype(np.int64))], names=names)


def _expect(v: Vocabulary) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        total = np.zeros(len(v.hashes))
        for batch in batches:
            total += expected_counts(v, batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["piece", "expected"])

    return run


def _score_words(v: Vocabulary) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            logp = word_logps(v, batch.column(1).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(logp)], names=["hash", "c", "n", "logp"])

    return run


PASS = "doc_id long, row_key long, held_out boolean, hash long, rare long, documents long, tokens long, known long, base double, score double"


def _score_documents(frequent: Callable[[], tuple[np.ndarray, ...]]) -> Callable[[Batches], Batches]:
    """Per document one row with the sums over frequent words (its hash is arbitrary), and one row per rare word."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in PASS.split(", ")]

    def run(batches: Batches) -> Batches:
        hashes, known, base, score = frequent()
        for batch in batches:
            for chunk in textops.chunks(batch.column(3)):
                rows, w = len(chunk.offsets) - 1, textops.words(chunk, lower=True)
                at = np.minimum(np.searchsorted(hashes, w.hash), max(0, len(hashes) - 1))
                hit = hashes[at] == w.hash if len(hashes) else np.zeros(len(w.hash), bool)
                add = lambda x: np.bincount(w.row[hit], x[at[hit]], minlength=rows)  # noqa: B023, E731
                own = [c.slice(chunk.first, rows) for c in batch.columns[:3]]
                zero, one = np.zeros(rows, np.int64), np.ones(rows, np.int64)
                sums = [own[1], pa.array(zero), pa.array(one), pa.array(np.bincount(w.row, minlength=rows)), pa.array(add(known).astype(np.int64)), pa.array(add(base)), pa.array(add(score))]
                yield pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip([*own, *sums], kinds, strict=True)], names=names)
                miss = np.flatnonzero(~hit)
                if len(miss):
                    order = miss[np.lexsort((w.hash[miss], w.row[miss]))]
                    row, h = w.row[order], w.hash[order]
                    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])))
                    times, who = np.diff(np.append(new, len(row))), pa.array(row[new])
                    zero = np.zeros(len(new))
                    rare = [pa.array(h[new].view(np.int64)), pa.array(times), *(pa.array(zero.astype(np.int64)),) * 3, pa.array(zero), pa.array(zero)]
                    yield pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip([*(c.take(who) for c in own), *rare], kinds, strict=True)], names=names)

    return run


def score(docs: DataFrame, vocabulary_path: str | None = None, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, text) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), logs to base 10."""
    spark = docs.sparkSession
    held = crc_mod(F.col("doc_id"), folds) == held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), held.alias("held_out"), "text")
    ends = docs.where("not held_out").count()
    counted = docs.select(~F.col("held_out"), "text").mapInArrow(_count_words, "hash long, word binary, c long, n long")
    words = cut(counted.groupBy("word").agg(F.first("hash").alias("hash"), F.sum("c").alias("c"), F.sum("n").alias("n")), "lattice-words")
    spread = F.floor(4 * F.log2("n")).cast("int")
    seen, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    train_tokens, unit = seen + ends, math.log10(seen + ends + 0.5 * (kinds + (ends > 0) + 1))
    v = vocabulary(vocabulary_path)
    expected = np.zeros(len(v.hashes))
    for piece, x in words.where("c > 0").select("word", "c").mapInArrow(_expect(v), "piece long, expected double").groupBy("piece").agg(F.sum("expected")).collect():
        expected[piece] = x
    v = adapted(v, expected, float(ends))
    scored = cut(words.select("hash", "word", "c", "n").mapInArrow(_score_words(v), "hash long, c long, n long, logp double"), "lattice-scores")
    # the most frequent words: whole classes of frequency, as many as fit
    least, room = None, FREQUENT
    for bin_, count in sorted(scored.groupBy(spread.alias("bin")).count().collect(), reverse=True):
        if count > room:
            break
        least, room = bin_, room - count
    top = (scored.where(spread >= least) if least is not None else scored.limit(0)).select("hash", "c", "logp").toArrow()
    h = top.column("hash").to_numpy().astype(np.int64).view(np.uint64)
    order, c = np.argsort(h), top.column("c").to_numpy().astype(float)
    table = (h[order], (c > 0).astype(float)[order], (np.log10(c + 0.5) - unit)[order], top.column("logp").to_numpy().astype(float)[order])
    sent = spark.sparkContext.broadcast(table)
    rows = docs.mapInArrow(_score_documents(lambda: sent.value), PASS)
    rows = rows.join(scored.select("hash", "c", "logp"), "hash", "left")
    times = lambda x: F.when(F.col("rare") > 0, F.col("rare") * x)
    sums = {
        "known": F.sum(F.coalesce(times(F.when(F.col("c") > 0, 1).otherwise(0)), F.col("known"))), "tokens": F.sum("tokens"), "documents": F.sum("documents"),
        "base": F.sum(F.coalesce(times(F.log10(F.col("c") + 0.5) - unit), F.col("base"))), "score": F.sum(F.coalesce(times(F.col("logp")), F.col("score"))),
    }
    total = rows.groupBy("doc_id", "row_key", "held_out").agg(*(x.alias(k) for k, x in sums.items()))
    # equal rows are one group: shares of its sums, and as many rows
    each = lambda k: F.col(k) / F.col("documents")
    end_base, end_score = math.log10(ends + 0.5) - unit, v.end / math.log(10)
    out = total.select("doc_id", "held_out", (each("tokens") + 1).cast("long").alias("n_tokens"), (each("known") + int(ends > 0)).cast("long").alias("n_known"),
                       F.lit(train_tokens).cast("long").alias("train_tokens"), (each("base") + end_base).alias("base_score"), (each("score") + end_score).alias("score"), "documents")
    return out.withColumn("documents", F.explode(F.sequence(F.lit(1).cast("long"), F.col("documents")))).drop("documents")


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
