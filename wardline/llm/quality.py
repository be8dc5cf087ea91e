"""Quality classifier from weak labels: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a
hashed linear scorer that learns the posterior labels.

Two faults are modelled, each with labellers of its own: bad form (symbols, repetition, shouting, tables, no words) and toxic
language. Two toxic labellers read a dictionary of word beginnings that toxic ones among some LABELLED_ROWS labelled documents
prefer, where labels are given; all others need no labels. A vote says bad or good; on texts too short for it a labeller abstains,
which is no evidence. The votes of all documents are counted by vote pattern with map-side combination; the patterns' number is
bounded by three to the number of labellers, and EM over their counts, one class for each kind of fault, gives every pattern's posterior. A logistic scorer per fault, over hashed words and hashed statistics, then learns the posteriors on a bounded sample of documents
(FIT_ROWS, chosen by a hash of id and text, each pair once) and scores every whole text. A document is kept if neither fault is more likely than not.

Passes over the texts are row by row without a shuffle.

Nulls and edges: a text that is null or has no words is bad form with score 0 and not kept; labellers abstain on short texts; null
ids are scored like others; equal rows get equal results; an empty table gives no row; extra columns ride along in `classify`, one
named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import textops
from wardline.llm.shared import append, documents, release, small_batches, table

FIT_ROWS = 10_000
#: Entries of the sample that the training reads at a time.
ENTRIES = 1 << 19
#: Labelled documents that the mined dictionary is taken from; how often and how much more often toxic ones hold an entry.
LABELLED_ROWS, MINED_DOCUMENTS, MINED_LIFT, MINED_ENTRIES = 8_000, 8, 10.0, 5_000
#: Bytes of a word's beginning in the mined dictionary.
BEGINNINGS = (6, 7, 8)
FEATURES = 1 << 16
BINS = 12
ABSTAIN, BAD, GOOD = 0, 1, 2
FORM, TOXIC = "form", "toxic"
Batches = Iterator[pa.RecordBatch]

STOP_WORDS = (
    "the of and to in is was that it for with as on be at by this have from or had not are but which you were all there can an they has "
    "le la les de des du et en un une est que qui dans pour par sur pas au aux avec ce il elle sont "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "el los las y que en un una por con no para es del se lo como más o su al"
).split()
#: Insults and abuse; the strong ones first.
INSULTS = (
    "idiot idiots moron morons stupid scum worthless pathetic loser losers imbecile retard bastard bitch whore slut cunt asshole "
    "fuck fucking shit bullshit trash garbage disgusting clown clowns vermin filth filthy freak creep coward liar"
).split()
STRONG = 24


def _hashes(words: list[str]) -> np.ndarray:
    return textops.words(textops.chunk_of([" ".join(words)]), lower=True, white=textops.NO_WORD).hash


STOP_HASHES, INSULT_HASHES, STRONG_HASHES = np.unique(_hashes(STOP_WORDS)), np.unique(_hashes(INSULTS)), np.unique(_hashes(INSULTS[:STRONG]))
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123), *range(128, 256)]] = 2
_CLASS[[ord(c) for c in "#$%&*|~^<>{}[]\\=+_@"]] = 3
_CLASS[ord("!")] = 4
_CLASS[[ord(c) for c in ".?,;:"]] = 5
_CLASS[[*range(48, 58)]] = 6


class Texts(NamedTuple):
    """Statistics per row of a chunk, and its plain words."""

    stats: dict[str, np.ndarray]
    words: textops.Words


def beginnings(chunk: textops.Chunk, w: textops.Words) -> list[np.ndarray]:
    """Hashes of the words' first bytes, one array per number of bytes; shorter words count whole."""
    return [textops.span_hashes(chunk.data, w.start, np.minimum(w.end, w.start + n), lower=True) for n in BEGINNINGS]


def measure(chunk: textops.Chunk, mined: np.ndarray) -> Texts:
    """`mined` holds the hashes of word beginnings that toxic documents prefer, sorted."""
    rows = len(chunk.offsets) - 1
    spaced, plain = textops.words(chunk, lower=True), textops.words(chunk, lower=True, white=textops.NO_WORD)
    per = lambda row, weight=None: np.bincount(row, weight, minlength=rows).astype(float)
    byte_row = np.repeat(np.arange(rows), np.diff(chunk.offsets))
    kind = _CLASS[chunk.data]
    upper, lower, symbol, shout, point = (per(byte_row[kind == k]) for k in (1, 2, 3, 4, 5))
    n, n_spaced = per(plain.row), per(spaced.row)
    same = np.flatnonzero((spaced.hash[1:] == spaced.hash[:-1]) & (spaced.row[1:] == spaced.row[:-1])) if len(spaced.row) else []
    pairs = np.lexsort((plain.hash, plain.row))
    row, h = plain.row[pairs], plain.hash[pairs]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))) if len(row) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(row)))
    most = np.zeros(rows)
    np.maximum.at(most, row[new], times)
    insult = np.isin(h[new], INSULT_HASHES)
    hit = np.zeros(len(plain.row), bool)
    for b in beginnings(chunk, plain) if len(mined) else ():
        at = np.minimum(np.searchsorted(mined, b), len(mined) - 1)
        hit |= mined[at] == b
    ratio = lambda a, b: a / np.maximum(1.0, b)
    stats = {
        "words": n, "spaced": n_spaced, "symbols": ratio(symbol, upper + lower + symbol + shout + point), "shouting": ratio(upper, upper + lower), "shouts": ratio(shout, n_spaced),
        "marks": ratio(symbol, n_spaced), "points": ratio(point, n_spaced), "wordless": ratio(np.maximum(0.0, n_spaced - n), n_spaced), "echo": ratio(per(spaced.row[same]), n_spaced), "distinct": ratio(per(row[new]), np.sqrt(2 * n)),
        "top": ratio(most, n), "stop": ratio(per(plain.row, np.isin(plain.hash, STOP_HASHES).astype(float)), n), "length": ratio(upper + lower, n),
        "insults": per(row[new], insult.astype(float)), "insult_share": ratio(per(plain.row, np.isin(plain.hash, INSULT_HASHES).astype(float)), n),
        "strong": per(row[new], np.isin(h[new], STRONG_HASHES).astype(float)),
        "mined": per(row[new], hit[pairs][new].astype(float)), "mined_share": ratio(per(plain.row, hit.astype(float)), n), "has_mined": np.full(rows, float(len(mined) > 0)),
    }
    return Texts(stats, plain)


def _vote(bad: np.ndarray, able: np.ndarray) -> np.ndarray:
    return np.where(able, np.where(bad, BAD, GOOD), ABSTAIN)


def votes(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Labellers' votes, [labeller, row] per fault; every kind of fault shows in two labellers or more."""
    any_, some, many = s["words"] >= 1, s["words"] >= 12, s["words"] >= 20
    form = [
        _vote(s["symbols"] > 0.06, some), _vote(s["marks"] > 0.4, some), _vote(s["wordless"] > 0.08, some),
        _vote(s["echo"] > 0.08, some), _vote(s["top"] > 0.2, many), _vote(s["distinct"] < 1.5, many),
        _vote(s["shouting"] > 0.3, some), _vote(s["shouts"] > 0.1, some),
    ]
    toxic = [
        _vote(s["insults"] >= 2, any_), _vote(s["insult_share"] > 0.004, any_), _vote(s["strong"] >= 1, any_),
        _vote(s["mined"] >= 2, any_ & (s["has_mined"] > 0)), _vote(s["mined_share"] > 0.01, any_ & (s["has_mined"] > 0)),
    ]
    return {FORM: np.array(form), TOXIC: np.array(toxic)}


#: Per fault its kinds, as the numbers of their labellers: symbols and tables, repetition, shouting; abuse.
KINDS = {FORM: [[0, 1, 2], [3, 4, 5], [6, 7]], TOXIC: [[0, 1, 2, 3, 4]]}
LABELLERS = {fault: sum(map(len, kinds)) for fault, kinds in KINDS.items()}


def pattern(v: np.ndarray) -> np.ndarray:
    """Votes as one number, base 3."""
    return (v * 3 ** np.arange(len(v))[:, None]).sum(axis=0)


def unpacked(patterns: np.ndarray, labellers: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(labellers) % 3


def posteriors(patterns: np.ndarray, counts: np.ndarray, kinds: list[list[int]], rounds: int = 100) -> np.ndarray:
    """P(bad) per vote pattern, by EM over each labeller's rate of bad votes among good documents and those of each kind of fault.

    Faults of different kinds are seen by different labellers, so each kind is a class of its own, which starts from its labellers.
    An abstention says nothing.
    """
    labellers = sum(map(len, kinds))
    v = unpacked(patterns, labellers)
    said, bad_vote = v != ABSTAIN, v == BAD
    share = np.array([0.85, *[0.15 / len(kinds)] * len(kinds)])
    rate = np.full((1 + len(kinds), labellers), 0.05)
    rate[0] = 0.02
    for k, own in enumerate(kinds, 1):
        rate[k, own] = 0.6
    for _ in range(rounds):
        like = np.log(share) + bad_vote @ np.log(rate).T + (said & ~bad_vote) @ np.log(1 - rate).T
        like -= like.max(axis=1, keepdims=True)
        belief = np.exp(like) / np.exp(like).sum(axis=1, keepdims=True)
        weight = belief * counts[:, None]
        share = (weight.sum(axis=0) + 1) / (counts.sum() + 1 + len(kinds))
        rate = (weight.T @ bad_vote + 0.5) / (weight.T @ said + 1)
        # in documents of a kind its own labellers speak up more often than in good ones
        for k, own in enumerate(kinds, 1):
            rate[k, own] = np.maximum(rate[k, own], rate[0, own])
    return 1 - belief[:, 0]


FORM_STATS = ("symbols", "wordless", "echo", "top", "distinct", "shouting", "shouts", "points", "stop", "length", "insult_share", "mined_share")
_SCALES = {"insult_share": 0.05, "mined_share": 0.1, "symbols": 0.2, "wordless": 0.3, "echo": 0.3, "top": 0.5, "distinct": 5.0, "shouting": 0.8, "shouts": 0.4, "points": 0.5, "stop": 0.5, "length": 20.0}


def features(t: Texts, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once: a bias, binned statistics and words, hashed into FEATURES numbers."""
    r, f = [np.arange(rows)], [np.zeros(rows, np.int64)]
    for i, name in enumerate(FORM_STATS):
        level = np.minimum(BINS - 1, t.stats[name] / _SCALES[name] * BINS).astype(np.int64)
        r.append(np.arange(rows))
        f.append(1 + i * BINS + level)
    fixed = 1 + len(FORM_STATS) * BINS
    key = textops.distinct((t.words.row.astype(np.int64) << 16) | (fixed + (t.words.hash % np.uint64(FEATURES - fixed)).view(np.int64)))
    return np.concatenate([*r, key >> 16]), np.concatenate([*f, key & 0xFFFF])


def train(row: np.ndarray, feature: np.ndarray, target: np.ndarray, rounds: int = 100, ridge: float = 2e-6) -> np.ndarray:
    """Logistic weights for soft targets; Adam over the whole sample, ENTRIES at a time. Rare words hold little weight by the ridge."""
    w, m, s = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    parts = [slice(a, a + ENTRIES) for a in range(0, len(row), ENTRIES)]
    for k in range(1, rounds + 1):
        z, g = np.zeros(len(target)), ridge * w
        for p in parts:
            z += np.bincount(row[p], w[feature[p]], minlength=len(target))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / max(1, len(target))
        for p in parts:
            g += np.bincount(feature[p], error[row[p]], minlength=FEATURES)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-7)
    return w


def _count_patterns(mined: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for chunk in textops.chunks(batch.column(0)):
                for fault, v in votes(measure(chunk, mined).stats).items():
                    p, n = np.unique(pattern(v), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([fault] * len(p)), pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], names=["fault", "pattern", "n"])

    return run


def _sample_features(mined: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for chunk in textops.chunks(batch.column(1)):
                rows, t = len(chunk.offsets) - 1, measure(chunk, mined)
                v, pick = votes(t.stats), batch.column(0).slice(chunk.first, rows)
                row, feature = features(t, rows)
                order = np.argsort(row, kind="stable")
                edge = np.searchsorted(row[order], np.arange(rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(feature[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pick, pa.array(pattern(v[FORM])), pa.array(pattern(v[TOXIC])), lists], names=["pick", FORM, TOXIC, "features"])

    return run


def _beginning_counts(batches: Batches) -> Batches:
    """Documents per beginning over (text, toxic), added up by chunk."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for chunk in textops.chunks(batch.column(0)):
            w = textops.words(chunk, lower=True, white=textops.NO_WORD)
            for b in beginnings(chunk, w):
                order = np.lexsort((b, w.row))
                row, h = w.row[order], b[order]
                new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(row) else np.zeros(0, bool)
                kinds, which, n = np.unique(h[new], return_inverse=True, return_counts=True)
                bad = np.bincount(which, toxic[chunk.first + row[new]], minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(bad), pa.array(n.astype(np.int64))], names=["beginning", "bad", "n"])


def mine(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> np.ndarray:
    """The dictionary labeller: beginnings of words that toxic ones of about `rows` labelled documents hold far more often."""
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") == 1).alias("bad")).dropDuplicates(["doc_id"])
    total = known.count()
    chosen = known.where(F.expr(f"pmod(xxhash64(doc_id, 5), 1000003) < {min(1.0, rows / max(1, total)) * 1_000_003}"))
    bad, n = chosen.agg(F.count_if("bad"), F.count("*")).first()
    if not 0 < bad < n:
        return np.zeros(0, np.uint64)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("text", "bad")
    counted = texts.mapInArrow(_beginning_counts, "beginning long, bad long, n long").groupBy("beginning").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    lift = (F.col("bad") / bad) / ((F.col("n") - F.col("bad") + 1) / (n - bad))
    found = counted.where(F.col("bad") >= MINED_DOCUMENTS).where(lift >= MINED_LIFT).orderBy(F.desc("bad"), "beginning").limit(MINED_ENTRIES).collect()
    return np.sort(np.array([r["beginning"] for r in found], np.int64).view(np.uint64))


class Model(NamedTuple):
    """Posterior P(bad) per vote pattern and linear weights, per fault; the mined dictionary."""

    posterior: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]
    mined: np.ndarray


def fit(docs: DataFrame, labels: DataFrame | None = None, rows: int = FIT_ROWS) -> Model:
    """From all documents' votes, and from the features of about `rows` documents; `labels` (doc_id, toxic) feed one labeller."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    mined = mine(texts, labels) if labels is not None else np.zeros(0, np.uint64)
    counted = texts.select("text").mapInArrow(_count_patterns(mined), "fault string, pattern long, n long").groupBy("fault", "pattern").agg(F.sum("n").alias("n")).orderBy("fault", "pattern").collect()
    posterior = {fault: np.full(3**n, 0.0) for fault, n in LABELLERS.items()}
    for fault, n in LABELLERS.items():
        seen = [(r["pattern"], r["n"]) for r in counted if r["fault"] == fault]
        if seen:
            p, c = (np.array(x) for x in zip(*seen, strict=True))
            posterior[fault][p] = posteriors(p, c.astype(float), KINDS[fault])
    total = sum(r["n"] for r in counted if r["fault"] == FORM)
    share = min(1.0, rows / max(1, total))
    # by id and text, each pair once: no id or text, however often repeated, fills the sample
    pick = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    chosen = texts.select(pick.alias("pick"), "text").where(F.pmod("pick", F.lit(1_000_003)) < share * 1_000_003)
    chosen = chosen.mapInArrow(_sample_features(mined), f"pick long, {FORM} long, {TOXIC} long, features array<int>")
    once = chosen.groupBy("pick").agg(*(F.first(c).alias(c) for c in (FORM, TOXIC, "features")))
    sample = once.orderBy("pick").limit(rows + rows // 4).drop("pick").toArrow()
    weights = {fault: np.zeros(FEATURES) for fault in LABELLERS}
    if sample.num_rows:
        lists = sample.column("features").combine_chunks()
        feature, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(sample.num_rows, dtype=np.int32), size)
        for fault in LABELLERS:
            weights[fault] = train(row, feature, posterior[fault][sample.column(fault).to_numpy()])
        del lists, feature, row
    del sample
    release()
    return Model(posterior, weights, mined)


SCORES = "quality_score double, toxic_score double, weak_quality double, weak_toxic double, kept boolean"


def classify(docs: DataFrame, model_of: Callable[[], Model]) -> DataFrame:
    """`docs` (text, ...) with the scorers' probabilities of good form and of toxic language, the weak labels and the decision."""

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        model, parts = model_of(), []
        for chunk in textops.chunks(batch.column(batch.schema.get_field_index("text"))):
            rows, t = len(chunk.offsets) - 1, measure(chunk, model.mined)
            row, feature = features(t, rows)
            bad = {k: 1 / (1 + np.exp(-np.clip(np.bincount(row, w[feature], minlength=rows), -40, 40))) for k, w in model.weights.items()}
            weak = {k: model.posterior[k][pattern(v)] for k, v in votes(t.stats).items()}
            wordless = t.stats["words"] == 0
            good = np.where(wordless, 0.0, 1 - bad[FORM])
            parts.append((good, np.where(wordless, 0.0, bad[TOXIC]), np.where(wordless, 0.0, 1 - weak[FORM]), np.where(wordless, 0.0, weak[TOXIC]), (good >= 0.5) & (bad[TOXIC] < 0.5)))
        return [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]

    return append(docs, SCORES, columns)


def scored(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Documents scored by a model fitted on themselves."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return classify(docs, lambda: sent.value)


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality_score", "toxic_score", "weak_quality", "weak_toxic", "kept")
