"""Substring dedup with prefix-partitioned suffix trees: words in passages that occur elsewhere are found and removed.

A suffix starts at a word and is read WINDOW words deep; a node at that depth with two suffixes below it is a repeat, and the
runs of such suffixes are the maximal repeats. Suffixes are partitioned by a prefix of their text, of variable length:

1. Every window has one anchor, the least PREFIX-word gram in it, so equal windows have equal anchors; only about one word in
   fourteen is one. Suffixes are dealt by the words at their anchor. Anchors that occur once end here (counted with map-side
   combination), most of the corpus with them.
2. Where at most GROUP anchors share the prefix, their spans (the text that their windows cover) meet in one memory-sized
   subtree: suffixes are sorted by their path of WINDOW words, neighbours compared word by word; nodes with two leaves are deep
   internal nodes.
3. Where more share it, the prefix is lengthened to the whole path: all suffixes of such a group are equal, so that it is
   only counted, never gathered. A passage that a third of all documents share costs a counter.

Repeats within one document are found in that document alone; only its first occurrence takes part in the steps above.

Nulls and edges: null text has no words; documents of fewer than WINDOW words keep all; equal rows are each other's repeats, null
ids included; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import textops
from wardline.llm.shared import cut, documents, partitions

WINDOW, PREFIX, GROUP = 35, 8, 20_000
TREE_ROWS = 20_000
#: Stands for a null id in joins.
NO_ID = -(1 << 62)
Batches = Iterator[pa.RecordBatch]
KEY = ["doc_key", "row_key"]
AT = "doc_key long, row_key long, at long"


def _batch(kinds: dict[str, pa.DataType], *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def least_grams(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams the place of its least one, the leftmost of equals; by doubling."""
    at, step = np.arange(len(grams)), 1

    def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(grams[right] < grams[left], right, left)

    while step * 2 <= width:
        at = join(at[: len(at) - step], at[step:])
        step *= 2
    rest = width - step
    return join(at[: len(at) - rest], at[rest:]) if rest else at


def repeated_within(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one document's window paths: which are its first of their kind, and which occur more than once."""
    _, first, inverse, count = np.unique(paths, return_index=True, return_inverse=True, return_counts=True)
    fresh = np.zeros(len(paths), bool)
    fresh[first] = True
    return fresh, count[inverse] > 1


def _anchors(window: int, prefix: int) -> Callable[[Batches], Batches]:
    kinds = {"doc_key": pa.int64(), "row_key": pa.int64(), "prefix": pa.int64(), "place": pa.int64()}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for chunk in textops.chunks(batch.column(2)):
                w = textops.words(chunk, lower=False)
                bounds = textops.row_bounds(w.row, len(chunk.offsets) - 1)
                grams, paths = textops.ngram_hashes(w.hash, prefix), textops.ngram_hashes(w.hash, window)
                if not len(paths):
                    continue
                at = least_grams(grams, window - prefix + 1)
                take = np.zeros(len(paths), bool)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if b - a >= window:
                        take[a : b - window + 1] = repeated_within(paths[a : b - window + 1])[0]
                s = np.flatnonzero(take)
                if not len(s):
                    continue
                p = at[s]
                new = np.ones(len(s), bool)
                # a run: following windows of one document with one anchor
                new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1) | (w.row[s[1:]] != w.row[s[:-1]])
                head = np.flatnonzero(new)
                n, first = np.diff(np.append(head, len(s))), s[head]
                row = w.row[first] + chunk.first
                place = ((first - bounds[w.row[first]]) << 16) | (n << 8) | (p[head] - first)
                yield _batch(kinds, ids[row], keys[row], grams[p[head]].view(np.int64), place)

    return run


def _spans(window: int) -> Callable[[Batches], Batches]:
    """Documents with their shared anchors to one row per anchor, with the text that its windows cover."""
    kinds = {"prefix": pa.int64(), "doc_key": pa.int64(), "row_key": pa.int64(), "place": pa.int64(), "span": pa.binary()}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, keys, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for chunk in textops.chunks(batch.column(2)):
                w, out = textops.words(chunk, lower=False), []
                bounds, raw = textops.row_bounds(w.row, len(chunk.offsets) - 1), chunk.data.tobytes()
                for k in range(len(chunk.offsets) - 1):
                    row = chunk.first + k
                    for anchor in lists[row].as_py() or ():
                        first, n = int(bounds[k]) + (anchor["place"] >> 16), anchor["place"] >> 8 & 255
                        out.append((anchor["prefix"], ids[row], keys[row], anchor["place"], raw[w.start[first] : w.end[first + n + window - 2]]))
                if out:
                    yield _batch(kinds, *zip(*out, strict=True))

    return run


def _paths(window: int) -> Callable[[Batches], Batches]:
    """Documents with their hot anchors to one row per window, keyed by its whole path."""
    kinds = {"path": pa.int64(), "path2": pa.int64(), "doc_key": pa.int64(), "row_key": pa.int64(), "at": pa.int64()}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, keys, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for chunk in textops.chunks(batch.column(2)):
                w, out = textops.words(chunk, lower=False), []
                bounds = textops.row_bounds(w.row, len(chunk.offsets) - 1)
                one, two = (textops.ngram_hashes(h, window).view(np.int64) for h in (w.hash, textops.mixed(w.hash + np.uint64(1))))
                for k in range(len(chunk.offsets) - 1):
                    row = chunk.first + k
                    for anchor in lists[row].as_py() or ():
                        first = anchor["place"] >> 16
                        for s in range(first, first + (anchor["place"] >> 8 & 255)):
                            out.append((int(one[bounds[k] + s]), int(two[bounds[k] + s]), ids[row], keys[row], s))
                if out:
                    yield _batch(kinds, *zip(*out, strict=True))

    return run


def subtree(spans: pa.Array, places: np.ndarray, window: int) -> np.ndarray:
    """(span, window within it) of suffixes below a node of depth `window` with two leaves or more."""
    hashes, lengths = [], []
    for chunk in textops.chunks(spans):
        w = textops.words(chunk, lower=False)
        hashes.append(w.hash)
        lengths.append(np.diff(textops.row_bounds(w.row, len(chunk.offsets) - 1)))
    word, length = np.concatenate(hashes), np.concatenate(lengths)
    begin = np.cumsum(length) - length
    n = places >> 8 & 255
    span = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
    suffix = begin[span] + within
    path = textops.ngram_hashes(word, window)[suffix]
    order = np.argsort(path, kind="stable")
    twin = np.zeros(len(order), bool)
    for a in range(0, len(order) - 1, 100_000):
        left, right = order[a : a + 100_000], order[a + 1 : a + 100_001]
        left = left[: len(right)]
        same = np.flatnonzero(path[left] == path[right])
        reach = np.arange(window)
        equal = (word[suffix[left[same]][:, None] + reach] == word[suffix[right[same]][:, None] + reach]).all(axis=1)
        same = same[equal] + a
        twin[same] = twin[same + 1] = True
    found = np.sort(order[twin])
    return np.stack([span[found], within[found]])


def _trees(window: int) -> Callable[[Batches], Batches]:
    """Rows sorted by prefix: whole groups, TREE_ROWS anchors or one group at a time."""
    kinds = {"doc_key": pa.int64(), "row_key": pa.int64(), "at": pa.int64()}

    def grown(rows: pa.Table) -> pa.RecordBatch:
        places = rows.column("place").to_numpy()
        span, within = subtree(rows.column("span").combine_chunks(), places, window)
        at = (places >> 16)[span] + within
        picked = [rows.column(c).combine_chunks().take(pa.array(span)) for c in KEY]
        return _batch(kinds, *picked, at)

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, TREE_ROWS):
                held.append(batch.slice(a, TREE_ROWS))
                if sum(b.num_rows for b in held) < TREE_ROWS:
                    continue
                rows = pa.Table.from_batches(held)
                prefix = rows.column("prefix").to_numpy()
                # the last group may go on
                end = int(np.searchsorted(prefix != prefix[-1], False)) if (prefix == prefix[-1]).all() else int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1
                if end:
                    yield grown(rows.slice(0, end))
                    held = rows.slice(end).to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield grown(rows)

    return run


def covered(starts: np.ndarray, words: int, window: int) -> np.ndarray:
    """Which of a document's words lie in a window that starts at one of `starts`."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _keep(window: int) -> Callable[[Batches], Batches]:
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, out = batch.slice(a, 500), []
                ids, lists = part.column(0).to_pylist(), part.column(2)
                for chunk in textops.chunks(part.column(1)):
                    w = textops.words(chunk, lower=False)
                    bounds, paths = textops.row_bounds(w.row, len(chunk.offsets) - 1), textops.ngram_hashes(w.hash, window)
                    for k in range(len(chunk.offsets) - 1):
                        row, lo, hi = chunk.first + k, int(bounds[k]), int(bounds[k + 1])
                        words = chunk.data[chunk.offsets[k] : chunk.offsets[k + 1]].tobytes().split()
                        if hi - lo >= window:
                            twice = np.flatnonzero(repeated_within(paths[lo : hi - window + 1])[1])
                            elsewhere = lists[row].as_py()
                            if len(twice) or elsewhere:
                                gone = covered(np.concatenate([twice, np.array(elsewhere or [], np.int64)]), hi - lo, window)
                                words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                        kept = b" ".join(words)
                        out.append((ids[row], hi - lo, hi - lo - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
                yield _batch(kinds, *zip(*out, strict=True))

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_removed, kept_sha256, kept): kept words joined by one space."""
    n = partitions(docs.sparkSession)
    doc_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_key")
    docs = docs.select(doc_key, F.xxhash64("doc_id", "text").alias("row_key"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    anchors = cut(docs.select(*KEY, "text").mapInArrow(_anchors(window, prefix), "doc_key long, row_key long, prefix long, place long"), "suffix-anchors")
    counts = anchors.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    anchor = F.struct("prefix", "place")
    lists = anchors.join(counts, "prefix").groupBy(*KEY).agg(F.collect_set(F.when(F.col("n") <= GROUP, anchor)).alias("cold"), F.collect_set(F.when(F.col("n") > GROUP, anchor)).alias("hot"))
    lists = cut(lists, "suffix-lists")
    # the three joins with the texts read one exchange of them: same columns, same keys
    marked = lambda c: docs.join(lists.where(F.size(c) > 0), KEY).select(*KEY, "text", c, "doc_id")
    spans = marked("cold").mapInArrow(_spans(window), "prefix long, doc_key long, row_key long, place long, span binary")
    leaves = spans.repartition(n, "prefix").sortWithinPartitions("prefix").mapInArrow(_trees(window), AT)
    paths = marked("hot").mapInArrow(_paths(window), f"path long, path2 long, {AT}")
    twice = paths.groupBy("path", "path2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = leaves.union(paths.join(twice, ["path", "path2"]).select(*KEY, "at"))
    starts = found.groupBy(*KEY).agg(F.collect_set("at").alias("at"))
    rows = docs.join(starts, KEY, "left").select("doc_id", "text", "at", *KEY)
    return rows.mapInArrow(_keep(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op4_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS p FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY p) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
l AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, CASE WHEN js IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda x : NOT list_contains(js, x)), lambda x : ws[x]) END AS kept
      FROM w LEFT JOIN l USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
