"""Periodic runs of words: suffix automaton whose link tree is read by link-cut access, squares extended to runs.

A run is a stretch of words with smallest period q and at least max(least, 2 q) words that no neighbouring word extends. Words are
appended one after another. The strings that end at word i are the path from i's state to the root of the suffix links; the path
falls into segments by the place where their strings ended last. One `access` reads the segments and recolours them all with i, as
a preferred path of a link-cut tree (splay trees over depth, one colour per path), in amortised logarithmic time.

If the longest string of a segment has m words and ended last at e, words i-m+1..i recur d = i - e words earlier. For m >= d that is
a square: the d + m words that end at i have the period d, no smaller one (else the strings had ended later than e), and no word on
the left extends them (else a longer string had ended at e). It is a run if word i+1 does not continue the period. Every run shows
up so, at its last word and with its own period, and no run twice.

Most words lie in no run, and that is settled first, a batch at a time: a run of L words and period q repeats L - q >= least / 2
words at distance q <= L / 2. So each of its words is covered by a gram of (least + 1) // 2 words that recurs in the run, and the run lies in one
stretch of covered words. The automaton reads only stretches of at least `least` words, anew reduced to grams whose next or
last occurrence lies in the stretch, at most half of it away. Hashes only decide what is read: the automaton compares words.

Nothing is shuffled. Memory: one batch of texts, and about 1.5 kB a word for the longest stretch of a document.

Nulls and edges: null and empty texts have no words, no run and an empty collapsed text; equal rows get equal results; a document that is
all one word is one run of period 1; extra columns ride along, one named like a result is replaced; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm import textops
from wardline.llm.shared import WORD, append, documents

LEAST = 12
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
Run = tuple[int, int, int]


class SuffixLinks:
    """The suffix automaton of a sequence, reduced to its link tree: state 0 is none, state 1 the root."""

    def __init__(self, sequence: list[int]) -> None:
        self.size, self.link, self.ends = [0, 0], [0, 0], []
        size, link, step, last = self.size, self.link, [{}, {}], 1
        for x in sequence:
            new, p = len(size), last
            size.append(size[last] + 1)
            link.append(1)
            step.append({})
            while p and x not in step[p]:
                step[p][x] = new
                p = link[p]
            if p:
                q = step[p][x]
                if size[q] != size[p] + 1:  # q also stands for longer strings: split off the shorter ones
                    short = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    step.append(step[q].copy())
                    link[q] = short
                    while p and step[p].get(x) == q:
                        step[p][x] = short
                        p = link[p]
                    q = short
                link[new] = q
            self.ends.append(new)
            last = new


class PreferredPaths:
    """Link-cut tree over a fixed tree given by parents: preferred paths as splay trees by depth, each path with one colour."""

    def __init__(self, parent: list[int]) -> None:
        n = len(parent)
        self.up, self.left, self.right, self.colour = list(parent), [0] * n, [0] * n, [-1] * n

    def _splay(self, x: int) -> None:
        """Make x the root of its path's splay tree; the colour goes with the root."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        top = p
        while (g := up[top]) and (left[g] == top or right[g] == top):
            top = g
        self.colour[x] = self.colour[top]
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                straight = (left[g] == p) == (left[p] == x)
                self._rotate(p if straight else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            up[child] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from v to the root; gives (old colour, its deepest node) from v upwards, uncoloured parts left out."""
        up, right, colours = self.up, self.right, self.colour
        x, below, found = v, 0, []
        while x:
            self._splay(x)
            if right[x]:
                colours[right[x]] = colours[x]
            right[x] = below
            if colours[x] >= 0 and (not found or found[-1][0] != colours[x]):
                found.append((colours[x], x))
            below, x = x, up[x]
        self._splay(v)
        colours[v] = colour
        return found


def runs(sequence: list[int], least: int = LEAST) -> list[Run]:
    """All runs (start, length, period) of at least max(least, 2 * period) items, by start and period."""
    automaton, found, n = SuffixLinks(sequence), [], len(sequence)
    paths, size = PreferredPaths(automaton.link), automaton.size
    for i, state in enumerate(automaton.ends):
        for end, deepest in paths.access(state, i):
            period, again = i - end, size[deepest]
            if again >= period and again + period >= least and (i + 1 == n or sequence[i + 1] != sequence[i + 1 - period]):
                found.append((i + 1 - again - period, again + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: textops.Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of the stretches of a chunk that may hold runs; no run lies outside, none crosses a border."""
    gram, none = (least + 1) // 2, np.zeros(0, np.int64)
    key = textops.ngram_hashes(words.hash, gram)
    if not len(key):
        return none, none
    key ^= textops.mixed(words.row[: len(key)].astype(np.uint64) + np.uint64(1))
    inside = words.row[: len(key)] == words.row[gram - 1 :]
    at = np.flatnonzero(inside)
    key = key[at]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    # pairs of following occurrences of one gram in one document
    one, two = at[order[:-1][same]], at[order[1:][same]]
    first = end = none
    while len(one):
        edge = np.zeros(len(words.row) + 1, np.int64)
        np.add.at(edge, np.concatenate([one, two]), 1)
        np.add.at(edge, np.concatenate([one, two]) + gram, -1)
        covered = np.cumsum(edge[:-1]) > 0
        border = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])) | np.concatenate([[False], covered[1:] & covered[:-1] & (words.row[1:] != words.row[:-1]), [False]]))
        # a border between two documents that are both covered closes one stretch and opens the next
        double = np.concatenate([[False], covered[1:] & covered[:-1] & (words.row[1:] != words.row[:-1]), [False]])[border]
        border = np.repeat(border, 1 + double)
        first, end = border[::2], border[1::2]
        long = end - first >= least
        first, end = first[long], end[long]
        if not len(first):
            break
        place = np.searchsorted(first, one, "right") - 1
        near = (place >= 0) & (two - one <= (end - first)[place] // 2) & (two + gram <= end[place])
        if near.all():
            break
        one, two = one[near], two[near]
        first = end = none
    return first, end


def _columns(least: int, text: str):
    def of(batch: pa.RecordBatch) -> list[pa.Array]:
        every, collapsed = [], []
        for chunk in textops.chunks(batch.column(batch.schema.names.index(text))):
            w = textops.words(chunk, lower=False)
            bounds, raw = textops.row_bounds(w.row, len(chunk.offsets) - 1), chunk.data.tobytes()
            found: dict[int, list[Run]] = {}
            for a, b in zip(*(x.tolist() for x in stretches(w, least)), strict=True):
                codes: dict[bytes, int] = {}
                sequence = [codes.setdefault(raw[s:e], len(codes)) for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
                row = int(w.row[a])
                shift = a - int(bounds[row])
                found.setdefault(row, []).extend((start + shift, length, period) for start, length, period in runs(sequence, least))
            for k in range(len(chunk.offsets) - 1):
                words = raw[chunk.offsets[k] : chunk.offsets[k + 1]].split()
                own = found.get(k, [])
                if own:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in own:
                        gone[start + period] += 1
                        gone[start + length] -= 1
                    words = [x for x, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
                every.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                collapsed.append(b" ".join(words).decode())
        return [pa.array(every, RUNS), pa.array(collapsed, pa.string())]

    return of


def find(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """`docs` with `runs` (by start, then period) and `collapsed`: each run's words after its first period dropped, the rest joined by spaces."""
    kept = docs.select(*(c for c in docs.columns if c not in ("runs", "collapsed")))
    return append(kept, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", _columns(least, text))


def planted(doc_id: Column, text: Column) -> Column:
    """The query's test pattern: for one document in ten (by crc32 of its id; null as empty text) a tail of words made periodic."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def build(x: Column) -> Column:
        w, g, n = x["w"], x["g"], F.size(x["w"])
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))), " ")).otherwise("")

    # as elements of an array, words and number are computed once, not once for each word
    once = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), build)
    return F.when(h % 10 == 0, F.get(once, 0)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find(docs)
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period"),
        F.floor(-1000 * best["l"] / best["p"]).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
