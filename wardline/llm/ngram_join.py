"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of distinct word shingles. All sets are ordered by one global order, rare shingles first. Two sets that
meet the threshold share at least l shingles within their prefixes of length n - ceil(t*n) + l, for every l. Each document
lengthens its prefix (raises its own l) while the estimated cost of its candidates falls, and a pair needs the smaller of its
two l as shared prefix shingles before it is verified on the texts.

Steps:
1. One pass gives each document's set size and 128-bit set fingerprint, and counts shingles into a sketch that grows with the
   text, so that rare shingles are told from common ones at any size. The sketch sets the order and the cost estimates only;
   results do not depend on it. Equal sets are one class from here on.
2. One shuffle deals prefix postings by shingle, those that the sketch calls hot by shingle and a slice of the classes;
   shingles of a single class end here. Each run also names a leader, and (leader, member) pairs are verified first.
3. Components of the verified links settle most shingles: where all classes of a shingle are in one component, no further pair
   can matter. Shingles that stay open and have more than CROWD classes tie these into families; all pairs of a family whose sizes
   can be similar are compared in blocks of classes, as matrix products over their whole sets, and a block gives its spanning
   links only. Open shingles of
   fewer classes give pairs between components, which are verified if they share enough prefix shingles for their sizes. No pair that could
   join components is skipped, and no crowd is ever written out as pairs.

A class is known by its set (size and fingerprint) and a number of its own, never by a doc_id: ids are labels, carried along for the
result. The text of a class is that of its least text hash, fetched once for each class however many rows hold it.

Nulls and edges: null or empty text, or text without words, is an empty set and links with nothing; fewer words than a shingle
are one shingle; equal rows are in one class; rows of null doc_id link and bridge like all others, their component is the least id
reachable, null if there is none; rows that repeat a doc_id with other texts are nodes of their own; extra columns are not read; an
empty table gives no row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm import textops
from wardline.llm.components import components
from wardline.llm.shared import cut, documents, drop, partitions, small_batches

SHINGLE, SIMILAR = 5, 80
#: Buckets of the sketch: one for each TEXT_PER_BUCKET characters of text, between these bounds (2 to 64 MB as 32-bit numbers).
BUCKETS, MOST_BUCKETS, TEXT_PER_BUCKET, SLICES = 1 << 19, 1 << 24, 1024, 64
MAX_MATCH, VERIFY_COST, HOT = 4, 20.0, 50_000
#: Open shingles of more classes are compared as families; blocks of a verification hold about so many classes.
CROWD, BLOCK, SPREAD = 32, 512, 16
#: Classes whose texts are wanted are broadcast against the documents up to this number (about 30 MB); more are joined.
BROADCAST_REQUESTS = 500_000
SIGNATURE = "doc_id long, t1 long, t2 long, n long, h long, h2 long, slice int, counts binary"
Batches = Iterator[pa.RecordBatch]


def _batch(schema: list[tuple[str, pa.DataType]], *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set of hashes."""
    return tuple(int(_signed(np.array([textops.mixed(s + np.uint64(k)).sum(dtype=np.uint64)], np.uint64))[0]) for k in (0x51ED, 0xA0761D64))


def buckets_for(docs: DataFrame) -> int:
    """Buckets for the text of `docs`, a power of two: about as many shingles share one whatever the input's size."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(BUCKETS, min(MOST_BUCKETS, 1 << max(0, math.ceil(chars / TEXT_PER_BUCKET) - 1).bit_length()))


def _signatures(n_words: int, buckets: int) -> Callable[[Batches], Batches]:
    kinds = [(c, pa.int64()) for c in ("doc_id", "t1", "t2", "n", "h", "h2")] + [("slice", pa.int32()), ("counts", pa.binary())]

    def run(batches: Batches) -> Batches:
        counts, some = np.zeros(buckets, np.uint32), False
        for batch in batches:
            keys, rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)), []
            for chunk in textops.chunks(batch.column(3)):
                seen = []
                for k, s in enumerate(textops.shingle_sets(chunk, n_words)):
                    rows.append((*keys[chunk.first + k], len(s), *fingerprint(s)))
                    seen.append(s)
                np.add.at(counts, (np.concatenate(seen) % np.uint64(buckets)).view(np.int64), np.uint32(1))
                some = True
            if rows:
                yield _batch(kinds, *zip(*rows, strict=True), [None] * len(rows), [None] * len(rows))
        each = buckets // SLICES
        if some:
            nothing = [None] * SLICES
            # a task fills few of many buckets: packed, its counts take no more than in proportion to its text
            packed = [zlib.compress(np.minimum(counts[k * each : (k + 1) * each], 65_535).astype("<u2").tobytes(), 1) for k in range(SLICES)]
            yield _batch(kinds, *[nothing] * 6, list(range(SLICES)), packed)

    return run


def _sum_slices(batches: Batches) -> Batches:
    """Adds up the sketch, slice by slice: memory for the slices of one partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), "<u2")
            if k in total:
                total[k] += part
            else:
                total[k] = part.astype(np.int64)
    if total:
        yield _batch([("slice", pa.int32()), ("counts", pa.binary())], list(total), [np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes() for v in total.values()])


def sketch(signatures: DataFrame, buckets: int) -> np.ndarray:
    """Counts of the shingle buckets over all documents, as 32-bit numbers."""
    rows = signatures.where("slice is not null").select("slice", "counts").repartition(partitions(signatures.sparkSession), "slice").mapInArrow(_sum_slices, "slice int, counts binary").collect()
    out = np.zeros((SLICES, buckets // SLICES), np.uint32)
    while rows:  # what has been read is let go
        k, raw = rows.pop()
        out[k] = np.frombuffer(raw, "<u4")
    return out.reshape(-1)


def overlap(n: int, similar: int) -> int:
    """The least intersection that a set of n can have with a similar one."""
    return -(-n * similar // 100)


def prefix(s: np.ndarray, counts: np.ndarray, noise: float, similar: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The adaptive prefix of one set: its shingles, their bucket counts and the number of matches that it asks for."""
    count = counts[(s % np.uint64(len(counts))).view(np.int64)].astype(np.int64)
    order = np.lexsort((s, count))
    least = overlap(len(s), similar)
    base, most = len(s) - least, min(MAX_MATCH, least)
    lists = np.cumsum(np.maximum(0.0, count[order[: base + most]] - noise - 1))
    want = np.arange(1, most + 1)
    scan = lists[base + want - 1]
    # at most scan/l documents can share l of these shingles: the candidates to verify
    l = int(np.argmin(base + want + scan + VERIFY_COST * scan / want)) + 1  # noqa: E741
    head = order[: base + l]
    return s[head], count[head], l


def _postings(counts_of: Callable[[], np.ndarray], n_words: int, similar: int) -> Callable[[Batches], Batches]:
    kinds = [("token", pa.int64()), ("h", pa.int64()), ("meta", pa.int64())]

    def run(batches: Batches) -> Batches:
        counts = counts_of()
        noise = counts.sum(dtype=np.int64) / len(counts)
        for batch in batches:
            for chunk in textops.chunks(batch.column(0)):
                tokens, hs, metas = [], [], []
                for s in textops.shingle_sets(chunk, n_words):
                    if len(s):
                        t, c, l = prefix(s, counts, noise, similar)  # noqa: E741
                        tokens.append(t)
                        hs.append(np.full(len(t), fingerprint(s)[0], np.int64))
                        metas.append((len(s) << 24) | (np.minimum(65_535, c // HOT + 1) << 8) | l)
                if tokens:
                    yield _batch(kinds, _signed(np.concatenate(tokens)), np.concatenate(hs), np.concatenate(metas).astype(np.int64))

    return run


def _shared(batches: Batches) -> Batches:
    """Postings sorted by (token, n, h), whole shingles or slices of hot ones: those with company, each with its run's leader.

    A run is one token's postings. It may go on in the next batch: its leader and last posting are carried over, and a first
    posting that has no company yet waits for it.
    """
    kinds = [(c, pa.int64()) for c in ("token", "h", "n", "l", "lead_h", "lead_n")]
    # token, n, h, l of the last posting; h and n of its run's leader; whether the leader still waits
    last: tuple[int, int, int, int] | None = None
    lead, waits = (0, 0), False
    for batch in batches:
        token, h, meta = (batch.column(k).to_numpy() for k in range(3))
        if not len(token):
            continue
        n, l = meta >> 24, meta & 255  # noqa: E741
        sliced = (meta >> 8 & 65_535) > 1
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (h[1:] != h[:-1]) | (n[1:] != n[:-1])
        fresh[0] = last is None or (int(token[0]), int(n[0]), int(h[0])) != last[:3]
        token, h, n, l, sliced = (x[fresh] for x in (token, h, n, l, sliced))  # noqa: E741
        if not len(token):
            continue
        goes_on = last is not None and int(token[0]) == last[0]
        if goes_on and waits:
            yield _batch(kinds, [last[0]], [last[2]], [last[1]], [last[3]], [lead[0]], [lead[1]])
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        first[0] = not goes_on
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(token)))
        head = int(start[0]) if len(start) else len(token)
        lead_h, lead_n = (np.concatenate([np.full(head, x), np.repeat(y[start], size)]) for x, y in zip(lead, (h, n), strict=True))
        company = np.concatenate([np.ones(head, bool), np.repeat(size, size) > 1]) | sliced
        keep = np.flatnonzero(company)
        if len(keep):
            yield _batch(kinds, token[keep], h[keep], n[keep], l[keep], lead_h[keep], lead_n[keep])
        last, lead = (int(token[-1]), int(n[-1]), int(h[-1]), int(l[-1])), (int(lead_h[-1]), int(lead_n[-1]))
        waits = not company[-1]


def sizes_fit(a: Column, b: Column, similar: int) -> Column:
    return 100 * F.least(a, b) >= similar * F.greatest(a, b)


def within_reach(matches: Column, n: tuple[Column, Column], l: tuple[Column, Column], similar: int) -> Column:  # noqa: E741
    """Whether two sets with so many shared prefix shingles can still meet the threshold.

    Of the two prefixes one ends first in the global order; its shingles that are not shared are not in the other set at all, so
    the intersection is at most the matches and what lies behind that prefix.
    """
    behind = [F.ceil(x * similar / 100) - y for x, y in zip(n, l, strict=True)]
    return (100 + similar) * (matches + F.greatest(*behind)) >= similar * (n[0] + n[1])


def _keyed_groups(batches: Batches, keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Rows sorted by their first columns as slices of one key; whether the key is new."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in columns)
            yield key != last, batch.slice(a, b - a)
            last = key


def _verify(n_words: int, similar: int) -> Callable[[Batches], Batches]:
    """Rows (p, q, kind, a, b, text) sorted so: the texts of all a of a block, then its pairs with the text of b."""
    kinds = [("a", pa.int64()), ("b", pa.int64())]

    def run(batches: Batches) -> Batches:
        firsts: dict[int, frozenset] = {}
        for new, part in _keyed_groups(batches, 2):
            if new:
                firsts = {}
            kind, a, b, found = part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), []
            for chunk in textops.chunks(part.column(5)):
                for k, s in enumerate(textops.shingle_sets(chunk, n_words), chunk.first):
                    if kind[k] == 0:
                        firsts[a[k]] = frozenset(s.tolist())
                        continue
                    x = firsts[a[k]]
                    both = len(x.intersection(s.tolist()))
                    if both and 100 * both >= similar * (len(x) + len(s) - both):
                        found.append((a[k], b[k]))
            if found:
                yield _batch(kinds, *zip(*found, strict=True))

    return run


def with_texts(requests: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Requests (class_id, ...) with the text of their class; copies of a text are combined inside the tasks that read them."""
    needed = cut(requests.select("class_id").distinct().join(classes.select("class_id", "t1", "t2"), "class_id"), "ngram-needed")
    few = needed.count() <= BROADCAST_REQUESTS
    texts = docs.select("t1", "t2", "text").join(F.broadcast(needed) if few else needed, ["t1", "t2"])
    return requests.join(texts.groupBy("class_id").agg(F.first("text").alias("text")), "class_id")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n_words: int, similar: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose whole texts meet the threshold.

    A block holds the sets of about BLOCK different a, and its pairs stream past with the text of b; the pairs of one a are spread
    over SPREAD blocks, so that no a makes a task of its own.
    """
    spark = docs.sparkSession
    pairs = cut(pairs, "ngram-pairs")
    blocks = max(1, -(-pairs.count() // BLOCK))
    keyed = pairs.select(F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("p"), F.pmod(F.xxhash64("b"), F.lit(SPREAD)).alias("q"), "a", "b")
    heads = keyed.select("p", "q", F.lit(0).alias("kind"), "a", F.lit(None).cast("long").alias("b"), F.col("a").alias("class_id")).distinct()
    requests = cut(heads.union(keyed.select("p", "q", F.lit(1), "a", "b", "b")), "ngram-requests")
    rows = with_texts(requests, classes, docs).select("p", "q", "kind", "a", "b", "text")
    rows = rows.repartition(partitions(spark), "p", "q").sortWithinPartitions("p", "q", "kind")
    return rows.mapInArrow(_verify(n_words, similar), "a long, b long")


def spanning(sets: list[np.ndarray], similar: int, columns: int = 4096) -> np.ndarray:
    """For each set the first one of its component under the threshold: intersections as matrix products, columns by columns."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets) if len(owner) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    held = count[column] > 1
    owner, column = owner[held], rank[column[held]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(rank[-1]) + 1 if len(rank) else 0, columns):
        here = (column >= a) & (column < a + columns)
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[here], column[here] - a] = 1
        both += m @ m.T
    linked = (both > 0) & (100 * both >= similar * (size[:, None] + size[None] - both))
    label = np.arange(len(sets))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(sets)).min(axis=1)) if len(sets) else label
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _families(n_words: int, similar: int) -> Callable[[Batches], Batches]:
    """Rows (family, p, q, class_id, text) sorted so: one pair of blocks at a time."""
    kinds = [("a", pa.int64()), ("b", pa.int64())]

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, sets = [], []
        for part in parts:
            ids += part.column(3).to_pylist()
            for chunk in textops.chunks(part.column(4)):
                sets += list(textops.shingle_sets(chunk, n_words))
        label = spanning(sets, similar)
        return _batch(kinds, ids, [ids[k] for k in label])

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for new, part in _keyed_groups(batches, 3):
            if new and held:
                yield links(held)
                held = []
            held.append(part)
        if held:
            yield links(held)

    return run


def family_links(families: DataFrame, classes: DataFrame, docs: DataFrame, n_words: int, similar: int) -> DataFrame:
    """Spanning links of each family (class_id, family): every pair of its classes that can be similar meets in some pair of its blocks.

    The classes of a family of more than one block are dealt by bands of set size, so wide that similar sets are in the same band or in
    neighbouring ones: blocks of other bands never meet, and a text is copied for blocks of its own three bands only.
    """
    sized = families.join(classes.select("class_id", F.col("n").alias("size")), "class_id")
    whole = families.groupBy("family").agg(F.count("*").alias("all"))
    # a little wider than the ratio, so that rounding never parts two sets by more than one band
    width = 1.0001 * math.log(100 / similar) if similar < 100 else 0.0001
    banded = sized.join(whole, "family").withColumn("band", F.when(F.col("all") <= BLOCK, 0).otherwise(F.floor(F.log("size") / width)).cast("int"))
    banded = cut(banded.select("class_id", "family", "band"), "ngram-banded")
    sizes = banded.groupBy("family", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    there = sizes.select("family", F.col("band").alias("near"), F.col("n").alias("m"))
    own = banded.join(sizes, ["family", "band"]).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("n")).cast("int"))
    near = own.withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(there, ["family", "near"])
    same = F.col("near") == F.col("band")
    # the blocks of a band meet one another; a single one is compared in itself
    others = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda x: ~same | (F.col("n") == 1) | (x != F.col("own")))
    block = lambda band, k: F.shiftleft(band.cast("long"), 32) + k
    each = near.select("class_id", "family", block(F.col("band"), F.col("own")).alias("mine"), "near", F.explode(others).alias("k"))
    each = each.select("class_id", "family", "mine", block(F.col("near"), F.col("k")).alias("other"))
    requests = cut(each.select("class_id", "family", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q")), "ngram-families")
    rows = with_texts(requests, classes, docs).select("family", "p", "q", "class_id", "text")
    rows = rows.repartition(partitions(docs.sparkSession), "family", "p", "q").sortWithinPartitions("family", "p", "q")
    return rows.mapInArrow(_families(n_words, similar), "a long, b long").where("a != b")


def text_keys(docs: DataFrame) -> DataFrame:
    """`docs` with t1 and t2, 128 bits of hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("t1", F.xxhash64(text)).withColumn("t2", F.xxhash64(F.concat(F.lit("#"), text)))


def groups(docs: DataFrame, n_words: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, t1, t2, n_shingles, class_id, group, component_id), one row each.

    `class_id` is the least id of the rows with the same set, `component_id` the least one reachable by links, 100 * intersection >=
    similar * union. `group` numbers the components, whether they have an id or not; null for documents without words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = text_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    buckets = buckets_for(docs)
    made = cut(docs.select("doc_id", "t1", "t2", "text").mapInArrow(_signatures(n_words, buckets), SIGNATURE), "ngram-signatures")
    counts = spark.sparkContext.broadcast(sketch(made, buckets))
    signs = made.where("slice is null").select("doc_id", "t1", "t2", "n", "h", "h2")
    same = signs.where("n > 0").groupBy("n", "h", "h2").agg(F.min("doc_id").alias("label"), F.min("t1").alias("t1"), F.min_by("t2", "t1").alias("t2"))
    # written, so that the numbers hold
    classes = cut(same.withColumn("class_id", F.monotonically_increasing_id()), "ngram-classes")
    postings = docs.select("text").mapInArrow(_postings(lambda: counts.value, n_words, similar), "token long, h long, meta long")
    dealt = postings.repartition(partitions(spark), "token", F.expr("pmod(h, shiftright(meta, 8) & 65535)"))
    # meta's upper bits are n
    dealt = dealt.sortWithinPartitions("token", F.expr("shiftright(meta, 24)"), "h")
    raw = cut(dealt.mapInArrow(_shared, "token long, h long, n long, l long, lead_h long, lead_n long"), "ngram-shared")
    counts.destroy()
    one = classes.select("n", "h", "class_id")
    led = raw.where("h != lead_h or n != lead_n").where(sizes_fit(F.col("n"), F.col("lead_n"), similar)).groupBy("h", "n", "lead_h", "lead_n").agg(F.count("*").alias("matches"))
    # a leader's matches may be spread over runs with other leaders: what is left out here comes back below
    led = led.where(within_reach(F.col("matches"), (F.col("n"), F.col("lead_n")), (F.lit(1), F.lit(1)), similar)).drop("matches")
    led = led.join(one, ["h", "n"]).withColumnRenamed("class_id", "x").drop("h", "n")
    led = led.join(one.select(F.col("h").alias("lead_h"), F.col("n").alias("lead_n"), F.col("class_id").alias("y")), ["lead_h", "lead_n"])
    ordered = lambda df: df.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = cut(verified(ordered(led), classes, docs, n_words, similar), "ngram-links")
    shared = cut(raw.join(one, ["h", "n"]).select("token", "n", "l", "class_id"), "ngram-postings")
    drop(raw)
    comps = components(links, "ngram")
    known = shared.join(comps.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("c", F.coalesce("component", "class_id"))
    open_tokens = known.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"), F.min("class_id").alias("first")).where("lo != hi")
    left = cut(known.join(open_tokens.select("token", "k", "first"), "token").select("token", "n", "l", "class_id", "c", "k", "first"), "ngram-open")
    drop(shared)
    crowds = left.where(F.col("k") > CROWD).select(F.col("class_id").alias("a"), F.col("first").alias("b")).distinct()
    families = cut(components(crowds, "ngram-family").select(F.col("id").alias("class_id"), F.col("component").alias("family")), "ngram-family")
    links = links.union(cut(family_links(families, classes, docs, n_words, similar), "ngram-links"))
    x = left.where(F.col("k") <= CROWD).join(families, "class_id", "left").select("token", "n", "l", "class_id", "c", "family")
    y = x.select("token", *(F.col(c).alias(f"{c}_y") for c in ("n", "l", "class_id", "c", "family")))
    both = x.join(y, "token").where("class_id < class_id_y and c != c_y and not coalesce(family = family_y, false)").where(sizes_fit(F.col("n"), F.col("n_y"), similar))
    both = both.groupBy("class_id", "class_id_y", "n", "n_y", "l", "l_y").agg(F.count("*").alias("matches")).where("matches >= least(l, l_y)")
    both = both.where(within_reach(F.col("matches"), (F.col("n"), F.col("n_y")), (F.col("l"), F.col("l_y")), similar))
    pairs = both.select(F.col("class_id").alias("a"), F.col("class_id_y").alias("b"))
    links = links.union(cut(verified(pairs, classes, docs, n_words, similar), "ngram-links"))
    comps = components(links, "ngram")
    named = classes.join(comps.withColumnRenamed("id", "class_id"), "class_id", "left").select("n", "h", "h2", "label", F.coalesce("component", "class_id").alias("group"))
    named = cut(named, "ngram-named")
    least = named.groupBy("group").agg(F.min("label").alias("least"))
    rows = signs.join(named.join(least, "group"), ["n", "h", "h2"], "left")
    own = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias
    return rows.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), own("label")("class_id"), "group", own("least")("component_id"))


def join(docs: DataFrame, n_words: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, n_shingles, class_id, component_id), one row each; see `groups`."""
    return groups(docs, n_words, similar).select("doc_id", "n_shingles", "class_id", "component_id")


def one_of_each(docs: DataFrame, n_words: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """The rows of `docs`, with all columns, that stay: of each group the one of least id, null ids last, then of least text hash.

    Documents without words are no one's copies, but of rows that repeat both id and text one stays.
    """
    rows = cut(groups(docs.select("doc_id", "text"), n_words, similar).select("doc_id", "t1", "t2", "group"), "ngram-groups")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2")
    first = rows.where("group is not null").groupBy("group").agg(F.min(row).alias("row")).select("row.doc_id", "row.t1", "row.t2")
    wordless = rows.where("group is null").select("doc_id", "t1", "t2").distinct()
    keep = first.union(wordless).select(F.col("doc_id").alias("k"), F.col("t1").alias("k1"), F.col("t2").alias("k2"))
    times = rows.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("times")).where("times > 1").select(F.col("doc_id").alias("r"), F.col("t1").alias("r1"), F.col("t2").alias("r2"))
    repeated = cut(times, "ngram-repeated")
    # rows equal in id and text go through one more step; where there are none, no text is shuffled for them
    some = not repeated.isEmpty()
    own = text_keys(docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc", "doc_id", "t1", "t2")
    kept = own.join(cut(keep, "ngram-keep"), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")), "left_semi")
    if not some:
        return kept.select("doc.*")
    again = F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2"))
    kept = cut(kept, "ngram-kept")
    twice = kept.join(repeated, again, "left_semi").dropDuplicates(["doc_id", "t1", "t2"])
    return kept.join(repeated, again, "left_anti").union(twice).select("doc.*")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i : array_to_string(ws[i:i + 4], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.seen FROM r JOIN e ON e.x = r.id AND r.seen < e.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.seen) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY ALL
"""
