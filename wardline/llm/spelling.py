"""Spelling variant grouping: words one edit apart by asymmetric q-chunks, each word joined to its more frequent form.

Counting. Texts become (word, count) inside the tasks, one dictionary per batch of Arrow rows, flushed at `HELD` words; the counts
are summed with map-side combination. Nothing wider than a distinct word is shuffled.

Joining. Of two words one edit apart let x be the shorter one (or either, if equally long), L its length and q = L // 2. x contributes two
disjoint chunks, x[0:q] and x[q:2q]. One edit leaves one of them whole: the first stays at its place unless the edit lies in
it or before it, and then the second one does, shifted by the difference in length, one at most. So the other word offers its
positional grams of q letters within that shift: at 0 for the first chunk, at q or q + 1 for the second. Equal (L, chunk number, letters)
make a candidate, and the Levenshtein distance decides.

Short words have short chunks, shared by very many. A chunk whose candidates exceed `PAIRS` isn't joined but lengthened: what is left of a
word beside the chunk is again one edit away from what is left of its partner, so it is split into two chunks in the same way, which
are added to the key. This ends at one letter left, where a key's words differ in that letter alone (the alphabet bounds them).
No word, pair or key is dropped, and no key's pairs exceed the bound but these last ones.

Forms. A form has at least twice the word's count, so chains have no cycle and at most log2 of the largest count links; roots are
found by pointer doubling, joins that adaptive execution can split.

Nulls and edges: null texts hold no words; a null id counts as empty text before the colon; rows that repeat an id count each; words of
any length are compared; equal rows count each; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm.shared import cut, documents, drop

#: A word in UTF-8: ASCII letters and U+00C0 to U+00FF, lower-cased from A-Z before.
LETTERS = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LEAST_LETTERS, LEAST_COUNT, FORM_FACTOR = 5, 3, 2
HELD = 500_000
PAIRS = 4_000_000
#: Changes the distinct words of one document: (id as text, word) to the word that counts.
Noise = Callable[[str, bytes], bytes]


def deleted(doc_id: str, word: bytes) -> bytes:
    """The query's test pattern: where 97 divides h = crc32("id:word"), the letter at h modulo the word's length is left out."""
    h = zlib.crc32(word, zlib.crc32(f"{doc_id}:".encode()))
    if h % 97:
        return word
    letters = word.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def _counted(least_letters: int, noise: Noise | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(total: Counter) -> pa.RecordBatch:
        words = pa.array(list(total), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if not text:
                    continue
                own = Counter(LETTERS.findall(text.encode().translate(LOWER)))
                if noise:
                    changed: Counter = Counter()
                    name = ids[k].as_py() or ""
                    for word, n in own.items():
                        changed[noise(name, word)] += n
                    own = changed
                total.update(own)
                if len(total) >= HELD:
                    yield flush(total)
                    total = Counter()
        if total:
            yield flush(total)

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: Noise | None = None) -> DataFrame:
    """(doc_id, text) to (word, n): words of at least so many letters that occur at least so often in all texts."""
    parts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counted(least_letters, noise), "word string, n long")
    return parts.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _piece(text: Column, at: Column | int, n: Column) -> Column:
    return F.substring(text, (at if isinstance(at, Column) else F.lit(at)) + 1, n)


def _keys(rows: DataFrame, chunk_side: bool) -> DataFrame:
    """Rows (key, word, rest, size, longer) with the keys of the two chunks of `rest`, what is left beside them as `rest`.

    `size` is the length of the chunk side's rest, `longer` by how much the gram side's is longer (0 or 1).
    """
    q, rest, shift = F.floor(F.col("size") / 2).cast("int"), F.col("rest"), F.lit(0) if chunk_side else F.col("longer")
    places = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("at")), F.struct(F.lit(1).alias("k"), (q + shift).cast("int").alias("at")))
    each = rows.withColumn("q", q).withColumn("place", F.explode(places))
    at, q = F.col("place.at"), F.col("q")
    left = F.concat(_piece(rest, 0, at), F.substring(rest, at + q + 1, F.char_length(rest)))
    # as long chunks only make long keys, a key is a hash; equal hashes of different chunks are candidates that fail
    key = F.xxhash64("key", "size", "longer", "place.k", _piece(rest, at, q))
    return each.select(key.alias("key"), "word", left.alias("rest"), (F.col("size") - q).cast("int").alias("size"), "longer")


def _sides(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every word as the chunk side of partners as long and one longer, and as the gram side of those as long and one shorter."""
    size = F.char_length("word").cast("int")
    both = lambda s: words.select(F.lit(0).cast("long").alias("key"), "word", F.col("word").alias("rest"), s.alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    chunk, gram = both(size), both(size)
    return chunk, gram.withColumn("size", (F.col("size") - F.col("longer")).cast("int"))


def near_pairs(words: DataFrame, pairs: int | None = None) -> DataFrame:
    """(word) of distinct words to (a, b): all pairs one inserted, deleted or replaced letter apart, each once."""
    bound, found = pairs or PAIRS, None
    chunk, gram = _sides(words)
    while True:
        chunk, gram = cut(_keys(chunk, True), "spelling-chunks"), cut(_keys(gram, False), "spelling-grams")
        weight = chunk.groupBy("key").agg(F.count("*").alias("x")).join(gram.groupBy("key").agg(F.count("*").alias("y")), "key")
        # with one letter left, nothing is there to lengthen a key by
        hot = cut(weight.where(F.col("x") * F.col("y") > bound).select("key"), "spelling-hot")
        more = not hot.isEmpty()
        open_ = (lambda side: side.join(hot, "key", "left_semi").where("size > 1")) if more else None
        cold = (lambda side: side.join(hot.select("key", F.lit(True).alias("hot")), "key", "left").where("hot is null or size <= 1").drop("hot")) if more else (lambda side: side)
        a, b = (cold(side).select("key", F.col("word").alias(name), "longer") for side, name in ((chunk, "a"), (gram, "b")))
        met = a.join(b, ["key", "longer"]).where((F.col("longer") == 1) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1)
        pair = cut(met.select("a", "b").distinct(), "spelling-pairs")
        found = pair if found is None else found.unionByName(pair)
        if not more:
            drop(hot)
            return found.distinct()
        chunk, gram = open_(chunk), open_(gram)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms followed to their end, by doubling."""
    now = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, factor: int = FORM_FACTOR, pairs: int | None = None) -> DataFrame:
    """(word, n) to word, form, root, n, n_near, form_n."""
    words = cut(words.select("word", "n"), "spelling-words")
    pair = cut(near_pairs(words.select("word"), pairs), "spelling-near")
    both = pair.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pair.select("b", "a"))
    near = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best")
    own = words.join(near.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left")
    isform = -F.col("best.n") >= factor * F.col("n")
    formed = cut(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(isform, F.col("best.other")).alias("form"), F.when(isform, -F.col("best.n")).alias("form_n")), "spelling-forms")
    drop(pair)
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(documents(spark, sf_dir), noise=deleted))
