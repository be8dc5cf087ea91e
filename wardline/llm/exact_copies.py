"""Exact dedup: documents grouped by a 128-bit content hash, bytes compared inside the groups, the smallest id kept.

Texts count as equal when they are identical after each run of ASCII white space (`[\\x20\\x09-\\x0D]+`) became one space.

1. One scan reduces a document to its hash, SHA-256, id and a row number; written once, so that row numbers hold from then on.
2. Groups are aggregations of these few bytes with map-side combination: a text that a third of all documents share costs a
   counter per task. Rows meet their group in a sort-merge join, which adaptive execution splits where a hash is hot.
3. Bytes are compared by grouping the texts themselves under their hash: copies are combined inside each task before anything is
   shuffled, and a hash with more than one text below it has collided. Texts whose hash occurs once cannot collide; they
   stay where they are as long as the repeated hashes, counted before, are few enough to be sent (`SENT` of them, 16 bytes
   each). Beyond that every distinct text of a task is shuffled once. The result is the same.
4. Documents of collided hashes are grouped anew, by hash and text. Usually there are none.

Nulls and edges: null text counts as empty; null ids come last, a group of null ids alone has a null `keep_id`; of rows that
repeat id and text exactly one is kept; extra columns are not read, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm.shared import cut, documents, drop

#: Most repeated hashes that are sent to every executor to tell which texts to compare.
SENT = 200_000
HASH = "content_hash"
Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """Null as empty, runs of ASCII white space as one space; single spaces are no match, so that few are replaced."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _decided(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (doc_id, row, text_sha256, *by) with their group's keep_id and group_size, and whether they stay."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("least")
    groups = rows.groupBy(*by).agg(least, F.count("*").alias("group_size"))
    joined = rows.join(groups, by)
    return joined.select("doc_id", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("least.row")).alias("kept"), "text_sha256")


def collided(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Hashes (of `repeated`, a table of one column) under which `docs` (hash, norm) holds more than one text."""
    if not repeated.limit(SENT + 1).count() > SENT:
        docs = docs.join(F.broadcast(repeated), HASH, "left_semi")
    return docs.groupBy(HASH, "norm").agg(F.count("*").alias("n")).groupBy(HASH).agg(F.count("*").alias("texts")).where("texts > 1").select(HASH)


def copies(docs: DataFrame, digest: Digest = hash128) -> DataFrame:
    """(doc_id, text) to one row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn(HASH, digest(F.col("norm")))
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    rows = cut(texts.select("doc_id", HASH, sha, F.monotonically_increasing_id().alias("row")), "copies-rows")
    repeated = cut(rows.groupBy(HASH).agg(F.count("*").alias("n")).where("n > 1").select(HASH), "copies-repeated")
    clashes = cut(collided(texts.select(HASH, "norm"), repeated), "copies-collided")
    drop(repeated)
    if clashes.isEmpty():
        drop(clashes)
        return _decided(rows, [HASH])
    apart = cut(texts.join(clashes, HASH, "left_semi").select("doc_id", HASH, sha, "norm", F.monotonically_increasing_id().alias("row")), "copies-apart")
    return _decided(rows.join(clashes, HASH, "left_anti"), [HASH]).unionByName(_decided(apart, [HASH, "norm"]))


def without_copies(docs: DataFrame, digest: Digest = hash128) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: one of each text."""
    stay = cut(copies(docs.select("doc_id", "text"), digest).where("kept").select(F.col("doc_id").alias("id"), "text_sha256"), "copies-kept")
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    # a text that stays is known by its digest; several rows with the kept id are equal in id and text, so one of them is taken
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", sha.alias("text_sha256"))
    kept = rows.join(stay, (rows["text_sha256"] == stay["text_sha256"]) & rows["doc_id"].eqNullSafe(stay["id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_sha256"]).select("doc.*")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER p AS keep_id, count(*) OVER p AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW p AS (PARTITION BY t)
"""
