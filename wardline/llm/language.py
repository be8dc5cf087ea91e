"""Language identification by a string kernel: blended-spectrum presence of byte n-grams, Nystroem landmarks, kernel ridge regression.

The kernel of two texts blends, for n = 1, 2, 3, the number of n-grams that both hold, divided by the root of the product of
their numbers. Landmarks are whole texts of each language; a text is described by its kernel values against them, and one ridge
regression per language (one against the rest) weighs these. n-grams are those that some landmark holds: three bytes index a
table, so that looking up a text's n-grams is a gather, and kernel values of a batch are one matrix product.

Fitted on bounded samples of the training rows, chosen by a hash of the text, each text once, whatever the ids: LANDMARKS texts per language, and for the regression
the landmarks and further distinct rows up to FIT_ROWS / languages of each language. A rare language so keeps all its rows at any size.
Rows count alike: weighted back to their language's total, a language of 0.01 % of the rows is lost in the ridge. Every whole text is scored, row by row without a shuffle. The language column, the source and the id are
never inputs of a prediction.

Nulls and edges: `und` with score 0 for null text or text without a letter, and for all rows if nothing was learned; null ids
count as empty text for the fold; equal rows get equal results; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wardline.llm import textops
from wardline.llm.shared import crc_mod, documents

FOLDS, HELD_OUT = 4, 2
LANDMARKS, FIT_ROWS, RIDGE = 24, 20_000, 1e-3
#: So many times a language's bound are looked at, for distinct rows.
SPARE = 2
ORDERS = (1, 2, 3)
BLEND = (0.2, 0.3, 0.5)
FIT_PARTITIONS = 16
UNKNOWN = "und"
ROWS = 256
Batches = Iterator[pa.RecordBatch]


class Space(NamedTuple):
    """The landmarks' n-gram codes per order, sorted, and per order which landmark holds which: small enough to send to all tasks."""

    grams: list[np.ndarray]
    held: list[np.ndarray]

    def opened(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Feature number by n-gram code per order (0: none), and landmarks as columns."""
        tables = []
        for n, grams in zip(ORDERS, self.grams, strict=True):
            table = np.zeros(256**n, np.uint16 if len(grams) < 65_535 else np.int32)
            table[grams] = np.arange(1, len(grams) + 1)
            tables.append(table)
        return tables, [h.astype(np.float32) for h in self.held]


class Model(NamedTuple):
    """Landmarks, weights per language."""

    space: Space
    weights: np.ndarray
    languages: list[str]


#: Lower case; white space and digits as one space each.
FOLD = textops.LOWER.copy()
FOLD[np.flatnonzero(textops.WHITE)] = 32
FOLD[48:58] = 32


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """n-grams of bytes as numbers."""
    out = data[: len(data) - n + 1].astype(np.int64) if len(data) >= n else np.zeros(0, np.int64)
    for k in range(1, n):
        out = (out << 8) | data[k : len(data) - n + 1 + k]
    return out


def presence(chunk: textops.Chunk, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Per order a matrix [row, feature] of 0 and 1; feature 0 is no feature."""
    rows, out = len(chunk.offsets) - 1, []
    row = np.repeat(np.arange(rows), np.diff(chunk.offsets))
    data = FOLD[chunk.data]
    for n, table in zip(ORDERS, tables, strict=True):
        found = np.zeros((rows, int(table.max()) + 1), bool)
        grams = codes(data, n)
        inside = row[: len(grams)] == row[n - 1 : n - 1 + len(grams)] if len(grams) else np.zeros(0, bool)
        found[row[: len(grams)][inside], table[grams[inside]]] = True
        found[:, 0] = False
        out.append(found.astype(np.float32))
    return out


def kernel(chunk: textops.Chunk, tables: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """[row, landmark]."""
    total = 0.0
    for weight, found, marks in zip(BLEND, presence(chunk, tables), landmarks, strict=True):
        size = np.sqrt(np.maximum(1.0, found.sum(axis=1)))[:, None] * np.sqrt(np.maximum(1.0, marks.sum(axis=0)))[None]
        total = total + weight * (found @ marks) / size
    return total


def _parts(column: pa.Array) -> Iterator[textops.Chunk]:
    for a in range(0, len(column), ROWS):
        for chunk in textops.chunks(column.slice(a, ROWS)):
            yield chunk._replace(first=chunk.first + a)


def spectrum(texts: list[str]) -> Space:
    """The space of some landmark texts."""
    (chunk,) = textops.chunks(pa.array(texts, pa.string()), 1 << 40)
    grams = []
    for n in ORDERS:
        parts = [codes(FOLD[chunk.data[a:b]], n) for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
        grams.append(textops.distinct(np.concatenate(parts)))
    tables, _ = Space(grams, []).opened()
    return Space(grams, [p.T.astype(bool) for p in presence(chunk, tables)])


def _moments(space_of: Callable[[], Space], languages: list[str]) -> Callable[[Batches], Batches]:
    """Sums of k k' and k y' over (text, lang)."""
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Batches) -> Batches:
        total = 0.0
        tables, landmarks = space_of().opened()
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            for chunk in _parts(batch.column(0)):
                k = kernel(chunk, tables, landmarks).astype(float)
                y = np.full((len(k), len(languages)), -1.0)
                for i in range(len(k)):
                    y[i, number[kinds[chunk.first + i]]] = 1.0
                total = total + k.T @ np.hstack([k, y])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return run


def fit_rows(train: DataFrame, marks: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(text, lang) of the regression: by language the landmarks (lang, pick) and its distinct rows of least pick."""
    most = max(LANDMARKS, FIT_ROWS // len(counts))
    share = F.broadcast(train.sparkSession.createDataFrame([(x, min(1.0, SPARE * most / n)) for x, n in counts.items()], "lang string, share double"))
    near = train.select("lang", "pick").join(share, "lang").join(F.broadcast(marks.withColumn("mark", F.lit(0))), ["lang", "pick"], "left")
    near = near.where("mark is not null or pmod(pick, 1000003) < share * 1000003").groupBy("lang", "pick").agg(F.min("mark").alias("mark"))
    by = W.partitionBy("lang").orderBy(F.col("mark").asc_nulls_last(), "pick")
    # ranked without their texts, which come in by a join with at most FIT_ROWS + LANDMARKS * languages picks
    chosen = near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).select("lang", "pick")
    return train.join(F.broadcast(chosen), ["lang", "pick"]).groupBy("lang", "pick").agg(F.first("text").alias("text")).select("text", "lang")


def fit(train: DataFrame) -> Model | None:
    """From (text, lang) of the training rows, chosen by their texts alone: None if there are none with a text and a language."""
    spark = train.sparkSession
    train = train.where("lang is not null and text rlike '\\\\p{L}'").withColumn("pick", F.xxhash64("text"))
    # short and very long texts make poor landmarks
    odd = ~F.length("text").between(200, 20_000)
    narrow = train.select("lang", "pick", odd.alias("odd")).distinct()
    counts = {r["lang"]: r["count"] for r in narrow.groupBy("lang").count().collect()}
    if not counts:
        return None
    best = W.partitionBy("lang").orderBy("odd", "pick")
    # languages that are rare enough to miss the sample still get landmarks from all their rows, hot ones are cut down first
    slim = narrow.withColumn("slice", F.expr("pmod(pick, 64)"))
    slim = slim.withColumn("r", F.row_number().over(W.partitionBy("lang", "slice").orderBy("odd", "pick"))).where(F.col("r") <= LANDMARKS)
    marks = slim.withColumn("r", F.row_number().over(best)).where(F.col("r") <= LANDMARKS).select("lang", "pick").distinct()
    rows = train.join(F.broadcast(marks), ["lang", "pick"]).select("lang", "pick", "text").dropDuplicates(["lang", "pick"]).orderBy("lang", "pick").collect()
    languages = sorted({r["lang"] for r in rows})
    space = spectrum([r["text"] for r in rows])
    sent = spark.sparkContext.broadcast(space)
    sample = fit_rows(train, marks, counts).repartition(FIT_PARTITIONS)
    parts = sample.mapInArrow(_moments(lambda: sent.value, languages), "m binary").collect()
    tables, landmarks = space.opened()
    moments = sum(np.frombuffer(p["m"]).reshape(len(rows), -1) for p in parts)
    gram, target = moments[:, : len(rows)], moments[:, len(rows) :]
    (chunk,) = textops.chunks(pa.array([r["text"] for r in rows], pa.string()), 1 << 40)
    among = kernel(chunk, tables, landmarks).astype(float)
    n = max(1.0, float(np.trace(gram)))
    weights = np.linalg.lstsq(gram / n + RIDGE * (among + among.T) / 2 / len(rows), target / n, rcond=None)[0]
    return Model(space, weights.astype(np.float32), languages)


def _predict(model_of: Callable[[], Model]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        m = model_of()
        tables, landmarks = m.space.opened()
        for batch in batches:
            texts = batch.column(2)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, top = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for chunk in _parts(texts):
                score = kernel(chunk, tables, landmarks) @ m.weights
                here = slice(chunk.first, chunk.first + len(score))
                best[here], top[here] = score.argmax(axis=1), np.clip((score.max(axis=1) + 1) / 2, 0, 1)
            names = np.array(m.languages, object)[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(letters, names, UNKNOWN), pa.string()), pa.array(np.where(letters, top, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, text, lang) to (doc_id, held_out, lang_pred, score); rows of the held-out fold teach nothing."""
    held = crc_mod(F.col("doc_id"), folds) == held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text", "lang")
    model = fit(docs.where("not held_out").select("doc_id", "text", "lang"))
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(lambda: sent.value), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
