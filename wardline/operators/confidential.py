"""Confidential text: segments, best reference category, hybrid score, redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.functions import spans as S
from wardline.functions.lookup import contains_any, first_match, words_found
from wardline.operators.retrieval import best_by_label


def segment_text(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per sentence-sized segment with offsets."""
    return df.select(*keep, F.explode(S.segments(F.col(text), V.SENTENCE_BOUNDARY)).alias("s")).select(*keep, "s.*")


def _case_by_category(category: Column, make) -> Column:
    default = make({"keywords": (), "negative_keywords": ()})
    return first_match([(category == c, make(d)) for c, d in V.CONFIDENTIAL_CATEGORIES.items()], default)


def hybrid_score(df: DataFrame, taxonomy: Sequence[str] = (), threshold: float = V.CONFIDENTIAL_THRESHOLD) -> DataFrame:
    """Blend the semantic score with keyword, rule and taxonomy evidence.

    Needs ``segment``, ``category`` and ``similarity``; adds ``score``, ``signals``, ``confidential``.
    """
    low = df.withColumn("_low", F.lower("segment"))
    t, category = F.col("_low"), F.col("category")
    empty = F.array().cast("array<string>")
    low = (
        low.withColumn("_kw", _case_by_category(category, lambda d: words_found(t, d["keywords"], "keyword:") if d["keywords"] else empty))
        .withColumn("_neg", _case_by_category(category, lambda d: words_found(t, d["negative_keywords"], "negative_context:") if d["negative_keywords"] else empty))
        .withColumn("_rule", words_found(t, V.CONFIDENTIAL_RULE_WORDS, "rule:"))
        .withColumn("_tax", words_found(t, taxonomy, "taxonomy:") if taxonomy else empty)
    )
    w = V.CONFIDENTIAL_WEIGHTS
    half = lambda c: F.least(F.lit(1.0), F.size(c) / F.lit(2.0))
    raw = (
        F.lit(w["semantic"]) * F.greatest(F.lit(0.0), F.col("similarity").cast("double"))
        + F.lit(w["keywords"]) * half("_kw") + F.lit(w["rules"]) * half("_rule")
        + F.lit(w["taxonomy"]) * F.when(F.size("_tax") > 0, 1.0).otherwise(0.0)
    )
    damped = raw * F.when(F.size("_neg") > 0, F.lit(V.CONFIDENTIAL_NEGATIVE_FACTOR)).otherwise(F.lit(1.0))
    score = F.least(F.lit(1.0), damped)
    return (
        low.withColumn("_score", score).withColumn("confidential", F.col("_score") >= threshold)
        .withColumn("score", F.round("_score", 4))
        .withColumn("signals", F.concat(F.array(F.lit("semantic_similarity")), "_kw", "_rule", "_tax", "_neg"))
        .drop("_low", "_kw", "_neg", "_rule", "_tax", "_score")
    )


def classify_confidential(
    segments: DataFrame, refs: DataFrame, key: Sequence[str], taxonomy: Sequence[str] = (),
    threshold: float = V.CONFIDENTIAL_THRESHOLD,
) -> DataFrame:
    """Findings for ``segments(key..., segment_index, segment, start, end, embedding)``.

    ``refs(reference_id, category, embedding)`` are unit vectors; the best reference decides
    the category.
    """
    best = best_by_label(segments, refs, label="category", score="similarity", reference="reference_id", one_per_row=True)
    hit = hybrid_score(best, taxonomy, threshold).filter("confidential")
    return hit.select(
        *key, F.lit("confidential").alias("detector"), F.col("category").alias("type"), "start", "end", "score",
        F.concat(F.lit("<CONFIDENTIAL_INFORMATION:"), "category", F.lit(">")).alias("placeholder"),
        F.lit("HYBRID_SEMANTIC").alias("method"), "signals",
    )


def redact_confidential(df: DataFrame, text: str, findings: str, out: str = "redacted") -> DataFrame:
    """Replace whole flagged segments; segments never overlap."""
    return df.withColumn(out, S.replace_spans(F.col(text), F.col(findings)))


def findings_array(findings: DataFrame, key: str, out: str) -> DataFrame:
    """Long findings back to one sorted array per key (few per text)."""
    span = F.struct("start", "end", "detector", "type", "score", "placeholder", "method", "signals")
    back = lambda s: F.struct(*[s[c].alias(c) for c in ("detector", "type", "start", "end", "score", "placeholder", "method", "signals")])
    return findings.groupBy(key).agg(F.array_sort(F.collect_list(span)).alias("_l")).select(
        key, F.transform("_l", back).cast(S.SPAN_TYPE).alias(out)
    )
