"""Detector quality: confusion metrics, threshold sweep, group breakdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.functions.scores import safe_divide
from wardline.operators.skew import quantile_of_counts, value_counts

ALL = "*"
UNKNOWN = "unknown"


def rate_columns(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, FPR and FNR from tp, tn, fp and fn; zero-safe, 6 digits."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return (
        df.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6))
        .withColumn("f1", F.round(safe_divide(p * r * 2, p + r), 6))
        .withColumn("false_positive_rate", F.round(safe_divide(fp, fp + tn), 6))
        .withColumn("false_negative_rate", F.round(safe_divide(fn, fn + tp), 6))
    )


def _cells(expected: Column, actual: Column) -> dict[str, Column]:
    return {"tp": expected & actual, "tn": ~expected & ~actual, "fp": ~expected & actual, "fn": expected & ~actual}


def confusion_metrics(results: DataFrame, by: str = "category") -> DataFrame:
    """Metrics per category and overall (``*``) from expected and actual outcomes.

    Reads expected_positive, actual_positive, expected_action, actual_action, latency_ms,
    llm_call_avoided.  Results are combined per category once; the overall row is their rollup.
    """
    results = results.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit(UNKNOWN)))
    cells = _cells(F.col("expected_positive"), F.col("actual_positive"))
    base = results.groupBy(by).agg(
        F.count("*").alias("cases"), *[F.count_if(c).alias(n) for n, c in cells.items()],
        F.count_if(F.col("expected_action") == F.col("actual_action")).alias("_right"),
        F.count_if("llm_call_avoided").alias("llm_calls_avoided"),
        F.sum(F.col("latency_ms").cast("decimal(20,6)")).alias("_latency"),
    )
    sums = [c for c in base.columns if c != by]
    rolled = base.rollup(by).agg(F.grouping_id().alias("_all"), *[F.sum(c).alias(c) for c in sums])
    rolled = rolled.withColumn(by, F.when(F.col("_all") == 1, ALL).otherwise(F.col(by))).drop("_all")
    counts = value_counts(results, [by], "latency_ms")
    both = counts.unionByName(counts.withColumn(by, F.lit(ALL)).groupBy(by, "_v").agg(F.sum("_n").alias("_n")))
    p95 = quantile_of_counts(both, [by], 0.95, "p95_latency_ms", nearest_rank=True)
    out = rate_columns(rolled.join(p95, by, "left"))
    return (
        out.withColumn("action_accuracy", F.round(safe_divide(F.col("_right"), F.col("cases")), 6))
        .withColumn("average_latency_ms", F.round(safe_divide(F.col("_latency"), F.col("cases")), 4))
        .withColumn("p95_latency_ms", F.round(F.coalesce("p95_latency_ms", F.lit(0.0)), 4)).drop("_right", "_latency")
    )


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float], actual: str = "actual", score: str = "score") -> DataFrame:
    """Metrics per threshold from one aggregation: four counters per threshold, no row copies."""
    truth = F.col(actual)
    aggs = []
    for i, t in enumerate(thresholds):
        for name, cell in _cells(truth, F.col(score) >= float(t)).items():
            aggs.append(F.count_if(cell).alias(f"{name}_{i}"))
    one = scores.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in ("tp", "tn", "fp", "fn")])
        for i, t in enumerate(thresholds)
    ])
    return rate_columns(one.select(F.explode(rows).alias("r")).select("r.*"))


def group_breakdown(scores: DataFrame, group: str, threshold: float = V.BIAS_SETTINGS["final_detection_threshold"],
                    actual: str = "actual", score: str = "score") -> DataFrame:
    """The same metrics per group at one threshold."""
    cells = _cells(F.col(actual), F.col(score) >= float(threshold))
    return rate_columns(scores.groupBy(group).agg(*[F.count_if(c).alias(n) for n, c in cells.items()]))
