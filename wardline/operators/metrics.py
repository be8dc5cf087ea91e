"""Reports over the audit table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline import fixed_values as V
from wardline.functions.scores import period_hours, pii_type_risk, safe_divide
from wardline.operators.audit import tenant_scope
from wardline.operators.skew import quantile, quantile_of_counts, value_counts

ALL = "*"
UNKNOWN = "unknown"


def in_period(df: DataFrame, period: str = "24h", as_of: dt.datetime | None = None, tenant: str | None = None) -> DataFrame:
    """Rows of the period that ends at ``as_of`` (newest row when not given)."""
    if as_of is None:
        as_of = df.agg(F.max("ts")).first()[0]
        if as_of is None:
            return df.filter(F.lit(False))
    start = as_of - dt.timedelta(hours=period_hours(period))
    out = tenant_scope(df, tenant).filter(F.col("ts") >= F.lit(start))
    if "date" in df.columns:  # partition column of the stored audit table
        out = out.filter(F.col("date") >= F.lit(start.date()))
    return out


def _actions(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("action_taken") == a).alias(f"{prefix}{a.lower()}_count") for a in V.ACTIONS]


def _levels() -> list[Column]:
    return [F.count_if(F.col("risk_level") == lv).alias(f"{lv.lower()}_count") for lv in V.RISK_LEVELS]


def action_breakdown(audit: DataFrame, *by: str) -> DataFrame:
    """Counts per action, 0-filled, and the total."""
    return audit.groupBy(*by).agg(*_actions(), F.count("*").alias("total"))


def risk_distribution(audit: DataFrame, *by: str) -> DataFrame:
    return audit.groupBy(*by).agg(*_levels(), F.count("*").alias("total"))


def latency_stats(audit: DataFrame, *by: str) -> DataFrame:
    """Average and interpolated p95 latency; 0 without rows (ungrouped form)."""
    avg = audit.groupBy(*by).agg(F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))
    p95 = quantile(audit, by, "latency_ms", 0.95, "p95_latency_ms")
    if by:
        return avg.join(p95, list(by))
    both = avg.unionByName(p95, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("avg_latency_ms", "p95_latency_ms")])


def use_case_metrics(audit: DataFrame) -> DataFrame:
    known = audit.filter(F.col("use_case").isNotNull())
    return known.groupBy("use_case").agg(
        F.count("*").alias("total_requests"), F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("avg_risk_score"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"), *_actions(),
    )


def _per_request(feedback: DataFrame) -> DataFrame:
    """Feedback counts per request, combined before the join, so a hot request costs one row."""
    f = feedback
    fp = (F.col("correct_action") != F.col("engine_action")) & F.col("engine_action").isin("BLOCK", "REDACT", "ESCALATE")
    missed = (F.col("correct_action") != F.col("engine_action")) & (F.col("engine_action") == "ALLOW")
    return f.groupBy("request_id").agg(
        F.count("*").alias("_n"), F.count_if(fp).alias("_fp"), F.count_if(F.col("false_negative")).alias("_fn"),
        F.count_if(missed).alias("_missed"),
    )


def feedback_rates(feedback: DataFrame, audit: DataFrame, *by: str) -> DataFrame:
    """False-positive rate, flagged false-negative rate and missed-allow rate over all feedback."""
    side = audit.select("request_id", *by)
    joined = _per_request(feedback).join(side, "request_id")
    total = joined.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("feedback_count"), F.coalesce(F.sum("_fp"), F.lit(0)).alias("false_positives"),
        F.coalesce(F.sum("_fn"), F.lit(0)).alias("false_negatives"), F.coalesce(F.sum("_missed"), F.lit(0)).alias("missed_allows"),
    )
    n = F.col("feedback_count")
    return (
        total.withColumn("false_positive_rate", safe_divide(F.col("false_positives"), n))
        .withColumn("false_negative_rate", safe_divide(F.col("false_negatives"), n))
        .withColumn("missed_allow_rate", safe_divide(F.col("missed_allows"), n))
    )


def false_positive_rate(feedback: DataFrame, audit: DataFrame, *by: str) -> DataFrame:
    return feedback_rates(feedback, audit, *by).select(*by, "feedback_count", "false_positives", "false_positive_rate")


def false_negative_rate(feedback: DataFrame, audit: DataFrame, *by: str) -> DataFrame:
    return feedback_rates(feedback, audit, *by).select(
        *by, "feedback_count", "false_negatives", "false_negative_rate", "missed_allows", "missed_allow_rate")


def _tally_columns(df: DataFrame) -> list[Column]:
    bias = F.col("bias_score") if "bias_score" in df.columns else F.get_json_object("risk_breakdown", "$.bias_score").cast("double")
    claims = (
        F.col("flagged_claim_count") if "flagged_claim_count" in df.columns else F.json_array_length("flagged_claims")
    )
    return [
        F.count_if(F.col("action_taken") == "REDACT").alias("pii_redactions"),
        F.count_if(bias > V.BIAS_TALLY_ABOVE).alias("bias_detections"),
        F.count_if(claims > 0).alias("hallucinations_caught"),
    ]


def tallies(audit: DataFrame, *by: str) -> DataFrame:
    """Redactions, rows with a bias score above 0.1, rows with a flagged claim."""
    return audit.groupBy(*by).agg(*_tally_columns(audit))


def rates(df: DataFrame) -> DataFrame:
    """Shares and saved tokens from an action breakdown with a total."""
    share = lambda c: safe_divide(F.col(c) * 100, F.col("total"))
    out = df.withColumn("block_rate", F.round(share("block_count"), 1)).withColumn("escalation_rate", F.round(share("escalate_count"), 1))
    for a in V.ACTIONS:
        out = out.withColumn(f"{a.lower()}_pct", F.round(share(f"{a.lower()}_count"), 0).cast("bigint"))
    return out.withColumn("tokens_saved", F.col("block_count") * V.TOKENS_PER_BLOCKED_REQUEST)


def top_pii_types(findings: DataFrame, n: int = 10, *by: str) -> DataFrame:
    """The ``n`` most frequent types, overall or per group, ties by name."""
    counted = findings.filter(F.col("detector") == "pii").groupBy(*by, "type").agg(F.count("*").alias("n"))
    if not by:
        return counted.orderBy(F.desc("n"), "type").limit(n)
    # a group has one row per type here
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "type")
    return counted.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def most_common_pii_type(findings: DataFrame, *by: str) -> DataFrame:
    return top_pii_types(findings, 1, *by).withColumnRenamed("type", "most_common_pii_type")


def bias_detection_rate(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col("bias_detected").cast("double")).alias("bias_detection_rate"))


def total_estimated_cost(df: DataFrame, *by: str) -> DataFrame:
    cost = F.sum(F.col("estimated_cost_usd").cast("decimal(20,10)")).cast("double")
    return df.groupBy(*by).agg(F.round(F.coalesce(cost, F.lit(0.0)), 8).alias("total_cost_usd"))


def metrics_summary(audit: DataFrame, feedback: DataFrame, period: str | None = None, as_of: dt.datetime | None = None,
                    tenant: str | None = None, findings: DataFrame | None = None, top: int = 10) -> DataFrame:
    """One row per use case and one for all (``*``): actions, risk, latency, tallies, feedback.

    With ``period`` only the rows of the period that ends at ``as_of`` count, with ``tenant``
    only its rows.  Where the audit table has ``bias_detected`` or ``estimated_cost_usd``, the
    detection rate and the cost are added; with ``findings`` (use_case, detector, type) the
    ``top`` most frequent types of personal data.

    The audit table is combined to one row per use case in one aggregation, and to latency
    counts in another; the overall row comes from those rows, not from the data again.
    """
    if period is not None:
        audit = in_period(audit, period, as_of, tenant)
    elif tenant is not None:
        audit = tenant_scope(audit, tenant)
    extra = {}
    if "bias_detected" in audit.columns:
        extra["_biased"] = F.count_if("bias_detected")
    if "estimated_cost_usd" in audit.columns:
        extra["_cost"] = F.sum(F.col("estimated_cost_usd").cast("decimal(20,10)"))
    audit = audit.withColumn("use_case", F.coalesce("use_case", F.lit(UNKNOWN)))
    base = audit.groupBy("use_case").agg(
        F.count("*").alias("total_requests"), *_actions(), *_levels(), *_tally_columns(audit),
        F.sum("risk_score").alias("_risk"), F.count("risk_score").alias("_risk_n"),
        F.sum("latency_ms").alias("_lat"), F.count("latency_ms").alias("_lat_n"), *[c.alias(n) for n, c in extra.items()],
    )
    sums = [c for c in base.columns if c != "use_case"]
    rolled = base.rollup("use_case").agg(F.grouping_id().alias("_all"), *[F.sum(c).alias(c) for c in sums])
    named = rolled.withColumn("use_case", F.when(F.col("_all") == 1, ALL).otherwise(F.col("use_case"))).drop("_all")
    shaped = (
        named.withColumn("avg_risk_score", safe_divide(F.col("_risk"), F.col("_risk_n")))
        .withColumn("avg_latency_ms", safe_divide(F.col("_lat"), F.col("_lat_n"))).drop("_risk", "_risk_n", "_lat", "_lat_n")
    )
    if "_biased" in extra:
        shaped = shaped.withColumn("bias_detection_rate", safe_divide(F.col("_biased"), F.col("total_requests"))).drop("_biased")
    if "_cost" in extra:
        shaped = shaped.withColumn("total_cost_usd", F.round(F.coalesce(F.col("_cost").cast("double"), F.lit(0.0)), 8)).drop("_cost")
    counts = value_counts(audit, ["use_case"], "latency_ms")
    both = counts.unionByName(counts.withColumn("use_case", F.lit(ALL)).groupBy("use_case", "_v").agg(F.sum("_n").alias("_n")))
    p95 = quantile_of_counts(both, ["use_case"], 0.95, "p95_latency_ms")
    fp = false_positive_rate(feedback, audit, "use_case").select("use_case", "feedback_count", "false_positives")
    fp_all = fp.rollup("use_case").agg(
        F.grouping_id().alias("_all"), F.sum("feedback_count").alias("feedback_count"), F.sum("false_positives").alias("false_positives"))
    fp_all = fp_all.withColumn("use_case", F.when(F.col("_all") == 1, ALL).otherwise(F.col("use_case"))).drop("_all")
    out = shaped.join(p95, "use_case", "left").join(fp_all, "use_case", "left")
    if findings is not None:
        named = findings.withColumn("use_case", F.coalesce("use_case", F.lit(UNKNOWN)))
        ranked = top_pii_types(named, top, "use_case").unionByName(top_pii_types(named.withColumn("use_case", F.lit(ALL)), top, "use_case"))
        order = F.struct((-F.col("n")).alias("k"), "type")
        lists = ranked.groupBy("use_case").agg(F.array_sort(F.collect_list(order)).alias("_t"))
        lists = lists.select("use_case", F.transform("_t", lambda x: F.struct(x["type"].alias("type"), (-x["k"]).alias("n"))).alias("top_pii_types"))
        out = out.join(lists, "use_case", "left")
    return (
        out.withColumn("p95_latency_ms", F.coalesce("p95_latency_ms", F.lit(0.0)))
        .withColumn("feedback_count", F.coalesce("feedback_count", F.lit(0)))
        .withColumn("false_positive_rate", safe_divide(F.col("false_positives"), F.col("feedback_count"))).drop("false_positives")
    )


def session_risk(audit: DataFrame, gap_minutes: int = 30, user: str = "user_id") -> DataFrame:
    """Sessions per user: start, requests, summed and highest risk.

    Rows are first combined per user and minute.  The gap is longer than a minute, so that
    keeps every session whole, and a user's window then holds at most one row per minute.
    """
    minute = F.date_trunc("minute", "ts")
    per_minute = audit.groupBy(user, minute.alias("_m")).agg(
        F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.count("*").alias("_n"),
        F.sum(F.col("risk_score").cast("decimal(20,6)")).alias("_sum"), F.max("risk_score").alias("_max"),
    )
    w = Window.partitionBy(user).orderBy("_m")
    gap = F.expr(f"interval {int(gap_minutes)} minutes")
    opens = F.coalesce(F.col("_from") >= F.lag("_to").over(w) + gap, F.lit(True))
    marked = per_minute.withColumn("_open", opens.cast("int")).withColumn(
        "_session", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(user, "_session").agg(
        F.min("_from").alias("session_start"), F.max("_to").alias("session_end"), F.sum("_n").alias("requests"),
        F.sum("_sum").cast("double").alias("risk_sum"), F.max("_max").alias("risk_max"),
    ).drop("_session")


def pii_risk_by(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(F.max(pii_type_risk(F.col("type"))).alias("max_risk"), F.count("*").alias("n"))
