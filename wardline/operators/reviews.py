"""Human review: queue, decisions, released texts, feedback, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wardline import fixed_values as V
from wardline.functions.lookup import look_up
from wardline.functions.scores import safe_divide
from wardline.operators.audit import tenant_scope_any
from wardline.operators.skew import HOT_KEY_ROWS, join_unique

STATUS_OF = {"APPROVE": "APPROVED", "EDIT": "EDITED", "REJECT": "REJECTED"}
CORRECT_ACTION_OF = {"APPROVE": "ALLOW", "EDIT": "REPAIR", "REJECT": "ESCALATE"}
SUMMARY_DROPS = (
    "original_response", "action_evidence", "groundedness_evidence", "efficiency_evidence",
    "reviewer_id", "reviewer_notes", "edited_response",
)


def enqueue_reviews(audit: DataFrame, reviews: DataFrame) -> DataFrame:
    """New PENDING reviews: escalated requests that have none yet, one per request."""
    escalated = audit.filter(F.col("action_taken") == "ESCALATE").dropDuplicates(["request_id"])
    new = escalated.join(reviews.select("request_id"), "request_id", "left_anti")
    have = lambda c, kind="string": F.col(c) if c in audit.columns else F.lit(None).cast(kind).alias(c)
    return new.select(
        F.sha2(F.concat(F.lit("review:"), F.col("request_id").cast("string")), 256).alias("review_id"),
        "request_id", "tenant_id", "use_case", F.lit("PENDING").alias("status"),
        F.col("action_taken").alias("engine_action"), F.coalesce(have("llm_response"), F.lit("")).alias("original_response"),
        have("final_response").alias("holding_response"), "risk_level", "risk_score",
        have("action_evidence").alias("action_evidence"), F.col("ts").alias("created_at"),
    )


def list_reviews(df: DataFrame, status: str = "PENDING", use_case: str | None = None, limit: int = 50,
                 tenants: Sequence[str] | None = None) -> DataFrame:
    """Oldest first, ties by id."""
    if not 1 <= limit <= V.LISTING_LIMIT_MAX:
        raise ValueError("limit must be between 1 and 200")
    out = tenant_scope_any(df.filter(F.col("status") == status), tenants)
    if use_case:
        out = out.filter(F.col("use_case") == use_case)
    return out.orderBy("created_at", "review_id").limit(limit)


def review_summary(df: DataFrame) -> DataFrame:
    return df.drop(*SUMMARY_DROPS)


def get_review(df: DataFrame, request_id: object, tenants: Sequence[str] | None = None) -> DataFrame:
    return tenant_scope_any(df.filter(F.col("request_id") == request_id), tenants)


def get_feedback(feedback: DataFrame, audit: DataFrame, request_id: object, tenants: Sequence[str] | None = None) -> DataFrame:
    """Feedback of a request in order; no row for an unknown request, one null row when empty."""
    known = tenant_scope_any(audit.filter(F.col("request_id") == request_id), tenants).select("request_id")
    return known.join(feedback.filter(F.col("request_id") == request_id), "request_id", "left").orderBy("ts", "feedback_id")


def resolve_review(df: DataFrame, out: str = "released_text") -> DataFrame:
    s = F.col("status")
    text = (
        F.when(s == "PENDING", F.when(F.length("holding_response") > 0, F.col("holding_response")).otherwise(V.PENDING_TEXT))
        .when(s == "APPROVED", F.col("original_response"))
        .when(s == "EDITED", F.coalesce("edited_response", F.lit(""))).otherwise(V.REJECTED_TEXT)
    )
    return df.withColumn(out, text)


def decision_outcomes(reviews: DataFrame, decisions: DataFrame, tenants: Sequence[str] | None = None) -> DataFrame:
    """Per decided request: the first decision by (ts, decision_id) and what it does.

    The first decision is a grouped minimum, so many decisions for one request are combined
    before the shuffle.  ``outcome`` is applied, conflict (not pending) or unknown.
    """
    fields = [c for c in decisions.columns if c != "request_id"]
    order = F.struct("ts", "decision_id", *[c for c in fields if c not in ("ts", "decision_id")])
    first = decisions.groupBy("request_id").agg(F.min(order).alias("d"))
    held = tenant_scope_any(reviews, tenants).select("request_id", F.col("status").alias("_status"), F.col("engine_action").alias("_engine"),
                                                     F.col("review_id").alias("_review"))
    joined = first.join(held, "request_id", "left")
    outcome = F.when(F.col("_status").isNull(), "unknown").when(F.col("_status") == "PENDING", "applied").otherwise("conflict")
    return joined.withColumn("outcome", outcome)


def decide_reviews(reviews: DataFrame, decisions: DataFrame, tenants: Sequence[str] | None = None,
                   hot_rows: int = HOT_KEY_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews after the decisions, new feedback, decisions with their outcome).

    Only PENDING moves and the first decision wins; later ones are conflicts.
    """
    outcomes = decision_outcomes(reviews, decisions, tenants)
    applied = outcomes.filter(F.col("outcome") == "applied")
    change = applied.select(
        "request_id", look_up(STATUS_OF, F.col("d.decision")).alias("_new_status"), F.col("d.reviewer_id").alias("_reviewer"),
        F.col("d.notes").alias("_notes"), F.when(F.col("d.decision") == "EDIT", F.col("d.edited_response")).alias("_edited"),
        F.col("d.ts").alias("_at"),
    )
    moved = reviews.join(change, "request_id", "left")
    hit = F.col("_new_status").isNotNull()
    keep = {"status": "_new_status", "reviewer_id": "_reviewer", "reviewer_notes": "_notes", "edited_response": "_edited", "reviewed_at": "_at"}
    for old, new in keep.items():
        before = F.col(old) if old in reviews.columns else F.lit(None)
        moved = moved.withColumn(old, F.when(hit, F.col(new)).otherwise(before))
    updated = moved.drop(*keep.values())
    correct = look_up(CORRECT_ACTION_OF, F.col("d.decision"))
    feedback = applied.select(
        F.sha2(F.concat(F.lit("feedback:"), F.col("_review").cast("string")), 256).alias("feedback_id"),
        "request_id", F.col("_review").alias("review_id"), F.col("d.ts").alias("ts"), F.col("_engine").alias("engine_action"),
        correct.alias("correct_action"), F.col("d.reviewer_id").alias("reviewer_id"), F.col("d.notes").alias("notes"),
        (correct == "ALLOW").alias("false_positive"), F.lit(False).alias("false_negative"),
    )
    winner = outcomes.select("request_id", F.col("d.decision_id").alias("_first"), "outcome")
    judged = join_unique(decisions, winner, ["request_id"], hot_rows=hot_rows)
    late = (F.col("outcome") == "applied") & (F.col("decision_id") != F.col("_first"))
    return updated, feedback, judged.withColumn("outcome", F.when(late, "conflict").otherwise(F.col("outcome"))).drop("_first")


def append_feedback(feedback_in: DataFrame, audit: DataFrame, tenants: Sequence[str] | None = None,
                    hot_rows: int = HOT_KEY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows name an unknown or out-of-scope request."""
    known = tenant_scope_any(audit, tenants).select("request_id").distinct()
    return (
        join_unique(feedback_in, known, ["request_id"], "left_semi", hot_rows),
        join_unique(feedback_in, known, ["request_id"], "left_anti", hot_rows),
    )


def feedback_with_audit(feedback: DataFrame, audit: DataFrame, tenants: Sequence[str] | None = None,
                        hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Feedback rows with tenant and use case of their audit row (unique per request)."""
    side = tenant_scope_any(audit, tenants).select("request_id", "tenant_id", "use_case")
    return join_unique(feedback, side, ["request_id"], "inner", hot_rows)


def review_metrics(reviews: DataFrame, tenants: Sequence[str] | None = None) -> DataFrame:
    """Counts per status and the three rates; all rates 0 without reviews."""
    s = F.col("status")
    n = tenant_scope_any(reviews, tenants).agg(
        F.count("*").alias("total_reviews"), F.count_if(s == "PENDING").alias("pending_reviews"),
        F.count_if(s == "APPROVED").alias("approved_count"), F.count_if(s == "EDITED").alias("edited_count"),
        F.count_if(s == "REJECTED").alias("rejected_count"),
    )
    done = F.col("approved_count") + F.col("edited_count") + F.col("rejected_count")
    return (
        n.withColumn("completed_reviews", done)
        .withColumn("completion_rate", safe_divide(F.col("completed_reviews"), F.col("total_reviews")))
        .withColumn("override_rate", safe_divide(F.col("approved_count"), F.col("completed_reviews")))
        .withColumn("agreement_rate", safe_divide(F.col("edited_count") + F.col("rejected_count"), F.col("completed_reviews")))
    )
