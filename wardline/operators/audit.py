"""Audit: stored content, evidence cleaning, listings, search, receipts, invariants."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wardline import fixed_values as V
from wardline.functions import text as T
from wardline.functions.lookup import fence, labels_where
from wardline.functions.scores import risk_level
from wardline.operators import pii as P, secrets as X

CONTENT = ("prompt", "llm_response", "final_response")


def tenant_scope(df: DataFrame, tenant: str | None = None) -> DataFrame:
    return df if tenant is None else df.filter(F.col("tenant_id") == tenant)


def tenant_scope_any(df: DataFrame, tenants: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Rows of any of the tenants; None means all tenants, an empty list none.

    A long list comes as a table with ``tenant_id`` and is semi-joined.
    """
    if isinstance(tenants, DataFrame):
        return df.join(tenants.select("tenant_id").distinct(), "tenant_id", "left_semi")
    return df if tenants is None else df.filter(F.col("tenant_id").isin(list(tenants)))


def sanitize_content(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Credentials first, then personal data; a failed step withholds the text.

    Placeholders contain nothing a personal-data pattern accepts, so the bits of the raw text
    also cover the text without credentials.
    """
    out = df
    marks: dict[str, Column] = {}
    for c in columns:
        marks |= {f"_{c}_s": X.secret_bits(c), **P.pii_bits(c, f"_{c}_")}
    out = out.withColumns(marks)
    for c in columns:
        first = X.redact_secrets(X.scan_secrets(out, c, "_sec", f"_{c}_s"), c, "_sec", "_plain")
        second = P.redact_spans(P.scan_pii(first, "_plain", "_pii", bits=f"_{c}_"), "_plain", "_pii", "_clean")
        safe = F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.coalesce("_clean", F.lit(V.WITHHELD)))
        out = second.withColumn(c, safe).drop("_sec", "_plain", "_pii", "_clean")
    return out.drop(*marks)


def prepare_audit_content(df: DataFrame, mode: str = "redacted", columns: Sequence[str] = CONTENT) -> DataFrame:
    """Hashes and lengths of the raw texts, then the text as the mode allows."""
    if mode not in ("redacted", "metadata_only", "raw"):
        raise ValueError(f"unknown audit content mode {mode!r}")
    out = df
    for c in columns:
        out = out.withColumn(f"{c}_sha256", T.sha256(F.col(c))).withColumn(f"{c}_length", F.length(c))
    if mode == "metadata_only":
        out = out.withColumns({c: F.lit(V.OMITTED) for c in columns})
    elif mode == "redacted":
        out = sanitize_content(out, columns)
    return out.withColumn("audit_content_mode", F.lit(mode))


def sanitize_evidence(df: DataFrame, column: str, mode: str = "redacted") -> DataFrame:
    """Replace values under content keys at any depth of an open JSON document."""
    if mode == "raw":
        return df
    keys = frozenset(V.CONTENT_KEYS)

    def clean(value: object) -> object:
        if isinstance(value, dict):
            return {k: V.REDACTED_METADATA if k.lower() in keys else clean(v) for k, v in value.items()}
        return [clean(v) for v in value] if isinstance(value, list) else value

    def cleaned(document: str | None) -> str | None:
        if document is None:
            return None
        try:
            return json.dumps(clean(json.loads(document)), ensure_ascii=False)
        except (ValueError, RecursionError):  # not a document: nothing in it can be told apart
            return V.REDACTED_METADATA

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(cleaned)

    # Documents without any content key keep their text and skip Python.
    pattern = "(?i)\"(?:" + "|".join(V.CONTENT_KEYS) + ")\""
    touched = F.when(F.col(column).rlike(pattern), F.col(column))
    return df.withColumn("_clean", run(touched)).withColumn(column, F.coalesce("_clean", column)).drop("_clean")


def sanitize_evidence_struct(df: DataFrame, column: str, fields: Sequence[str] = V.CONTENT_KEYS) -> DataFrame:
    """The same for ARRAY<STRUCT> evidence with known fields; stays native."""
    element = df.schema[column].dataType.elementType
    named = [f.name for f in element.fields]

    def clean(x: Column) -> Column:
        return F.struct(*[
            (F.when(x[n].isNotNull(), F.lit(V.REDACTED_METADATA)) if n.lower() in fields else x[n]).alias(n) for n in named
        ])

    return df.withColumn(column, F.transform(column, clean))


def recent_audit(df: DataFrame, limit: int = 50, tenant: str | None = None) -> DataFrame:
    """Newest rows; ties by request id."""
    if not 1 <= limit <= V.LISTING_LIMIT_MAX:
        raise ValueError("limit must be between 1 and 200")
    return tenant_scope(df, tenant).orderBy(F.desc("ts"), "request_id").limit(limit)


def audit_by_use_case(df: DataFrame, use_case: str, tenant: str | None = None) -> DataFrame:
    return recent_audit(df.filter(F.col("use_case") == use_case), V.LISTING_LIMIT_MAX, tenant)


def search_audit(df: DataFrame, action: str | None = None, risk: str | None = None, use_case: str | None = None,
                 text: str | None = None) -> DataFrame:
    """AND of the given filters; the text is looked for in prompt or request id, any case."""
    out = df
    for column, value in (("action_taken", action), ("risk_level", risk), ("use_case", use_case)):
        if value:
            out = out.filter(F.col(column) == value)
    if text:
        low = text.lower()
        out = out.filter(
            F.lower(F.coalesce("prompt", F.lit(""))).contains(low) | F.lower(F.col("request_id").cast("string")).contains(low)
        )
    return out


def audit_row_view(df: DataFrame) -> DataFrame:
    """Parse the JSON columns; null becomes an empty document."""
    any_map, list_of = "map<string,string>", "array<map<string,string>>"
    parsed = df
    for c in ("risk_breakdown", "action_evidence"):
        parsed = parsed.withColumn(c, F.coalesce(F.from_json(c, any_map), F.create_map().cast(any_map)))
    for c in ("flagged_claims", "pii_entities"):
        parsed = parsed.withColumn(c, F.coalesce(F.from_json(c, list_of), F.array().cast(list_of)))
    return parsed


def governance_receipt(audit: DataFrame, findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Safe projection per request: types, source ids and titles, no text.

    ``findings(request_id, target, detector, type)`` and ``sources(request_id, doc_id, title,
    first_claim)`` are rolled up first, so each join is one row per request.
    """
    kinds = lambda target: F.array_sort(F.collect_set(F.when((F.col("detector") == "pii") & (F.col("target") == target), F.col("type"))))
    rolled = findings.groupBy("request_id").agg(kinds("prompt").alias("pii_prompt_types"), kinds("response").alias("pii_response_types"))
    cited = sources.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("first_claim").alias("o"), "doc_id", "title"))).alias("_s")
    ).select("request_id", F.transform("_s", lambda s: F.struct(s["doc_id"].alias("doc_id"), s["title"].alias("title"))).alias("evidence_sources"))
    joined = audit.join(rolled, "request_id", "left").join(cited, "request_id", "left")
    strings = F.array().cast("array<string>")
    have = lambda c, default: F.coalesce(F.col(c), default) if c in audit.columns else default
    return joined.select(
        "request_id", F.col("final_action"), "use_case", "risk_level", F.col("overall_risk").alias("risk_score"),
        "policy_file", "policy_rule_ids", "policy_reason", F.col("groundedness_verdict").alias("trust_verdict"),
        "injection_detected", F.coalesce("pii_prompt_types", strings).alias("pii_prompt_types"),
        F.coalesce("pii_response_types", strings).alias("pii_response_types"), "bias_detected",
        have("bias_types", strings).alias("bias_types"),
        have("selected_model", F.lit(None).cast("string")).alias("selected_model"),
        have("selected_tier", F.lit(None).cast("string")).alias("selected_tier"),
        have("routing_branch", F.lit(None).cast("string")).alias("routing_reason"),
        have("estimated_cost_usd", F.lit(None).cast("double")).alias("estimated_cost_usd"),
        have("latency_ms", F.lit(0)).alias("latency_ms"),
        F.coalesce("evidence_sources", F.array().cast("array<struct<doc_id:string,title:string>>")).alias("evidence_sources"),
        "repair_attempted", "repair_success", "review_required",
    )


def invariant_rules(df: DataFrame) -> list[tuple[Column, str]]:
    """(violated, name) for every cross-field rule whose columns are present."""
    c = F.col
    size0 = lambda x: F.coalesce(F.size(x), F.lit(0))
    between = lambda x: ~c(x).between(0.0, 1.0)
    rules: list[tuple[tuple[str, ...], Column, str]] = []

    def rule(needs: tuple[str, ...], make, name: str) -> None:
        if set(needs) <= set(df.columns):
            rules.append((needs, make(), name))

    rule(("overall_risk",), lambda: between("overall_risk"), "risk_out_of_range")
    rule(("overall_risk", "risk_level"), lambda: c("risk_level") != risk_level(c("overall_risk")), "risk_level_mismatch")
    rule(("final_action",), lambda: ~c("final_action").isin(*V.ACTIONS), "unknown_action")
    rule(("use_case",), lambda: ~c("use_case").isin(*V.USE_CASES), "unknown_use_case")
    rule(("final_action", "final_response", "response"),
         lambda: c("final_action").isin("BLOCK", "ESCALATE") & (c("final_response") == c("response")), "held_text_released")
    rule(("final_action", "final_response", "response"),
         lambda: (c("final_action") == "ALLOW") & (c("final_response") != c("response")), "allowed_text_changed")
    rule(("final_action", "review_required"), lambda: (c("final_action") == "ESCALATE") & ~c("review_required"), "escalation_without_review")
    rule(("repair_attempts", "repair_attempted"), lambda: (c("repair_attempts") > 0) & ~c("repair_attempted"), "repair_count_mismatch")
    for p in ("pii_prompt", "pii_response"):
        rule((f"{p}_found", f"{p}_count", f"{p}_risk"),
             lambda p=p: ~c(f"{p}_found") & ((c(f"{p}_count") != 0) | (c(f"{p}_risk") != 0)), f"{p}_not_empty")
    rule(("injection_detected", "injection_confidence", "injection_method"),
         lambda: ~c("injection_detected") & ((c("injection_confidence") != 0) | (c("injection_method") != "none")), "injection_not_empty")
    rule(("bias_detected", "bias_types"), lambda: ~c("bias_detected") & (size0("bias_types") > 0), "bias_types_without_detection")
    rule(("groundedness_status", "groundedness_verdict"),
         lambda: (c("groundedness_status") == "UNAVAILABLE") != (c("groundedness_verdict") == "UNAVAILABLE"), "groundedness_status_mismatch")
    rule(("grounded_claims", "total_claims"), lambda: c("grounded_claims") > c("total_claims"), "more_grounded_than_claims")
    rule(("tokens_input", "tokens_output", "tokens_total"),
         lambda: c("tokens_total") != c("tokens_input") + c("tokens_output"), "token_sum_mismatch")
    rule(("false_positive", "false_negative"), lambda: c("false_positive") & c("false_negative"), "both_error_flags")
    rule(("decision", "edited_response"),
         lambda: (c("decision") == "EDIT") & (F.length(F.trim(F.coalesce("edited_response", F.lit("")))) == 0), "edit_without_text")
    rule(("prompt",), lambda: ~F.length("prompt").between(1, V.MAX_PROMPT_CHARS), "prompt_length")
    rule(("tenant_id",), lambda: F.coalesce(F.length("tenant_id"), F.lit(0)) == 0, "tenant_missing")
    rule(("user_id",), lambda: F.coalesce(F.length(c("user_id").cast("string")), F.lit(0)) == 0, "user_missing")
    return [(cond, name) for _, cond, name in rules]


def with_violations(df: DataFrame, out: str = "violations") -> DataFrame:
    found = labels_where([(F.coalesce(cond, F.lit(False)), name) for cond, name in invariant_rules(df)])
    return fence(df.withColumn(out, found), df.columns)


def check_invariants(df: DataFrame) -> DataFrame:
    """Violations per rule, one pass, only the counts are shuffled."""
    return with_violations(df).select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("violations"))
