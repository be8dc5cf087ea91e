"""How the given tables become interactions, audit rows, reviews, claims and signals.

Every view exists twice: as a DataFrame and as a SQL common table expression with the same
rows, so that each registered query can be checked against an independent SQL statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline import fixed_values as V
from wardline.functions.scores import risk_level
from wardline.operators.skew import broadcast_if_small, next_in_order

CANDIDATES_PER_CLAIM = 3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def use_case_of(number: Column) -> Column:
    return F.when(number % 3 == 0, V.USE_CASES[0]).when(number % 3 == 1, V.USE_CASES[1]).otherwise(V.USE_CASES[2])


def use_case_sql(number: str) -> str:
    return f"CASE {number} % 3 WHEN 0 THEN 'customer_chatbot' WHEN 1 THEN 'hr_copilot' ELSE 'finance_tool' END"


def level_sql(score: str) -> str:
    return f"CASE WHEN {score} <= 0.2 THEN 'LOW' WHEN {score} <= 0.55 THEN 'MEDIUM' ELSE 'HIGH' END"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("request_id"), "doc_id", use_case_of(F.col("doc_id")).alias("use_case"), "lang", "source", "text")


DOCS = f"docs_v AS (SELECT CAST(doc_id AS VARCHAR) AS request_id, doc_id, {use_case_sql('doc_id')} AS use_case, lang, source, text FROM documents)"


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows (``next_in_order`` keeps long conversations balanced)."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    nxt = next_in_order(c, "conv_id", "turn", ["role", "text"])
    return nxt.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), "conv_id", "turn",
        F.concat(F.lit("t"), (F.col("conv_id") % 4).cast("string")).alias("tenant_id"),
        use_case_of(F.col("conv_id")).alias("use_case"), F.col("text").alias("prompt"), F.col("next_text").alias("response"),
    )


PAIRS = f"""pairs_v AS (SELECT conv_id || '-' || turn AS request_id, conv_id, turn, 't' || (conv_id % 4) AS tenant_id,
  {use_case_sql('conv_id')} AS use_case, text AS prompt, next_text AS response FROM (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_from(table(spark, sf, "events"))


def audit_from(e: DataFrame) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    action = (
        F.when(kind == "view", "ALLOW").when(kind == "click", "REDACT").when(kind == "purchase", "REPAIR")
        .when(kind == "signup", "ESCALATE").otherwise("BLOCK")
    )
    out = e.select(
        i.alias("request_id"), "ts", "user_id", F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        use_case_of(F.col("user_id")).alias("use_case"), action.alias("action_taken"), ((i % 101) / F.lit(100.0)).alias("risk_score"),
        (F.floor(F.col("value") * 10) + 1).cast("int").alias("latency_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens_used"),
        ((i % 7) / F.lit(10.0)).alias("bias_score"), F.when(i % 5 == 0, i % 3).otherwise(0).alias("flagged_claim_count"),
        F.concat(kind, F.lit(" "), "props").alias("prompt"), F.concat(F.lit("answer "), i.cast("string")).alias("llm_response"),
        F.concat(F.lit("held "), i.cast("string")).alias("final_response"),
        F.when(kind == "error", "none").otherwise("standard").alias("model_used"),
    )
    return out.withColumn("risk_level", risk_level(F.col("risk_score")))


AUDIT = f"""audit_v AS (SELECT *, {level_sql('risk_score')} AS risk_level FROM (SELECT event_id AS request_id, ts, user_id,
  't' || (user_id % 4) AS tenant_id, {use_case_sql('user_id')} AS use_case,
  CASE event_type WHEN 'view' THEN 'ALLOW' WHEN 'click' THEN 'REDACT' WHEN 'purchase' THEN 'REPAIR' WHEN 'signup' THEN 'ESCALATE' ELSE 'BLOCK' END AS action_taken,
  (event_id % 101) / 100.0::DOUBLE AS risk_score, CAST(floor(value * 10) + 1 AS INTEGER) AS latency_ms,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_used, (event_id % 7) / 10.0::DOUBLE AS bias_score,
  CASE WHEN event_id % 5 = 0 THEN event_id % 3 ELSE 0 END AS flagged_claim_count, event_type || ' ' || props AS prompt,
  'answer ' || event_id AS llm_response, 'held ' || event_id AS final_response,
  CASE WHEN event_type = 'error' THEN 'none' ELSE 'standard' END AS model_used FROM events))"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    a = audit(spark, sf).filter(F.col("action_taken") == "ESCALATE")
    i = F.col("request_id")
    status = F.when(i % 4 == 0, "PENDING").when(i % 4 == 1, "APPROVED").when(i % 4 == 2, "EDITED").otherwise("REJECTED")
    return a.select(
        F.concat(F.lit("rv-"), i.cast("string")).alias("review_id"), "request_id", "tenant_id", "use_case", status.alias("status"),
        F.col("action_taken").alias("engine_action"), F.col("llm_response").alias("original_response"),
        F.when(i % 3 == 0, "").otherwise(F.col("final_response")).alias("holding_response"), "risk_level", "risk_score",
        F.lit(None).cast("string").alias("reviewer_id"), F.lit(None).cast("string").alias("reviewer_notes"),
        F.when(i % 4 == 2, F.concat(F.lit("edited "), i.cast("string"))).alias("edited_response"), F.col("ts").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
    )


REVIEWS = """reviews_v AS (SELECT 'rv-' || request_id AS review_id, request_id, tenant_id, use_case,
  CASE request_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'EDITED' ELSE 'REJECTED' END AS status,
  action_taken AS engine_action, llm_response AS original_response, CASE WHEN request_id % 3 = 0 THEN '' ELSE final_response END AS holding_response,
  risk_level, risk_score, CASE WHEN request_id % 4 = 2 THEN 'edited ' || request_id END AS edited_response, ts AS created_at
  FROM audit_v WHERE action_taken = 'ESCALATE')"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Two competing decisions per third event; many name a resolved or unknown review."""
    a = audit(spark, sf).filter(F.col("request_id") % 3 == 0)
    two = a.select("request_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    n = F.floor(F.col("request_id") / 3) + F.col("k")
    return two.select(
        "request_id", (F.col("request_id") * 2 + 1 - F.col("k")).alias("decision_id"),
        F.when(n % 3 == 0, "APPROVE").when(n % 3 == 1, "EDIT").otherwise("REJECT").alias("decision"),
        F.concat(F.lit("rev"), F.col("k").cast("string")).alias("reviewer_id"), F.lit("note").alias("notes"),
        F.concat(F.lit("fixed "), F.col("request_id").cast("string")).alias("edited_response"),
        F.when(F.col("request_id") % 2 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("make_interval(0, 0, 0, 0, k)")).alias("ts"),
    )


DECISIONS = """decisions_v AS (SELECT request_id, request_id * 2 + 1 - k AS decision_id,
  CASE (request_id // 3 + k) % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'EDIT' ELSE 'REJECT' END AS decision, 'rev' || k AS reviewer_id,
  'fixed ' || request_id AS edited_response, CASE WHEN request_id % 2 = 0 THEN ts ELSE ts + to_hours(k) END AS ts
  FROM audit_v, (VALUES (0), (1)) AS two(k) WHERE request_id % 3 = 0)"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback on every fifth event; every seventh of those names an unknown request."""
    a = audit(spark, sf).filter(F.col("request_id") % 5 == 0)
    i = F.col("request_id")
    correct = F.when(i % 3 == 0, F.col("action_taken")).when(i % 3 == 1, "ALLOW").otherwise("BLOCK")
    known = F.when(i % 7 == 0, i + 1_000_000_000_000).otherwise(i)
    return a.select(
        i.alias("feedback_id"), known.alias("request_id"), F.col("ts"), F.col("action_taken").alias("engine_action"),
        correct.alias("correct_action"), F.lit("rev0").alias("reviewer_id"),
    ).withColumn("false_positive", (F.col("engine_action") != "ALLOW") & (F.col("correct_action") == "ALLOW")).withColumn(
        "false_negative", (F.col("engine_action") == "ALLOW") & (F.col("correct_action") != "ALLOW"))


FEEDBACK = """feedback_v AS (SELECT *, engine_action <> 'ALLOW' AND correct_action = 'ALLOW' AS false_positive,
  engine_action = 'ALLOW' AND correct_action <> 'ALLOW' AS false_negative FROM (SELECT request_id AS feedback_id,
  CASE WHEN request_id % 7 = 0 THEN request_id + 1000000000000 ELSE request_id END AS request_id, ts, action_taken AS engine_action,
  CASE request_id % 3 WHEN 0 THEN action_taken WHEN 1 THEN 'ALLOW' ELSE 'BLOCK' END AS correct_action FROM audit_v WHERE request_id % 5 = 0))"""


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Detector signals per event, with unavailable detectors mixed in."""
    a = audit(spark, sf).drop("risk_level", "bias_score", "risk_score")
    i = F.col("request_id")
    status = lambda m: F.when(i % m == 0, "UNAVAILABLE").otherwise("AVAILABLE")
    verdict = F.when(i % 3 == 0, "SUPPORTED").when(i % 3 == 1, "INSUFFICIENT_EVIDENCE").otherwise("CONTRADICTED")
    pii = lambda m: F.when(i % m == 0, 0.95).when(i % m == 1, 0.7).otherwise(0.0)
    return a.select(
        "request_id", "use_case", "tenant_id", status(13).alias("injection_status"), (i % 11 == 0).alias("injection_detected"),
        ((i % 50 + 50) / F.lit(100.0)).alias("injection_confidence"), status(17).alias("pii_prompt_status"), pii(5).alias("pii_prompt_risk"),
        F.lit("AVAILABLE").alias("pii_response_status"), pii(4).alias("pii_response_risk"), status(19).alias("groundedness_status"),
        F.when(i % 3 == 0, 1.0).when(i % 3 == 1, 0.5).otherwise(0.0).alias("groundedness_score"), verdict.alias("groundedness_verdict"),
        (i % 2 == 0).alias("repairable"), status(23).alias("bias_status"), ((i % 10) / F.lit(10.0)).alias("bias_score"),
        (i % 10 >= 7).alias("bias_detected"), (pii(4) > 0).alias("pii_detected"), (i % 29 == 0).alias("secrets_detected"),
        (i % 31 == 0).alias("confidential_detected"),
    )


SIGNALS = """signals_v AS (SELECT request_id, use_case, tenant_id,
  CASE WHEN request_id % 13 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS injection_status, request_id % 11 = 0 AS injection_detected,
  (request_id % 50 + 50) / 100.0::DOUBLE AS injection_confidence,
  CASE WHEN request_id % 17 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS pii_prompt_status,
  CASE request_id % 5 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0::DOUBLE END AS pii_prompt_risk, 'AVAILABLE' AS pii_response_status,
  CASE request_id % 4 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0::DOUBLE END AS pii_response_risk,
  CASE WHEN request_id % 19 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS groundedness_status,
  CASE request_id % 3 WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS groundedness_score,
  CASE request_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'CONTRADICTED' END AS groundedness_verdict,
  request_id % 2 = 0 AS repairable, CASE WHEN request_id % 23 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS bias_status,
  (request_id % 10) / 10.0::DOUBLE AS bias_score, request_id % 10 >= 7 AS bias_detected, request_id % 4 <= 1 AS pii_detected,
  request_id % 29 = 0 AS secrets_detected, request_id % 31 = 0 AS confidential_detected FROM audit_v)"""

WEIGHTS_SQL = "weights AS (SELECT * FROM (VALUES " + ", ".join(
    "('%s', %s)" % (u, ", ".join(f"{V.RISK_WEIGHTS[u][s]}::DOUBLE" for s in V.SIGNAL_ORDER) + ", " + ", ".join(f"{V.UNAVAILABLE_RISK[u][s]}::DOUBLE" for s in V.SIGNAL_ORDER))
    for u in V.USE_CASES) + ") AS w(use_case, w_i, w_pp, w_pr, w_g, w_b, u_i, u_pp, u_pr, u_g, u_b))"
POLICY_SQL = "policy AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{u}', {p['block_at']}::DOUBLE, {p['escalate_at']}::DOUBLE)" for u, p in V.POLICY.items()) + ") AS p(use_case, block_at, escalate_at))"
RISKS = """inputs AS (SELECT s.*, w.* EXCLUDE (use_case),
  CASE WHEN injection_status = 'UNAVAILABLE' THEN u_i WHEN injection_detected THEN injection_confidence ELSE 0::DOUBLE END AS r_i,
  CASE WHEN pii_prompt_status = 'UNAVAILABLE' THEN u_pp ELSE pii_prompt_risk END AS r_pp, pii_response_risk AS r_pr,
  CASE WHEN groundedness_status = 'UNAVAILABLE' THEN u_g ELSE 1 - groundedness_score END AS r_g,
  CASE WHEN bias_status = 'UNAVAILABLE' THEN u_b ELSE bias_score END AS r_b FROM signals_v s JOIN weights w USING (use_case)),
risks AS (SELECT *, greatest(0, least(1, w_i * r_i + w_pp * r_pp + w_pr * r_pr + w_g * r_g + w_b * r_b)) AS overall_risk,
  CASE greatest(w_i * r_i, w_pp * r_pp, w_pr * r_pr, w_g * r_g, w_b * r_b) WHEN w_i * r_i THEN 'injection' WHEN w_pp * r_pp THEN 'pii_prompt'
  WHEN w_pr * r_pr THEN 'pii_response' WHEN w_g * r_g THEN 'groundedness' ELSE 'bias' END AS dominant_signal,
  array_to_string(list_sort(list_filter([CASE WHEN injection_status = 'UNAVAILABLE' THEN 'injection' END,
  CASE WHEN pii_prompt_status = 'UNAVAILABLE' THEN 'pii_prompt' END, CASE WHEN groundedness_status = 'UNAVAILABLE' THEN 'groundedness' END,
  CASE WHEN bias_status = 'UNAVAILABLE' THEN 'bias' END], lambda x: x IS NOT NULL)), ',') AS unavailable FROM inputs),
leveled AS (SELECT *, """ + level_sql("overall_risk") + " AS risk_level FROM risks)"


def kb_and_claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings").withColumn("use_case", use_case_of(F.col("label")))
    kb = e.filter(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("doc_id"), "use_case", "embedding")
    claims = e.filter(F.col("vec_id") % 2 == 1).select(F.col("vec_id").alias("query_id"), "use_case", "embedding")
    return kb, claims


def kb_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as knowledge-base documents with a number and a permission."""
    b = table(spark, sf, "benchmark")
    i = F.col("item_id")
    content = F.concat("text", F.lit(" It takes "), (i % 3 + 1).cast("string"), F.when(i % 2 == 0, " days and is permitted.").otherwise(" days and is prohibited."))
    return b.select(i.alias("doc_id"), use_case_of(i).alias("use_case"), F.concat(F.lit("Passage "), i.cast("string")).alias("title"), content.alias("content"))


KB_TEXTS = f"""kb_v AS (SELECT item_id AS doc_id, {use_case_sql('item_id')} AS use_case, 'Passage ' || item_id AS title,
  text || ' It takes ' || (item_id % 3 + 1) || CASE WHEN item_id % 2 = 0 THEN ' days and is permitted.' ELSE ' days and is prohibited.' END AS content FROM benchmark)"""


def simulated_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One claim per turn pair with three passages and a similarity derived from the ids."""
    kb = kb_texts(spark, sf).select("doc_id", "title", "content")
    n = kb.count()
    p = turn_pairs(spark, sf)
    c = F.col("conv_id") * 3 + F.col("turn")
    ending = F.concat(F.lit(" It takes "), (c % 3 + 1).cast("string"), F.when(F.col("turn") % 4 == 0, " days and is permitted.").otherwise(" days and is not permitted."))
    claim = F.when(c % 5 == 0, F.concat(F.lit("It takes "), (c % 3 + 1).cast("string"), F.lit(" days"))).otherwise(F.concat("prompt", ending))
    rows = p.select("request_id", "use_case", claim.alias("claim"), c.alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES_PER_CLAIM - 1))).alias("j"))
    rows = rows.withColumn("doc_id", (F.col("_c") + F.col("j") * 7) % n).withColumn("similarity", ((F.col("_c") * 13 + F.col("j") * 3) % 60 + 40) / F.lit(100.0))
    return rows.join(broadcast_if_small(kb), "doc_id").withColumn("rank", F.col("j") + 1).drop("_c", "j")


CANDIDATES = KB_TEXTS + """, claims_v AS (SELECT request_id, use_case, conv_id * 3 + turn AS c, CASE WHEN (conv_id * 3 + turn) % 5 = 0
  THEN 'It takes ' || ((conv_id * 3 + turn) % 3 + 1) || ' days' ELSE prompt || ' It takes ' || ((conv_id * 3 + turn) % 3 + 1) ||
  CASE WHEN turn % 4 = 0 THEN ' days and is permitted.' ELSE ' days and is not permitted.' END END AS claim FROM pairs_v),
cands_v AS (SELECT request_id, c.use_case, claim, j + 1 AS rank, doc_id, title, content, ((c * 13 + j * 3) % 60 + 40) / 100.0::DOUBLE AS similarity
  FROM claims_v c CROSS JOIN (VALUES (0), (1), (2)) AS three(j) JOIN kb_v ON kb_v.doc_id = (c.c + j * 7) % (SELECT count(*) FROM benchmark))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
