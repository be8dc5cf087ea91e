"""Sources: interactions, knowledge base, labelled cases and configuration.

Configuration files are small and are read through Spark (any file system), parsed and
checked before a job starts.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardline import fixed_values as V
from wardline.functions.lookup import labels_where
from wardline.operators.routing import PROFILE_FIELDS

INTERACTIONS = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("tenant_id", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()), T.StructField("use_case", T.StringType()),
    T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType()),
    T.StructField("repaired_response", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
LABELLED_CASE = (
    "id string, category string, detector string, use_case string, risk_level string, text string, claim string, "
    "evidence array<struct<score:double,doc_id:string,title:string,content:string>>, threshold double, "
    "expected_positive boolean, expected_action string"
)
FAIL_FAST = {"mode": "FAILFAST"}  # malformed documents end the job; PERMISSIVE would give no rows
MAX_CONFIG_BYTES = 16 * 1024 * 1024


def request_violations() -> F.Column:
    """Reasons to reject a request row."""
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    return labels_where([
        (blank("request_id"), "request_id_missing"),
        (F.col("prompt").isNull() | ~F.length("prompt").between(1, V.MAX_PROMPT_CHARS), "prompt_length"),
        (blank("tenant_id"), "tenant_missing"), (blank("user_id"), "user_missing"),
        (F.col("use_case").isNull() | ~F.col("use_case").isin(*V.USE_CASES), "unknown_use_case"),
    ])


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("violations", request_violations())
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def read_interactions(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their violations); the schema is fixed, never inferred."""
    return split_valid(spark.read.schema(INTERACTIONS).format(fmt).load(path))


def _config_text(spark: SparkSession, path: str) -> str:
    files = spark.read.format("binaryFile").load(path).select("length", "content").limit(2).collect()
    if len(files) != 1 or files[0]["length"] > MAX_CONFIG_BYTES:
        raise ValueError(f"{path}: expected one configuration file of at most {MAX_CONFIG_BYTES} bytes")
    return bytes(files[0]["content"]).decode("utf-8")


def _config(spark: SparkSession, path: str) -> dict:
    text = _config_text(spark, path)
    if path.endswith((".yaml", ".yml")):
        import yaml

        loaded = yaml.safe_load(text)
    else:
        loaded = json.loads(text)
    if not isinstance(loaded, dict):
        raise ValueError(f"{path}: expected a mapping")
    return loaded


def load_kb(spark: SparkSession, path: str) -> DataFrame:
    """Flatten ``{use_case: [documents]}`` to rows; ``index_text`` is title and content."""
    doc = "map<string,array<struct<id:string,title:string,content:string>>>"
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", doc, FAIL_FAST).alias("m"))
    rows = files.select(F.explode("m").alias("use_case", "docs")).select("use_case", F.explode("docs").alias("d"))
    return rows.select(
        F.col("d.id").alias("doc_id"), F.col("d.title").alias("title"), F.col("d.content").alias("content"), "use_case",
        F.concat_ws(". ", "d.title", "d.content").alias("index_text"),
    )


def check_profiles(profiles: list[dict], baseline: str) -> None:
    ids = [p["id"] for p in profiles]
    if not ids or len(ids) != len(set(ids)):
        raise ValueError("profiles need at least one unique id")
    if baseline not in ids:
        raise ValueError("baseline profile is missing")


def load_model_profiles(spark: SparkSession, path: str) -> tuple[list[dict], str, dict[str, int]]:
    """(profiles, baseline id, latency budgets) from YAML or JSON."""
    raw = _config(spark, path)
    names = {
        "input_cost_per_1m": "input_cost_per_1m_tokens", "output_cost_per_1m": "output_cost_per_1m_tokens",
        "use_cases": "supported_use_cases", "risk_levels": "supported_risk_levels",
    }
    profiles = [
        {n: m[names.get(n, n)] if names.get(n, n) in m else m.get(n, True) for n in PROFILE_FIELDS}
        for m in raw.get("models", [])
    ]
    baseline = str(raw.get("baseline_profile_id", V.BASELINE_PROFILE))
    check_profiles(profiles, baseline)
    return profiles, baseline, {str(k): int(v) for k, v in (raw.get("latency_budgets_ms") or {}).items()}


def profiles_frame(spark: SparkSession, profiles: list[dict]) -> DataFrame:
    schema = ", ".join(f"{n} {k}" for n, k in PROFILE_FIELDS.items())
    return spark.createDataFrame([tuple(p[n] for n in PROFILE_FIELDS) for p in profiles], schema)


def check_policy(use_cases: Mapping, intercept: Mapping) -> None:
    """Reject bad thresholds and actions before any job runs."""
    for name, row in use_cases.items():
        low, high = float(row["escalate_at"]), float(row["block_at"])
        if not 0.0 <= low <= high <= 1.0:
            raise ValueError(f"policy thresholds for {name} are invalid")
        for key in ("sensitive_data_action", "confidential_action", "bias_action"):
            if row[key] not in V.ACTIONS:
                raise ValueError(f"policy action {key} for {name} is invalid")
    if not 0.0 <= float(intercept["multi_signal_increment"]) <= 1.0 or int(intercept["multi_signal_minimum"]) < 2:
        raise ValueError("intercept policy is invalid")
    for key, value in intercept.items():
        if key.endswith("_action") and value not in V.ACTIONS:
            raise ValueError(f"intercept action {key} is invalid")


def load_policy(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(use-case policy, intercept policy), validated."""
    raw = _config(spark, path)
    if not isinstance(raw.get("use_cases"), dict):
        raise ValueError("policy has no use cases")
    try:
        target = raw["intercept"]["targets"]["external_llm"]
        intercept = {**target, "multi_signal_increment": raw["intercept"]["risk_aggregation"]["multi_signal_increment"]}
        check_policy(raw["use_cases"], intercept)
    except (KeyError, TypeError) as exc:
        raise ValueError("policy configuration is invalid") from exc
    return raw["use_cases"], intercept


def policy_frame(spark: SparkSession, use_cases: Mapping = V.POLICY) -> DataFrame:
    fields = ("block_at", "escalate_at", "sensitive_data_action", "confidential_action", "bias_action")
    rows = [(u, *(row[f] for f in fields)) for u, row in use_cases.items()]
    return spark.createDataFrame(
        rows, "use_case string, block_at double, escalate_at double, sensitive_data_action string, confidential_action string, bias_action string")


def weights_frame(spark: SparkSession, table: Mapping = V.RISK_WEIGHTS, prefix: str = "w_") -> DataFrame:
    rows = [(u, *(row[s] for s in V.SIGNAL_ORDER)) for u, row in table.items()]
    return spark.createDataFrame(rows, "use_case string, " + ", ".join(f"{prefix}{s} double" for s in V.SIGNAL_ORDER))


def load_rules(spark: SparkSession, path: str, kind: str):
    """``injection``: ordered (pattern, family); ``bias``: (rules, references, settings);
    ``aliases``: entity type -> concept -> aliases.  Thresholds must lie in [0, 1]."""
    raw = _config(spark, path)
    if kind == "injection":
        return tuple((r["pattern"], r["family"]) for r in raw["rules"])
    if kind == "bias":
        settings = {k: float(raw[k]) for k in (
            "explicit_pattern_threshold", "model_threshold", "semantic_threshold", "final_detection_threshold",
            "context_reduction", "toxicity_support_increment", "weak_signal_threshold", "reinforcement_increment")}
        if any(not 0.0 <= v <= 1.0 for v in settings.values()):
            raise ValueError("bias thresholds must lie in [0, 1]")
        rules = tuple((r["pattern"], r["dimension"], r["behavior"], float(r["confidence"])) for r in raw["patterns"])
        refs = tuple((r["id"], r["dimension"], r["behavior"], r["text"]) for r in raw["semantic_references"])
        return rules, refs, settings
    if kind == "aliases":
        kinds = {"people": "PERSON", "organizations": "DOMAIN_ORGANIZATION", "projects": "DOMAIN_PROJECT", "domain_terms": "DOMAIN_TERM"}
        return {kinds[k]: raw[k] for k in kinds if raw.get(k)}
    raise ValueError(f"unknown rule kind {kind!r}")


def rules_frame(spark: SparkSession, rules=V.INJECTION_RULES) -> DataFrame:
    return spark.createDataFrame([(i, f, p) for i, (p, f) in enumerate(rules)], "rule_ord int, family string, pattern string")


def aliases_frame(spark: SparkSession, aliases: Mapping) -> DataFrame:
    rows = [(k, c, a) for k, concepts in aliases.items() for c, names in concepts.items() for a in names]
    return spark.createDataFrame(rows, "kind string, concept string, alias string")


def references_frame(spark: SparkSession, references=V.BIAS_REFERENCES) -> DataFrame:
    return spark.createDataFrame(list(references), "reference_id string, dimension string, behavior string, text string")


def load_labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from ``{"cases": [...]}`` documents or JSON lines, with the explicit schema.

    A file whose first line is a whole JSON document without ``cases`` holds JSON lines.
    Anything malformed ends the job.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    first = F.coalesce(F.element_at(lines, 1), F.lit(""))
    is_lines = F.coalesce(F.json_object_keys(first).isNotNull() & ~F.array_contains(F.json_object_keys(first), "cases"), F.lit(False))
    case = f"struct<{_as_struct(LABELLED_CASE)}>"
    boxed = F.from_json(F.when(~is_lines, F.col("value")), f"cases array<{case}>", FAIL_FAST)["cases"]
    each = F.from_json(F.when(is_lines, F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))), f"array<{case}>", FAIL_FAST)
    return whole.select(F.explode(F.coalesce(boxed, each)).alias("c")).select("c.*")


def _as_struct(ddl: str) -> str:
    return ", ".join(part.strip().replace(" ", ":", 1) for part in ddl.split(", "))
