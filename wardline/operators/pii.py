"""Personal data: findings, validation, redaction.

Every scan adds one ARRAY<STRUCT> column of findings (types, offsets, scores, never the
matched value), so scanning and redacting need no shuffle.  ``findings_table`` gives the
long form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T_
from pyspark.sql.pandas.types import to_arrow_schema

from wardline import fixed_values as V
from wardline.functions import phrases, spans as S, text as T
from wardline.functions.lookup import contains_any, one_of
from wardline.functions.prefilter import rule_bits
from wardline.functions.scores import pii_type_risk
from wardline.operators.skew import BROADCAST_MAX_ROWS

VALIDATED = "PATTERN_VALIDATED"
#: Most characters of aliases in one automaton, some 50 bytes of memory each.
ALIAS_CHARS = 2_000_000
LONG_FINDINGS = ("detector", "type", "start", "end", "score", "placeholder", "method", "signals")


# (type, pattern, score, method, signals) in prefilter order
CHECKED_RULES = (
    ("IN_AADHAAR", V.AADHAAR_PATTERN, V.CHECKED_SCORE, VALIDATED, ("verhoeff",)),
    ("IN_PAN", V.PAN_PATTERN, V.PAN_BASE_SCORE, VALIDATED, ()),
    ("IN_PASSPORT", V.PASSPORT_PATTERN, V.PASSPORT_SCORE, VALIDATED, ()),
    ("CREDIT_CARD", V.CARD_PATTERN, V.CHECKED_SCORE, VALIDATED, ("luhn",)),
    ("IBAN_CODE", V.IBAN_PATTERN, V.CHECKED_SCORE, VALIDATED, ("mod97",)),
    ("IP_ADDRESS", V.IP_PATTERN, V.IP_SCORE, VALIDATED, ()),
    ("URL", V.URL_PATTERN, V.URL_SCORE, VALIDATED, ()),
    ("MEDICAL_LICENSE", V.MEDICAL_LICENSE_PATTERN, V.CHECKED_SCORE, VALIDATED, ("checksum",)),
)
QUICK_RULES = tuple((k, p, V.QUICK_SCORE, VALIDATED, ("local_regex",)) for k, p in V.QUICK_PATTERNS.items())


def with_bits(df: DataFrame, text: str, rules: Sequence[tuple], out: str) -> DataFrame:
    """The patterns a text may match, as prefilter bits."""
    return df.withColumn(out, rule_bits(F.col(text), [r[1] for r in rules]))


def pii_bits(text: str, prefix: str) -> dict[str, Column]:
    """Bits of the checked and of the quick patterns, for ``withColumns``."""
    return {f"{prefix}c": rule_bits(F.col(text), [r[1] for r in CHECKED_RULES]),
            f"{prefix}q": rule_bits(F.col(text), [r[1] for r in QUICK_RULES])}


def regex_spans(df: DataFrame, text: str, patterns: Mapping[str, str] = V.QUICK_PATTERNS, out: str = "findings",
                score: float = V.QUICK_SCORE) -> DataFrame:
    """All matches of ``type -> pattern`` as findings with offsets; the value is not kept."""
    rules = [(k, p, score, VALIDATED, ("local_regex",)) for k, p in patterns.items()]
    marked = with_bits(df, text, rules, "_rbits")
    return marked.withColumn(out, S.rule_spans(F.col(text), F.col("_rbits"), rules, "pii")).drop("_rbits")


def validate_aadhaar(value: Column) -> Column:
    """12 digits, first 2-9, valid Verhoeff checksum."""
    return (F.size(T.digits_of(value)) == 12) & value.rlike("^[2-9]") & T.verhoeff_valid(value)


def score_pan(text: Column, m: Column) -> Column:
    """1.0 with tax context within 60 characters, else the base score."""
    near = F.lower(S.window_around(text, m, V.CONTEXT_WINDOW_CHARS))
    return F.when(contains_any(near, V.PAN_CONTEXT), V.CHECKED_SCORE).otherwise(V.PAN_BASE_SCORE)


def gate_passport(text: Column, m: Column) -> Column:
    """Passport shapes count only with passport context within 60 characters."""
    return S.window_around(text, m, V.CONTEXT_WINDOW_CHARS).rlike(V.PASSPORT_CONTEXT)


def is_valid(text: Column, rule: Column, m: Column) -> Column:
    """Checksum, range or context test of a checked type."""
    kind, value = rule["type"], m["value"]
    return (
        F.when(kind == "IN_AADHAAR", validate_aadhaar(value)).when(kind == "IN_PASSPORT", gate_passport(text, m))
        .when(kind == "CREDIT_CARD", T.luhn_valid(value)).when(kind == "IBAN_CODE", T.iban_valid(value))
        .when(kind == "IP_ADDRESS", T.ipv4_valid(value)).when(kind == "MEDICAL_LICENSE", T.dea_valid(value))
        .otherwise(True)
    )


def checked_spans(text: Column, bits: Column, rules: Sequence[tuple] = CHECKED_RULES) -> Column:
    """Types with a validation: Indian identifiers, card, IBAN, IP, URL, medical licence."""
    score = lambda r, m: F.when(r["type"] == "IN_PAN", score_pan(text, m)).otherwise(r["score"])
    return S.rule_spans(text, bits, rules, "pii", lambda r, m: is_valid(text, r, m), score)


def other_pattern_pii(df: DataFrame, text: str, kinds: Sequence[str], out: str = "findings") -> DataFrame:
    """Findings of the chosen checked types."""
    rules = [r for r in CHECKED_RULES if r[0] in kinds]
    marked = with_bits(df, text, rules, "_obits")
    return marked.withColumn(out, checked_spans(F.col(text), F.col("_obits"), rules)).drop("_obits")


def alias_spans(text: Column, aliases: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """Small dictionaries unrolled as literals: entity type -> concept -> aliases."""
    parts = [S.no_spans()]
    for kind, concepts in aliases.items():
        for concept, names in concepts.items():
            for name in names:
                literal = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in name)
                method = "DICTIONARY" if name.lower() == concept.lower() else "ALIAS"
                found = S.matches(text, rf"(?iU)(?<!\w){literal}(?!\w)")
                parts.append(S.as_spans(found, "pii", kind, V.DICTIONARY_SCORE, method, ("taxonomy_match",)))
    return F.concat(*parts)


def scan_pii(df: DataFrame, text: str, out: str = "pii", aliases: Mapping | None = None, bits: str | None = None) -> DataFrame:
    """All pattern detectors plus the quick patterns; adds the findings array ``out``.

    ``bits`` is the prefix of ``pii_bits`` columns taken beforehand.
    """
    found = df if bits else df.withColumns(pii_bits(text, "_pbits_"))
    bits = bits or "_pbits_"
    t, checked, quick = F.col(text), F.col(f"{bits}c"), F.col(f"{bits}q")
    first = checked_spans(t, checked)
    if aliases:
        first = F.concat(first, alias_spans(t, aliases))
    found = found.withColumns({"_checked": first, "_quick": S.rule_spans(t, quick, QUICK_RULES, "pii")})
    both = F.when(F.size("_quick") > 0, S.union_spans(F.col("_checked"), F.col("_quick"))).otherwise(F.col("_checked"))
    return found.withColumn(out, F.when(t.isNotNull(), both)).drop("_pbits_c", "_pbits_q", "_checked", "_quick")


def scan_aliases(df: DataFrame, aliases: DataFrame, key: str, text: str, max_rows: int = BROADCAST_MAX_ROWS, max_chars: int = ALIAS_CHARS) -> DataFrame:
    """Large dictionaries ``aliases(kind, concept, alias)``: long findings with offsets.

    An automaton of all aliases reads each text once; texts are not moved. The dictionary is counted first: beyond ``max_rows`` aliases or
    ``max_chars`` characters it is dealt into blocks by a hash, each a pass over the texts of its own, with the same findings.
    """
    known = aliases.where("alias is not null").select("kind", "concept", "alias").distinct()
    rows, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("alias")), F.lit(0))).first()
    blocks = max(1, -(-rows // max(1, max_rows)), -(-chars // max_chars))
    texts = df.select(key, F.col(text).cast("string").alias("_t"))
    schema = T_.StructType([df.schema[key], *T_.StructType.fromDDL(
        "detector string, type string, start int, end int, score double, placeholder string, method string, signals array<string>").fields])
    arrow = to_arrow_schema(schema)

    def row(start: int, end: int, entry: tuple[str, str, str]) -> tuple:
        kind, concept, alias = entry
        method = "DICTIONARY" if concept is not None and alias.lower() == concept.lower() else "ALIAS"
        return "pii", kind, start, end, float(V.DICTIONARY_SCORE), f"<{kind}>", method, ["taxonomy_match"]

    found = None
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("alias"), F.lit(blocks)) == k).collect()  # of bounded size, see above
        sent = df.sparkSession.sparkContext.broadcast([(r["alias"], (r["kind"], r["concept"], r["alias"])) for r in part])
        some = texts.mapInArrow(phrases.scan(lambda s=sent: s.value, row, arrow), schema)
        found = some if found is None else found.unionByName(some)
    return found


def governed_types(target: str) -> tuple[str, ...]:
    return V.PII_GOVERNED_TYPES + (("PERSON",) if target == "response" else ())


def governance_pii(df: DataFrame, findings: str, target: str, prefix: str) -> DataFrame:
    """Keep governed types; add found, count, risk and the sorted high-risk types."""
    kept = F.filter(F.col(findings), lambda s: one_of(s["type"], governed_types(target)))
    out = df.withColumn(findings, F.coalesce(kept, F.when(F.col(findings).isNotNull(), S.no_spans())))
    spans = F.col(findings)
    high = F.array_sort(F.array_distinct(F.transform(
        F.filter(spans, lambda s: one_of(s["type"], V.PII_HIGH_RISK_TYPES)), lambda s: s["type"])))
    risk = F.array_max(F.transform(spans, lambda s: pii_type_risk(s["type"])))
    return out.withColumns({
        f"{prefix}_status": F.when(spans.isNull(), "UNAVAILABLE").otherwise("AVAILABLE"),
        f"{prefix}_found": F.coalesce(F.size(spans) > 0, F.lit(False)),
        f"{prefix}_count": F.when(spans.isNull(), 0).otherwise(F.size(spans)),
        f"{prefix}_risk": F.coalesce(risk, F.lit(0.0)),
        f"{prefix}_high": F.coalesce(high, F.array().cast("array<string>")),
    })


def findings_table(df: DataFrame, findings: str, *keep: str) -> DataFrame:
    """Long table: one row per finding."""
    return S.explode_findings(df, findings, *keep)


def entity_summary(findings: DataFrame, *keys: str) -> DataFrame:
    """Count, highest risk and distinct high-risk types per key, from the long table."""
    return findings.groupBy(*keys).agg(
        F.count("*").alias("entity_count"),
        F.max(pii_type_risk(F.col("type"))).alias("risk_score"),
        F.array_sort(F.collect_set(F.when(one_of(F.col("type"), V.PII_HIGH_RISK_TYPES), F.col("type")))).alias("high_risk_types"),
    )


def resolve_overlaps(df: DataFrame, findings: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or findings, S.resolve_overlaps(F.col(findings), V.PII_HIGH_RISK_TYPES))


def redact_spans(df: DataFrame, text: str, findings: str, out: str = "redacted") -> DataFrame:
    """Replace the chosen, disjoint spans by their typed placeholders."""
    chosen = resolve_overlaps(df, findings, "_chosen")
    return chosen.withColumn(out, S.replace_spans(F.col(text), F.col("_chosen"))).drop("_chosen")


def quick_pattern_sweep(df: DataFrame, text: str) -> DataFrame:
    """Apply the four quick patterns once more to an already redacted text."""
    out = F.col(text)
    for kind, pattern in V.QUICK_PATTERNS.items():
        out = F.regexp_replace(out, pattern, f"<{kind}>")
    return df.withColumn(text, F.when(F.col(text).rlike("[0-9@]"), out).otherwise(F.col(text)))


def verify_redaction(df: DataFrame, original: str, redacted: str, findings: str, out: str = "redaction_ok") -> DataFrame:
    """False when nothing changed, nothing was found or a detected value still occurs."""
    o, r, f = F.col(original), F.col(redacted), F.col(findings)

    def leaks(s: Column) -> Column:
        raw = F.substring(o, s["start"] + 1, s["end"] - s["start"])
        return (F.length(raw) > 0) & r.contains(raw)

    return df.withColumn(out, F.coalesce((F.size(f) > 0) & (r != o) & ~F.exists(f, leaks), F.lit(False)))


def redact_pii(df: DataFrame, text: str, findings: str, out: str = "redacted") -> DataFrame:
    """Span redaction followed by the quick-pattern sweep."""
    return quick_pattern_sweep(redact_spans(df, text, findings, out), out)
