"""Character spans of pattern matches as native expressions.

Matches are enclosed in marks in one pass of the pattern and the text is cut at the marks; the running length of the pieces gives
every offset.  Nothing leaves the JVM and no row is multiplied: a row carries its spans as an array until somebody asks for the
long table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.lookup import constant
from wardline.functions.prefilter import may_match

MATCH_TYPE = "array<struct<start:int,end:int,value:string>>"
SPAN_TYPE = (
    "array<struct<detector:string,type:string,start:int,end:int,score:double,"
    "placeholder:string,method:string,signals:array<string>>>"
)
SEGMENT_TYPE = "array<struct<segment_index:int,segment:string,start:int,end:int>>"


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


#: Private characters that enclose matches; a text that holds one of them is searched with ``MARK_INSTEAD`` in its place.
OPEN, CLOSE, MARK_INSTEAD = "\ue000", "\ue001", "\ue002"


def matches(text: Column, pattern: str | Column, hint: Column | None = None) -> Column:
    """Every match of ``pattern`` with its offsets (end exclusive), in order.

    The pattern reads the text once: matches are enclosed in marks, and cutting at the marks gives gaps and matches in turn, whose
    running length gives the offsets.  ``hint`` is a cheap necessary condition that keeps the regex off most rows.  The pattern
    may be a literal, compiled once, or come from a rule table.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    empty = F.array().cast(MATCH_TYPE)
    marked_before = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    clean = F.when(marked_before, F.translate(text, OPEN + CLOSE, MARK_INSTEAD * 2)).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, regex, F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)

    def of(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"), empty.alias("out"))

        def step(acc: Column, piece: Column) -> Column:
            end = acc["pos"] + F.length(piece)
            found = F.array(F.struct(acc["pos"].alias("start"), end.alias("end"), piece.alias("value")))
            return F.struct(end.alias("pos"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

        return F.when(F.size(p) > 1, F.aggregate(p, start, step)["out"]).otherwise(empty)

    # as the element of an array the pieces are made once, however often they are looked at
    found = F.get(F.transform(F.array(pieces), of), 0)
    return F.when(text.isNotNull() if hint is None else hint, found).otherwise(empty)


RULE = "array<struct<i:int,type:string,pattern:string,score:double,method:string,signals:array<string>>>"


def rule_table(rules: Sequence[tuple]) -> Column:
    """Constant table of ``(type, pattern, score, method, signals)`` in prefilter order."""
    return constant([
        {"i": i, "type": k, "pattern": p, "score": float(s), "method": m, "signals": list(g)}
        for i, (k, p, s, m, g) in enumerate(rules)
    ], RULE)


def finding(m: Column, detector: str, kind: Column, score: Column, method: Column, signals: Column) -> Column:
    """A finding for a match; the matched value is dropped here and never leaves."""
    return F.struct(
        F.lit(detector).alias("detector"), kind.alias("type"), m["start"].alias("start"), m["end"].alias("end"),
        score.cast("double").alias("score"), F.concat(F.lit("<"), kind, F.lit(">")).alias("placeholder"),
        method.alias("method"), signals.alias("signals"),
    )


def rule_spans(text: Column, bits: Column, rules: Sequence[tuple], detector: str, accept=None, score=None) -> Column:
    """Findings of all rules whose prefilter bit is set.

    One expression serves every rule, so the plan stays small however long the rule list is.
    ``accept(rule, match)`` validates a match, ``score(rule, match)`` overrides the rule's score.
    """

    def of_rule(r: Column) -> Column:
        found = matches(text, r["pattern"])
        if accept is not None:
            found = F.filter(found, lambda m: accept(r, m))
        worth = (lambda m: score(r, m)) if score is not None else (lambda m: r["score"])
        return F.transform(found, lambda m: finding(m, detector, r["type"], worth(m), r["method"], r["signals"]))

    tried = F.filter(rule_table(rules), lambda r: may_match(bits, r["i"]))
    return F.when(bits != 0, F.flatten(F.transform(tried, of_rule)).cast(SPAN_TYPE)).otherwise(no_spans())


def as_spans(found: Column, detector: str, kind: str, score: float, method: str, signals: Sequence[str] = ()) -> Column:
    """Turn matches into findings of one type."""
    tags = F.array(*[F.lit(s) for s in signals]).cast("array<string>")
    return F.transform(
        found, lambda m: finding(m, detector, F.lit(kind), F.lit(float(score)), F.lit(method), tags)
    ).cast(SPAN_TYPE)


def window_around(text: Column, m: Column, chars: int) -> Column:
    """The text from ``chars`` before a match to ``chars`` after it."""
    begin = F.greatest(m["start"] - F.lit(chars), F.lit(0))
    return F.substring(text, begin + 1, m["end"] + F.lit(chars) - begin)


def union_spans(first: Column, second: Column) -> Column:
    """``first`` plus the spans of ``second`` whose (type, start, end) is not in it."""

    def new(s: Column) -> Column:
        return ~F.exists(
            first, lambda f: (f["type"] == s["type"]) & (f["start"] == s["start"]) & (f["end"] == s["end"])
        )

    return F.concat(first, F.filter(second, new))


def resolve_overlaps(spans: Column, preferred: Sequence[str]) -> Column:
    """Greedy choice of disjoint spans: preferred types, score, length, start; sorted by start."""

    def rank(s: Column) -> Column:
        return F.struct(
            F.when(s["type"].isin(list(preferred)), 0).otherwise(1).alias("a"),
            (-s["score"]).alias("b"), (s["start"] - s["end"]).alias("c"), s["start"].alias("d"),
            s["type"].alias("e"), s.alias("s"),
        )

    ordered = F.transform(F.array_sort(F.transform(spans, rank)), lambda r: r["s"])

    def keep(chosen: Column, s: Column) -> Column:
        clash = F.exists(chosen, lambda c: (s["start"] < c["end"]) & (s["end"] > c["start"]))
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(s)))

    by_start = lambda s: F.struct(s["start"].alias("p"), s.alias("s"))
    chosen = F.aggregate(ordered, no_spans(), keep)
    picked = F.transform(F.array_sort(F.transform(chosen, by_start)), lambda r: r["s"])
    return F.when(F.size(spans) < 2, spans).otherwise(picked)


def replace_spans(text: Column, spans: Column) -> Column:
    """Replace disjoint spans (sorted by start) by their placeholders."""

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(F.substring(text, begin + 1, s["start"] - begin), s["placeholder"])

    last = F.get(spans, F.size(spans) - 1)["end"]
    tail = F.substring(text, last + 1, F.length(text))
    return F.when(
        F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, piece), ""), tail)
    ).otherwise(text)


def segments(text: Column, boundary: str) -> Column:
    """Trimmed, non-empty pieces between boundaries, with offsets into ``text``."""
    empty = F.array().cast(SEGMENT_TYPE)
    pieces = F.split(text, boundary, -1)
    cuts = F.regexp_extract_all(text, F.lit(boundary), F.lit(0))
    pairs = F.zip_with(
        pieces, cuts, lambda p, c: F.struct(p.alias("piece"), F.coalesce(F.length(c), F.lit(0)).alias("cut"))
    )
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("n"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        piece = pair["piece"]
        trimmed = F.regexp_replace(piece, r"^\s+|\s+$", "")
        lead = F.length(piece) - F.length(F.regexp_replace(piece, r"^\s+", ""))
        begin = acc["pos"] + lead
        row = F.struct(
            acc["n"].alias("segment_index"), trimmed.alias("segment"), begin.alias("start"),
            (begin + F.length(trimmed)).alias("end"),
        )
        filled = F.length(trimmed) > 0
        return F.struct(
            (acc["pos"] + F.length(piece) + pair["cut"]).alias("pos"),
            F.when(filled, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(filled, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(pairs, start, step)["out"]


def segment_texts(text: Column, boundary: str) -> Column:
    """The same pieces without offsets, which needs no running position."""
    trimmed = F.transform(F.split(text, boundary, -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def explode_findings(df: DataFrame, spans_col: str, *keep: str) -> DataFrame:
    """The long findings table: one row per span, no text."""
    return df.select(*keep, F.explode(spans_col).alias("f")).select(*keep, "f.*")
