"""One fast pass that tells which rules a text may match.

Running dozens of case-insensitive patterns over every text in the JVM costs about a
microsecond per character.  Arrow's RE2 runs all of them as one automaton at tens of
megabytes per second and core, so a vectorised pass marks the few texts and rules worth a
closer look; the JVM then applies the exact pattern to those only.  The pass is a superset:
lookarounds, word boundaries and line anchors are left out of it.

Flows that scan several texts take all their bits in one ``withColumns`` at the start: Spark
merges projections to batch Python functions, and one batch at the bottom of the plan keeps
the native steps above it from being copied into each other.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

BITS = 62
#: Unicode classes as the exact patterns read them, for the prefilter's engine.
WIDE = {"s": r"\s\v\p{Z}\x{85}", "w": r"\w\p{L}\p{M}\p{N}\p{Pc}", "d": r"\d\p{Nd}"}
_LOOKAROUND = re.compile(r"\(\?<?[=!](?:[^()\\]|\\.|\[[^\]]*\])*\)")


def superset(pattern: str) -> str:
    """A pattern for the linear-time engine that matches wherever ``pattern`` does."""
    out, in_class, negated, i = [], False, False, 0
    text = _LOOKAROUND.sub("", pattern)
    while i < len(text):
        c = text[i]
        if c == "\\":
            pair = text[i:i + 2]
            if pair[1:] in WIDE and not (in_class and negated):  # fewer exclusions match more
                out.append(WIDE[pair[1:]] if in_class else f"[{WIDE[pair[1:]]}]")
            elif pair != r"\b" or in_class:
                out.append(pair)
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class, negated = True, text[i + 1:i + 2] == "^"
            if text[i + 1:i + 2] in ("]", "^"):
                out.append(c)
                i, c = i + 1, text[i + 1]
        elif c in "^$":
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def _supported(pattern: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
        return True
    except pa.ArrowInvalid:
        return False


def _joined(patterns: Sequence[str]) -> list[str]:
    """Alternations that the engine takes: halves where it finds one too large."""
    one = "|".join(f"(?:{p})" for p in patterns)
    if len(patterns) < 2 or _supported(one):
        return [one]
    half = len(patterns) // 2
    return _joined(patterns[:half]) + _joined(patterns[half:])


def rule_bits(text: Column, patterns: Sequence[str], flags: str = "") -> Column:
    """BIGINT whose bit ``i % 62`` is set when rule ``i`` may match; 0 for most texts."""
    each = [flags + superset(p) for p in patterns]
    sure = [p if _supported(p) else "" for p in each]  # unknown to the engine: always look closer
    every = _joined(sure)

    @F.arrow_udf("bigint")
    def bits(column: pa.Array) -> pa.Array:
        column = pc.fill_null(column, "")
        hit = pc.match_substring_regex(column, every[0])
        for one in every[1:]:
            hit = pc.or_(hit, pc.match_substring_regex(column, one))
        some = column.filter(hit)
        marks = [0] * len(some)
        for i, p in enumerate(sure):
            one = 1 << (i % BITS)
            for at in pc.indices_nonzero(pc.match_substring_regex(some, p)).to_pylist():
                marks[at] |= one
        return pc.replace_with_mask(pa.array([0] * len(column), pa.int64()), hit, pa.array(marks, pa.int64()))

    return bits(text)


def may_match(bits: Column, rule: Column) -> Column:
    """Whether the bit of rule number ``rule`` is set."""
    return F.bit_get(bits, F.pmod(rule, F.lit(BITS))) == 1
