"""Scalar text functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardline import fixed_values as V
from wardline.functions.lookup import constant


def squeeze(text: Column) -> Column:
    """Whitespace runs to one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def estimate_tokens(text: Column) -> Column:
    """ceil(non-whitespace characters / 4)."""
    chars = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))
    return F.floor((chars + 3) / 4).cast("int")


def strip_markdown(text: Column) -> Column:
    """Drop bold, italic, headers, bullets and code quotes."""
    out = F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1")
    out = F.regexp_replace(out, r"\*([^*]+)\*", "$1")
    out = F.regexp_replace(out, r"(?md)^#+\s+", "")
    out = F.regexp_replace(out, r"(?md)^\s*[*\-•]\s+", "")
    return F.regexp_replace(out, r"`([^`]+)`", "$1")


def extract_numbers(text: Column) -> Column:
    """Numbers as doubles, without currency, percent and thousands signs."""
    clean = F.regexp_replace(F.regexp_replace(text, "[$€£¥%]", ""), r",(\d{3})", "$1")
    found = F.regexp_extract_all(clean, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))
    return F.transform(found, lambda n: n.cast("double"))


def polarity_markers(text: Column) -> Column:
    """ARRAY<STRUCT<category, polarity>> of the categories the text takes a side on.

    Every match of a category's patterns holds one of its stems, so the patterns run on texts with a stem only. A text is lower-cased
    once and its white space squeezed once, where some category needs it.
    """
    side = lambda name, polarity: F.struct(F.lit(name).alias("category"), F.lit(polarity).alias("polarity"))

    def held(low: Column, name: str) -> Column:
        stem = F.lit(False)
        for s in V.POLARITY_STEMS[name]:
            stem = stem | F.contains(low, F.lit(s))
        return stem

    def markers(x: Column) -> Column:
        return F.array_compact(F.array(*(
            F.when(x[name], F.when(x["t"].rlike(negative), side(name, -1)).when(x["t"].rlike(positive), side(name, 1)))
            for name, (negative, positive) in V.POLARITY_PATTERNS.items()
        )))

    def marked(low: Column) -> Column:
        return F.struct(low.alias("t"), *(held(low, name).alias(name) for name in V.POLARITY_PATTERNS))

    def squeezed(x: Column) -> Column:
        some = F.lit(False)
        for name in V.POLARITY_PATTERNS:
            some = some | x[name]
        return x.withField("t", F.when(some, F.regexp_replace(x["t"], r"\s+", " ")))

    each = lambda value, body: F.transform(F.array(value), body)  # evaluates a value once
    return F.flatten(F.transform(F.transform(F.transform(each(F.lower(text), lambda low: low), marked), squeezed), markers))


def character_classes(value: Column) -> Column:
    """How many of lower, upper, digit and other occur in the value."""
    return sum(
        (F.when(value.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")),
        F.lit(0),
    )


def shannon_entropy(value: Column) -> Column:
    """Bits per character."""
    size = F.length(value).cast("double")
    chars = F.split(value, "")

    def part(total: Column, ch: Column) -> Column:
        share = F.size(F.filter(chars, lambda c: c == ch)) / size
        return total - share * F.log2(share)

    return F.when(
        F.length(value) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0).cast("double"), part)
    ).otherwise(F.lit(0.0))


def digits_of(value: Column) -> Column:
    """ARRAY<INT> of the digits in a value, separators ignored."""
    return F.transform(
        F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int")
    )


def luhn_valid(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def verhoeff_valid(value: Column) -> Column:
    """Fold the reversed digits through the two Verhoeff tables."""
    product = constant([x for row in V.VERHOEFF_PRODUCT for x in row], "array<int>")
    permutation = constant([x for row in V.VERHOEFF_PERMUTATION for x in row], "array<int>")
    numbered = F.transform(
        F.reverse(digits_of(value)), lambda d, i: F.struct(d.alias("d"), (i % 8).alias("i"))
    )
    check = F.aggregate(
        numbered, F.lit(0),
        lambda acc, x: F.get(product, acc * 10 + F.get(permutation, x["i"] * 10 + x["d"])),
    )
    return check == 0


def iban_valid(value: Column) -> Column:
    """Move the first four characters to the end, letters to 10..35, remainder mod 97 is 1."""
    plain = F.upper(F.regexp_replace(value, " ", ""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    remainder = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (remainder == 1)


def ipv4_valid(value: Column) -> Column:
    return F.forall(
        F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda part: part.cast("int") <= 255
    )


def dea_valid(value: Column) -> Column:
    """Registration-number checksum: odd digits plus twice the even digits, last digit checks."""
    d = digits_of(F.substring(value, 3, 7))
    odd = F.get(d, F.lit(0)) + F.get(d, F.lit(2)) + F.get(d, F.lit(4))
    even = F.get(d, F.lit(1)) + F.get(d, F.lit(3)) + F.get(d, F.lit(5))
    return (odd + even * 2) % 10 == F.get(d, F.lit(6))
