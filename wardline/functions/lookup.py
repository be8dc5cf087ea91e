"""Column helpers for small fixed tables and ordered rules."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import utils
from pyspark.sql import Column, DataFrame, functions as F


def literal_map(values: Mapping[str, object]) -> Column:
    """A constant MAP column; folded once by Catalyst."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def constant(value: object, kind: str) -> Column:
    """A constant array or struct as one small expression; Catalyst folds it to a literal."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def first_match(cases: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """One flat CASE WHEN over ``(condition, value)`` in order."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)


def look_up(values: Mapping[str, object], key: Column, default: object = None) -> Column:
    """``values[key]`` as a flat CASE expression, which stays inside whole-stage codegen."""
    return first_match([(key == name, F.lit(value)) for name, value in values.items()], F.lit(default))


def fence(df: DataFrame, inputs: Sequence[str] = ()) -> DataFrame:
    """Keep later filters and projections from being copied into a long chain of derived columns.

    Catalyst pushes a filter through projections by writing every alias out, which multiplies a long derivation many times over.
    Derived columns are therefore packed and unpacked by a generator, which is as far as conditions on them are pushed. Columns
    named in ``inputs`` are handed through untouched: conditions on them reach the scan, also through several fences.
    """
    inputs = [c for c in df.columns if c in inputs]
    derived = [c for c in df.columns if c not in inputs]
    if not derived:
        return df
    return df.select(*inputs, F.inline_outer(F.array(F.struct(*derived))))


def thin_fence(df: DataFrame, inputs: Sequence[str] = ()) -> DataFrame:
    """The same for rows of which few columns are taken and on which nothing filters, as when they are written.

    A generator of one row stands between the steps and all columns are handed through it, so that those nobody reads are neither
    derived nor copied from step to step. Conditions on derived columns would be copied: ``fence`` is for those.
    """
    return df.withColumn("_one", F.explode(F.array(F.lit(0)))).drop("_one")


@contextmanager
def plain_expressions() -> Iterator[None]:
    """Build expressions without recording a call site for each.

    With debugging on (``spark.python.sql.dataFrameDebugging.enabled``, the default) every function call asks the JVM several times; a
    flow of thousands of expressions then takes most of its planning for that. The user's own calls keep their call sites.
    """
    before = getattr(utils, "_enable_debugging_cache", None)
    utils._enable_debugging_cache = False
    try:
        yield
    finally:
        utils._enable_debugging_cache = before


def one_of(col: Column, values: Sequence[str]) -> Column:
    return col.isin(list(values))


def labels_where(cases: Sequence[tuple[Column, str]]) -> Column:
    """Array of the labels whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(label)) for condition, label in cases]))


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """True when any word occurs as a substring of an already lower-cased text."""
    table = constant([w.lower() for w in words], "array<string>")
    # the text enters as an element: inside the inner function it would be lower-cased again for every word
    return F.coalesce(F.exists(F.array(lowered), lambda t: F.exists(table, lambda w: F.contains(t, w))), F.lit(False))


def words_found(lowered: Column, words: Sequence[str], prefix: str = "") -> Column:
    """Array of ``prefix + word`` for the words that occur in a lower-cased text."""
    found = F.filter(constant(list(words), "array<string>"), lambda w: F.contains(lowered, F.lower(w)))
    return F.transform(found, lambda w: F.concat(F.lit(prefix), w))
