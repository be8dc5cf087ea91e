"""Exact copies against brute force, with a content hash that collides too."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import Column, SparkSession, functions as F

from tests.llm.conftest import make_docs, prose
from wardline.llm import exact_copies

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def norm(text: str | None) -> str:
    return WHITE.sub(" ", text or "")


def weak(text: Column) -> Column:
    """Two bits of a hash: nearly every group holds different texts."""
    return F.xxhash64(text) % 4


def wanted(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        groups[norm(t)].append((i is None, i or 0, k, i))
    out = []
    for k, (i, t, *_) in enumerate(rows):
        g = groups[norm(t)]
        out.append((i, min(g)[3], len(g), min(g)[2] == k, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def case(awkward: list[tuple]) -> list[tuple]:
    base = prose(1, 120)
    rows = awkward + [(60 + k, base.replace(" ", "\t\r\n"[k % 3] * (1 + k % 2)), "en", "z") for k in range(40)]
    # other white space is text; leading and trailing runs become one space, they do not vanish
    return rows + [(200, "a b", "", ""), (201, "a b", "", ""), (202, " a b", "", ""), (203, "  a\n\nb", "", ""), (204, "a b ", "", ""), (205, "a b\t", "", ""), (205, "a b", "", ""), (None, "only null", "", ""), (None, "only  null", "", "")]


@pytest.mark.parametrize("digest", [exact_copies.hash128, weak])
@pytest.mark.parametrize("sent", [200_000, 1])
def test_copies(spark: SparkSession, awkward: list[tuple], digest: exact_copies.Digest, sent: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(exact_copies, "SENT", sent)
    rows = case(awkward)
    got = [tuple(r) for r in exact_copies.copies(make_docs(spark, rows).repartition(5), digest).collect()]
    # which of equal rows is kept is open, how many are is not
    assert sorted(got, key=str) == sorted(wanted(rows), key=str)


@pytest.mark.parametrize("digest", [exact_copies.hash128, weak])
def test_without_copies(spark: SparkSession, awkward: list[tuple], digest: exact_copies.Digest) -> None:
    rows = case(awkward)
    docs = make_docs(spark, rows)
    got = exact_copies.without_copies(docs, digest)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], norm(r["text"])) for r in got.collect()), key=str)
    assert kept == sorted(((i, norm(t)) for (i, t, *_), w in zip(rows, wanted(rows), strict=True) if w[3]), key=str)


def test_empty(spark: SparkSession) -> None:
    assert exact_copies.copies(make_docs(spark, [])).count() == 0


def test_no_python(spark: SparkSession, awkward: list[tuple]) -> None:
    plan = exact_copies.copies(make_docs(spark, awkward))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
