"""Small documents with every awkward case, and their brute-force counterparts' helpers."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, matches string, spans string"
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, lang, source, None if t is None else len(t), "s", "h", "m", None) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in", "river", "stone", "walks", "under", "bright", "evening", "market", "paper", "quiet", "number", "garden", "letter", "window", "morning", "slowly", "carried", "between"]
    words = [rng.choice(vocabulary) + (rng.choice("abcdefgh") + rng.choice("xyz") if rng.random() < 0.4 else "") for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


@pytest.fixture(scope="session")
def awkward(spark: SparkSession) -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, one word, odd white space."""
    base = prose(1, 120)
    return [
        (0, base, "en", "a"), (1, base, "en", "a"), (1, base, "en", "a"), (2, base.upper(), "en", "b"), (3, base + " tail", "en", "b"),
        (4, None, "en", "a"), (5, "", None, "a"), (6, " \t\n ", "fr", None), (7, "one", "fr", ""), (8, "One", "fr", None), (None, base, "en", "a"), (None, None, None, None),
        (9, prose(2, 6000), "en", "a"), (10, "x" * 70_000, "en", "b"), (11, prose(3, 60) + "\x1c\x85 " + prose(4, 60), "en", "c"), (12, "la " * 300, "es", "c"),
        (13, "a b c d", "en", "a"), (14, "a b c d", "en", "a"), (15, "a b c d e", "en", "a"), (16, prose(5, 100) + " " + prose(6, 50) + " " + prose(5, 100), "en", "a"),
        (17, prose(7, 30) + " " + prose(6, 50) + " " + prose(8, 30), "en", "d"),
    ]


def closure(n: list, links: set[tuple]) -> dict:
    """Smallest member reachable, by plain propagation."""
    root = {i: i for i in n}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root
