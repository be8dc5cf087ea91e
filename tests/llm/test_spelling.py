"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import SparkSession

from tests.llm.conftest import make_docs, prose
from wardline.llm import spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counted(rows: list[tuple]) -> dict[str, int]:
    total: Counter = Counter()
    for i, text, *_ in rows:
        for run in LETTERS.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def wanted(words: dict[str, int]) -> list[tuple]:
    form, count = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        count[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, count[w], words.get(form[w])))
    return sorted(out)


def edited(rng: random.Random, word: str) -> str:
    k, c = rng.randrange(len(word) + 1), rng.choice("abcé÷")
    return rng.choice([word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :]])


def dictionary() -> dict[str, int]:
    """Crowded words: few letters, many edits of edits, counts that make chains."""
    rng, words = random.Random(8), {"".join(random.Random(k).choices("abc", k=5 + k % 4)) for k in range(60)}
    for _ in range(3):
        words |= {edited(rng, w) for w in sorted(words)}
    long = "x" * 3000
    words |= {long, long + "y", "y" + long, long[:1500] + "z" + long[1501:], "étéét", "éteét", "ÀÀÀÀÀ"}
    return {w: rng.choice([3, 6, 12, 25, 50, 100, 200]) for w in sorted(words) if len(w) >= 5}


@pytest.mark.parametrize("pairs", [4_000_000, 30, 1])
def test_variants(spark: SparkSession, pairs: int) -> None:
    words = dictionary()
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), pairs=pairs).collect()
    want = wanted(words)
    assert sorted(tuple(r) for r in got) == want
    # chains of several steps are among them
    steps = {w: f for w, f, *_ in want}
    assert any(steps.get(steps.get(f)) for f in steps.values() if f)


def case(awkward: list[tuple]) -> list[tuple]:
    rng, words = random.Random(5), sorted({w for w in LETTERS.findall(prose(1, 400)) if len(w) > 4})
    line = lambda: " ".join(rng.choice(["%s", "%s,", "%s's", "Ünser%s", "%s÷", "%s9x"]) % (edited(rng, w) if rng.random() < 0.3 else w) for w in rng.choices(words, k=60))
    return awkward + [(50 + k, line(), "en", "z") for k in range(250)]


@pytest.mark.parametrize("held", [500_000, 7])
def test_query(spark: SparkSession, awkward: list[tuple], tmp_path, held: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(spelling, "HELD", held)
    rows = case(awkward)
    make_docs(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = spelling.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = wanted(counted(rows))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[1] is not None for w in want) > 5


def test_vocabulary_without_noise(spark: SparkSession, awkward: list[tuple]) -> None:
    total = Counter(lower(w) for _, t, *_ in awkward for w in LETTERS.findall(t or ""))
    got = spelling.vocabulary(make_docs(spark, awkward), 1, 1).collect()
    assert {r["word"]: r["n"] for r in got} == total


def test_empty(spark: SparkSession) -> None:
    assert spelling.variants(spelling.vocabulary(make_docs(spark, []), noise=spelling.deleted)).count() == 0


def test_deleted_letter() -> None:
    hit = next(f"w{'o' * k}é" for k in range(1, 5000) if zlib.crc32(f"7:w{'o' * k}é".encode()) % 97 == 0)
    assert len(spelling.deleted("7", hit.encode()).decode()) == len(hit) - 1
