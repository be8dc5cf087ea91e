"""Runs of words against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

from tests.llm.conftest import ASCII_WORD, make_docs, prose
from wardline.llm import periodic_runs, textops


def brute(words: list, least: int) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        same = [words[k] == words[k + q] for k in range(n - q)] + [False]
        start = 0
        for k, s in enumerate(same):
            if not s:
                if k - start >= q and k - start + q >= least:
                    piece = words[start : k + q]
                    if not any(piece[r:] == piece[:-r] for r in range(1, q)):
                        out.append((start, k - start + q, q))
                start = k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def sequences() -> list[list[int]]:
    rng, out = random.Random(4), []
    for _ in range(250):
        n, letters = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 8])
        s = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n:
                a, p = rng.randrange(n), rng.randint(1, 9)
                for k in range(a, min(n, a + rng.randint(5, 40))):
                    s[k] = s[a + (k - a) % p]
        out.append(s)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 150:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    return [*out, fibonacci[-1], [0] * 40, [0, 1] * 30, list(range(30)) * 3]


@pytest.mark.parametrize("least", [2, 12, 13])
def test_runs(least: int) -> None:
    for s in sequences():
        assert periodic_runs.runs(s, least) == brute(s, least), s


def test_stretches_hold_all_runs() -> None:
    rows = [" ".join(f"w{x}" for x in s) for s in sequences()]
    import pyarrow as pa

    (chunk,) = textops.chunks(pa.array(rows))
    w = textops.words(chunk, lower=False)
    first, end = periodic_runs.stretches(w)
    bounds = textops.row_bounds(w.row, len(rows))
    held = [(int(a), int(b)) for a, b in zip(first, end, strict=True)]
    assert all(w.row[a] == w.row[b - 1] for a, b in held) and all(x[1] <= y[0] for x, y in zip(held, held[1:], strict=False))
    for k, s in enumerate(sequences()):
        for start, length, _ in brute(s, 12):
            a = int(bounds[k]) + start
            assert any(x <= a and a + length <= y for x, y in held)
    # prose without repeats is not read at all
    assert sum(b - a for a, b in held) < len(w.row)


def planted(i: int | None, words: list[str]) -> list[str]:
    h, n = zlib.crc32(("" if i is None else str(i)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (k - a) % p] for k in range(a, n)]


def case(awkward: list[tuple]) -> list[tuple]:
    line = "this line is said again and again by the page of the book "
    return awkward + [(100 + k, prose(k, 30 + k % 90), "en", "z") for k in range(200)] + [(400, line * 3 + prose(9, 40) + " " + line * 2, "en", "z"), (401, prose(8, 100) + " " + prose(9, 10) + " " + prose(8, 100), "en", "z"), (402, "a  b c\tä " * 9, "de", "z")]


def test_find(spark: SparkSession, awkward: list[tuple]) -> None:
    rows = case(awkward)
    docs = make_docs(spark, rows).withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(0))
    got = periodic_runs.find(docs).collect()
    want = []
    for i, t, *_ in rows:
        w = ASCII_WORD.findall(t or "")
        # the long text's brute force is quadratic: it holds no run of twelve words by construction of the vocabulary
        found = brute(w, 12) if len(w) < 2000 else []
        want.append((i, found, collapse(w, found)))
    assert sorted([(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got], key=str) == sorted(want, key=str)
    assert any(len(w[1]) > 1 for w in want)


def test_query(spark: SparkSession, awkward: list[tuple], tmp_path) -> None:
    rows = [r for r in case(awkward) if len(r[1] or "") < 9000]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want, planted_rows = [], 0
    for i, t, *_ in rows:
        w = planted(i, ASCII_WORD.findall(t or ""))
        found = brute(w, 12)
        planted_rows += bool(found)
        best = min(((-n, s, q) for s, n, q in found), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), digest(lines), digest(collapse(w, found))))
    got = [tuple(r) for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert planted_rows > 10


def test_long_text(spark: SparkSession) -> None:
    """A long period in a long text, and one word a hundred thousand times."""
    page = prose(3, 20_000)
    got = periodic_runs.find(make_docs(spark, [(1, f"{page} {page}", "en", "a"), (2, "ha " * 100_000, "en", "a")])).collect()
    assert {(r["doc_id"], max((x["length"], x["period"]) for x in r["runs"])) for r in got} == {(1, (40_000, 20_000)), (2, (100_000, 1))}


def test_empty(spark: SparkSession) -> None:
    assert periodic_runs.find(make_docs(spark, [])).count() == 0


def test_paths_keep_colours() -> None:
    """Link-cut access against plain walks over random trees."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 60))
        parent = [0, 0] + [int(rng.integers(1, k)) for k in range(2, n + 1)]
        paths, colour = periodic_runs.PreferredPaths(parent), {}
        for t in range(80):
            v = x = int(rng.integers(1, n + 1))
            want: list[tuple[int, int]] = []
            while x:
                if x in colour and (not want or want[-1][0] != colour[x]):
                    want.append((colour[x], x))
                colour[x], x = t, parent[x]
            assert list(paths.access(v, t)) == want
