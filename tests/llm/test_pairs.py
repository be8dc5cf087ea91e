"""Near-duplicate joins and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import SparkSession

from tests.llm.conftest import ASCII_WORD, closure, make_docs, prose
from wardline.llm import embedding_join, ngram_join, suffix_trees, textops
from wardline.llm.components import components


def lowered(text: str | None) -> list[str]:
    return ASCII_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text: str | None) -> frozenset:
    w = lowered(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def family(seed: int, copies: int, n: int = 80, most: int = 6) -> list[str]:
    rng, words = random.Random(seed), prose(seed, n).split()
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("hot", "crowd"), [(50_000, 32), (3, 2), (3, 6)])
def test_ngram_join(spark: SparkSession, awkward: list[tuple], hot: int, crowd: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = list(awkward) + [(100 + 50 * f + k, t, "en", "z") for f in range(4) for k, t in enumerate(family(f, 12))]
    # short texts of one very common line and a few words of their own
    rows += [(500 + k, "this line is part of every page here " + prose(900 + k, 8), "en", "z") for k in range(40)]
    check_join(ngram_join.join(make_docs(spark, rows)).collect(), rows)


def wanted_components(rows: list[tuple]) -> tuple[list[frozenset], list[int]]:
    """Sets of all rows, and for each row the first one reachable; rows are nodes, whatever their ids."""
    sets = [shingles(t) for _, t, *_ in rows]
    links = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    root = closure(list(range(len(rows))), links)
    return sets, [root[k] for k in range(len(rows))]


def check_join(got: list, rows: list[tuple]) -> None:
    sets, root = wanted_components(rows)
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in root}
    want = sorted(((rows[k][0], len(sets[k]), least[root[k]] if sets[k] else rows[k][0]) for k in range(len(rows))), key=str)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def changed(text: str, *places: int) -> str:
    words = text.split()
    for k in places:
        words[k] = f"other{k}"
    return " ".join(words)


def id_cases() -> list[tuple]:
    a, b, c = prose(81, 60), prose(82, 60), prose(83, 60)
    # 1 ~ null ~ 2: the null row bridges, its ends are below the threshold
    rows = [(1, changed(a, 0), "en", "z"), (None, a, "en", "z"), (2, changed(a, 59), "en", "z")]
    middle = changed(prose(84, 60), 3)
    rows += [(11, changed(middle, 20), "en", "z"), (None, middle, "en", "z"), (None, middle, "en", "z"), (12, changed(middle, 50), "en", "z")]
    # two different texts with one id, each with a near copy; a repeated id whose other text is unique
    rows += [(21, b, "en", "z"), (21, c, "en", "z"), (22, changed(b, 59), "en", "z"), (23, changed(c, 59), "en", "z"), (24, changed(b, 0), "en", "z"), (24, prose(85, 60), "en", "z")]
    # near copies without any id, equal rows, rows without words
    d = prose(86, 60)
    rows += [(None, d, "en", "z"), (None, changed(d, 59), "en", "z"), (31, d, "en", "z"), (31, d, "en", "z"), (None, prose(87, 60), "en", "z"), (None, changed(prose(87, 60), 1), "en", "z")]
    return rows + [(41, "", "en", "z"), (41, "", "en", "z"), (41, " ", "en", "z"), (None, None, "en", "z"), (42, None, "en", "z")]


@pytest.mark.parametrize(("hot", "crowd", "few"), [(50_000, 32, 500_000), (3, 2, 0)])
def test_ngram_join_ids(spark: SparkSession, hot: int, crowd: int, few: int, monkeypatch: pytest.MonkeyPatch) -> None:
    """Null ids bridge, repeated ids with different texts are nodes of their own."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "BROADCAST_REQUESTS", few)
    rows = id_cases()
    got = ngram_join.join(make_docs(spark, rows)).collect()
    check_join(got, rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (1, 2, 11, 12, 22, 23)} == {1: 1, 2: 1, 11: 11, 12: 11, 22: 21, 23: 21}


def test_one_of_each(spark: SparkSession) -> None:
    rows = id_cases() + [(k, prose(700 + k, 50), "en", "z") for k in range(60, 70)]
    docs = make_docs(spark, rows)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    sets, root = wanted_components(rows)
    at = {(i, t): k for k, (i, t, *_) in enumerate(rows)}
    # one of each group, of least id where there is one
    kept = sorted(root[at[x]] for x in left if sets[at[x]])
    assert kept == sorted({r for k, r in enumerate(root) if sets[k]})
    for i, t in left:
        if sets[at[i, t]]:
            ids = [rows[k][0] for k in range(len(rows)) if root[k] == root[at[i, t]] and rows[k][0] is not None]
            assert i == min(ids, default=None)
    assert sorted(((i, t) for i, t in left if not shingles(t)), key=str) == sorted({(i, t) for i, t, *_ in rows if not shingles(t)}, key=str)


def test_shared_streams() -> None:
    """Runs cut anywhere into batches give what one batch gives."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.randint(0, 40), rng.randint(1, 3), rng.randint(0, 4), rng.randint(1, 4), 2 if k % 7 == 0 else 1) for k in range(200))
    rows += [(t, 1, 1, 1, 1) for t in range(50, 60)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[1] << 24 | r[4] << 8 | r[3] for r in part], pa.int64())], names=["token", "h", "meta"])
    seen = lambda parts: sorted(tuple(x.values()) for b in ngram_join._shared(iter(parts)) for x in b.to_pylist())
    whole = seen([batch(rows)])
    distinct = {}
    for t, n, h, l, s in rows:
        distinct.setdefault((t, n, h), (l, s))
    by = Counter(t for t, *_ in distinct)
    leads = {}
    for t, n, h in sorted(distinct):
        leads.setdefault(t, (h, n))
    assert {(t, h, n) for t, h, n, *_ in whole} == {(t, h, n) for (t, n, h), (_, s) in distinct.items() if by[t] > 1 or s > 1}
    assert all(leads[t] == (lh, ln) for t, _, _, _, lh, ln in whole)
    for size in (1, 2, 3, 7):
        assert seen([batch(rows[a : a + size]) for a in range(0, len(rows), size)]) == whole


def test_ngram_join_stars(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Chains of near copies, where many pairs are left after the leaders."""
    rng, words, rows = random.Random(3), prose(50, 100).split(), []
    for k in range(60):
        rows.append((k, " ".join(words), "en", "a"))
        words[rng.randrange(100)] = f"step{k}"
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and 100 * len(shingles(a[1]) & shingles(b[1])) >= 80 * len(shingles(a[1]) | shingles(b[1]))}
    root = closure(list(range(60)), want)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(make_docs(spark, rows)).collect()} == root


def test_prefix_property() -> None:
    """Two similar sets share the smaller wanted number within their prefixes, whatever the order's counts."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        counts = rng.integers(0, 50, 64).astype(np.int64)
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 62, 2).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        (p, _, l), (q, _, m) = (ngram_join.prefix(s, counts, 5.0, 80) for s in (a, b))
        assert len(np.intersect1d(p, q)) >= min(l, m)


def test_empty_tables(spark: SparkSession) -> None:
    empty = make_docs(spark, [])
    assert ngram_join.join(empty).count() == 0
    assert suffix_trees.remove_repeats(empty).count() == 0
    assert embedding_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("group", [20_000, 2])
def test_suffix_trees(spark: SparkSession, awkward: list[tuple], group: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(suffix_trees, "GROUP", group)
    monkeypatch.setattr(suffix_trees, "TREE_ROWS", 3)
    rows = awkward + [(200 + k, prose(300 + k, 20) + " " + prose(6, 50) + " " + prose(400 + k, 5 * k), "en", "z") for k in range(8)]
    rows += [(300, prose(70, 34), "en", "z"), (301, prose(70, 34), "en", "z"), (302, prose(71, 35), "en", "z"), (303, "x " + prose(71, 35), "en", "z")]
    texts = [ASCII_WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    want = []
    for (i, *_), w in zip(rows, texts, strict=True):
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in suffix_trees.remove_repeats(make_docs(spark, rows)).drop("kept").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_least_grams() -> None:
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 8, 28):
        g = rng.integers(0, 9, 200).astype(np.uint64)
        want = [s + int(np.argmin(g[s : s + width])) for s in range(len(g) - width + 1)]
        assert suffix_trees.least_grams(g, width).tolist() == want


def test_embedding_join(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(embedding_join, "CELL", 40)
    rng, rows = np.random.default_rng(2), []
    for _c in range(12):
        centre = rng.standard_normal(24)
        rows += [(centre + rng.standard_normal(24) * s).astype(np.float32).tolist() for s in rng.choice([0.0, 0.2, 0.35, 0.6], 25)]
    rows += [rng.standard_normal(24).astype(np.float32).tolist() for _ in range(100)]
    table = [(k, r) for k, r in enumerate(rows)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0] + [None] * 23), (904, [float("inf")] * 24), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (5, rows[5]), (None, rows[6]), (None, rows[130])]
    # one id for two vectors, each with a near copy of its own; a null id that ties two others together
    tie = rng.standard_normal(24)
    turn = lambda x, angle: math.cos(angle) * x / np.linalg.norm(x) + math.sin(angle) * np.roll(np.eye(24)[0], 5)
    tie = tie - tie[5] * np.eye(24)[5]
    table += [(950, rng.standard_normal(24).astype(np.float32).tolist()), (950, rng.standard_normal(24).astype(np.float32).tolist())]
    table += [(951, [x + 0.01 for x in table[-2][1]]), (952, [x + 0.01 for x in table[-1][1]])]
    table += [(960, turn(tie, -0.4).tolist()), (None, turn(tie, 0.0).tolist()), (961, turn(tie, 0.4).tolist()), (None, turn(rng.standard_normal(24), 0.1).tolist())]
    got = embedding_join.near_duplicates(spark.createDataFrame([(i, v, 7, "x") for i, v in table], "vec_id long, embedding array<float>, label int, cell string"))
    fine = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(table) if v and None not in v and np.isfinite(v).all() and any(v)]
    cos = lambda x, y: len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9
    pairs = {(a[0], b[0]) for a in fine for b in fine if a[0] != b[0] and cos(a[2], b[2])}
    known = {k: i for k, i, _ in fine}
    root = closure([k for k, *_ in fine], pairs)
    ids = {}
    for k, r in root.items():
        ids.setdefault(r, []).append(known[k])
    want = []
    for k, (i, _) in enumerate(table):
        members = [x for x in ids[root[k]] if x is not None] if k in root else [i]
        low = min(members) if members else None
        want.append((i, sum(a == k for a, _ in pairs), low, i is not None and i == low))
    got = got.collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert [r["n_links"] for r in got if r["vec_id"] == 950] == [1, 1] and {r["component_id"] for r in got if r["vec_id"] in (960, 961)} == {960}


def test_cells_are_complete() -> None:
    """Every pair within the radius meets in the home cell of either side."""
    rng = np.random.default_rng(4)
    points, radius = np.rint(rng.standard_normal((400, 4)) * 1e4), 6e3
    who, cell, home = embedding_join.cells(points, embedding_join.grow(points[:50], 4), radius)
    homes = {int(w): int(c) for w, c, h in zip(who, cell, home, strict=True) if h}
    assert len(homes) == 400
    visits = set(zip(who.tolist(), cell.tolist(), strict=True))
    near = np.argwhere(((points[:, None] - points[None]) ** 2).sum(axis=2) <= radius**2)
    assert all((int(a), homes[int(b)]) in visits for a, b in near)


def test_components(spark: SparkSession) -> None:
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert got == closure(nodes, {(a, b) for a, b in links if a != b})


def test_words() -> None:
    texts = ["", "a  b\tA", None, "x" * 3_000_000 + " end", "été   \x1c", " lead", "trail "]
    import pyarrow as pa

    got = []
    for chunk in textops.chunks(pa.array(texts)):
        w = textops.words(chunk, lower=True)
        got += [(chunk.first + int(r), bytes(chunk.data[a:b]).decode()) for r, a, b in zip(w.row, w.start, w.end, strict=True)]
        assert len(set(zip((textops.LOWER[chunk.data].tobytes()[a:b] for a, b in zip(w.start, w.end, strict=True)), w.hash.tolist(), strict=True))) == len(set(w.hash.tolist()))
    assert got == [(k, x) for k, t in enumerate(texts) for x in ASCII_WORD.findall(t or "")]


def test_within_reach_keeps_all_similar_pairs(spark: SparkSession) -> None:
    """The bound on prefix matches never leaves out a similar pair, whatever the order."""
    rng, rows = np.random.default_rng(11), []
    for _ in range(400):
        counts = rng.integers(0, 30, 64).astype(np.int64)
        a = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 80))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 62, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            (p, _, l), (q, _, m) = (ngram_join.prefix(s, counts, 3.0, 80) for s in (a, b))
            rows.append((len(a), len(b), l, m, len(np.intersect1d(p, q))))
    df = spark.createDataFrame(rows, "n long, n_y long, l long, l_y long, matches long")
    c = df.columns
    assert rows and df.where(~ngram_join.within_reach(df[c[4]], (df.n, df.n_y), (df.l, df.l_y), 80)).count() == 0
