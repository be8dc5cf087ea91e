"""Scoring, personal data, language, quality and leaks: brute force, planted cases and held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import SparkSession, functions as F

import corpus_pipeline
from tests.llm.conftest import ASCII_WORD, make_docs, prose
from wardline.llm import decontaminate, deobfuscate, language, lattice, quality


def crc(i: int | None) -> int:
    return zlib.crc32(b"" if i is None else str(i).encode())


# --- lattice -----------------------------------------------------------------------------------------------------

PIECES = [(b" ", 0.2), (b" a", 0.5), (b"a", 0.3), (b"b", 0.4), (b"ab", 0.6), (b" ab", 0.1), (b"ba", 0.2), (b"a", 0.1)]


def splits(data: bytes, weights: dict[bytes, float]) -> float:
    """Sum over all segmentations, by trying every set of cuts."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(data) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(data)]
        total += math.prod(weights.get(data[x:y], 0.0) for x, y in itertools.pairwise(at))
    return total


def test_forward_is_the_sum_over_segmentations() -> None:
    v = lattice.vocabulary_from(PIECES, 0.5)
    norm = 0.5 + sum(w for _, w in PIECES)
    weights: dict[bytes, float] = {}
    for p, w in PIECES:
        weights[p] = weights.get(p, 0.0) + w / norm
    words = [b"a", b"b", b"ab", b"aab", b"abba", b"bababab", b"abab"]
    assert np.allclose(np.exp(lattice.word_logps(v, words)), [splits(b" " + w, weights) for w in words])
    # expected counts: every use of a piece, weighted by its segmentation's share
    expected, order = lattice.expected_counts(v, words, np.arange(1.0, 8.0)), {}
    _, down = lattice.textops.powers(1)
    for p in weights:
        h = lattice.piece_hash(lattice._cumulated(np.frombuffer(p, np.uint8)), down, 0, len(p))[0]
        order[p] = int(np.searchsorted(v.hashes, h))
    for p, at in order.items():
        want = 0.0
        for n, w in enumerate(words, 1):
            data, total = b" " + w, splits(b" " + w, weights)
            for cuts in itertools.product([False, True], repeat=len(data) - 1):
                ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(data)]
                parts = [data[x:y] for x, y in itertools.pairwise(ends)]
                want += n * parts.count(p) * math.prod(weights.get(x, 0.0) for x in parts) / total
        assert math.isclose(expected[at], want, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("frequent", [1 << 18, 5])
def test_score(spark: SparkSession, awkward: list[tuple], frequent: int, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    got = lattice.score(make_docs(spark, awkward)).collect()
    tokens = [ASCII_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t, *_ in awkward]
    held = [crc(i) % 5 == 1 for i, *_ in awkward]
    counts = Counter(x for w, h in zip(tokens, held, strict=True) if not h for x in [*w, None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for (i, *_), w, h in zip(awkward, tokens, held, strict=True):
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in [*w, None])
        want.append((i, h, len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), total, base))
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    want.sort(key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(g[6] < 0 for g in got)
    # the same scores from the model itself, word by word
    v = lattice.vocabulary()
    used = Counter(x.encode() for w, h in zip(tokens, held, strict=True) if not h for x in w)
    v = lattice.adapted(v, lattice.expected_counts(v, list(used), np.array(list(used.values()), float)), float(counts[None]))
    by_doc = {len(w): (lattice.word_logps(v, [x.encode() for x in w]).sum() + v.end) / math.log(10) for w in tokens if w}
    for g in got:
        if g[2] > 1 and sum(len(w) == g[2] - 1 for w in tokens) == 1:
            assert math.isclose(g[6], by_doc[g[2] - 1], rel_tol=1e-9)


def test_score_empty(spark: SparkSession) -> None:
    assert lattice.score(make_docs(spark, [])).count() == 0


# --- personal data -----------------------------------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    def fine(kind: str, s: str) -> bool:
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            odd = [int(d) for d in digits[::-1]]
            return 16 <= len(odd) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return {k: [m.span() for m in p.finditer(text) if fine(k, m.group())] for k, p in BASE.items()}


def test_plain_spans() -> None:
    rng = random.Random(1)
    parts = ["a@b.c", "x.y+z@mail.example.org", "@", "1.2.3.4", "300.1.2.3", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+", "1", ".", "-", " ", "_", "é", "999", "+49 30 1234567", "a@b", "0001.02.3.255", "4111-1111 1111-1111"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert deobfuscate.detect(text) == plain(text), text


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("write to maria.lopez (at) posta (dot) example today", "email", "maria.lopez (at) posta (dot) example"),
    ("write maria at posta dot example dot org today", "email", "maria at posta dot example dot org"),
    ("mail: rоsa@example.com!", "email", "rоsa@example.com"),
    ("mail: rosa＠example．com!", "email", "rosa＠example．com"),
    ("card ５５００ ００００ ００００ ０００４.", "card", "５５００ ００００ ００００ ０００４"),
    ("card 5500​0000​0000​0004.", "card", "5500​0000​0000​0004"),
    ("ring plus three four nine one one two three four five six seven now", "phone", "plus three four nine one one two three four five six seven"),
    ("host 10 dot 20 dot 30 dot 40 is up", "ip", "10 dot 20 dot 30 dot 40"),
    ("é" * 50 + " nina[at]web.example.de", "email", "nina[at]web.example.de"),
])
def test_disguises(text: str, kind: str, found: str) -> None:
    base, added = deobfuscate.find(text)
    assert [text[a:b] for a, b in added[kind]] == [found]
    assert found not in deobfuscate.redacted(text, {k: base[k] + added[k] for k in deobfuscate.KINDS})


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("write to maria.lopez at example.com today", "email", "maria.lopez at example.com"),
    ("write maria dot lopez at example.com today", "email", "maria dot lopez at example.com"),
    ("write maria dot lopez@example.com today", "email", "maria dot lopez@example.com"),
    ("card 4111 one one one one 1111 1111.", "card", "4111 one one one one 1111 1111"),
    ("ring +49 three zero 1234567 now", "phone", "+49 three zero 1234567"),
])
def test_partly_spelled(text: str, kind: str, found: str) -> None:
    _, added = deobfuscate.find(text)
    assert [text[a:b] for a, b in added[kind]] == [found]
    assert deobfuscate.pc.match_substring_regex(deobfuscate.pa.array([text]), deobfuscate.BATCH_SIGNS)[0].as_py()


def test_gates_hold_all_that_transducers_change() -> None:
    rng = random.Random(9)
    parts = ["at", "dot", "point", "punto", "arroba", "(", ")", "[", "]", "@", ".", "-", ",", " ", " ", " ", "\t", "\u2003", "maria", "lopez", "example", "com", "org", "one", "Six", "oh", "plus", "12", "4111", "+", "é"]
    changed = 0
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 14))) for _ in range(40_000)]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randint(3, 9))) for _ in range(20_000)]
    batch = deobfuscate.pc.match_substring_regex(deobfuscate.pa.array(texts), deobfuscate.BATCH_SIGNS).to_pylist()
    for text, wide in zip(texts, batch, strict=True):
        if any(deobfuscate.rewrite(text, *step).text != text for step in deobfuscate.TRANSDUCERS):
            changed += 1
            assert wide and (deobfuscate.GLYPHS.search(text) or deobfuscate.SIGNS.search(text)), text
        assert wide or not any(deobfuscate.detect(text).values()), text
    assert changed > 1000
    for text in ("look at example.com for more", "we met at noon. one dot, two points"):
        assert not any(deobfuscate.find(text)[1].values())


def test_clean_texts_stay_clean() -> None:
    for text in [prose(1, 500), "we meet at the dot of noon", "look at page one, two or three of four", "La maison est à Paris. Él vive aquí, señor; über alles größer.", "at dot com", "one two three four five", "Москва — столица"]:
        assert not any(v for part in deobfuscate.find(text) for v in part.values()), text


def test_scan(spark: SparkSession, awkward: list[tuple]) -> None:
    rows = awkward + [(50, "a@b.c 1.2.3.4", "en", "a"), (50, "a@b.c 1.2.3.4", "en", "a"), (51, "9" * 30_000 + "@" * 30_000, "en", "a"), (52, "+1" + " " * 50_000, "en", "a")]
    got = deobfuscate.scan(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for (i, t, *_), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], r["text"], r["lang"], r["source"]))), strict=True):
        base = plain(t or "") if i != 51 else {k: [] for k in BASE}
        text = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in base[k])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(len(base[k]) for k in BASE)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["spans"] == text and r["text"] == t and r["matches"] == "m"
    assert deobfuscate.scan(make_docs(spark, [])).count() == 0


# --- language ----------------------------------------------------------------------------------------------------

LANGUAGES = {
    "en": "the of and to in that was with for his this which from they had not are but have were been their there when would more river light",
    "de": "der die und das nicht mit sich auf für werden einen über auch nach durch zwischen können müssen straße größer schön licht fluss",
    "fr": "le la les des une est que dans pour sur pas avec être cette mais nous vous leur très où déjà élève rivière lumière aujourd",
}


def test_language(spark: SparkSession) -> None:
    rng, rows = random.Random(4), []
    for k in range(240):
        lang = ("en", "de", "fr")[k % 3]
        rows.append((k, " ".join(rng.choices(LANGUAGES[lang].split(), k=rng.randint(4, 60))), lang, "s"))
    rows += [(900, None, "en", "a"), (901, "", "de", "a"), (902, "123 !!", "fr", "a"), (903, "le la les des une", None, None), (None, "der die und das nicht", "de", "a"), (0, rows[0][1], "en", "a"), (904, "the river " * 20_000, "en", "b")]
    got = language.identify(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" for i in (900, 901, 902)) and by[903]["lang_pred"] == "fr" and by[904]["lang_pred"] == "en"
    held = [(by[i]["lang_pred"], lang) for i, _, lang, _ in rows[:240] if crc(i) % 4 == 2]
    assert held and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert {r["lang_pred"] for r in language.identify(make_docs(spark, [(1, "text", None, None)])).collect()} == {"und"}
    assert language.identify(make_docs(spark, [])).count() == 0


def test_rare_language(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """A language of 0.01 % of the rows is learned, and no language has more regression rows than its bound."""
    monkeypatch.setattr(language, "FIT_ROWS", 1500)
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(LANGUAGES[("en", "de")[k % 2]].split(), k=12)), ("en", "de")[k % 2], "s") for k in range(30_000)]
    known = [k for k in range(40_000, 40_100) if crc(k) % 4 != 2][:3]
    asked = [k for k in range(40_000, 40_100) if crc(k) % 4 == 2][:5]
    rows += [(k, " ".join(rng.choices(LANGUAGES["fr"].split(), k=30)), "fr", "s") for k in known + asked]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(make_docs(spark, rows)).collect()}
    assert all(got[k] == "fr" for k in asked)
    held = [(got[k], lang) for k, _, lang, _ in rows[:30_000] if crc(k) % 4 == 2]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_kernel_counts_common_ngrams() -> None:
    texts = ["abab cd", "abc 12", "Éa x"]
    tables, marks = language.spectrum(texts).opened()
    (chunk,) = language.textops.chunks(language.pa.array(["ab xyz", "", "ABAB CD"]))
    got = language.kernel(chunk, tables, marks)

    def grams(t: str, n: int) -> set[bytes]:
        raw = re.sub(rb"[\s0-9]", b" ", t.encode().lower())
        return {raw[i : i + n] for i in range(len(raw) - n + 1)}

    for i, t in enumerate(["ab xyz", "", "ABAB CD"]):
        for j, m in enumerate(texts):
            want = 0.0
            for w, n in zip(language.BLEND, language.ORDERS, strict=True):
                known = set().union(*(grams(x, n) for x in texts))
                mine = grams(t, n) & known
                want += w * len(mine & grams(m, n)) / math.sqrt(max(1, len(mine)) * max(1, len(grams(m, n))))
            assert math.isclose(got[i, j], want, rel_tol=1e-5, abs_tol=1e-6)


# --- quality -----------------------------------------------------------------------------------------------------


def junk(kind: int, seed: int) -> str:
    words = prose(seed, 60).replace(".", "").split()
    return (" ".join(w + "###" for w in words), " | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 40))[kind]


def test_quality(spark: SparkSession) -> None:
    rng, rows, want = random.Random(8), [], {}
    for k in range(400):
        if k % 8 == 7:
            text, good = junk(k // 8 % 4, k), False
        elif k % 8 == 3:
            words = prose(k, 80).split()
            for bad in rng.sample(["idiot", "moron", "worthless", "pathetic", "scum", "trash"], 4):
                words.insert(rng.randrange(len(words)), bad)
            text, good = " ".join(words), False
        else:
            text, good = prose(k, rng.randint(40, 200)), True
        rows.append((k, text, "en", "a"))
        want[k] = good
    rows += [(900, None, "en", "a"), (901, "", "en", None), (902, "...", None, "a"), (None, prose(1, 50), "en", "a"), (0, rows[0][1], "en", "a"), (903, prose(2, 9000), "en", "b"), (904, "Fine.", "en", "a")]
    got = quality.scored(make_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["kept"] for r in got}
    wrong = [i for i, g in want.items() if by[i] != g]
    assert len(wrong) <= 4, wrong
    assert not by[900] and not by[901] and not by[902] and by[903] and by[904] and by[None]
    assert quality.scored(make_docs(spark, [])).count() == 0


def test_em_finds_accuracies() -> None:
    rng = np.random.default_rng(3)
    truth = rng.random(40_000) < 0.2
    accuracy = [0.95, 0.8, 0.7, 0.9]
    v = np.array([np.where(rng.random(len(truth)) < 0.3, quality.ABSTAIN, np.where((rng.random(len(truth)) < a) == truth, quality.BAD, quality.GOOD)) for a in accuracy])
    patterns, inverse, counts = np.unique(quality.pattern(v), return_inverse=True, return_counts=True)
    p = quality.posteriors(patterns, counts.astype(float), [[0, 1, 2, 3]])[inverse]
    said = (p >= 0.5) == truth
    best = max(((v[j] == quality.BAD) == truth).mean() for j in range(4))
    assert said.mean() > best and abs(p.mean() - truth.mean()) < 0.02


# --- leaks -------------------------------------------------------------------------------------------------------


def test_common_subsequence() -> None:
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common(decontaminate.masks_of(a), len(a), b) == table[-1][-1]


def test_leaks(spark: SparkSession) -> None:
    rng = random.Random(6)
    items = [(k, prose(5000 + k, rng.randint(18, 60))) for k in range(30)] + [(90, None), (91, ""), (92, "two words"), (3, prose(5003, 20))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, text_a string")
    rows, want = [], set()
    for k in range(200):
        text = prose(k, rng.randint(50, 400))
        if k % 5 == 0:
            i, item = items[rng.randrange(30)]
            words = item.split()
            if k % 10 == 0:  # a paraphrase: some words changed
                for at in rng.sample(range(len(words)), len(words) // 6):
                    words[at] = f"other{at}"
            own = text.split()
            at = rng.randrange(len(own))
            text = " ".join([*own[:at], *words, *own[at:]])
            want.add((k, i))
        rows.append((k, text, "en", "a"))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (None, "clean text", "en", None), (0, rows[0][1], "en", "a"), (902, prose(77, 8000), "en", "a")]
    found = decontaminate.matched(make_docs(spark, rows), benchmark, "leaks").select("doc_id", "matches", F.explode("leaks.item_id").alias("item")).collect()
    got = {(r["doc_id"], r["item"]) for r in found}
    assert want <= got and {i for i, _ in got} == {i for i, _ in want}
    assert len([r for r in found if r["doc_id"] == 0]) == 2 * len({r["item"] for r in found if r["doc_id"] == 0}) or any(i == 3 for _, i in got)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matched(make_docs(spark, rows[:3]), none, "leaks").where(F.size("leaks") > 0).count() == 0
    assert decontaminate.matched(make_docs(spark, []), benchmark, "leaks").count() == 0


def test_hot_leaks(spark: SparkSession) -> None:
    """Passages that much of the table holds: copies of a short document with an item, and a table of nothing else."""
    items = [(k, prose(6000 + k, 38)) for k in range(3)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    hot = prose(1, 25) + " " + items[0][1] + " " + prose(2, 30)
    rows = [(k, hot if k % 3 == 0 else prose(7000 + k, 95), "en", "a") for k in range(150)]
    got = decontaminate.matched(make_docs(spark, rows), benchmark, "leaks").select("doc_id", F.explode("leaks.item_id").alias("item")).collect()
    assert {(r["doc_id"], r["item"]) for r in got} == {(k, 0) for k in range(0, 150, 3)}
    got = decontaminate.matched(make_docs(spark, [(k, items[1][1], "en", "a") for k in (1, 2)]), benchmark, "leaks").select("doc_id", F.explode("leaks.item_id").alias("item")).collect()
    assert {(r["doc_id"], r["item"]) for r in got} == {(1, 1), (2, 1)}


def passages_of(text: str) -> list[list[int]]:
    """Terms of each block and the next, of the last block alone."""
    t = [h % decontaminate.FEATURES for h in decontaminate.words_of([text])[0]]
    return [t[a : a + 2 * decontaminate.BLOCK] for a in range(0, len(t), decontaminate.BLOCK)]


def weighted(terms: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a passage and their TF-IDF weights, of unit length."""
    t, n = np.unique(terms, return_counts=True)
    x = idf[t].astype(float) * n
    return t, x / np.sqrt((x * x).sum())


def test_space_of_all_passages(spark: SparkSession) -> None:
    """The latent space is whitened over every passage of every document and of the benchmark, repeated ones as often as they occur."""
    texts = [prose(200_000 + k, 500) for k in range(320)] + [prose(1, 40)] * 60 + [None, "", " .,; "]
    items = [prose(300_000 + k, 30) for k in range(20)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    index = decontaminate.build(make_docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), benchmark)
    rows = [weighted(p, index.idf) for t in [*texts, *items] for p in passages_of(t or "")]
    assert len(rows) > 10_000
    z = np.array([x @ index.basis[t] for t, x in rows])
    assert z.shape[1] == decontaminate.RANK and np.abs(z.T @ z - np.eye(decontaminate.RANK)).max() < 0.01


def test_pipeline_reads_all_passages(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch) -> None:
    """The pipeline's step makes its latent space of every passage that it gets, repeated ones and null ids too; removal is as before."""
    item = prose(400_000, 30)
    spark.createDataFrame([(1, item), (2, "the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [prose(410_000 + k % 20, 150) + (" " + item if k % 20 == 3 else "") for k in range(60)] + [None, ""]
    docs, seen, basis = make_docs(spark, [(None if k % 7 == 0 else k, t, "en", "a") for k, t in enumerate(texts)]), [], decontaminate.latent_basis

    def spy(terms, *rest):
        seen.append(sum(-(-len(r[0]) // (2 * decontaminate.BLOCK)) for r in terms.collect()))
        return basis(terms, *rest)

    monkeypatch.setattr(decontaminate, "latent_basis", spy)
    left = corpus_pipeline.no_leaks(spark, docs, str(tmp_path)).collect()
    assert seen == [sum(len(passages_of(t or "")) for t in [*texts, item])]
    assert sorted(r["text"] or "" for r in left) == sorted(t or "" for t in texts if item not in (t or ""))


def test_products_of_passages(monkeypatch: pytest.MonkeyPatch) -> None:
    """Products with the matrix of passages against its rows one by one, wherever a batch is cut apart."""
    rng = np.random.default_rng(5)
    texts = [None, "", *(prose(81_000 + n, n) for n in (1, 15, 16, 17, 31, 32, 33, 400)), " .,; ", " ".join(["same words here"] * 30), prose(5, 3)]
    basis, idf = rng.standard_normal((decontaminate.FEATURES, 6), np.float32), rng.random(decontaminate.FEATURES, np.float32) + 0.1
    terms = [*decontaminate._terms(iter([decontaminate.pa.RecordBatch.from_pydict({"text": texts})]))]
    found = [np.frombuffer(x, np.uint16).tolist() for b in terms for x in b.column(0).to_pylist()]
    assert found == [[h % decontaminate.FEATURES for h in w] for w in decontaminate.words_of(texts) if w]
    twice, moment = np.zeros(basis.shape), np.zeros((6, 6))
    for p in (p for t in texts for p in passages_of(t or "")):
        t, x = weighted(p, idf)
        y = x @ basis[t]
        twice[t] += x[:, None] * y
        moment += np.outer(y, y)
    sent = (basis * idf[:, None], idf.astype(float) ** 2)
    for multiplied, span, gathered in ((1, 2, 3), (7, 3, 1), (1 << 15, 32, 512)):
        for name, value in (("MULTIPLIED", multiplied), ("SPAN", span), ("GATHERED", gathered)):
            monkeypatch.setattr(decontaminate, name, value)
        got = np.zeros(basis.shape, np.float32)
        for b in decontaminate._multiply(lambda: sent, True)(iter(terms)):
            for k, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.reshape(-1, decontaminate.SENT * 6)[k] = np.frombuffer(m, np.float32)
        assert np.allclose(got * idf[:, None], twice, atol=1e-4)
        (only,) = decontaminate._multiply(lambda: sent, False)(iter(terms))
        assert np.allclose(np.frombuffer(only.column(1)[0].as_py()).reshape(6, 6), moment, rtol=1e-4, atol=1e-4)
    assert [*decontaminate._multiply(lambda: sent, True)(iter([]))] == []


def test_sample_of_passages(spark: SparkSession) -> None:
    """The sample keeps its bound, counts a repeated passage once and takes passages whatever their first word."""
    benchmark = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    rows = [(None if k % 3 == 0 else k, "same " + prose(0, 40) if k % 3 == 0 else f"the {prose(8000 + k, 300)}", "en", "a") for k in range(300)]
    docs = make_docs(spark, rows)
    idf = decontaminate.inverse_frequencies(docs)
    full = decontaminate.picked(docs, benchmark, idf, 1_000_000).count()
    n = 0
    for size in (200, 500):
        got = decontaminate.picked(docs, benchmark, idf, size).collect()
        n = len(got)
        assert size < n <= size + 2 and len({r["pick"] for r in got}) >= size
    again = decontaminate.picked(docs.repartition(7), benchmark, idf, 500).collect()
    assert {r["pick"] for r in again} == {r["pick"] for r in got} and n < full <= 200 * 19 + 5


def test_short_leaks(spark: SparkSession) -> None:
    """Verbatim items of any length are found wherever they stand, against a search of every document."""
    rng, items, rows = random.Random(12), [], []
    for k in range(120):
        words = prose(9000 + k, 60).split()
        items.append((k, " ".join(words[: (3, 5, 6, 7, 8, 10, 14, 20)[k % 8]])))
    items.append((500, "the the the the the the stone walks"))
    for k in range(121):
        own = prose(20_000 + k, 300).split()
        at = rng.randrange(len(own))
        rows.append((k, " ".join([*own[:at], items[k][1], *own[at:]]), "en", "a"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matched(make_docs(spark, rows), benchmark, "leaks").select("doc_id", F.explode("leaks").alias("m")).select("doc_id", "m.*").collect()
    got = {(r["doc_id"], r["item_id"]) for r in found if r["lcs"] == 1.0}
    texts = decontaminate.words_of([r[1] for r in rows])
    words = decontaminate.words_of([t for _, t in items])
    want = {(d, items[i][0]) for d, t in enumerate(texts) for i, w in enumerate(words) if any(t[a : a + len(w)] == w for a in range(len(t) - len(w) + 1))}
    assert len(want) >= 121 and want <= got


def test_blocks_of_items(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """A benchmark of several blocks gives what one block gives, whatever the columns of the documents."""
    rng, rows = random.Random(15), []
    items = [(k, prose(11_000 + k, rng.randint(10, 45))) for k in range(60)]
    for k in range(60):
        own = prose(31_000 + k, 150).split()
        at = rng.randrange(len(own))
        rows.append((k, " ".join([*own[:at], items[k][1], *own[at:]]) if k % 3 else prose(k, 90), "en", "a"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    seen = lambda: sorted((r["doc_id"], r["m"]["item_id"], r["m"]["lcs"]) for r in decontaminate.matched(make_docs(spark, rows), benchmark).select("doc_id", F.explode("matches").alias("m")).collect())
    one = seen()
    monkeypatch.setattr(decontaminate, "ITEMS", 20)
    assert seen() == one and len(one) >= 40


def test_paraphrases_against_all_pairs(spark: SparkSession) -> None:
    """Paraphrased items, a quarter of the words changed: recall against the longest common subsequence with every window of every text."""
    rng, rows = random.Random(21), []
    items = [(k, prose(41_000 + k, rng.randint(20, 40))) for k in range(40)]
    for k in range(40):
        words, own = items[k][1].split(), prose(51_000 + k, 120).split()
        for at in rng.sample(range(len(words)), len(words) // 4):
            words[at] = f"other{at}"
        at = rng.randrange(len(own))
        rows.append((k, " ".join([*own[:at], *words, *own[at:]]), "en", "a"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item"]) for r in decontaminate.matched(make_docs(spark, rows), benchmark).select("doc_id", F.explode("matches.item_id").alias("item")).collect()}
    texts, words, want = decontaminate.words_of([r[1] for r in rows]), decontaminate.words_of([t for _, t in items]), set()
    for d, text in enumerate(texts):
        for i, w in enumerate(words):
            masks = decontaminate.masks_of(w)
            # windows as long as the item and a block on either side: what the check reads at least
            if any(decontaminate.common(masks, len(w), text[a : a + len(w) + 16]) >= decontaminate.SURE * len(w) for a in range(0, len(text), 4)):
                want.add((d, i))
    assert len(want) >= 40 and len(want & got) >= 0.9 * len(want)


def test_short_items_remove_nothing(spark: SparkSession) -> None:
    benchmark = spark.createDataFrame([(1, "the"), (2, ""), (3, None), (4, prose(61_000, 30)), (5, "über naïve ça été où là déjà señor")], "item_id long, text string")
    rows = [(k, prose(62_000 + k, 60) + (" " + prose(61_000, 30) if k == 3 else ""), "en", "a") for k in range(6)] + [(9, "x über naïve ça été où là déjà señor y", "fr", "a"), (10, None, None, None)]
    docs = make_docs(spark, rows)
    left = decontaminate.without_leaks(docs, benchmark)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {0, 1, 2, 4, 5, 10}
    said = {r[0] for r, w in zip(rows, decontaminate.words_of([r[1] for r in rows]), strict=True) if decontaminate.words_of(["the"])[0][0] in w}
    found = decontaminate.matched(docs, benchmark).where(F.exists("matches", lambda m: m["item_id"] == 1))
    assert {r["doc_id"] for r in found.collect()} == said and said


def test_orthonormal() -> None:
    basis = np.random.default_rng(1).standard_normal((decontaminate.SLICE * 2, 12), np.float32) * np.logspace(0, 4, 12, dtype=np.float32)
    basis[:, 3] = basis[:, 4]
    decontaminate.orthonormal(basis)
    gram = basis.T.astype(float) @ basis
    kept = np.diag(gram) > 0.5
    assert kept.sum() == 11 and np.abs(gram - np.diag(kept.astype(float))).max() < 1e-4


def test_block_vectors(monkeypatch: pytest.MonkeyPatch) -> None:
    """Sums of the words' rows, whatever the lengths and wherever the blocks are cut apart."""
    rng = np.random.default_rng(3)
    basis, idf = rng.standard_normal((decontaminate.FEATURES, 6), np.float32), rng.random(decontaminate.FEATURES, np.float32)
    texts = [None, "", *(prose(71_000 + n, n) for n in (1, 15, 16, 17, 31, 32, 33, 400)), " .,; ", prose(5, 3)]
    chunk = decontaminate.textops.chunk_of(texts)
    w = decontaminate.plain_words(chunk)
    start, row, _ = decontaminate.blocks(w, len(texts))
    stop = [*start[1:], len(w.row)]
    terms = [decontaminate.term(w.hash[a:b]) for a, b in zip(start, stop, strict=True)]
    assert sorted({len(t) for t in terms}) == [1, 3, 15, 16]
    for gathered in (1, 7, 512):
        monkeypatch.setattr(decontaminate, "GATHERED", gathered)
        vectors, norms = decontaminate.block_vectors(w, start, basis, idf)
        assert np.allclose(vectors, [basis[t].sum(axis=0) for t in terms], atol=1e-4) and np.allclose(norms, [(idf[t] ** 2).sum() for t in terms], rtol=1e-4)
    none = decontaminate.plain_words(decontaminate.textops.chunk_of([]))
    assert decontaminate.block_vectors(none, none.start, basis, idf)[0].shape == (0, 6)


def test_regions(monkeypatch: pytest.MonkeyPatch) -> None:
    """No pair is lost that has enough of the item's words; signatures are doubled once for all reaches, and read once for each reach."""
    rng = random.Random(9)
    items = [prose(72_000 + k, rng.randint(8, 70)).split() for k in range(40)] + [["same"] * 20]
    texts = [prose(73_000 + k, rng.randint(1, 260)) for k in range(30)]
    texts += [" ".join([prose(k, 40), *items[k][: len(items[k]) * (5 + k % 5) // 9], prose(k + 1, 30)]) for k in range(40)] + ["same " * 50, ""]
    chunk = decontaminate.textops.chunk_of(texts)
    w = decontaminate.plain_words(chunk)
    start, row, _ = decontaminate.blocks(w, len(texts))
    bounds = decontaminate.textops.row_bounds(w.row, len(texts))
    words = decontaminate.words_of([" ".join(i) for i in items])
    sizes = np.array([len(x) for x in words])
    marks = {b: decontaminate.signatures(np.array([x for y in words for x in y], np.uint64), np.repeat(np.arange(len(words)), sizes), len(words), b) for b in (decontaminate.SIGNATURE, decontaminate.FINE)}
    made, asked, around = [], [], decontaminate.Spread.around

    class Counted(decontaminate.Spread):
        def __init__(self, held: np.ndarray, row: np.ndarray) -> None:
            super().__init__(held, row)
            made.append(self)

        def around(self, block: np.ndarray, reach: np.ndarray | int) -> np.ndarray:
            asked.append((self.levels[0].shape[1] * 64, len(block)))
            out = around(self, block, reach)
            for b, r, got in zip(block.tolist(), np.broadcast_to(reach, len(block)).tolist(), out, strict=True):
                near = [k for k in range(max(0, b - r), min(len(row), b + r + 3)) if row[k] == row[b]]
                assert (got == np.bitwise_or.reduce(self.levels[0][near])).all()
            return out

    monkeypatch.setattr(decontaminate, "Spread", Counted)
    regions = decontaminate.Regions(w, start, row, sizes, marks)
    block, item = (x.ravel() for x in np.meshgrid(np.arange(len(start)), np.arange(len(words)), indexing="ij"))
    fit = set(regions.possible(block, item).tolist())
    assert regions.possible(block[:0], item[:0]).tolist() == [] and fit == set(regions.possible(block, item).tolist())
    enough = 0
    for k, (b, i) in enumerate(zip(block.tolist(), item.tolist(), strict=True)):
        region = w.hash[max(bounds[row[b]], start[b] - sizes[i]) : min(bounds[row[b] + 1], start[b] + 2 * decontaminate.BLOCK + sizes[i])].tolist()
        if decontaminate.common(decontaminate.masks_of(words[i]), len(words[i]), region) >= decontaminate.LIKELY * len(words[i]):
            enough += 1
            assert k in fit
    assert enough >= 40 and len(fit) < 0.8 * len(block)
    assert len(made) == 2 and all(len(m.levels) <= 5 for m in made)
    wide = [n for bits, n in asked if bits == decontaminate.SIGNATURE]
    assert wide == [len(start)] * len({-(-n // decontaminate.BLOCK) for n in sizes.tolist()})


def test_bits_set() -> None:
    rng = np.random.default_rng(4)
    for columns in (8, 16):
        x = rng.integers(0, 1 << 63, (50, columns), np.uint64) * np.uint64(2) + rng.integers(0, 2, (50, columns), np.uint64)
        x[0], x[1] = 0, ~np.uint64(0)
        assert decontaminate.bits_set(x).tolist() == [sum(int(v).bit_count() for v in r) for r in x]
        assert decontaminate.bits_set(x[:0]).tolist() == []


def test_words_of_bytes() -> None:
    """Words and their rows against a split of each text; a word's hash is the same wherever it stands, also beyond what is summed at a time."""
    textops = decontaminate.textops
    long = "q" * (textops.SUMMED + 5)
    texts = [None, "", "one", " \t one\x0btwo ", "é\x1cü one", *["one " + prose(k, 3000) + " one" for k in range(8)], long, "a " + long + " one " + long, "\x0c"]
    for white, lower in ((textops.WHITE, False), (textops.NO_WORD, True)):
        chunk = textops.chunk_of(texts)
        w = textops.words(chunk, lower=lower, white=white)
        split = [[x for x in re.split(b"[" + re.escape(bytes(np.flatnonzero(white).astype(np.uint8))) + b"]+", (t or "").encode()) if x] for t in texts]
        assert [bytes(chunk.data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == [x for t in split for x in t]
        assert w.row.tolist() == [k for k, t in enumerate(split) for _ in t]
        assert all(len({h for h, x in zip(w.hash.tolist(), (x for t in split for x in t), strict=True) if x == word}) == 1 for word in (b"one", long.encode()))
    none = textops.words(textops.chunk_of([]), lower=True)
    assert len(none.row) == len(none.hash) == 0
