"""Mixing, chat formatting and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
import shutil

import duckdb
import pytest
from pyspark.sql import SparkSession

import corpus_pipeline
from tests.llm.conftest import ASCII_WORD, make_docs, prose
from wardline.llm import chat, curriculum, deobfuscate, ngram_join, quality

DATA = "/root/testdata/sf0.001"


def targets(sizes: dict, weights: list[float], repeats: int) -> dict:
    """Shares by weight, caps and resharing, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > repeats * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(repeats * sizes[s])
        free -= over
        left -= sum(out[s] for s in over)
    return out


def test_mix(spark: SparkSession, awkward: list[tuple]) -> None:
    rows = awkward + [(1000 + k, prose(k, 5 + k % 40), "en", f"s{k % 7}") for k in range(400)]
    mixed = curriculum.mix(make_docs(spark, rows))
    got, again = mixed.collect(), curriculum.mix(make_docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(ASCII_WORD.findall(t or ""))
    want = targets(sizes, [1, 2, 3], 3)
    largest = {s: max(len(ASCII_WORD.findall(t or "")) for _, t, _, x in rows if x == s) for s in sizes}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["size"] == len(ASCII_WORD.findall(r["text"] or "")) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"]) and r["h"] == "h"
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) <= largest[s]
    order = curriculum.training_order(mixed, ["doc_id"]).collect()
    assert len(order) == sum(r["copies"] for r in got)
    assert curriculum.mix(make_docs(spark, [])).count() == 0
    assert [r["taken"] for r in curriculum.mix(make_docs(spark, [(1, None, None, None)])).collect()] == [0]


def test_positions_follow_the_schedule(spark: SparkSession) -> None:
    """Numerically: the demand integral up to a copy's position is the share of tokens before the copy's middle."""
    schedules = [[(0.0, 1.0, 2.0, 0.0)], [(0.0, 0.4, 0.0, 1.0), (0.4, 1.0, 3.0, 3.0)]]

    def used(schedule: list, t: float) -> float:
        steps = 20_000
        at = lambda x: next(u + (v - u) * (x - a) / (b - a) for a, b, u, v in schedule if x <= b)
        return sum(at((k + 0.5) / steps * t) for k in range(steps)) * t / steps / curriculum.integral(schedule)

    rows = [(k, "w " * (k % 9 + 1), "en", "ab"[k % 2]) for k in range(60)]
    got = curriculum.mix(make_docs(spark, rows), schedules).collect()
    for kind, source in enumerate("ab"):
        mine = sorted((p, r["size"]) for r in got if r["source"] == source for p in r["positions"])
        target, done = next(r["target"] for r in got if r["source"] == source), 0
        for p, size in mine:
            assert math.isclose(used(schedules[kind], p), (done + size / 2) / target, abs_tol=2e-3)
            done += size


AWKWARD_TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\", "\\\\<|", "<\\|", "[\\INST]", "a\\", "<s></s><|end|>", "été\n\n", "<", "[", "<|" * 500]


def test_chat_round_trip(spark: SparkSession) -> None:
    rows = [(k, t, role, text) for k, text in enumerate(AWKWARD_TEXTS) for t, role in ((0, "user"), (1, "assistant"), (2, "assistant"), (3, "a\nb<|c\\"), (None, None))]
    rows += [(500, 1, "assistant", "b"), (500, 1, "assistant", "b"), (500, 0, "user", None), (None, 0, "user", "x"), (None, 1, "assistant", None)]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_messages(chat.text_parts(table))
    for r in formatted.collect():
        role, body = chat.parse(r["formatted"])
        assert role == (r["role"] or "") and r["formatted"].count("<|") == 2
        assert not any(c in body for c in chat.CONTROLS)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is None, x[1] or 0))
        learnt = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["loss_chars"] == len(learnt) and r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_messages(chat.text_parts(empty))).count() == 0


def test_typed_parts(spark: SparkSession) -> None:
    part = lambda **x: {"type": None, "text": None, "uri": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    parts = [part(type="text", text="see <|"), part(type="image", uri="a.png", width=513, height=512), None, part(type="audio", uri="b.wav", seconds=2.01), part(type="document", uri="c.pdf", pages=3), part(type="odd", text="x"), part(text="y")]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])]
    got = chat.format_messages(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).orderBy("turn").collect()
    assert got[0]["formatted"] == "<|turn|>user\nsee <\\|<|image:1|><|audio:2|><|document:3|>xy<|end|>\n"
    assert [(r["type"], r["uri"], r["tokens"]) for r in got[0]["attachments"]] == [("image", "a.png", 85 + 340), ("audio", "b.wav", 51), ("document", "c.pdf", 1200)]
    assert got[0]["expanded_tokens"] == 425 + 51 + 1200 and got[1]["formatted"] == got[2]["formatted"] == "<|turn|>assistant\n<|end|>\n"


# --- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    """Each stage on what its predecessor kept, against its operator's own definition."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(path := str(tmp_path / name))
        after = spark.read.parquet(path)
        before, rows = {r["doc_id"]: r for r in docs.collect()}, after.collect()
        if name != "mix":
            assert after.columns == columns
        if name == "quality":
            kept = {r["doc_id"] for r in quality.scored(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").collect()}
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            assert {r["doc_id"] for r in rows} == kept
            bad = [i for i in kept if len(set(quality.INSULTS[: quality.STRONG]) & set((before[i]["text"] or "").lower().split())) >= 2]
            assert not bad and sum(labels[i]["quality"] == 1 and not labels[i]["toxic"] for i in labels if i in before and i not in kept) <= 0.03 * len(labels)
        if name == "near_duplicates":
            roots = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, c in roots.items() if i == c)
        if name == "decontamination":
            words = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
            items = [words(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            leaky = {i for i, r in before.items() if any(x in words(r["text"]) for x in items)}
            assert leaky and not leaky & {r["doc_id"] for r in rows} and len(rows) >= len(before) - len(leaky) - 2
        if name == "personal_data":
            assert len(rows) == len(before)
            for r in rows:
                assert not any(v for v in deobfuscate.detect(r["text"]).values()) and r["n_chars"] == len(r["text"])
                if not any(v for part in deobfuscate.find(before[r["doc_id"]]["text"]) for v in part.values()):
                    assert r["text"] == before[r["doc_id"]]["text"]
        if name == "mix":
            want = {r["doc_id"]: r["copies"] for r in curriculum.mix(docs).collect()}
            got: dict = {}
            for r in rows:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == {i: n for i, n in want.items() if n}
        docs = after


def test_pipeline_awkward(spark: SparkSession, awkward: list[tuple], tmp_path) -> None:  # noqa: ANN001
    for t in ("benchmark", "labels"):
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = make_docs(spark, awkward)
    for k, rows in enumerate((docs, docs.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, rows, str(tmp_path)).write.parquet(path := str(tmp_path / f"{k}-{name}"))
            rows = spark.read.parquet(path)


@pytest.mark.parametrize("name", ["op1_embedding_neardup", "op4_suffix_trees", "op5_ngram_join", "op6_curriculum_mix", "op10_chat_parts"])
def test_queries_equal_their_sql(spark: SparkSession, name: str) -> None:
    from wardline.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]), QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert sorted(x[0] for x in want.description) == columns
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    names = [x[0] for x in want.description]
    assert sorted(rows, key=str) == sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in want.fetchall()), key=str)


