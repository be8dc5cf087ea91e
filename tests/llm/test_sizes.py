"""What keeps the corpus operators in bounds on large tables, and that every stage has an effect."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession, functions as F

from tests.llm.conftest import make_docs, prose
from tests.llm.test_pairs import check_join, family
from wardline.llm import curriculum, ngram_join


def test_sketch_grows_with_the_text(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = [(10 * f + k, t, "en", "z") for f in range(3) for k, t in enumerate(family(f, 8))] + [(90, None, "en", "z")]
    docs = make_docs(spark, rows)
    assert ngram_join.buckets_for(docs) == ngram_join.BUCKETS == ngram_join.buckets_for(docs.limit(0))
    monkeypatch.setattr(ngram_join, "BUCKETS", 64)
    monkeypatch.setattr(ngram_join, "TEXT_PER_BUCKET", 4)
    chars = sum(len(t or "") for _, t, *_ in rows)
    assert chars / 4 <= ngram_join.buckets_for(docs) < chars / 2
    check_join(ngram_join.join(docs).collect(), rows)
    monkeypatch.setattr(ngram_join, "MOST_BUCKETS", 128)
    assert ngram_join.buckets_for(docs) == 128


def test_families_copy_texts_within_reach_only(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """A crowd of far sizes: sets that cannot be similar share no block, links within and between neighbouring sizes stay."""
    monkeypatch.setattr(ngram_join, "CROWD", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    line, rows = "this line is part of every page here", []
    for at, n in enumerate((12, 30, 80, 200)):
        rows += [(100 * at + k, f"{line} {prose(40 * at + k, n)}", "en", "z") for k in range(14)]
        rows += [(100 * at + 50, rows[-1][1] + " tail", "en", "z")]
    asked: list[int] = []
    real = ngram_join.cut

    def cut(df, name):  # noqa: ANN001, ANN202
        out = real(df, name)
        if name == "ngram-families":
            asked.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", cut)
    # all shingles in the prefix, so that the line's tie all rows into one family
    monkeypatch.setattr(ngram_join, "prefix", lambda s, counts, noise, similar: (s, counts[:1].repeat(len(s)).astype("int64"), 1))
    check_join(ngram_join.join(make_docs(spark, rows)).collect(), rows)
    # 60 classes in 10 blocks were 540 copies
    assert 0 < asked[0] < 300


def test_mix_query_takes_what_the_curriculum_places(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = [(k, prose(k, 20 + k), "en", "ab"[k % 2]) for k in range(12)]
    docs, real = make_docs(spark, rows), curriculum.mix
    monkeypatch.setattr(curriculum, "documents", lambda spark, sf_dir: docs)
    plain = {r["doc_id"]: r["taken"] for r in curriculum.op6_curriculum_mix(spark, "").collect()}
    mixed = {r["doc_id"]: r for r in real(docs).collect()}
    assert plain == {k: r["copies"] * r["size"] for k, r in mixed.items()} and any(plain.values())
    order = [r["doc_id"] for r in curriculum.op6_curriculum_mix(spark, "").collect() if r["taken"]]
    assert order == sorted(order, key=lambda k: (min(mixed[k]["positions"]), k))
    # copies that get no training time are not taken
    lost = next(k for k, r in mixed.items() if r["copies"])
    nowhere = F.array().cast("array<double>")
    monkeypatch.setattr(curriculum, "mix", lambda d: real(d).withColumn("positions", F.when(F.col("doc_id") == lost, nowhere).otherwise(F.col("positions"))))
    assert {r["doc_id"]: r["taken"] for r in curriculum.op6_curriculum_mix(spark, "").collect()} == plain | {lost: 0}
