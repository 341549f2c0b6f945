"""The language field knows every language of the table, however rare, and the stage rejects texts without one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import lang_id

LETTERS = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}


def prose(rng: random.Random, letters: str, words: int = 30) -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture
def docs():
    rng = random.Random(4)
    rows = [(i, prose(rng, LETTERS["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb") for i in range(1500)]
    return rows + [(9000 + i, prose(rng, LETTERS["cc"]), "cc") for i in range(10)]


def test_rare_language_is_learned(spark, docs, monkeypatch):
    monkeypatch.setattr(lang_id, "DOCS", 40)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert lang_id.fitted(df).value.states == ["aa", "bb", "cc"]
    got = {r.doc_id: r.lang_pred for r in lang_id.languages(df).collect()}
    assert [got[i] for i, _, lang in docs if lang == "cc"] == ["cc"] * 10


def test_rare_language_keeps_its_words(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(lang_id, "WORDS", 600)
    texts = [prose(rng, LETTERS["aa"]) for _ in range(400)] + [prose(rng, LETTERS["cc"]) for _ in range(2)]
    field = lang_id.fit(texts, ["aa"] * 400 + ["cc"] * 2)
    names, _ = lang_id.Labeller(field).labels([prose(rng, LETTERS["cc"]) for _ in range(20)])
    assert (names == "cc").all()


def test_stage_rejects_texts_without_a_language(spark):
    rng = random.Random(8)
    own = {i: r for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").collect())}
    long = {s: [r.text for r in own.values() if r.lang == s and len(r.text) > 1500] for s in sorted({r.lang for r in own.values()})}
    gibberish = [prose(rng, "abcdefghijklmnopqrstuvwxyz", 200) for _ in range(10)]
    mixed = [f"{rng.choice(long[a])[:1000]}\n{rng.choice(long[b])[:1000]}" for a in long for b in long if a < b]
    unlearned = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler."]
    bad = gibberish + mixed + unlearned + ["12 34", ""]
    df = spark.createDataFrame([(i, r.text, r.lang) for i, r in own.items()] + [(10**6 + i, t, None) for i, t in enumerate(bad)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, df, "").select("doc_id").collect()}
    passed = [bad[i - 10**6][:60] for i in kept if i >= 10**6]
    assert not passed
    assert sum(i in kept for i in own) >= 0.99 * len(own)


def test_first_by_hash_is_the_ordered_limit(spark):
    even = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"))
    hot = even.where("doc_id < 30").union(even.where("doc_id = 7").crossJoin(spark.range(5000)).select("doc_id", "lang"))  # few ids, one of nearly all rows
    for ids, n in [(even, 100), (even, 4999), (hot, 100), (even.limit(0), 10), (even.limit(7), 10)]:
        want = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
        assert sorted(lang_id.first_by_hash(ids, n).collect()) == sorted(want)
