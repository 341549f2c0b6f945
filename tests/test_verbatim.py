"""Passages are found wherever they stand in a document, as brute force finds them."""

from __future__ import annotations

import random

from panelwright.plans.news import Passages, verbatim_passages

DOCS = ["A line before.\nThe passage stands within a longer line, doesn't it?\nThe end.", "one\ntwo\nthree", "größe und maß", None, "", "a whole line\nand more"]
PASSAGES = ["passage stands within a longer", "two\nthree", "e\ntw", "ße u", "ß", "a whole line", "a line that no text has", "within a longer line, doesn't it?\nThe end, not", "", None, "two\nthree"]


def test_passages_anywhere(spark, tmp_path):
    spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.chars, r.verbatim) for r in verbatim_passages(spark, str(tmp_path)).collect()}
    assert got == {i: (None if p is None else len(p), int(p is not None and any(p in d for d in DOCS if d is not None))) for i, p in enumerate(PASSAGES)}


def test_found_equals_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(300))) for _ in range(200)]
    passages = {t[a : a + rng.choice([1, 2, 3, 5, 40, 64, 65, 130])] for t in texts for a in [rng.randrange(len(t) + 1)]} | {"".join(rng.choice("abé \n") for _ in range(6)) for _ in range(200)}
    finder = Passages(sorted(passages))
    for t in texts:
        assert finder.found(t, set()) == {p for p in passages if p in t}
