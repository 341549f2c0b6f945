"""Marks of the n-gram join: families of chance beyond a block are taken apart before texts are dealt out, and no link is lost."""

from __future__ import annotations

import random

import numpy as np
import pytest

from panelwright.llm import ngram_join
from tests.llm.test_families import edited, grouped


def chained(rng: random.Random, n: int) -> list[str]:
    """Texts of common words, each of which shares one passage of six rare words, the rarest it has, with the next one."""
    links = [[f"w{rng.randrange(10**9)}" for _ in range(6)] for _ in range(n + 1)]
    return [" ".join([*links[i], *(f"c{rng.randrange(300)}" for _ in range(188)), *links[i + 1]]) for i in range(n)]


def test_mark_bounds_the_difference():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 20, 63, 64, 65, 300, 900, 2000)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) < keep], rng.integers(0, 2**63, more, dtype=np.uint64)])) for s in sets for keep in (0.8, 0.95, 1) for more in (0, 1, 30)]
    for percent in (50, 80, 90, 100):
        sizes, marks = np.array([len(s) for s in sets]), [ngram_join.mark(s, percent) for s in sets]
        side = np.full(len(sets), 2)
        up = ngram_join.near_blocks(marks, sizes, side, percent)
        linked = ngram_join.linked_blocks([np.sort(s) for s in sets], side, percent).roots()
        for a in range(len(sets)):
            assert up[a] == up[linked[a]]
    # at 80 % the marks of unrelated sets tell them apart
    apart = ngram_join.near_blocks([ngram_join.mark(s, 80) for s in sets[4:8]], sizes[4:8], side[4:8], 80)
    assert apart.tolist() == [0, 1, 2, 3]


@pytest.fixture
def dealt(monkeypatch):
    """Rows that go to tasks which compare them: last the texts, before them the marks of families beyond a block."""
    found, real = [], ngram_join._cells

    def cells(*args):
        found.append(real(*args))
        return found[-1]

    monkeypatch.setattr(ngram_join, "_cells", cells)
    return found


def test_chance_deals_no_text(spark, monkeypatch, dealt):
    monkeypatch.setattr(ngram_join, "LIST", 1)  # as if every shared n-gram were one of many texts
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(9)
    texts = chained(rng, 60)
    texts += [edited(rng, texts[7], 0.01) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(df, n=5, percent=80).collect()}
    assert got == {i: 7 if i >= 60 else i for i in range(62)}
    assert len(dealt) == 2
    assert sorted(r[0] for r in dealt[-1].groupBy("node").count().select("count").collect()) == [1, 1, 1]


@pytest.mark.parametrize("block, marked, n, percent", [(4, 1 << 25, 5, 80), (4, 3000, 1, 50), (40, 2000, 3, 90)])
def test_no_link_is_lost_to_marks(spark, monkeypatch, block, marked, n, percent):
    monkeypatch.setattr(ngram_join, "LIST", 1)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MARKED", marked)
    rng = random.Random(block + n)
    texts = chained(rng, 30)
    for base in texts[:5]:
        texts += [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(6)]
        texts += [" ".join(base.split()[: rng.randint(140, 199)]) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(df, n=n, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == grouped(texts, n, percent)
