"""Families of the n-gram join: texts that share an n-gram by chance make none, and no link is lost to the bound on pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from panelwright.llm import ngram_join
from panelwright.llm.components import Forest


def chained(rng: random.Random, n: int) -> list[str]:
    """Texts of 200 words, each of which shares one passage of six rare words with the next one and nothing else."""
    own = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    links = [own(6) for _ in range(n + 1)]
    return [" ".join([*links[i], *own(188), *links[i + 1]]) for i in range(n)]


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in text.split())


def grouped(texts: list[str], n: int, percent: int) -> list[int]:
    sets = [s for s, _ in ngram_join.shingles(texts, n)]
    forest = Forest(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                forest.join(i, j)
    return forest.roots().tolist()


@pytest.fixture
def families(monkeypatch):
    """What the join writes as families."""
    found, real = [], ngram_join.written

    def written(df, what):
        out = real(df, what)
        if what == "families":
            found.append(out)
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    return found


def test_chance_makes_no_family(spark, families):
    df = spark.createDataFrame(list(enumerate(chained(random.Random(3), 60))), "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in ngram_join.jaccard_groups(df, n=5, percent=80).collect())
    assert families[0].count() == 0


@pytest.mark.parametrize("most, n, percent", [(2, 5, 80), (4, 1, 50), (1000, 3, 90)])
def test_no_link_is_lost(spark, monkeypatch, most, n, percent):
    monkeypatch.setattr(ngram_join, "LIST", most)
    rng = random.Random(most + n)
    texts = chained(rng, 10)
    for base in texts[:5]:
        texts += [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(6)]
        texts += [" ".join(base.split()[: rng.randint(140, 199)]) for _ in range(4)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(df, n=n, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == grouped(texts, n, percent)
