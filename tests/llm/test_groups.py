"""Near-duplicate operators against brute force, with blocks small enough that families are cut."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import near_embed, ngram_join
from panelwright.llm.components import components


def closure(n: int, links) -> list[int]:
    up = list(range(n))

    def find(a: int) -> int:
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a long, b long").repartition(4)
    want = closure(261, links)
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got.get(i, i) == want[i] for i in range(261))
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def texts() -> list[str | None]:
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    out: list[str | None] = [None, "", " \n ", "one", "ONE", "two words", "Two  words", "a b c", "a b c d"]
    for _ in range(25):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.choice([5, 30, 60, 61, 200]))]
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = "new" + str(rng.randrange(1000))
            out.append(" ".join(own))
    out += [out[10]] * 5
    common = " ".join(f"boiler{i}" for i in range(20))
    out += [f"{common} {i} tail{i} end{i}" for i in range(20)]
    return out


@pytest.mark.parametrize("block,n,percent", [(8192, 3, 90), (4, 3, 90), (30, 3, 90), (8192, 5, 80)])
def test_jaccard_groups(spark, monkeypatch, block, n, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    all_texts = texts()
    rows = [(i + 5, t, "x", -1) for i, t in enumerate(all_texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string, n string, component_id int").repartition(3), n, percent).collect()}
    sets = []
    for t in all_texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    up = closure(len(sets), links)
    assert got == {i + 5: (len(sets[i]), up[i] + 5) for i in range(len(sets))}


def test_jaccard_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d"), (3, "a b c d"), (2, "a b c d"), (2, "a b c d"), (2, "other text here now"), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([("None", 2, "2"), ("3", 2, "2"), ("2", 2, "2"), ("2", 2, "2"), ("2", 2, "2"), ("None", 0, "None")])
    mixed = [(1, "a b c d"), (2, "e f g h"), (2, "a b c d"), (3, "e f g h"), (4, "x y z w"), (4, "x y z w"), (None, "x y z w"), (None, "only here now"), (None, "only here now"), (5, None), (5, None)]
    left = ngram_join.one_of_each_group(spark.createDataFrame([(*r, "k") for r in mixed], schema + ", key string"))
    assert left.columns == ["doc_id", "text", "key"]
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted([("1", "a b c d"), ("2", "e f g h"), ("4", "x y z w"), ("None", "only here now"), ("5", "None"), ("5", "None")])
    assert not ngram_join.jaccard_groups(spark.createDataFrame([], schema)).collect()
    kept = ngram_join.one_of_each_group(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], schema))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("block", [2048, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near_embed, "BLOCK", block)
    monkeypatch.setattr(near_embed, "LISTS", (4, 4))
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = rng.normal(size=16)
        for _ in range(6):
            rows.append(((base + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.1, 0.15])) * rng.choice([1.0, 3.0]), g % 3))
    rows += [(rng.normal(size=16), 1) for _ in range(20)]
    table = [(i, [float(np.float32(x)) for x in v], lab) for i, (v, lab) in enumerate(rows)]
    n = len(table)
    table += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0] * 15 + [None], 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] + [1.0] * 15, 1), (n + 5, table[0][1], None), (n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [], 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").withColumn("component_id", F.lit("clash")).repartition(3)
    x = np.array([t[1] for t in table[:n]])
    s = (x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    lab = np.array([t[2] for t in table[:n]])
    link = (s >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    up = closure(n, zip(*np.nonzero(link), strict=True))
    want = {i: (int(link[i].sum()), up[i]) for i in range(n)} | {n + k: (0, n + k) for k in range(9)} | {n + 6: (1, n + 6), n + 7: (1, n + 6)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_embed.near_vectors(df).collect()}
    assert got == {i: (a, b, b == i) for i, (a, b) in want.items()}
    assert not near_embed.near_vectors(df.limit(0)).collect()


def test_near_vectors_of_any_magnitude_and_label(spark):
    rows = [(1, [1e200, 1e200], "x"), (2, [1e200, 1.0001e200], "x"), (3, [1e-200, 1e-200], "x"), (4, [5e-324, 5e-324], "x"), (5, [1.0, 1.0], "y"), (6, [3.0, 3.0], "y"), (7, [1.0, -1.0], "x"), (6, [1.0, -1.0], "y"), (None, [2.0, 2.0], "y"), (None, [9.0, 1.0], "z")]
    got = {(r.vec_id, r.n_links, r.component_id) for r in near_embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got >= {(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (7, 0, 7), (6, 0, 6), (None, 0, None)}
    assert {(i, n) for i, n, _ in got if i == 5} == {(5, 2)}


def test_recall_of_near_vectors_in_many_dimensions(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 64))
    x = np.repeat(base, 6, 0) + rng.normal(size=(900, 64)) * rng.choice([0.05, 0.1, 0.13, 0.15], (900, 1))
    x[:300] = np.repeat(base[:50], 6, 0)
    x[np.arange(300), rng.integers(0, 64, 300)] += rng.choice([0.5, 1.0, 1.2], 300)  # the whole difference in one component
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.98).sum(1) - 1
    got = np.array([r.n_links for r in near_embed.near_vectors(df).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()
