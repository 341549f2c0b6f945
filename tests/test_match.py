"""Linkage reaches every document, whatever its identifier, as all pairs give it."""

from __future__ import annotations

import random

from panelwright.plans.texts import match_best


def test_best_match_equals_all_pairs(spark, tmp_path):
    rng = random.Random(5)
    texts = [f"{rng.choice('abc')}\n{rng.choice('xyz')}" for _ in range(40)] + ["", "", None, None, "alone"]
    docs = [(2 * i, t, None if i % 9 == 8 else len(t or "")) for i, t in enumerate(texts)] + [(7, "odd\n1", 5), (9, "odd\n1", 5), (9, "odd\n1", 5), (11, "odd\n2", 5)] + [(None, "alone", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t, n in docs:
        for j, u, m in docs:
            if None in (i, j, t, u) or i == j:
                continue
            priority = 1 if t == u else 2 if None not in (n, m) and (t.split("\n")[0], n) == (u.split("\n")[0], m) else None
            if priority:
                want[i] = min(want.get(i, (3, 0)), (priority, j))
    got = match_best(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.priority, r.match) for r in got} == want and len(got) == len(want)
    assert {i % 2 for i in want} == {0, 1}
