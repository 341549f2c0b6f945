"""The toxicity chain on texts that it was not fitted on, and both scorers against a plain re-computation."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pytest

from panelwright.llm.linear import SCALE, SMOOTH, Scorer, fit_chain, pair_features, sigmoid, spelled, stems, word_hashes
from panelwright.llm.toxicity import MOST, REJECTED_FROM
from panelwright.llm.words import WORD, code_points

DATA = "/root/testdata/check_s"


def labelled():
    labels = f"{DATA}/labels.parquet" + "/*.parquet" * bool(glob.glob(f"{DATA}/labels.parquet/*"))
    return duckdb.sql(f"SELECT doc_id, any_value(d.text), any_value(quality), any_value(toxic) FROM '{DATA}/documents.parquet/*.parquet' d JOIN '{labels}' USING (doc_id) WHERE length(d.text) <= 50000 GROUP BY 1 ORDER BY hash(doc_id)").fetchall()


def chain(train, describe, pairs):
    low, toxic = (np.array([r[k] == v for r in train]) for k, v in ((2, 0), (3, 1)))
    return fit_chain([r[1] for r in train], [low, toxic, low & toxic], describe, pairs=pairs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_toxic_texts_are_found_held_out():
    rows = labelled()
    toxic, clean = ([r for r in rows if r[3] == v] for v in (1, 0))
    seen = {r[1] for r in toxic[:-400][: MOST[1]] + clean[:-2500][: MOST[0]]}
    train = sorted(toxic[:-400][: MOST[1]] + clean[:-2500][: MOST[0]], key=lambda r: r[0] * 2654435761 % 2**32)
    scorer = Scorer(chain(train, stems, False), stems, pairs=False)

    def rejected(part):
        p = scorer.probabilities(scorer.hashed([WORD.findall(r[1]) for r in part if r[1] not in seen])[1])
        return (np.maximum(p[:, 1], p[:, 2]) >= REJECTED_FROM).mean()

    assert rejected(toxic[-400:]) > 0.97 and rejected(clean[-2500:]) < 0.005


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize(("describe", "pairs"), [(stems, False), (spelled, True)])
def test_scores_equal_a_plain_computation(describe, pairs):
    rows = labelled()[:300]
    fits = chain(rows, describe, pairs)
    scorer = Scorer(fits, describe, pairs=pairs)
    texts = [r[1][:1500] for r in rows[:40]] + ["", "one", "é ü   x"]
    got = scorer.probabilities(scorer.hashed([WORD.findall(t) for t in texts])[1])
    for t, row in zip(texts, got, strict=True):
        words, before = WORD.findall(t), []
        for f, p in zip(fits, row, strict=True):
            total = sum(float(f.weights[describe([w])[1]].sum()) for w in words)
            if pairs and len(words) > 1:
                h = np.array([word_hashes(next(code_points([w]))[1], 1)[0] for w in words])
                total += float(f.weights[pair_features(h)].sum())
            z = SCALE * total / (len(words) + SMOOTH) + float(np.dot(before, f.extra)) + f.constant
            assert abs(p - sigmoid(f.slope * z + f.shift)) < 1e-3
            before.append(p)
