"""Few held-out texts of low quality pass the model that op2's sample sizes give."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pytest

from panelwright.llm.linear import Scorer, fit_chain, spelled
from panelwright.llm.quality_rules import KEPT_FROM, MOST
from panelwright.llm.words import WORD

DATA = "/root/testdata/check_s"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_low_quality_is_found_held_out():
    labels = f"{DATA}/labels.parquet" + "/*.parquet" * bool(glob.glob(f"{DATA}/labels.parquet/*"))
    rows = duckdb.sql(f"SELECT doc_id, any_value(d.text), any_value(quality) FROM '{DATA}/documents.parquet/*.parquet' d JOIN '{labels}' USING (doc_id) WHERE length(d.text) <= 50000 GROUP BY 1 ORDER BY hash(doc_id)").fetchall()
    good, low = ([r for r in rows if r[2] == v] for v in (1, 0))
    train = sorted(good[:-2500][: MOST[1]] + low[:-700][: MOST[0]], key=lambda r: r[0] * 2654435761 % 2**32)
    scorer = Scorer(fit_chain([r[1] for r in train], [np.array([r[2] for r in train])], spelled, pairs=True), spelled, pairs=True)
    kept = lambda part: (scorer.probabilities(scorer.hashed([WORD.findall(r[1]) for r in part])[1])[:, 0] >= KEPT_FROM).mean()
    assert kept(low[-700:]) < 0.03 and kept(good[-2500:]) > 0.99
