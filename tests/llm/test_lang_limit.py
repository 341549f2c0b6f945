"""The pipeline's language limit comes from all held-out documents."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import lang_id

from .test_lang_sample import LETTERS, docs, prose  # noqa: F401


def test_limit_comes_from_all_held_out(spark, docs, monkeypatch):
    monkeypatch.setattr(lang_id, "LOST", 0.3)
    mixed = [(20000 + i, t + " " + prose(random.Random(i), LETTERS["bb" if lang == "aa" else "aa"], i % 12), lang) for i, t, lang in docs if lang != "cc"]
    df = spark.createDataFrame(docs + mixed + mixed, "doc_id long, text string, lang string")
    shared = lang_id.fitted(df)
    held = df.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).collect()
    names, scores = lang_id.Labeller(shared.value).labels([r.text for r in held])
    reached = [s for s, n, r in zip(scores, names, held) if n == r.lang]
    assert lang_id.least_score(df, shared) == pytest.approx(max(2 / 3, np.quantile(reached, 0.3)))
    assert np.quantile(reached, 0.3) > 2 / 3
