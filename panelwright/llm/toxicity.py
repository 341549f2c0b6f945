"""Toxicity by a chain of linear classifiers: each category's model sees the probabilities of those before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .labelled import sample
from .linear import Scorer, fit_chain, stems
from .runtime import keep_where, slices, tidied
from .words import WORD

#: The chain: text that is low in quality, then toxic text (the label), then toxic text that is low in quality as well.
CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")
#: Labelled texts without and with toxicity that the chain is fitted on, at most; the probability that rejects a text.
MOST, REJECTED_FROM = {0: 2500, 1: 1500}, 0.5
#: Bytes of texts that a worker scores at a time.
SLICE = 1 << 20


def fitted(docs: DataFrame, labels: DataFrame) -> Broadcast:
    """The chain, fitted on a bounded sample."""
    found = sample(docs, labels, "toxic", MOST, ["quality", "toxic"])
    toxic, low = found["toxic"].to_numpy() == 1, found["quality"].to_numpy() == 0
    return docs.sparkSession.sparkContext.broadcast(fit_chain(found["text"].tolist(), [low, toxic, toxic & low], stems, pairs=False))


def _probabilities(scorer: Scorer, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    p = scorer.probabilities(scorer.hashed([WORD.findall(t or "") for t in texts])[1])
    return p, np.maximum(p[:, 1], p[:, 2]) >= REJECTED_FROM


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, a probability per category, toxic and kept (its opposite) for every row of `docs` (doc_id, text).

    `labels` has doc_id, quality and toxic (0 or 1); other columns are ignored. A null quality counts as good. The models are fitted on a bounded
    sample, with out-of-fold probabilities of earlier categories, and calibrated on out-of-fold scores. A null or empty
    text scores as one without words. Rows of null or repeated doc_id are answered each; an empty table gives no rows.
    Without toxic labels no text is toxic. Scoring is one pass without a shuffle.
    """
    shared = fitted(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, stems, pairs=False)
        for part in slices(batches, "text", SLICE):
            p, toxic = _probabilities(scorer, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, k]) for k in range(3)), pa.array(toxic), pa.array(~toxic)], ["doc_id", *CATEGORIES, "is_toxic", "kept"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(tidied(score), "doc_id long, low_quality double, toxic double, toxic_low_quality double, is_toxic boolean, kept boolean")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text toxicity() keeps; in the same pass, without a join."""
    shared = fitted(docs, labels)

    def judge():
        scorer = Scorer(shared.value, stems, pairs=False)
        return lambda texts: ~_probabilities(scorer, texts)[1]

    return keep_where(docs, judge, SLICE)
