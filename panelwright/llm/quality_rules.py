"""Quality rules: counts of a text, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import sample
from .linear import Scorer, fit_chain, spelled
from .runtime import slices, tidied
from .words import WORD, mix

#: Labelled texts of low and of good quality that the model is fitted on, at most; the probability that keeps a text.
MOST, KEPT_FROM = {0: 2000, 1: 3000}, 0.5

#: Bytes of texts that a worker scores at a time.
SLICE = 4 << 20

_SPACE, _SYMBOLS, _WINDOW = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>", 8


def repeated_words(h: np.ndarray, window: int = _WINDOW) -> int:
    """Words that lie in a window of `window` words which occurs twice or more, its first occurrence included."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    acc = np.zeros(n, np.uint64)
    for k in range(window):
        acc = mix(acc ^ h[k : k + n])
    ordered = np.sort(acc)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(acc, twice))
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability per row.

    `docs` has doc_id and text, `labels` doc_id and quality (1 is good); other columns are ignored. A text fails the
    base rules if it has under 20 words or over 30 % of its words lie in repeated windows; else it is kept if its
    calibrated probability of good quality is at least KEPT_FROM. A null text has no words. Rows of null or repeated
    doc_id are answered each. Without labels of both values every text that passes the base rules is kept if the
    only value is good, or if there is none. The model is fitted on a bounded sample; scoring is one pass, no shuffle.
    """
    found = sample(docs, labels, "quality", MOST, ["quality"])
    y = found["quality"].to_numpy()
    fits = fit_chain(found["text"].tolist(), [y if len(y) else np.ones(0)], spelled, pairs=True)
    if not len(y):
        fits[0].constant = 20.0
    shared = docs.sparkSession.sparkContext.broadcast(fits)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, spelled, pairs=True)
        for part in slices(batches, "text", SLICE):
            texts = [t or "" for t in part.column("text").to_pylist()]
            words = [WORD.findall(t) for t in texts]
            hashes, means = scorer.hashed(words)
            p = scorer.probabilities(means)[:, 0]
            n_words = np.array([len(w) for w in words], np.int64)
            word_chars = [sum(map(len, w)) for w in words]
            symbols = [sum(map(t.count, _SYMBOLS)) for t in texts]
            repeats = np.array([repeated_words(h) for h in hashes], np.int64)
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            columns = [n_words, word_chars, symbols, [duplicate_lines(t) for t in texts], repeats, failed, ~failed & (p >= KEPT_FROM), p]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(tidied(score), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
