"""Language identification by a linear-chain conditional random field over words, summed to a document by its marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import excerpt
from .runtime import drop_written, keep_where, slices, tidied, written
from .words import WordTable, code_points, gram_hashes, word_hashes

#: Documents, characters of one (from a place given by its doc_id), and words that the field is fitted on, at most.
DOCS, LONGEST, WORDS = 1500, 20_000, 90_000
#: Half the buckets of documents of a language, by a hash, the first of each of which the field is fitted on besides DOCS, so
#: that a rare language has nearly all of its documents in the sample, or more than EACH.
EACH = 100
#: The share of held-out documents that the stage's limit may cost.
LOST = 0.001
#: Hash buckets of features; words of a language's lexicon; words of a training sequence; optimiser steps.
DIM, LEXICON, LENGTH, STEPS = 1 << 16, 2000, 48, 30
#: Bytes of texts that a worker labels at a time; a word takes some 200 bytes of arrays meanwhile.
SLICE = 1 << 20
#: What a text without letters gets.
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


@dataclass
class Field:
    """States, feature weights (DIM hashed features, then one per lexicon), transitions, and the lexicons."""

    states: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicons: list[frozenset]

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) pairs: first and last one to three letters, inner 2- and 3-grams, the word, its lexicons."""
        at, feature = [], []
        for rows, points in code_points(words):
            length = (points != 0).sum(1)
            at.append(rows)
            feature.append(word_hashes(points, 5) % np.uint64(DIM))
            for n in (2, 3):
                h, ok = gram_hashes(points, n, 6)
                i, j = np.nonzero(ok)
                at.append(rows[i])
                feature.append(h[i, j] % np.uint64(DIM))
            for n in (1, 2, 3):  # with the frame: the first and the last n letters
                h, ok = gram_hashes(points, n + 1, 7)
                if not h.shape[1]:
                    continue
                i = np.flatnonzero(ok[:, 0] & (length >= n + 2))
                at += [rows[i], rows[i]]
                feature += [h[i, 0] % np.uint64(DIM), h[i, length[i] - n - 1] % np.uint64(DIM)]
        for k, lexicon in enumerate(self.lexicons):
            held = np.array([i for i, w in enumerate(words) if w in lexicon], np.int64)
            at.append(held)
            feature.append(np.full(len(held), DIM + k))
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at), np.concatenate([np.asarray(f, np.int64) for f in feature])

    def emissions(self, words: list[str]) -> np.ndarray:
        word, feature = self.features(words)
        return np.stack([np.bincount(word, self.weights[feature, k], minlength=len(words)) for k in range(len(self.states))], 1)


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior state probabilities of every word of many sequences laid end to end, by forward-backward.

    The sequences advance together, longest first, so a step costs one small product for all that are still running.
    """
    n_states = emission.shape[1]
    phi = np.exp(emission - emission.max(1, keepdims=True))
    step = np.exp(moves - moves.max())
    ends = np.cumsum(lengths)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts, ends = lengths[order], (ends - lengths)[order], ends[order]
    running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    forward = np.empty_like(phi)
    state = np.full((len(order), n_states), 1 / n_states)
    for t, k in enumerate(running):
        at = starts[:k] + t
        state = (state[:k] if t == 0 else state[:k] @ step) * phi[at]
        state /= state.sum(1, keepdims=True)
        forward[at] = state
    state = np.ones((len(order), n_states))
    for t, k in enumerate(running):
        at = ends[:k] - 1 - t
        state = state[:k]
        if t:
            state = (state * phi[at + 1]) @ step.T
            state /= state.sum(1, keepdims=True)
        forward[at] *= state
    return forward / forward.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str]) -> Field:
    """A field fitted on code-switched sequences, made of spans of texts whose words bear their text's language.

    Gradients are expected minus observed feature and transition counts, by forward-backward; steps are Adam's.
    """
    states = sorted(set(langs))
    words = [letter_words(t) for t in texts]
    counts = {s: Counter() for s in states}
    for own, lang in zip(words, langs, strict=True):
        counts[lang].update(own)
    field = Field(states, np.zeros((DIM + len(states), len(states))), np.zeros((len(states),) * 2), [frozenset(w for w, _ in counts[s].most_common(LEXICON)) for s in states])
    rng = np.random.default_rng(11)
    spans = []
    for own, lang in zip(words, langs, strict=True):
        at = 0
        while at < len(own):
            n = int(rng.integers(6, LENGTH))
            spans.append((own[at : at + n], states.index(lang)))
            at += n
    order = rng.permutation(len(spans))
    taken, of_state, total = np.zeros(len(spans), bool), np.zeros(len(states), np.int64), 0
    for least in (WORDS // (2 * max(1, len(states))), WORDS):  # a share of the words for each language first
        for i in order:
            if total >= WORDS:
                break
            n, state = len(spans[i][0]), spans[i][1]
            if not taken[i] and of_state[state] < least:
                taken[i] = True
                of_state[state] += n
                total += n
    chosen = [spans[i] for i in order if taken[i]]
    if len(states) < 2 or not chosen:
        return field
    table: dict[str, int] = {}
    ids = np.array([table.setdefault(w, len(table)) for own, _ in chosen for w in own])
    truth = np.repeat([s for _, s in chosen], [len(own) for own, _ in chosen])
    lengths = np.full(-(-len(ids) // LENGTH), LENGTH)
    lengths[-1] = len(ids) - LENGTH * (len(lengths) - 1)
    word, feature = field.features(list(table))
    first = np.zeros(len(ids), bool)
    first[np.cumsum(lengths) - lengths] = True
    n, n_states = len(ids), len(states)
    observed = np.zeros((n, n_states))
    observed[np.arange(n), truth] = 1
    pairs = np.flatnonzero(~first)
    seen = np.zeros((n_states, n_states))
    np.add.at(seen, (truth[pairs - 1], truth[pairs]), 1)
    params = [field.weights, field.moves]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, STEPS + 1):
        e = np.stack([np.bincount(word, field.weights[feature, k], minlength=len(table)) for k in range(n_states)], 1)[ids]
        p = marginals(e, lengths, field.moves)
        # pair marginals: forward and backward messages are recovered from neighbouring marginals' potentials
        step = np.exp(field.moves - field.moves.max())
        left, right = _messages(e, lengths, field.moves)
        joint = left[pairs - 1][:, :, None] * step[None] * right[pairs][:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        word_error = np.stack([np.bincount(ids, (p - observed)[:, k], minlength=len(table)) for k in range(n_states)], 1)
        gradient = np.stack([np.bincount(feature, word_error[word, k], minlength=DIM + n_states) for k in range(n_states)], 1)
        for i, g in enumerate((gradient / n + 1e-5 * field.weights, (joint.sum(0) - seen) / n + 1e-5 * field.moves)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] -= 0.15 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    field.weights = field.weights.astype(np.float32)
    return field


def _messages(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward states, and backward states times the word's potential, of equally long sequences (the last may be shorter)."""
    phi, step = np.exp(e - e.max(1, keepdims=True)), np.exp(moves - moves.max())
    starts = np.cumsum(lengths) - lengths
    left, right = np.empty_like(phi), np.empty_like(phi)
    for t in range(int(lengths.max())):
        on = starts[lengths > t] + t
        x = phi[on] if t == 0 else (left[on - 1] @ step) * phi[on]
        left[on] = x / x.sum(1, keepdims=True)
    ends = starts + lengths
    for t in range(int(lengths.max())):
        on = ends[lengths > t] - 1 - t
        x = phi[on] if t == 0 else (right[on + 1] @ step.T) * phi[on]
        right[on] = x / x.sum(1, keepdims=True)
    return left, right


class Labeller:
    """Labels whole texts; keeps the emissions of words that this task has met."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.table = WordTable(lambda words: field.emissions(words).astype(np.float32))

    def labels(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        field, table = self.field, self.table
        table.trim()
        words = [letter_words(t) for t in texts]
        lettered = np.array([any(any(map(str.isalpha, w)) for w in own) for own in words], bool)
        names, scores = np.full(len(words), UNDETERMINED, object), np.zeros(len(words))
        lengths = np.array([len(w) for w in words], np.int64)
        if lettered.any() and field.states:
            at = table.at([w for own in words for w in own])
            p = marginals(table.filled()[at].astype(np.float64), lengths[lengths > 0], field.moves)
            whole = np.flatnonzero(lengths > 0)
            means = np.add.reduceat(p, (np.cumsum(lengths) - lengths)[whole]) / lengths[whole][:, None]
            for i, row in zip(whole.tolist(), means, strict=True):
                if lettered[i]:
                    names[i], scores[i] = field.states[int(row.argmax())], min(1.0, float(row.max()))
        return names, scores


def first_by_hash(ids: DataFrame, n: int) -> DataFrame:
    """The first `n` rows of `ids` (doc_id, ...) in the order of a hash, at most `n` rows on the driver.

    Hashes are spread evenly, so about twice `n` rows lie below a cut at that share of their range, and those alone are
    ordered: the task that merges gets as many, whatever the number of partitions. Should fewer than `n` lie there, as
    repeated ids may bring about, all rows are ordered.
    """
    h, total = F.xxhash64("doc_id"), ids.count()
    first = lambda rows: rows.orderBy(h, "doc_id").limit(n).collect()
    found = first(ids.where(h <= (2 * n << 64) // total - (1 << 63))) if total > 4 * n else []
    return ids.sparkSession.createDataFrame(found if len(found) == n else first(ids), ids.schema)


def fitted(docs: DataFrame) -> Broadcast:
    """The field, fitted on a bounded sample of the rows that aren't held out: DOCS of all, and some of every language."""
    spark = docs.sparkSession
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where((rest != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.select("doc_id", "lang")
    of_bucket = F.min(F.struct(order[0].alias("h"), "doc_id")).alias("first")  # partial minima: no task gets all rows of a language
    each = ids.groupBy("lang", F.pmod(order[0], F.lit(2 * EACH)).alias("bucket")).agg(of_bucket).select("first.doc_id", "lang")
    picked = first_by_hash(ids, DOCS).union(each).distinct()
    texts = known.withColumn("text", excerpt(F.col("text"), F.col("doc_id"), LONGEST)).join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")
    found: pd.DataFrame = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).withColumn("order", F.xxhash64("doc_id")).toPandas()
    found = found.sort_values(["order", "doc_id", "lang"])
    return spark.sparkContext.broadcast(fit(found["text"].tolist(), found["lang"].tolist()))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang; other columns are ignored).

    The field learns from text and non-null lang of a bounded sample of the rows whose crc32(doc_id as text) mod 5 isn't
    0; predictions see text alone. Words (runs of letters, lower case) are labelled by forward-backward over the whole
    text; lang_pred has the largest mean of marginals and score is that mean, so passages in other languages count by
    their words. A text that is null or without a letter gets `und` and 0, as do all texts if nothing can be learned.
    Rows of null (never held out) or repeated doc_id are answered each; an empty table gives no rows. One pass, no
    shuffle; a task holds a slice of texts.
    """
    shared = fitted(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for part in slices(batches, "text", SLICE):
            names, scores = labeller.labels(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(rest == 0, F.lit(False)).alias("held_out"), docs["text"])
    return rows.mapInArrow(tidied(predict), "doc_id long, held_out boolean, lang_pred string, score double")


def least_score(docs: DataFrame, shared: Broadcast) -> float:
    """The score that a text must have to count as of one language.

    That is the score which all but LOST of the held-out documents that are labelled right reach (all of them, by whole
    texts), yet at least midway between an even share of the languages and 1: two languages half and half reach 0.5 at
    most, whatever their number. With fewer than two languages scores say nothing, and every text with letters passes.
    The driver gets the lowest scores, LOST of them.
    """
    states = len(shared.value.states)
    if states < 2:
        return 0.0
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    held = docs.where((rest == 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for part in slices(batches, "text", SLICE):
            names, scores = labeller.labels(part.column("text").to_pylist())
            same = names == np.array(part.column("lang").to_pylist(), object)
            yield pa.RecordBatch.from_arrays([pa.array(scores[same], pa.float64())], ["score"])

    reached = written(held.mapInArrow(tidied(right), "score double"), "held-scores")
    place = LOST * max(0, reached.count() - 1)
    low = [r["score"] for r in reached.orderBy("score").limit(int(place) + 2).collect()]
    drop_written(reached)
    quantile = float(np.interp(place, np.arange(len(low)), low)) if low else 0.0
    return max((1 + 1 / states) / 2, quantile)


def with_language(docs: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, that have a language of a score of at least `least`; in one pass.

    By default `least` comes from held-out documents, see least_score().
    """
    shared = fitted(docs)
    if least is None:
        least = least_score(docs, shared)

    def judge():
        labeller = Labeller(shared.value)

        def kept(texts: list[str | None]) -> np.ndarray:
            names, scores = labeller.labels(texts)
            return (names != UNDETERMINED) & (scores >= least)

        return kept

    return keep_where(docs, judge, SLICE)
