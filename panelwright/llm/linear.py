"""Hashed n-gram logistic regression: shares of words with a feature, selected features, calibrated probabilities."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .words import WORD, WordTable, code_points, gram_hashes, mix, word_hashes

#: Hash buckets of features; features that a fit keeps; folds of out-of-fold scores; scale of shares.
DIM, KEEP, FOLDS, SCALE = 1 << 18, 4096, 3, 100.0
#: Words added to the number of words of a text when shares are taken, so that few words say less.
SMOOTH = 30

_OTHER = re.compile(r"[\W\d_]+")


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of words as written: the word, and its character n-grams with ends. Returns (word, feature) and hashes."""
    return _features(words, grams=(1, 2, 3), heads=())


def stems(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the letters of words, without case: all letters, and the first three to eight."""
    return _features([_OTHER.sub("", w).lower() for w in words], grams=(), heads=range(3, 9))


def _features(words, grams, heads) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, features, hashes = [], [], np.zeros(len(words), np.uint64)
    for rows, points in code_points(words):
        hashes[rows] = whole = word_hashes(points, 1)
        at.append(rows.astype(np.int32))
        features.append((whole % np.uint64(DIM)).astype(np.int32))
        for n in grams:
            h, ok = gram_hashes(points, n, 2)
            i, j = np.nonzero(ok)
            at.append(rows[i].astype(np.int32))
            features.append((h[i, j] % np.uint64(DIM)).astype(np.int32))
        for n in heads:
            if points.shape[1] > n:
                h, ok = gram_hashes(points[:, : n + 1], n + 1, 3)
                i = np.flatnonzero(ok[:, 0])
                at.append(rows[i].astype(np.int32))
                features.append((h[i, 0] % np.uint64(DIM)).astype(np.int32))
    if not at:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), hashes
    return np.concatenate(at), np.concatenate(features), hashes


def pair_features(h: np.ndarray) -> np.ndarray:
    """Features of neighbouring words; a word beside itself has one feature, whatever the word."""
    hashed = mix(h[:-1] ^ (h[1:] * np.uint64(0x9E3779B97F4A7C15)))
    return (np.where(h[:-1] == h[1:], np.uint64(1), hashed) % np.uint64(DIM)).astype(np.int64)


@dataclass
class Design:
    """Documents by features, as shares of words."""

    doc: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: list[str], describe: Callable, pairs: bool) -> Design:
        table = WordTable(lambda words: np.zeros(len(words)), cap=1 << 60)
        ats = [table.at(WORD.findall(t or "")) for t in texts]
        word, feature, hashes = describe(list(table))
        order = np.argsort(word, kind="stable")
        feature, ends = feature[order], np.searchsorted(word[order], np.arange(len(table) + 1))
        del word, order

        def shares(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own, count = np.unique(at, return_counts=True)
            lengths = ends[own + 1] - ends[own]
            take = np.repeat(ends[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            f, c = feature[take], np.repeat(count, lengths)
            if pairs and len(at) > 1:
                p = pair_features(hashes[at]).astype(f.dtype)
                f, c = np.concatenate([f, p]), np.concatenate([c, np.ones(len(p), count.dtype)])
            u, inverse = np.unique(f, return_inverse=True)
            return u, np.bincount(inverse, c) * (SCALE / (len(at) + SMOOTH))

        held = np.zeros(DIM, np.int32)  # features of under three texts are never chosen: they aren't kept
        for at in ats:
            if len(at):
                held[shares(at)[0]] += 1
        docs, features, values = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for i, at in enumerate(ats):
            if len(at):
                u, v = shares(at)
                keep = held[u] >= 3
                docs.append(np.full(int(keep.sum()), i, np.int32))
                features.append(u[keep].astype(np.int32))
                values.append(v[keep].astype(np.float32))
        return cls(np.concatenate(docs), np.concatenate(features), np.concatenate(values), len(texts))

    def rows(self, mask: np.ndarray) -> Design:
        new = np.cumsum(mask) - 1
        keep = mask[self.doc]
        return Design(new[self.doc[keep]], self.feature[keep], self.value[keep], int(mask.sum()))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, self.value * weights[self.feature], minlength=self.n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Fit:
    """Weights of features, of extra columns, and a constant; `calibrated` turns a score into a probability."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    extra: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def score(self, design: Design, extra: np.ndarray) -> np.ndarray:
        return design.times(self.weights) + extra @ self.extra + self.constant

    def calibrated(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * score + self.shift)


def fit(design: Design, y: np.ndarray, extra: np.ndarray, steps: int = 150, l1: float = 1e-2, l2: float = 1e-4) -> Fit:
    """Logistic regression with an elastic net, by accelerated proximal steps, on the features that differ most by class."""
    y = y.astype(float)
    if not 0 < y.sum() < len(y):
        return Fit(extra=np.zeros(extra.shape[1]), constant=20.0 if len(y) and y.all() else -20.0)
    n1, n0 = y.sum(), (1 - y).sum()
    one = y[design.doc] > 0
    sums = [np.bincount(design.feature[m], design.value[m], minlength=DIM) for m in (one, ~one)]
    squares = [np.bincount(design.feature[m], design.value[m] ** 2, minlength=DIM) for m in (one, ~one)]
    held = np.bincount(design.feature, minlength=DIM)
    means = [sums[0] / n1, sums[1] / n0]
    spread = np.sqrt((squares[0] / n1 - means[0] ** 2) / n1 + (squares[1] / n0 - means[1] ** 2) / n0 + 1e-9)
    rank = np.where(held >= 3, np.abs(means[0] - means[1]) / spread, -1)
    chosen = np.flatnonzero(rank >= np.sort(rank)[-KEEP])
    chosen = chosen[rank[chosen] > 0]
    column = np.full(DIM, -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[design.feature] >= 0
    doc, feature, value = design.doc[keep], column[design.feature[keep]], design.value[keep]
    scale = np.sqrt(np.bincount(feature, value**2, minlength=len(chosen)) / len(y)) + 1e-3
    value = value / scale[feature]
    width = len(chosen) + extra.shape[1] + 1
    full = lambda w: np.bincount(doc, value * w[feature], minlength=len(y)) + extra @ w[len(chosen) : -1] + w[-1]
    share = 0.5 * np.where(y > 0, 1 / n1, 1 / n0)  # both classes weigh the same
    back = lambda r: np.concatenate([np.bincount(feature, value * r[doc], minlength=len(chosen)), r @ extra, [r.sum()]])
    v = np.full(width, 1.0)
    for _ in range(12):  # the largest curvature, by power iteration
        v = back(share * full(v)) / 4
        bound = np.linalg.norm(v)
        v /= bound
    rate = 1 / (1.3 * bound + l2)
    w = at = np.zeros(width)
    t = 1.0
    for _ in range(steps):
        step = at - rate * (back(share * (sigmoid(full(at)) - y)) + l2 * np.append(at[:-1], 0))
        new = np.append(np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - rate * l1, 0), step[-1])
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        at, w = new + (before - 1) / t * (new - w), new
    out = Fit(extra=w[len(chosen) : -1].copy(), constant=float(w[-1]))
    out.weights[chosen] = w[: len(chosen)] / scale
    return out


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a probability from out-of-fold scores (smoothed targets, Newton steps)."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, p = np.stack([score, np.ones(len(score))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(x @ p)
        gradient = x.T @ (q - target) + 1e-3 * (p - [1.0, 0.0])
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


def fit_chain(texts: list[str], labels: list[np.ndarray], describe: Callable, pairs: bool, folds: int = FOLDS) -> list[Fit]:
    """A model per label, in order; each sees the out-of-fold probabilities of those before it, and is calibrated on its own."""
    design = Design.of(texts, describe, pairs)
    fold = np.arange(len(texts)) % folds
    extra, fits = np.zeros((len(texts), 0)), []
    for y in labels:
        score = np.zeros(len(texts))
        for k in range(folds):
            if (fold == k).any() and (fold != k).any():
                score[fold == k] = fit(design.rows(fold != k), y[fold != k], extra[fold != k]).score(design.rows(fold == k), extra[fold == k])
        whole = fit(design, y, extra)
        if 0 < y.sum() < len(y):
            whole.slope, whole.shift = calibrate(score, y)
        fits.append(whole)
        extra = np.column_stack([extra, whole.calibrated(score)])
    return fits


class Scorer:
    """Scores of whole texts, from the scores of words and of neighbouring words."""

    def __init__(self, fits: list[Fit], describe: Callable, pairs: bool) -> None:
        self.fits, self.pairs = fits, pairs
        weights = np.stack([f.weights for f in fits], 1)
        self.weights = weights * np.float32(SCALE)
        kind = np.dtype([("h", "u8"), ("s", "f4", (len(fits),))])

        def rows(words: list[str]) -> np.ndarray:
            out = np.zeros(len(words), kind)
            word, feature, out["h"] = describe(words)
            for k in range(len(fits)):
                out["s"][:, k] = np.bincount(word, self.weights[feature, k], minlength=len(words))
            return out

        self.table = WordTable(rows)

    def hashed(self, texts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Word hashes of each text, and mean scores of each text by model (0 of no words)."""
        self.table.trim()
        ats = [self.table.at(words) for words in texts]
        rows = self.table.filled()
        hashes, means = [], []
        for at in ats:
            own = rows[at]
            total = own["s"].sum(0, dtype=np.float64) if len(at) else np.zeros(len(self.fits))
            if self.pairs and len(at) > 1:
                total = total + self.weights[pair_features(own["h"])].sum(0, dtype=np.float64)
            hashes.append(own["h"])
            means.append(total / (len(at) + SMOOTH))
        return hashes, means

    def probabilities(self, means: list[np.ndarray]) -> np.ndarray:
        """Calibrated probabilities, model after model, each with those before it as further columns."""
        z, out = np.array(means).reshape(len(means), len(self.fits)), np.zeros((len(means), 0))
        for k, f in enumerate(self.fits):
            out = np.column_stack([out, f.calibrated(z[:, k] + out @ f.extra + f.constant)])
        return out
