"""Line quality by a linear-chain conditional random field.

Every line of a document is labelled good or bad from features of the line and of its neighbours; transitions tie
consecutive lines together.  Forward-backward gives each line's probability of being good, and their mean weighted by
line length is the document's quality, calibrated to a score.  Only documents have labels: lines first take their
document's label, then lines of bad documents that the model finds good are set right, and the model is fitted again.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import best_cut, logistic, sample, sigmoid

#: Bounds of the training sample: documents of each class, characters of a document.
PER_CLASS, MAX_CHARS = 600, 20_000
#: Lines, padding included, whose chains run side by side; lines whose features become an array at once; characters of texts
#: that are scored together.
CELLS, PIECE, TOGETHER = 1 << 17, 1 << 13, 1 << 20
_OWN = 15


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines that hold a word; neighbours' features come after a line's own."""
    rows, lengths, seen, pieces = [], [], set(), []
    for line in (text or "").split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        c = line.count
        chars = len(line)
        rows.append((
            1.0,
            min(n, 50) / 50,
            (chars - n) / n / 10,
            (c("#") + c("*") + c("$") + c("%") + c("&") + c("<") + c(">") + c("@") + c("=")) / n,
            c("|") / n,
            c("!") / n,
            sum(map(str.isupper, words)) / n,
            sum(map(operator.eq, words, words[1:])) / n,
            1 - len(set(words)) / n,
            (c(".") + c(",") + c(";") + c(":")) / n,
            sum(map(str.isdigit, words)) / n,
            float(line in seen),
            float(words[0][:1].isupper()),
            float(line.rstrip()[-1] in ".!?:"),
            float(n < 4),
        ))
        seen.add(line)
        lengths.append(chars)
        if len(rows) == PIECE:
            pieces.append(np.array(rows, np.float32))
            rows = []
    if not lengths:
        return np.zeros((0, 3 * _OWN)), np.zeros(0)
    own = np.clip(np.vstack([*pieces, np.array(rows, np.float32).reshape(-1, _OWN)]), 0, 3)
    none = np.zeros((1, _OWN))
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])]), np.array(lengths, float)


def _marginals(scores: list[np.ndarray], transition: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """P(good) of each line, expected transition counts and the log partition sum.  Documents run side by side, the
    longest first, so a step works on all documents that are still going."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0)] * len(scores)
    pairs, total = np.zeros((2, 2)), 0.0
    m = np.exp(transition)
    at = 0
    while at < len(order) and lengths[at]:
        n = max(1, min(512, CELLS // int(lengths[at])))
        rows, size = order[at : at + n], lengths[at : at + n]
        at += n
        good = np.zeros((size[0], len(rows)))
        for k, i in enumerate(rows):
            good[: size[k], k] = scores[i]
        good = np.clip(good, -30, 30)
        live = [int((size > t).sum()) for t in range(size[0])]
        phi = np.stack([np.exp(-np.maximum(good, 0)), np.exp(np.minimum(good, 0))], axis=2)
        total += float(np.maximum(good, 0)[np.arange(size[0])[:, None] < size].sum())
        forward = np.zeros_like(phi)
        scale = np.ones(phi.shape[:2])
        for t in range(size[0]):
            a = phi[t, : live[t]] * (forward[t - 1, : live[t]] @ m if t else 1.0)
            scale[t, : live[t]] = a.sum(axis=1)
            forward[t, : live[t]] = a / scale[t, : live[t], None]
        total += float(np.log(scale).sum())
        back = np.ones_like(phi)
        for t in range(size[0] - 2, -1, -1):
            k = live[t + 1]
            ahead = phi[t + 1, :k] * back[t + 1, :k] / scale[t + 1, :k, None]
            pairs += m * (forward[t, :k].T @ ahead)
            back[t, :k] = ahead @ m.T
        p = forward[:, :, 1] * back[:, :, 1]
        for k, i in enumerate(rows):
            out[i] = p[: size[k], k]
    return out, pairs, total


def _fit_chain(features: list[np.ndarray], labels: list[np.ndarray], start=None, rounds: int = 120, ridge: float = 1.0):
    """Weights and transitions that maximise the ridged conditional likelihood, by Adam on the full gradient."""
    x, y = np.vstack(features), np.concatenate(labels)
    cuts = np.cumsum([len(f) for f in features])[:-1]
    w = np.zeros(x.shape[1] + 4) if start is None else start.copy()
    seen = np.zeros((2, 2))
    for lab in labels:
        np.add.at(seen, (lab[:-1], lab[1:]), 1)
    m = v = np.zeros_like(w)
    for k in range(1, rounds + 1):
        p, pairs, _ = _marginals(np.split(x @ w[:-4], cuts), w[-4:].reshape(2, 2))
        grad = np.concatenate([x.T @ (y - np.concatenate(p)), (seen - pairs).ravel()]) - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


@dataclass(frozen=True)
class LineModel:
    """Weights of the features, transitions (from, to) and the calibration: slope and cut of the logit of a document's
    quality, and the logit that a score takes at the cut."""

    weights: np.ndarray
    transition: np.ndarray
    slope: float
    cut: float
    at_cut: float

    def lines(self, features: list[np.ndarray]) -> list[np.ndarray]:
        return _marginals([f @ self.weights for f in features], self.transition)[0]

    def logits(self, texts) -> np.ndarray:
        """Logit of the length-weighted mean probability of good lines; texts without lines have the lowest."""
        made = [line_features(t) for t in texts]
        q = np.array([(p @ n) / n.sum() if len(p) else 0.0 for p, (_, n) in zip(self.lines([f for f, _ in made]), made, strict=True)])
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.log(q / (1 - q))

    def score(self, texts) -> np.ndarray:
        return sigmoid(self.slope * (self.logits(texts) - self.cut) + self.at_cut)


def fit(texts: list[str], good: np.ndarray, threshold: float = 0.3, passes: int = 3) -> LineModel:
    """A model from texts and their labels; a score of ``threshold`` is where labels are told apart best.  With one class
    only, scores follow the model's start: every line as likely good as not."""
    good = np.asarray(good, np.int64)
    at_cut = float(np.log(threshold / (1 - threshold)))
    made = [line_features(t) for t in texts]
    keep = [i for i, (f, _) in enumerate(made) if len(f)]
    if len({*good[keep].tolist()}) < 2:
        return LineModel(np.zeros(3 * _OWN), np.zeros((2, 2)), 1.0, 0.0, at_cut)
    features, y = [made[i][0] for i in keep], good[keep]
    labels = [np.full(len(f), v) for f, v in zip(features, y, strict=True)]
    w = None
    for _ in range(passes):
        w = _fit_chain(features, labels, w)
        p = _marginals([f @ w[:-4] for f in features], w[-4:].reshape(2, 2))[0]
        for i in np.flatnonzero(y == 0):
            labels[i] = (p[i] > 0.5).astype(np.int64)
            labels[i][np.argmin(p[i])] = 0
    model = LineModel(w[:-4], w[-4:].reshape(2, 2), 1.0, 0.0, at_cut)
    x = model.logits([texts[i] for i in keep])
    slope = float(np.clip(logistic(x[:, None], y, ridge=1.0)[0], 0.3, 3.0))
    return LineModel(model.weights, model.transition, slope, best_cut(x, y), at_cut)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> LineModel:
    """A model from a bounded sample of the labelled documents."""
    rows = sample(docs, labels, label, per_class, max_chars, text, doc_id)
    return fit(rows["text"].tolist(), rows["y"].to_numpy(), threshold)


def _runs(sizes: list[float]) -> list[tuple[int, int]]:
    """Bounds of runs of at most 256 texts and ``TOGETHER`` characters, or of one text."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > TOGETHER or i - at == 256):
            out.append((at, i))
            at, total = i, 0
        total += n
    return [*out, (at, len(sizes))] if sizes else []


def with_quality(docs: DataFrame, model: LineModel, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text in column ``name``, an existing one replaced; null and empty
    texts have the lowest quality.  Texts are handled a few at a time, whatever the batch, and a long one alone: memory follows
    the longest text, about 1 kB a line."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        out = [model.score(texts.iloc[i:j]) for i, j in _runs(texts.str.len().fillna(0).tolist())]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, of(text))
