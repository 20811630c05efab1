"""Bounded labelled samples and small fitting helpers shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, float]:
    """At most ``per_class`` documents of each class (0 and 1) with texts of 1 to ``max_chars`` characters, columns ``id``,
    ``text``, ``y``, and how many times as often labels 1 were picked as labels 0.  The choice is by hash of the id alone,
    the same in every run.

    Labels other than 0 and 1 and labels for absent documents are ignored; of several for one id the least counts."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"))
    order = F.xxhash64(F.lit("training"), "id")
    picked = [known.filter(F.col("y") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    chosen = picked[0].union(picked[1])  # 2 * per_class rows at most, so it can be broadcast
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.length("text").between(1, max_chars))
    rows = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    all_of = {r.y: min(per_class / r.n, 1.0) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return rows, all_of.get(1, 1.0) / all_of.get(0, 1.0)


def ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """``rows`` of a sample in order of a hash of the id."""
    return rows.sort_values("id", key=lambda s: pd.util.hash_array(s.to_numpy())).reset_index(drop=True)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, text: str = "text", doc_id: str = "doc_id") -> pd.DataFrame:
    """The rows of ``sampled``, ``ordered``, in pandas; the attribute ``odds`` has its second value."""
    rows, odds = sampled(docs, labels, label, per_class, max_chars, text, doc_id)
    out = ordered(rows.toPandas())
    out.attrs["odds"] = odds
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Weights (the last for the constant) of a ridge logistic regression, by Newton steps that are halved until the loss
    falls."""
    x = np.column_stack([x, np.ones(len(x))])
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + ridge * (w @ w) / 2
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-10:
            step = step / 2
        if now - then < 1e-9:
            break
        w, now = w + step, then
    return w


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The middle of the best range of cuts: ``x >= cut`` agrees most often with ``y``."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    right = np.concatenate(([ys.sum()], ys.sum() + np.cumsum(1 - 2 * ys)))
    ok = np.concatenate(([True], np.diff(xs) > 0, [True]))
    at = np.flatnonzero(ok & (right == right[ok].max()))
    lo, hi = int(at[0]), int(at[-1])
    left, top = xs[max(lo - 1, 0)], xs[min(hi, len(xs) - 1)]
    return float((left + top) / 2)
