"""Toxicity by FTRL-proximal logistic regression.

Features are the distinct hashed word 1-grams, 2-grams and skip-grams (a word and
the next but one) of a text; words are runs of letters and digits, A-Z lower-cased.
FTRL-proximal keeps a learning rate for each coordinate and an L1 penalty that leaves
most weights at exactly zero: the model is a short sorted table, bounded by the
sample's features, and is shipped with the task. Features of fewer than
``least_docs`` sampled documents are left out.

It learns from at most ``most`` toxic and ``most`` other labelled rows; a fifth of them
calibrates the logit to the classes' shares among all labelled training rows. A null
or empty text has no features and gets the bias's score. Other columns are kept as they
are, but for those named like the results; repeated rows give repeated rows. An empty table gives no rows; without
labels of both kinds every text gets one verdict. A very long text is scored whole and must fit in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import fold, labelled, scored
from .quality import platt, sigmoid

U64 = T.U64
#: Slots of the table that tells rare features before they are held.
SLOTS = 1 << 24


def items(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, document) of each occurrence."""
    buf = T.lower(raw)
    w = T.spans(buf, off, ~T.ALNUM)
    h = T.hashes(buf, w.start, w.end)
    out, doc = [h], [w.doc]
    for gap, salt in ((1, 0xA5A5A5A5A5A5A5A5), (2, 0xC3C3C3C3C3C3C3C3)):
        if len(h) > gap:
            at = np.flatnonzero(w.doc[:-gap] == w.doc[gap:])
            out.append(T.mix(h[at] * U64(3) + T.mix(h[at + gap] ^ U64(salt))))
            doc.append(w.doc[at])
    return np.concatenate(out), np.concatenate(doc)


def distinct(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (feature hash, document) by document."""
    f, d = items(buf, off)
    order = np.lexsort((f, d))
    f, d = f[order], d[order]
    new = np.r_[True, (f[1:] != f[:-1]) | (d[1:] != d[:-1])] if len(f) else np.zeros(0, bool)
    return f[new], d[new]


class Ftrl:
    """FTRL-proximal for logistic loss over binary sparse rows."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z = self.z[ids]
        shrunk = np.maximum(np.abs(z) - self.l1, 0)
        return -np.sign(z) * shrunk / ((self.beta + np.sqrt(self.n[ids])) / self.alpha + self.l2)

    def step(self, ids: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(ids)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -40, 40))) - y)
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g


def fit(rows: list[tuple[str, int]], share: float, epochs: int = 4, least_docs: int = 4) -> dict:
    """rows: (text, label); share: of label 1 among all labelled rows; least_docs: at most 255."""
    y = np.array([v for _, v in rows], float)
    if len(set(y.tolist())) < 2:
        constant = float(y[0]) if len(y) else 0.0
        return {"keys": np.zeros(0, U64), "w": np.zeros(0), "a": 1.0, "b": 40.0 if constant else -40.0}
    texts = pa.array([t for t, _ in rows], pa.string())
    # a slot of the hash table counts at least as many documents as each of its features has; most rare features go before any is held
    slots = np.zeros(SLOTS, np.uint8)
    for _, _, buf, off in T.slices(texts):
        f, _ = distinct(buf, off)
        at, n = np.unique(f & U64(SLOTS - 1), return_counts=True)
        slots[at] = np.minimum(slots[at] + n, 255)  # far above least_docs, so more need not be told apart
    found = []
    for lo, _, buf, off in T.slices(texts):
        f, d = distinct(buf, off)
        ok = slots[f & U64(SLOTS - 1)] >= least_docs
        found.append((f[ok], (d[ok] + lo).astype(np.int32)))
    del slots
    keys, n = np.unique(np.concatenate([f for f, _ in found]), return_counts=True)
    keys = keys[n >= least_docs]
    held = []
    for f, d in found:
        at, ok = T.lookup(keys, f)
        held.append((at[ok].astype(np.int32), d[ok]))
    place, d = (np.concatenate([x[k] for x in held]) for k in range(2))
    del n, found, held
    bound = T.per_doc(d, len(y))
    calibrate = np.arange(len(y)) % 5 == 4
    learner = Ftrl(len(keys) + 1)
    order = np.random.default_rng(3).permutation(np.flatnonzero(~calibrate))

    def row(i: int) -> np.ndarray:
        return np.r_[place[bound[i] : bound[i + 1]], len(keys)]

    for _ in range(epochs):
        for i in order:
            learner.step(row(i), y[i])
    w = learner.weights(np.arange(len(keys) + 1))
    z = np.array([w[row(i)].sum() for i in range(len(y))])
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    a, b = platt(z[calibrate], y[calibrate], weight[calibrate])
    some = np.flatnonzero(w[:-1])
    return {"keys": keys[some], "w": w[some], "a": a, "b": a * float(w[-1]) + b}


def train(docs: DataFrame, labels: DataFrame, most: int = 2500) -> dict:
    """Learns from at most ``most`` labelled rows of each class (a documented bound)."""
    n = labels.where(fold("doc_id", 5) != 0).agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic").isNotNull()).alias("all")).first()
    return fit(labelled(docs, labels, "toxic", most), (n["toxic"] or 0) / max(n["all"] or 0, 1))


def score(model: dict, texts: pa.Array) -> np.ndarray:
    out = []
    for lo, hi, buf, off in T.slices(texts):
        f, d = items(buf, off)
        place, ok = T.lookup(model["keys"], f)
        hit = np.unique(d[ok] * (len(model["keys"]) + 1) + place[ok])
        sums = np.bincount(hit // (len(model["keys"]) + 1), weights=model["w"][hit % (len(model["keys"]) + 1)], minlength=hi - lo)
        out.append(sigmoid(model["a"] * sums + model["b"]))
    return np.concatenate(out)


def toxicity(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The input's columns, then held_out (fold of 5 is 0), score and predicted (score at least ``threshold``)."""

    def run(texts: pa.Array) -> dict:
        s = score(model, texts)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    rest = [c for c in docs.columns if c not in ("score", "predicted", "held_out")]
    return scored(docs, run, "score double, predicted int", rest).withColumn("held_out", fold("doc_id", 5) == 0)
