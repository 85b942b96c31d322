r"""Quality rules: counted facts of a text, then a calibrated linear model.

The counts are exact over the whole text. The model is logistic regression over
hashed word 1- and 2-grams and character (UTF-8 byte) 3-grams. A group's features
are relative frequencies, so a document's logit is a bias plus the mean weight of
its items in each group. It learns from at most ``most`` labelled rows of each
class; a fifth of them calibrates the logit (Platt scaling, weighted to the
classes' shares among all labelled training rows). Documents are scored in Arrow
batches against a fixed threshold, with no shuffle.

A null or empty text has zero counts and fails the base rules. Repeated rows give
repeated rows; other columns of the input are ignored. A probability equal to the threshold is kept. An empty
table gives no rows; without labels of both kinds every text gets one verdict. A very long text is counted
whole, as a batch of its own, and must fit in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import fold, labelled, scored

U64 = T.U64
BUCKETS = 1 << 16
SCALE = 30.0
_SYMBOL = T.table(b"#*$%&|<>")
REPEAT_WINDOW = 5


def counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    docs = len(off) - 1
    w = T.spans(buf, off, T.SPACE)
    h = T.hashes(buf, w.start, w.end)
    solid = ~T.SPACE[buf]
    ln = T.lines(buf, off)
    total = np.concatenate([[0], np.cumsum(solid)])
    full = total[ln.end] > total[ln.start]
    line_doc = ln.doc[full]
    key = T.mix(T.hashes(buf, ln.start[full], ln.end[full]) ^ T.mix(line_doc.astype(U64)))
    _, first = np.unique(key, return_index=True)
    dup = np.bincount(line_doc, minlength=docs) - np.bincount(line_doc[first], minlength=docs)
    s, at = T.windows(h, w.doc, REPEAT_WINDOW)
    mark = np.zeros(len(h) + 1, np.int64)
    if len(s):
        _, inv, n = np.unique(T.mix(s ^ T.mix(w.doc[at].astype(U64))), return_inverse=True, return_counts=True)
        again = at[n[inv] > 1]
        np.add.at(mark, again, 1)
        np.add.at(mark, again + REPEAT_WINDOW, -1)
    repeat = np.bincount(w.doc, weights=np.cumsum(mark)[:-1] > 0, minlength=docs)
    return {
        "n_words": np.bincount(w.doc, minlength=docs).astype(np.int64),
        "word_chars": T.sums(solid & T.LEAD[buf], off),
        "n_symbols": T.sums(_SYMBOL[buf], off),
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": repeat.astype(np.int64),
    }


def items(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of each item, by group: word 1-grams, word 2-grams, character 3-grams."""
    w = T.spans(buf, off, T.SPACE)
    h = T.hashes(buf, w.start, w.end)
    two, at = T.windows(h, w.doc, 2)
    out = [((h & U64(BUCKETS - 1)).astype(np.int64), w.doc), (((two >> U64(7)) & U64(BUCKETS - 1)).astype(np.int64), w.doc[at])]
    if len(buf) >= 3:
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        ok = np.flatnonzero(doc[:-2] == doc[2:])
        b = buf.astype(np.uint32)
        gram = (b[ok] << 16 | b[ok + 1] << 8 | b[ok + 2]) * np.uint32(2654435761)
        out.append(((gram >> np.uint32(16)).astype(np.int64), doc[ok]))
    else:
        out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


def logits(w: list[np.ndarray], bias: float, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    docs = len(off) - 1
    z = np.full(docs, bias)
    for weights, (ids, doc) in zip(w, items(buf, off), strict=True):
        n = np.bincount(doc, minlength=docs)
        z += SCALE * np.bincount(doc, weights=weights[ids], minlength=docs) / np.maximum(n, 1)
    return z


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a and b of P(1) = sigmoid(a z + b), by Newton's method with a weak prior at a = 1, b = 0."""
    t = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(30):
        p = sigmoid(x @ t)
        g = x.T @ (weight * (p - y)) + 1e-2 * (t - [1, 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        t = t - np.clip(np.linalg.solve(hess, g), -2, 2)
    return max(float(t[0]), 1e-3), float(t[1])


def sparse(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group: the distinct buckets of each document in turn, their scaled relative frequencies, and each document's bounds."""
    docs, out = len(off) - 1, []
    for ids, doc in items(buf, off):
        n = np.bincount(doc, minlength=docs)
        key, c = np.unique(doc * BUCKETS + ids, return_counts=True)
        d = key // BUCKETS
        out.append(((key % BUCKETS).astype(np.uint16), (SCALE * c / n[d]).astype(np.float32), T.per_doc(d, docs)))
    return out


def sums(w: np.ndarray, bias: float, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The logits of a block's documents; w holds the groups' weights one after another."""
    z = np.full(len(groups[0][2]) - 1, bias)
    for k, (ids, x, bound) in enumerate(groups):
        total = np.concatenate([[0.0], np.cumsum(w[k * BUCKETS : (k + 1) * BUCKETS][ids] * x)])
        z += total[bound[1:]] - total[bound[:-1]]
    return z


def fit(rows: list[tuple[str, int]], share: float, steps: int = 60, rate: float = 0.05, l2: float = 1e-6) -> dict:
    """rows: (text, label); share: of label 1 among all labelled rows."""
    if len({y for _, y in rows}) < 2:
        constant = float(rows[0][1]) if rows else 1.0
        return {"w": [np.zeros(BUCKETS, np.float32)] * 3, "bias": 0.0, "a": 1.0, "b": 40.0 if constant else -40.0}
    y = np.array([v for _, v in rows], float)
    blocks = [(lo, hi, sparse(buf, off)) for lo, hi, buf, off in T.slices(pa.array([t for t, _ in rows], pa.string()))]
    calibrate = np.arange(len(y)) % 5 == 4
    weight = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9))
    learn = ~calibrate
    w, bias = np.zeros(3 * BUCKETS), 0.0
    m, v = np.zeros(3 * BUCKETS + 1), np.zeros(3 * BUCKETS + 1)
    for step in range(1, steps + 1):
        g = np.zeros(3 * BUCKETS + 1)
        for lo, hi, groups in blocks:  # a block at a time, so that nothing but the counts themselves is as large as the sample
            err = (sigmoid(sums(w, bias, groups)) - y[lo:hi]) * learn[lo:hi] / learn.sum()
            for k, (ids, x, bound) in enumerate(groups):
                g[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(ids, weights=np.repeat(err, np.diff(bound)) * x, minlength=BUCKETS)
            g[-1] += err.sum()
        g[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    z = np.concatenate([sums(w, bias, groups) for _, _, groups in blocks])
    a, b = platt(z[calibrate], y[calibrate], weight[calibrate])
    return {"w": [k.astype(np.float32) for k in np.split(w, 3)], "bias": bias, "a": a, "b": b}


def train(docs: DataFrame, labels: DataFrame, most: int = 1500) -> dict:
    """Learns from at most ``most`` labelled rows of each class (a documented bound)."""
    n = labels.where(fold("doc_id", 5) != 0).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNotNull()).alias("all")).first()
    return fit(labelled(docs, labels, "quality", most), (n["good"] or 0) / max(n["all"] or 0, 1))


def verdicts(model: dict, texts: pa.Array, least_words: int = 10, most_repeat: int = 20, threshold: float = 0.3) -> dict[str, np.ndarray]:
    """The counts, base_failed, p_good and kept of each text."""
    out: dict[str, list] = {}
    for _, _, buf, off in T.slices(texts):
        c = counts(buf, off)
        c["base_failed"] = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeat * c["n_words"])
        c["p_good"] = sigmoid(model["a"] * logits(model["w"], model["bias"], buf, off) + model["b"])
        c["kept"] = ~c["base_failed"] & (c["p_good"] >= threshold)
        for k, v in c.items():
            out.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def quality_rules(docs: DataFrame, model: dict, least_words: int = 10, most_repeat: int = 20, threshold: float = 0.3) -> DataFrame:
    """doc_id, the counts, base_failed, p_good (calibrated probability of quality), kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeat`` hundredths of them repeated.
    kept: not base_failed, and p_good at least ``threshold``.
    """
    return scored(docs, lambda texts: verdicts(model, texts, least_words, most_repeat, threshold), "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double", ["doc_id"])
