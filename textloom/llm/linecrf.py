r"""Document quality from a linear-chain conditional random field over lines.

Each ``\n``-split line is good or bad. A line's features are dense facts about its
bytes and words, and the same facts of the lines before and after it; two states and a
2 x 2 table of transitions make the chain. Forward-backward gives each line's
probability of being good; a document's score is their mean weighted by line length
(bytes plus one). Labels are of documents, so in training each line carries its
document's label.

Chains are run side by side, position by position, so a batch costs a few numpy calls
for each line of its longest document. Learns from at most ``most`` labelled rows of each
class. A null or empty text is one empty line. Repeated rows are scored each, and alike. Columns named like the
results are replaced, others are kept. An empty table gives no rows; without labels of both kinds every text gets
one verdict. A very long text is scored whole, as a batch of its own, and must fit in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as T
from ._io import fold, labelled, scored

U64 = T.U64
_UPPER = T.table(range(65, 91))
_LOWER = T.table(range(97, 123))
_DIGIT = T.table(range(48, 58))
_HIGH = T.table(range(128, 256))
_SYMBOL = T.table(b"#*$%&|<>")
_BANG = T.table(b"!?")
_STOP = T.table(b".,;:")
_CLASSES = (_UPPER, _LOWER, _DIGIT, _HIGH, _SYMBOL, _BANG, _STOP)


def facts(buf: np.ndarray, off: np.ndarray) -> tuple[T.Spans, np.ndarray]:
    """Lines, and for each a row of facts between about 0 and 1."""
    ln = T.lines(buf, off)
    w = T.spans(buf, off, T.SPACE)
    total = lambda x, a, b: (c := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[b] - c[a]
    size = ln.end - ln.start
    some = np.maximum(size, 1)
    cols = [total(c[buf], ln.start, ln.end) / some for c in _CLASSES]
    first, last = np.searchsorted(w.start, ln.start), np.searchsorted(w.start, ln.end)
    n = last - first
    many = np.maximum(n, 1)
    if len(w.start):
        h = T.hashes(buf, w.start, w.end)
        odd = T.mix(h ^ T.mix(w.doc.astype(U64)))
        s, at = T.windows(h, w.doc, 3)
        cover = np.zeros(len(h) + 1, np.int64)
        if len(s):
            _, inv, k = np.unique(T.mix(s ^ T.mix(w.doc[at].astype(U64))), return_inverse=True, return_counts=True)
            again = at[k[inv] > 1]
            np.add.at(cover, again, 1)
            np.add.at(cover, again + 3, -1)
        repeated = np.cumsum(cover)[:-1] > 0
        _, place = np.unique(odd, return_index=True)
        new = np.zeros(len(h), bool)
        new[place] = True
        end = buf[w.end - 1]
        marked = _SYMBOL[end] | _BANG[end]
        alone = (w.end - w.start == 1) & _SYMBOL[end]
        caps = _UPPER[buf[w.start]] & ~_LOWER[end] & (w.end - w.start > 1)
        cols += [total(x, first, last) / many for x in (repeated, ~new, marked, alone, caps)]
    else:
        cols += [np.zeros(len(size))] * 5
    cols += [np.minimum(total(~T.SPACE[buf], ln.start, ln.end) / many / 12, 2), np.log1p(n) / 6, np.log1p(size) / 8, (n == 0).astype(float)]
    shape = np.zeros(len(size))
    ok = size > 0
    shape[ok] = _STOP[buf[ln.end[ok] - 1]]
    x = np.stack([*cols, shape], 1)
    return ln, np.concatenate([x, np.sqrt(x[:, :12])], 1)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[T.Spans, np.ndarray]:
    ln, x = facts(buf, off)
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = np.flatnonzero(ln.doc[1:] == ln.doc[:-1])
    before[same + 1], after[same] = x[same], x[same + 1]
    return ln, np.concatenate([x, before, after, np.ones((len(x), 1))], 1)


def marginals(unary: np.ndarray, trans: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected counts of the four transitions.

    unary: score of good over bad; trans: scores of (from, to); bound: first line of each document.
    """
    n = np.diff(bound)
    order = np.argsort(-n, kind="stable")
    first, size = bound[:-1][order], n[order]
    e = np.stack([np.zeros_like(unary), unary], 1)
    a, b = np.zeros_like(e), np.zeros_like(e)
    longest = int(size[0]) if len(size) else 0
    a[first] = e[first]
    for t in range(1, longest):
        at = first[: int(np.searchsorted(-size, -t, "left"))] + t
        a[at] = np.logaddexp(a[at - 1, :1] + trans[0], a[at - 1, 1:] + trans[1]) + e[at]
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = first[: int(np.searchsorted(-size, -t, "left"))] + t
        right = e[at] + b[at]
        b[at - 1] = np.logaddexp(trans[:, 0] + right[:, :1], trans[:, 1] + right[:, 1:])
        joint = a[at - 1][:, :, None] + trans + right[:, None, :]
        expected += np.exp(joint - np.logaddexp.reduce(joint.reshape(len(at), 4), axis=1)[:, None, None]).sum(0)
    s = a + b
    return 1 / (1 + np.exp(np.clip(s[:, 0] - s[:, 1], -40, 40))), expected


def fit(rows: list[tuple[str, int]], steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> dict:
    y = np.array([v for _, v in rows], int)
    width = 3 * 29 + 1
    if len(set(y.tolist())) < 2:
        w = np.zeros(width)
        w[-1] = 40.0 if not len(y) or y[0] else -40.0
        return {"w": w, "t": np.zeros((2, 2))}
    xs, docs, at = [], [], 0
    for _, hi, buf, off in T.slices(pa.array([t for t, _ in rows], pa.string())):
        ln, x = features(buf, off)
        xs.append(x)
        docs.append(ln.doc + at)
        at = hi
    x, doc = np.concatenate(xs), np.concatenate(docs)
    bound = T.per_doc(doc, len(y))
    good = y[doc].astype(float)
    steps_in = (np.diff(bound) - 1).clip(0)
    seen = np.diag([steps_in[y == 0].sum(), steps_in[y == 1].sum()]).astype(float)
    p = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, steps + 1):
        w, t = p[:-4], p[-4:].reshape(2, 2)
        q, expected = marginals(x @ w, t, bound)
        g = np.r_[x.T @ (q - good), (expected - seen).ravel()] / len(y) + l2 * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return {"w": p[:-4], "t": p[-4:].reshape(2, 2)}


def train(docs: DataFrame, labels: DataFrame, most: int = 1500) -> dict:
    """Learns from at most ``most`` labelled rows of each class (a documented bound)."""
    return fit(labelled(docs, labels, "quality", most))


def line_scores(model: dict, buf: np.ndarray, off: np.ndarray) -> tuple[T.Spans, np.ndarray]:
    """Lines and their probabilities of being good."""
    ln, x = features(buf, off)
    p, _ = marginals(x @ model["w"], model["t"], T.per_doc(ln.doc, len(off) - 1))
    return ln, p


def score(model: dict, texts: pa.Array) -> np.ndarray:
    out = []
    for lo, hi, buf, off in T.slices(texts):
        ln, p = line_scores(model, buf, off)
        weight = (ln.end - ln.start + 1).astype(float)
        out.append(np.bincount(ln.doc, weights=weight * p, minlength=hi - lo) / np.bincount(ln.doc, weights=weight, minlength=hi - lo))
    return np.clip(np.concatenate(out), 0, 1)


def line_quality(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The input's columns, then held_out (fold of 5 is 0), score and predicted (score at least ``threshold``)."""

    def run(texts: pa.Array) -> dict:
        s = score(model, texts)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    rest = [c for c in docs.columns if c not in ("score", "predicted", "held_out")]
    return scored(docs, run, "score double, predicted int", rest).withColumn("held_out", fold("doc_id", 5) == 0)
