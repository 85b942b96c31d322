r"""Language-model scores: exact counts, and a hashed maximum-entropy model.

Tokens are the words ``[^\x20\x09-\x0D]+`` (A-Z lower-cased) and one end a text. The
count of each token over all training documents is a table as large as the vocabulary;
it is never collected. The most frequent words, at most ``most_top``, are shipped with
the scoring tasks (a bounded table); the rest of a text's words meet their counts in a
join, where no key is frequent.

The model is a class-factored softmax: P(word | context) = P(class | context) P(slot | class,
context) P(word | slot). A word's class depends on a bucket of its last bytes, and buckets are
clustered by their neighbours. Inside a class the ``OWN`` most frequent words have a slot each;
the class's other words share ``REST`` slots by hash, and inside such a slot P(word | slot) is
(c + 1) / (N_slot + V_slot + 1), so that words never seen have a share. Both softmaxes are
maximum-entropy models over hashed features of the context: the word before, the two before
(n-grams), the one before that alone (a skip) and, for the classes, the bucket of the word
before; their priors are the exact counts.

Training is distributed: each step takes the learning rows of one fold of the ids (each row
gives its gradient once in ``steps`` steps), a task sends the sums of its gradients, which have a fixed
size, tasks add them up block by block, and the driver steps by gradient over expected count, damped and clipped.

Clusters, gradients, counts and scores cover all rows: nothing is sampled. A null text is empty:
one end. Repeated rows are counted and scored each; a null id is of fold 0. Other columns are ignored.
An empty table gives no rows. A very long text is read as a slice of its own and must fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import fold, mapped, stored

U64 = T.U64
BUCKETS = 8192
#: Rows of the hashed weights of classes and of slots.
FEATURES = 1 << 16
SLOT_ROWS = 1 << 14
CLASSES = 16
#: Slots of a class: one for each of its most frequent words, and shared ones for all others.
OWN, REST = 24, 8
SLOTS_IN = OWN + REST
END = U64(0x454E44)
_COUNT_BYTES = 4 << 20
#: Neighbours' buckets are folded to this number for the clusters.
_WIDE = 256
#: Tokens whose scores are held at once.
_ROWS = 1 << 15


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bucket, document) of each token, ends included, in order."""
    docs = len(off) - 1
    buf = T.lower(raw)
    w = T.spans(buf, off, T.SPACE)
    h = T.hashes(buf, w.start, w.end)
    size = w.end - w.start
    tail = np.zeros(len(h), U64)
    for k in range(1, 4):
        has = size >= k
        tail[has] = tail[has] << U64(8) | buf[w.end[has] - k].astype(U64)
    bucket = (T.mix(tail * U64(8) + np.minimum(size, 4).astype(U64)) % U64(BUCKETS - 1)).astype(np.int64)
    n = np.bincount(w.doc, minlength=docs)
    place = np.arange(len(h)) + w.doc
    ends = np.cumsum(n) + np.arange(docs)
    out_h, out_b, out_d = np.full(len(h) + docs, END, U64), np.full(len(h) + docs, BUCKETS - 1, np.int64), np.repeat(np.arange(docs), n + 1)
    out_h[place], out_b[place] = h, bucket
    out_h[ends] = END
    return out_h, out_b, out_d


def features(h: np.ndarray, bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashed features of the context of each token: the word before, the two before, the one before that, the bucket of the word before.

    Before a text's start stands the end token.
    """
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    one, two, tail = (np.full(len(h), END, U64) for _ in range(3))
    one[1:] = h[:-1]
    tail[1:] = bucket[:-1].astype(U64)
    one[first], tail[first] = END, U64(BUCKETS - 1)
    two[1:] = one[:-1]
    two[first] = END
    pair = one * U64(0x9E3779B97F4A7C15) + T.mix(two)
    return np.stack([(T.mix(x + U64(k << 40)) >> U64(48)).astype(np.int64) % FEATURES for k, x in enumerate((one, pair, two, tail), 1)])


def rows_of(features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of the slots' weights: each n-gram and skip feature, joined with the class and hashed again."""
    return (T.mix((features[:3] * CLASSES + y).astype(U64) * U64(0xD6E8FEB86659FD93)) >> U64(48)).astype(np.int64) % SLOT_ROWS


def raised(w: np.ndarray, prior: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all outcomes, a row for each token, and their exponentials. prior: logs, one row or a row for each token.

    Weights are clipped sums of a few steps, so exponentials stay in range.
    """
    z = w[features[0]]
    for f in features[1:]:
        z += w[f]
    z += prior
    return z, np.exp(z)


def picked(w: np.ndarray, prior: np.ndarray, features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of the probability of outcome y of each token."""
    z, e = raised(w, prior, features)
    return z[np.arange(len(y)), y] - np.log(e.sum(axis=1))


def missed(w: np.ndarray, prior: np.ndarray, features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(outcome is y) - P(outcome), a row for each token."""
    _, e = raised(w, prior, features)
    e /= -e.sum(axis=1, keepdims=True)
    e[np.arange(len(y)), y] += 1
    return e


class Slots:
    """Classes of buckets, slots of words, and their counts."""

    def __init__(self, of: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray):
        """top: hashes (signed), counts and buckets of the most frequent words; sizes: BUCKETS x REST x (tokens, tokens and types)."""
        h, n, bucket = top
        y = of[bucket]
        order = np.lexsort((h, -n, y))
        place = np.arange(len(order)) - np.searchsorted(y[order], y[order])
        own = order[place < OWN]
        slot = place[place < OWN]
        back = np.argsort(h[own])
        self.of, self.h, self.slot = of, h[own][back], slot[back]
        full = np.zeros((CLASSES, REST, 2))
        np.add.at(full, of, sizes)
        np.add.at(full, (y[own], rest_slot(h[own])), -np.stack([n[own], n[own] + 1], 1).astype(float))
        self.log_size = np.log10(np.maximum(full[:, :, 1], 0) + 1)
        own_n = np.zeros((CLASSES, OWN))
        own_n[y[own], slot] = n[own]
        mass = np.concatenate([own_n, np.maximum(full[:, :, 0], 0)], 1)
        live = np.concatenate([own_n > 0, np.ones((CLASSES, REST), bool)], 1)
        per = mass.sum(1) + 1
        self.class_prior = np.log(per / per.sum()).astype(np.float32)
        # a slot that no word has is out of the softmax
        self.slot_prior = np.where(live, np.log((mass + 0.5) / (mass.sum(1, keepdims=True) + 0.5 * SLOTS_IN)), -1e4).astype(np.float32)

    def find(self, h: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, slot, whether the slot is the word's own) of each token."""
        y = self.of[bucket]
        at, ok = T.lookup(self.h, T.signed(h))
        slot = rest_slot(T.signed(h)) + OWN
        if len(self.h):
            slot[ok] = self.slot[at[ok]]
        return y, slot, ok


def rest_slot(h: np.ndarray) -> np.ndarray:
    return (h >> 40) & (REST - 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """h, bucket and n of every token of the texts; tokens of a slice are summed before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, off in T.slices(b.column(0), _COUNT_BYTES):
                h, bucket, _ = tokens(buf, off)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(u)), pa.array(bucket[first].astype(np.int32)), pa.array(n)], ["h", "bucket", "n"])

    return mapped(docs.select("text"), run, "h long, bucket int, n long").groupBy("h").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


def neighbours(docs: DataFrame) -> DataFrame:
    """at and n: how often a bucket (at // (2 * _WIDE)) has a right or left neighbour, over all tokens; at most BUCKETS * 2 * _WIDE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in T.slices(batch.column(0), _COUNT_BYTES):
                _, b, d = tokens(buf, off)
                ok = np.flatnonzero(d[1:] == d[:-1])
                left, right = b[ok], b[ok + 1]
                u, n = np.unique(np.r_[left * 2 * _WIDE + right % _WIDE, (right * 2 + 1) * _WIDE + left % _WIDE], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), pa.array(n)], ["at", "n"])

    return mapped(docs.select("text"), run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))


def clusters(around: np.ndarray, n: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The class of each bucket, by spherical k-means of the neighbours' buckets (``around``: BUCKETS x 2 * _WIDE counts); n: tokens of each bucket."""
    x = np.sqrt(around, dtype=np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    order = np.argsort(-n, kind="stable")
    some = order[: max(int((n > 0).sum()), 1)]
    c = x[some[np.linspace(0, min(len(some), 400) - 1, CLASSES).astype(int)]]
    weight = np.where(n > 0, np.sqrt(n), 0).astype(np.float32)
    weight[some[:1]] = max(weight[some[0]], 1)  # an empty corpus has one bucket
    for _ in range(rounds):
        near = np.where(weight > 0, (x @ c.T).argmax(1), -1)
        c = np.stack([weight[at] @ x[at] if len(at := np.flatnonzero(near == k)) else c[k] for k in range(CLASSES)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    # a bucket that no training text has goes by its number
    return np.where(n > 0, (x @ c.T).argmax(1), np.arange(BUCKETS) % CLASSES)


def scatter(f: np.ndarray, err: np.ndarray, rows: int) -> np.ndarray:
    """Sums of err's rows by each of their features."""
    out, at, many = np.empty((err.shape[1], rows)), f.ravel(), len(f)
    for k, column in enumerate(np.ascontiguousarray(err.T, float)):
        out[k] = np.bincount(at, weights=np.tile(column, many), minlength=rows)
    return out.T


def gradient(h: np.ndarray, bucket: np.ndarray, doc: np.ndarray, slots: Slots, w: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Sums over the tokens: the log-likelihood's gradient of class weights and of slot weights, and how often each of their features is met."""
    y, s, _ = slots.find(h, bucket)
    every = features(h, bucket, doc)
    total: list[np.ndarray] = []
    for lo in range(0, len(y), _ROWS):
        cut = slice(lo, lo + _ROWS)
        f, c = every[:, cut], y[cut]
        r = rows_of(f, c)
        a, b = missed(w, slots.class_prior, f, c), missed(v, slots.slot_prior[c], r, s[cut])
        got = [scatter(f, a, FEATURES), scatter(r, b, SLOT_ROWS), np.bincount(f.ravel(), minlength=FEATURES), np.bincount(r.ravel(), minlength=SLOT_ROWS)]
        total = [x + z for x, z in zip(total, got, strict=True)] if total else got
    return total


def packed(x: np.ndarray) -> tuple[float, bytes]:
    """A scale and half-precision numbers; sums of many tasks need no more, and they are half as many bytes to send."""
    top = float(np.abs(x).max(initial=0.0)) or 1.0
    return top, (x * (32768 / top)).astype("<f2").tobytes()


def unpacked(top: float, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f2").astype(float) * (top / 32768)


def train(docs: DataFrame, slots: Slots, steps: int = 6, rate: float = 0.3, damp: float = 4.0, blocks: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and of slots. In each step a task sums the gradients of its rows and sends them in ``blocks`` blocks of feature rows;
    the tasks of the next stage add up a block each, so every number is shuffled once and the driver gets one table. A step has at most
    twice as many tasks as the cluster has cores, however large the input is, so that gradients, which have a fixed size, are few.
    """
    w, v = np.zeros((FEATURES, CLASSES), np.float32), np.zeros((SLOT_ROWS, SLOTS_IN), np.float32)
    most = 2 * docs.sparkSession.sparkContext.defaultParallelism
    p, q = np.exp(slots.class_prior), np.exp(slots.slot_prior).mean(0)
    turn = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(steps))
    names = ["g", "task", *"abcd", *(f"{k}_top" for k in "abcd")]

    def sent(g: int, task: int, sums: list[np.ndarray]) -> pa.RecordBatch:
        tops, raw = zip(*(packed(x.ravel()) for x in sums), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([task], pa.int32()), *(pa.array([x]) for x in raw), *(pa.array([x]) for x in tops)], names)

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, []
        for part in parts:
            for row in part.to_pylist():
                got = [unpacked(row[f"{k}_top"], row[k]) for k in "abcd"]
                if at is not None and row["g"] != at:
                    yield sent(at, 0, total)
                    total = []
                at, total = row["g"], [x + z for x, z in zip(total, got, strict=True)] if total else got
        if at is not None:
            yield sent(at, 0, total)

    kinds = "g int, task int, a binary, b binary, c binary, d binary, a_top double, b_top double, c_top double, d_top double"
    for step in range(steps):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, v: np.ndarray = v) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray] = []
            for batch in batches:
                for _, _, buf, off in T.slices(batch.column(0), _COUNT_BYTES):
                    got = gradient(*tokens(buf, off), slots, w, v)
                    total = [x + z for x, z in zip(total, got, strict=True)] if total else got
            if total:
                for g, sums in enumerate(zip(*(np.split(x, blocks) for x in total), strict=True)):
                    yield sent(g, TaskContext.get().partitionId(), list(sums))

        each = mapped(docs.where(turn == step).select("text").coalesce(most), run, kinds)
        made = sorted(mapped(each.repartition(blocks, "g").sortWithinPartitions("g", "task"), added, kinds).collect(), key=lambda r: r["g"])
        if not made:
            continue
        a, b, c, d = (np.concatenate([unpacked(r[f"{k}_top"], r[k]) for r in made]) for k in "abcd")
        w = w + np.clip(rate * a.reshape(w.shape) / (c[:, None] * p * (1 - p) + damp), -1, 1).astype(np.float32)
        v = v + np.clip(rate * b.reshape(v.shape) / (d[:, None] * q * (1 - q) + damp), -1, 1).astype(np.float32)
    return w, v


def top_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, counts and buckets of the most frequent words: all from the least count at which they are at most ``most``."""
    step = F.floor(F.log2("n") * 8).cast("int")
    bars = {r["s"]: r["k"] for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()}
    held, least = 0, None
    for s in sorted(bars, reverse=True):
        if held + bars[s] > most:
            break
        held, least = held + bars[s], s
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(step >= least).select("h", "n", "bucket").toArrow()
    h, n, bucket = (got[c].to_numpy() for c in ("h", "n", "bucket"))
    order = np.argsort(h)
    return h[order], n[order], bucket[order].astype(np.int64)


class Model(NamedTuple):
    """counts: h, bucket and n of every training token's word, a stored table; all else is of bounded size."""

    counts: DataFrame
    tokens: int
    types: int
    top: tuple[np.ndarray, np.ndarray, np.ndarray]
    slots: Slots
    w: np.ndarray
    v: np.ndarray


def learn(docs: DataFrame, most_top: int = 262_144, steps: int = 6) -> Model:
    """Learns from the rows of docs (doc_id, text without nulls) whose fold of 7 is not 2."""
    rows = docs.where(fold("doc_id", 7) != 2)
    counts = stored(word_counts(rows), "counts")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    sizes = np.zeros((BUCKETS, REST, 2))
    part = F.shiftright("h", 40).bitwiseAND(REST - 1)
    by = counts.groupBy("bucket", part.alias("part")).agg(F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("z")).toArrow()
    sizes[by["bucket"].to_numpy(), by["part"].to_numpy()] = np.stack([by["n"].to_numpy(), by["z"].to_numpy()], 1)
    around = np.zeros(BUCKETS * 2 * _WIDE, np.float32)
    for near in neighbours(rows).select("at", F.col("n").cast("float").alias("n")).toArrow().to_batches():
        around[near.column(0).to_numpy()] = near.column(1).to_numpy()
    of = clusters(around.reshape(BUCKETS, 2 * _WIDE), sizes[:, :, 0].sum(1))
    top = top_words(counts, most_top)
    slots = Slots(of, top, sizes)
    return Model(counts, int(total["n"] or 0), int(total["v"]), top, slots, *train(rows, slots, steps))


def lm_scores(docs: DataFrame, most_top: int = 262_144) -> DataFrame:
    """doc_id, held_out (fold of 7 is 2), n_tokens, n_known, train_tokens, base_score and score (log10)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts, n_all, n_types, (top_h, top_n, _), slots, w, v = learn(docs, most_top)
    top_log = np.log10(top_n + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, off in T.slices(batch.column(1)):
                docs = hi - lo
                h, b, d = tokens(buf, off)
                y, s, own = slots.find(h, b)
                every = features(h, b, d)
                model = np.empty(len(h))
                for at in range(0, len(h), _ROWS):
                    cut = slice(at, at + _ROWS)
                    f, c = every[:, cut], y[cut]
                    model[cut] = picked(w, slots.class_prior, f, c) + picked(v, slots.slot_prior[c], rows_of(f, c), s[cut])
                place, ok = T.lookup(top_h, T.signed(h))
                value = np.where(ok, top_log[place] if len(top_log) else 0.0, 0.0)
                # logs holds log10(count + 1) of each word, which a word with a slot of its own takes off again
                parts = np.bincount(d, weights=model / np.log(10) - np.where(own, value, slots.log_size[y, np.maximum(s - OWN, 0)]), minlength=docs)
                rare = np.flatnonzero(~ok)
                # one row for each of a text's rare words
                order = rare[np.lexsort((h[rare], d[rare]))]
                rh, rd = h[order], d[order]
                new = np.flatnonzero(np.r_[True, (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])]) if len(rh) else np.zeros(0, int)
                times = np.diff(np.r_[new, len(rh)])
                bound = T.per_doc(rd[new], docs).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, docs),
                        pa.array(np.arange(row, row + docs)),
                        pa.array(np.bincount(d, minlength=docs)),
                        pa.array(np.bincount(d, weights=ok, minlength=docs).astype(np.int64)),
                        pa.array(np.bincount(d, weights=value, minlength=docs)),
                        pa.array(parts),
                        pa.ListArray.from_arrays(pa.array(bound), pa.array(T.signed(rh[new]))),
                        pa.ListArray.from_arrays(pa.array(bound), pa.array(times.astype(np.int32))),
                    ],
                    ["doc_id", "row", "n_tokens", "n_known", "logs", "classes", "h", "times"],
                )
                row += docs

    part = stored(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, row long, n_tokens long, n_known long, logs double, classes double, h array<long>, times array<int>"), "texts")
    rare = part.select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.times").alias("times"))
    met = rare.join(counts.select("h", "n"), "h")
    found = met.select("row", F.col("times").cast("long").alias("n_known"), (F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    whole = part.select("row", "doc_id", "n_tokens", "n_known", "logs", "classes").unionByName(found, allowMissingColumns=True)
    by = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("logs").alias("logs"), F.max("classes").alias("classes"))
    room = float(np.log10(n_all + 1.0 * (n_types + 1)))
    return by.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(room)).alias("base_score"), (F.col("logs") + F.col("classes")).alias("score"))
