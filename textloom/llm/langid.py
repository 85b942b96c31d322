"""Language identification by nearest centroid.

A text becomes hashed byte 2- and 3-grams of its letters (A-Z lower-cased, other bytes
below 128 read as one space), weighted log(1 + tf) * idf and normalised. Each language has
several centroids from spherical k-means. The nearest centroid by cosine names the
language; a cosine below the language's rejection distance (a low quantile of its training
rows) marks the answer as rejected.

Centroids are fitted on at most ``per_language`` documents of each language, chosen by a hash
of the id, and of at most ``most_chars`` characters each (documented bounds); with very many
languages each gets fewer, so that ``most_rows`` rows are about enough for all, but four at least.
Every language of the learning rows has centroids, and all rows are scored, in Arrow batches and
with no shuffle. A text that is null or has no letter (Unicode categories L*) is ``und`` with
score 0. Equal cosines go to the language that sorts first. Repeated rows are scored each; other
columns are ignored; very long texts are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._io import fold, scored

BUCKETS = 1 << 12
#: Rows whose vectors are held at once.
_ROWS = 512
_MAP = np.full(256, 32, np.uint8)
_MAP[T.LETTER] = np.arange(256, dtype=np.uint8)[T.LETTER]


def vectors(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log(1 + tf) of each document."""
    docs = len(off) - 1
    out = np.zeros(docs * BUCKETS)
    if len(raw):
        b = _MAP[T.lower(raw)].astype(np.uint32)
        doc = np.repeat(np.arange(docs), np.diff(off))
        for n in (2, 3):
            if len(b) < n:
                break
            end = len(b) - n + 1
            ok = doc[:end] == doc[n - 1 :]
            gram = b[:end].copy()
            blank = (b[:end] == 32).astype(np.int8)
            for k in range(1, n):
                gram = gram << np.uint32(8) | b[k : end + k]
                blank += b[k : end + k] == 32
            ok &= blank < n - 1
            ids = ((gram[ok] + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20)
            out += np.bincount(doc[:end][ok] * BUCKETS + ids, minlength=len(out))
    out = out.astype(np.float32)
    return np.log1p(out, out=out).reshape(docs, BUCKETS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(rows: list[tuple[str, str]], clusters: int = 4, rounds: int = 12, reject: float = 0.01) -> dict:
    """rows: (text, language)."""
    rows = sorted(rows)
    names = sorted({v for _, v in rows})
    if not rows:
        return {"names": [], "of": np.zeros(0, int), "centroids": np.zeros((0, BUCKETS)), "idf": np.ones(BUCKETS), "floor": np.zeros(0)}
    x = np.concatenate([vectors(buf, off) for _, _, buf, off in T.slices(pa.array([t for t, _ in rows], pa.string()), rows=_ROWS)])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    x = unit(x * idf)
    lang = np.array([names.index(v) for _, v in rows])
    centroids, of, floor = [], [], []
    rng = np.random.default_rng(5)
    for k in range(len(names)):
        own = x[lang == k]
        c = unit(own[rng.permutation(len(own))[:clusters]])
        for _ in range(rounds):
            near = (own @ c.T).argmax(1)
            c = unit(np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
        floor.append(np.quantile((own @ c.T).max(1), reject))
        centroids.append(c)
        of += [k] * len(c)
    return {"names": names, "of": np.array(of), "centroids": np.concatenate(centroids).astype(np.float32), "idf": idf.astype(np.float32), "floor": np.array(floor)}


def train(docs: DataFrame, per_language: int = 300, most_rows: int = 30_000, most_chars: int = 50_000) -> dict:
    """Learns from rows whose fold of 4 is not 2 and that have a language and a text.

    Rows of more than ``most_chars`` characters are left out where a language has shorter ones; one that has none is learned from its four shortest.
    """
    base = docs.where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = base.where(F.length("text") <= most_chars)
    counts = base.groupBy("lang").agg(F.count_if(F.length("text") <= most_chars).alias("n")).collect()
    n = {r["lang"]: r["n"] for r in counts if r["n"]}
    long_only = [r["lang"] for r in counts if not r["n"]]
    rare: list[tuple] = []
    if long_only:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.length("text"), F.xxhash64("text")))
        shortest = base.where(F.col("lang").isin(long_only)).select("text", "lang", place.alias("place")).where("place <= 4")
        rare = sorted((r["text"], r["lang"]) for r in shortest.collect())
    if not n:
        return fit(rare)
    each = min(per_language, max(4, most_rows // len(n)))
    unit_hash = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    share = F.create_map(*[F.lit(v) for k, c in n.items() for v in (k, min(1.0, (1.5 * each + 20) / c))])
    # repeated rows count once, so that what is collected is bounded
    rows = known.where(unit_hash < share[F.col("lang")]).select("text", "lang").distinct().collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], hash_of(r["text"]), r["text"])):
        if len(got := by.setdefault(r["lang"], [])) < each:
            got.append((r["text"], r["lang"]))
    return fit([r for v in by.values() for r in v] + rare)


def lettered(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts have a letter: A-Z and a-z are seen in the bytes, texts with other high bytes are asked for Unicode letters."""
    out = T.sums(T.LETTER[buf] & (buf < 128), off) > 0
    for i in np.flatnonzero(~out & (T.sums(buf > 127, off) > 0)):
        out[i] = any(map(str.isalpha, buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def predict(model: dict, texts: pa.Array) -> dict:
    names, cos, rejected = [], [], []
    for lo, hi, buf, off in T.slices(texts, rows=_ROWS):
        letter = lettered(buf, off)
        if not model["names"]:
            names += [None if x else "und" for x in letter]
            cos.append(np.zeros(hi - lo))
            rejected.append(np.ones(hi - lo, bool))
            continue
        sim = unit(vectors(buf, off) * model["idf"]) @ model["centroids"].T
        best = sim.argmax(1)
        own = model["of"][best]
        top = np.where(letter, np.clip(sim[np.arange(hi - lo), best], 0, 1), 0.0).astype(float)
        names += [model["names"][k] if x else "und" for k, x in zip(own, letter, strict=True)]
        cos.append(top)
        rejected.append(~letter | (top < model["floor"][own]))
    return {"lang_pred": pa.array(names, pa.string()), "score": np.concatenate(cos), "rejected": np.concatenate(rejected)}


def language(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out (fold of 4 is 2), lang_pred, score (cosine) and rejected."""
    got = scored(docs, lambda texts: predict(model, texts), "lang_pred string, score double, rejected boolean", ["doc_id"])
    return got.withColumn("held_out", fold("doc_id", 4) == 2)
