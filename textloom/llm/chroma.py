"""Audio fingerprints from pitch classes, and their alignment.

A recording (mono samples) is cut into overlapping frames; the energy of each frame's
spectrum is summed by pitch class (12 of them), smoothed over five frames and normalised.
The frames by pitch classes are an image. Each of 16 filters compares two areas of a window
of frames by means of an integral image and is quantised to two bits (a Gray code), so
that each window gives one packed 32-bit integer.

Two recordings align where equal integers are met most often at one offset (offset
histogram); the share of differing bits over the overlap at that offset is their distance.

Recordings with the same fingerprint are one class. Queries (ids divisible by 100) are
compared, by class, against all classes through equal integers, so no pair is made that
shares none. Null, empty or too short recordings have an empty fingerprint and are
aligned with nothing; repeated rows are copies; other columns are ignored, whatever their names. Of equally good
alignments the least query and offset are named. An empty table gives no rows; a recording must fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import mapped, stored

RATE = 11025
FRAME = 4096
HOP = FRAME // 3
LOW, HIGH = 28.0, 3520.0
WIDEST = 16
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the 16 filters, spread by a rule over kinds, places and sizes."""
    return [(k % 6, (5 * k) % 9, 1 + (k * 7) % 3 + (2 if k % 6 in (2, 4) else 0), (4, 8, 12, 16)[k % 4]) for k in range(16)]


def _bounds() -> np.ndarray:
    """For each FFT bin its pitch class, or -1."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.full(len(f), -1)
    ok = (f >= LOW) & (f <= HIGH)
    out[ok] = np.round(12 * np.log2(f[ok] / 440.0)).astype(int) % 12
    return out


_CLASS = _bounds()
_FOLD = np.stack([(_CLASS == k).astype(np.float32) for k in range(12)], 1)
_WINDOW = np.hamming(FRAME).astype(np.float32)


def _power(frames: np.ndarray) -> np.ndarray:
    z = np.fft.rfft(frames * _WINDOW, axis=1)
    return z.real**2 + z.imag**2


def chroma(samples: np.ndarray) -> np.ndarray:
    """Normalised pitch-class frames."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    at = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    rows = np.concatenate([_power(at[k : k + 64]) @ _FOLD for k in range(0, len(at), 64)])
    if len(rows) < len(_SMOOTH):
        return np.zeros((0, 12))
    smooth = sum(w * rows[k : len(rows) - len(_SMOOTH) + 1 + k] for k, w in enumerate(_SMOOTH))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-2, smooth / np.maximum(norm, 1e-12), 0)


def responses(image: np.ndarray) -> np.ndarray:
    """The 16 filters' log ratios of areas at each place of the window."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros((0, 16))
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = np.cumsum(np.cumsum(image, 0), 1)
    at = np.arange(n)
    area = lambda x0, x1, y0, y1: total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]
    out = np.empty((n, 16))
    for k, (kind, y, h, w) in enumerate(filters()):
        y1 = min(y + max(h, 2 if kind in (2, 3) else 3 if kind == 4 else 1), 12)
        if kind == 0:
            a, b = area(0, w, y, y1), 0.0
        elif kind == 1:
            a, b = area(0, w // 2, y, y1), area(w // 2, w, y, y1)
        elif kind == 2:
            m = (y + y1) // 2
            a, b = area(0, w, y, m), area(0, w, m, y1)
        elif kind == 3:
            m, x = (y + y1) // 2, w // 2
            a, b = area(0, x, m, y1) + area(x, w, y, m), area(0, x, y, m) + area(x, w, m, y1)
        elif kind == 4:
            t = max((y1 - y) // 3, 1)
            a, b = area(0, w, y + t, y + 2 * t), area(0, w, y, y + t) + area(0, w, y + 2 * t, min(y + 3 * t, 12))
        else:
            t = w // 3
            a, b = area(t, 2 * t, y, y1), area(0, t, y, y1) + area(2 * t, 3 * t, y, y1)
        out[:, k] = np.log((1 + a) / (1 + b))
    return out


@lru_cache(4)
def _tones(note_samples: int) -> np.ndarray:
    """A sine tone with two overtones for each of 61 semitones from 110 Hz on."""
    t = np.arange(note_samples) / RATE
    env = np.hanning(note_samples + 2)[1:-1] ** 0.25
    return np.stack([(np.sin(2 * np.pi * f * t) + 0.4 * np.sin(4 * np.pi * f * t) + 0.2 * np.sin(6 * np.pi * f * t)) * env for f in 110.0 * 2 ** (np.arange(61) / 12)]).astype(np.float32)


def render(notes: np.ndarray, note_samples: int = HOP) -> np.ndarray:
    """A tune; notes in semitones above 110 Hz, -1 a rest."""
    return np.where((notes >= 0)[:, None], _tones(note_samples)[np.clip(notes, 0, 60)], np.float32(0)).reshape(-1)


def _cuts(seed: int = 17) -> np.ndarray:
    """Quartiles of each filter over tunes written from a seed: the quantiser's three bounds."""
    rng = np.random.default_rng(seed)
    got = [responses(chroma(render(rng.integers(0, 48, 96)))) for _ in range(12)]
    return np.quantile(np.concatenate(got), [0.25, 0.5, 0.75], axis=0)


class Fingerprinter:
    def __init__(self) -> None:
        self.cuts = _cuts()

    def __call__(self, samples: np.ndarray) -> np.ndarray:
        r = responses(chroma(np.asarray(samples, np.float32)))
        level = (r[:, :, None] > self.cuts.T[None]).sum(2)
        return (_GRAY[level] << (2 * np.arange(16, dtype=np.uint32))).sum(1, dtype=np.uint32)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int | None, float]:
    """The offset of b in a with the most equal integers (the least such offset), and the bit error rate there."""
    both = np.flatnonzero(np.isin(a, b))
    if not len(both):
        return None, 1.0
    off = np.concatenate([i - np.flatnonzero(b == a[i]) for i in both])
    values, n = np.unique(off, return_counts=True)
    best = int(values[n.argmax()])
    return best, error_rate(a, b, best)


def error_rate(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    lo, hi = max(offset, 0), min(len(a), len(b) + offset)
    if lo >= hi:
        return 1.0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).mean() / 32)


def fingerprints(recordings: DataFrame, key: str, samples: str, read=None) -> DataFrame:
    """key and fp (array<int>: the packed integers, as signed). ``read`` turns a value of the column into samples (default: it holds them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter()
        for b in batches:
            out = []
            for v in b.column(1):
                raw = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0, np.float32)
                raw = np.nan_to_num(raw.astype(np.float32))
                out.append(make(read(raw) if read and len(raw) else raw).view(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["id", "fp"])

    return mapped(recordings.select(F.col(key).cast("long").alias("id"), F.col(samples)), run, "id long, fp array<int>")


def aligned(prints: DataFrame, every: int = 100, most_error: float = 0.25, least_hits: int = 3) -> DataFrame:
    """One row per recording of (id, fp): id, n_fp, fp_crc32, class_id, n_links, best_query, best_offset, best_error.

    class_id is the least id with the same fingerprint. Classes are aligned with the classes that hold a query
    (an id divisible by ``every``): n_links counts those with at least ``least_hits`` equal integers at the best
    offset and a bit error rate of at most ``most_error``, itself left out; best_* is the one with the least error,
    then the least id (null if there is none). best_offset is the query's place in the recording.
    """
    prints = stored(prints.withColumn("name", F.sha2(F.array_join("fp", ",").cast("binary"), 256)), "fingerprints")
    some = prints.where(F.size("fp") > 0)
    classes = stored(some.groupBy("name").agg(F.min("id").alias("rep"), F.min_by("fp", "id").alias("fp"), F.max(F.coalesce(F.col("id") % every == 0, F.lit(False))).alias("asks")).where("rep is not null"), "classes")
    place = classes.select("rep", F.posexplode("fp").alias("at", "code"))
    asked = classes.where("asks").select(F.col("rep").alias("q"), F.posexplode("fp").alias("q_at", "code"))
    hits = place.join(asked, "code").where("q <> rep").groupBy("rep", "q", (F.col("at") - F.col("q_at")).alias("off")).agg(F.count("*").alias("n")).where(F.col("n") >= least_hits)
    best = hits.groupBy("rep", "q").agg(F.max(F.struct("n", (-F.col("off")).alias("back"))).alias("x")).select("rep", "q", (-F.col("x.back")).alias("off"))
    full = best.join(classes.select("rep", "fp"), "rep").join(classes.select(F.col("rep").alias("q"), F.col("fp").alias("q_fp")), "q")
    a, b, off = F.col("fp"), F.col("q_fp"), F.col("off")
    over = F.least(F.size(a), F.size(b) + off) - F.greatest(off, F.lit(0))
    left = F.slice(a, F.greatest(off, F.lit(0)) + 1, F.greatest(over, F.lit(0)))
    right = F.slice(b, F.greatest(-off, F.lit(0)) + 1, F.greatest(over, F.lit(0)))
    # bit_count widens a negative int to 64 bits
    wrong = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("bigint").bitwiseAND(0xFFFFFFFF))), F.lit(0), lambda t, x: t + x)
    error = F.round(F.when(over > 0, wrong / (32 * over)).otherwise(1.0), 6)
    links = full.select("rep", "q", "off", error.alias("error")).where(F.col("error") <= most_error)
    ranked = links.groupBy("rep").agg(F.count("*").alias("n_links"), F.min(F.struct("error", "q", "off")).alias("x"))
    found = classes.select("name", "rep").join(ranked, "rep", "left")
    out = prints.join(found, "name", "left")
    return out.select("id", F.size("fp").cast("long").alias("n_fp"), F.crc32(F.array_join("fp", ",").cast("binary")).alias("fp_crc32"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("x.q").alias("best_query"), F.col("x.off").cast("long").alias("best_offset"), F.col("x.error").alias("best_error"))


def tune(vector: np.ndarray) -> np.ndarray:
    """Samples of a tune read off a vector: one note for each value, higher values higher notes. For tables that hold no audio."""
    spread = np.clip(np.round(24 + vector * np.sqrt(len(vector)) * 12), 0, 48).astype(int)
    return render(spread)
