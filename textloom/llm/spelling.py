r"""Grouping of spelling variants by full neighbourhood generation.

Method: every word of the vocabulary emits all distinct strings that one deletion, replacement or insertion over the observed
alphabet makes of it. Those that stand in the vocabulary are exactly its near words, so an equi-join on the string is all:
no distance is computed. Nearness is symmetric, so the words that emitted a string are its near words, and
one shuffle by the emitted string counts them and finds the most frequent.

* A word of length L emits about (2 L + 1) * A strings. They are made as sums of 64-bit products, all words of a length at once, and
  a string is spelled out and sent only if a Bloom filter of the vocabulary has it. A hit says nothing yet: the join compares the strings.
* Two words at one edit share their first three code points or their last three (an edit at the third place or before leaves the end,
  any other the beginning). So words are dealt into buckets by either, each bucket has a filter of its own of 4 MB, and a word's strings with the same
  beginning or end are looked up in that bucket's only. The buckets grow with the vocabulary; a beginning that more words share than a
  filter is made for lets more strings through to the join, and is no less right. Nothing is broadcast but the
  alphabet. A bucket's words are dealt over tasks, each of which gets the filter first.
* Words are counted inside a batch of texts before they are shuffled, so a frequent word is a few rows.
* A form is at least ten times as frequent as its word, so chains of forms are no longer than the digits of the largest
  count; following them two, four, eight steps at once ends after a few joins.

Nulls and ties: a null text has no words; a null id hashes as no digits. Repeated rows count each. Of near words with equal counts the
smallest in code-point order is the form. Other columns are ignored, whatever their names. An empty table, or one
without words, gives no rows. Very long texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import Tables, mapped

U64 = T.U64
#: Bits of a bucket's filter, as a power of two; bits for each word; places of a word in the filter.
PLACES, BITS, PROBES = 25, 16, 6
#: Words whose strings one task makes.
DEALT = 100_000
#: Words counted in a task before they are sent on.
HELD = 200_000
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
ASCII_LETTER = T.table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def runs(buf: np.ndarray, off: np.ndarray) -> tuple[T.Spans, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8: C3 and one byte more), and their lengths in code points."""
    lead = buf == 0xC3
    inside = ASCII_LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    # reuse the span finder with a table over {0, 1}
    s = T.spans(inside.view(np.uint8), off, T.table(bytes([0])))
    points = np.concatenate([[0], np.cumsum(T.LEAD[buf])])
    return s, points[s.end] - points[s.start]


def words(text_bytes: bytes, starts: list[int], ends: list[int], sizes: list[int], owner: list[int], heads: list[int], least: int, rate: int) -> Iterator[bytes]:
    """Each run's word: the run, without one code point where ``rate`` divides the checksum of id and run."""
    crc = zlib.crc32
    for a, b, n, d in zip(starts, ends, sizes, owner, strict=True):
        word = text_bytes[a:b]
        h = crc(word, heads[d])
        if rate and h % rate == 0:
            if n <= least:
                continue
            text = word.decode()
            word = (text[: h % n] + text[h % n + 1 :]).encode()
        yield word


def word_counts(docs: DataFrame, least: int = 7, rate: int = 31) -> DataFrame:
    """word, n: words of at least ``least`` code points and how often they occur; one batch may give a word a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).view(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, raw, off in T.slices(b.column(1)):
                buf = T.lower(raw)
                s, size = runs(buf, off)
                long = np.flatnonzero(size >= least)
                heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[lo:hi]]
                for w in words(buf.tobytes(), s.start[long].tolist(), s.end[long].tolist(), size[long].tolist(), s.doc[long].tolist(), heads, least, rate):
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) >= HELD:
                    yield sent()
        if seen:
            yield sent()

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "word string, n long")


def value(code: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    return T.mix(code.astype(U64) + U64(0xD1B54A32D192ED03))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[U64(1), np.full(n, _STEP, U64)])


def name(codes: np.ndarray) -> np.ndarray:
    """The number of each row's word: the sum of code point times step to the power of its place."""
    return (value(codes) * powers(codes.shape[1] - 1)).sum(axis=1, dtype=U64)


def places(names: np.ndarray, probe: int) -> np.ndarray:
    """The words' places in a filter; a different one for each probe."""
    mask = U64((1 << PLACES) - 1)
    first = names >> U64(64 - PLACES)
    return ((first + U64(probe) * (names >> U64(64 - 2 * PLACES) | U64(1)) & mask if probe else first) & mask).astype(np.int64)


def held(taken: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names a filter has; each probe is made for those that passed the ones before."""
    ok = None
    for probe in range(PROBES):
        at = places(names, probe)
        hit = (taken[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        ok = np.flatnonzero(hit) if ok is None else ok[hit]
        if not len(ok):
            break
        names = names[hit]
    return ok


def by_length(words_: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, matrix of code points) of the words of each length."""
    text = words_.to_pylist()
    size = np.array([len(w) for w in text], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if n:
            yield at, np.frombuffer("".join(text[i] for i in at).encode("utf-32-le"), "<u4").reshape(-1, n)


def neighbours(codes: np.ndarray, alphabet: np.ndarray, taken: np.ndarray | None, begin: int = 0, end: int | None = None) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, strings): every string at one edit at a place from begin to end (all by default) from each row's word once, if the filter ``taken`` (None: all) has it."""
    m, n = codes.shape
    p = powers(n)
    term = value(codes) * p[:n]
    before = np.concatenate([np.zeros((m, 1), U64), np.cumsum(term, axis=1, dtype=U64)], axis=1)
    whole = before[:, -1]
    a_value = value(alphabet)
    width = len(alphabet)

    def hits(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = names.reshape(-1)
        at = np.arange(len(flat)) if taken is None else held(taken, flat)
        return (at, at) if names.ndim == 1 else (at // width, at % width)

    for i in range(begin, min(n + 1, n + 1 if end is None else end)):
        # a letter before place i; not the one that stands before, which is the same as one place earlier
        rows, letter = hits((before[:, i] + (whole - before[:, i]) * U64(_STEP))[:, None] + a_value * p[i])
        if i:
            ok = codes[rows, i - 1] != alphabet[letter]
            rows, letter = rows[ok], letter[ok]
        if len(rows):
            yield rows, _spelled(np.concatenate([codes[rows, :i], alphabet[letter][:, None], codes[rows, i:]], axis=1))
        if i == n:
            break
        # without code point i; of a run of equal ones, the first only
        rows, _ = hits(before[:, i] + (whole - before[:, i + 1]) * U64(_BACK))
        if i:
            rows = rows[codes[rows, i] != codes[rows, i - 1]]
        if len(rows):
            yield rows, _spelled(np.delete(codes[rows], i, axis=1))
        rows, letter = hits((whole - term[:, i])[:, None] + a_value * p[i])
        ok = codes[rows, i] != alphabet[letter]
        rows, letter = rows[ok], letter[ok]
        if len(rows):
            new = codes[rows].copy()
            new[:, i] = alphabet[letter]
            yield rows, _spelled(new)


def _spelled(codes: np.ndarray) -> list[str]:
    text, n = codes.astype("<u4").tobytes().decode("utf-32-le"), codes.shape[1]
    return [text[k : k + n] for k in range(0, len(text), n)] if n else [""] * len(codes)


def filters(sides: DataFrame) -> DataFrame:
    """(bucket, bits): each bucket's filter. A bucket's words stream through one task, which holds the filter only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, taken = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(taken, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

        for b in batches:
            of = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if bucket != of[lo]:
                    if bucket is not None:
                        yield out()
                    bucket, taken = int(of[lo]), np.zeros(1 << PLACES, bool)
                for _, codes in by_length(b.column(1).slice(lo, hi - lo)):
                    names = name(codes)
                    for probe in range(PROBES):
                        taken[places(names, probe)] = True
        if bucket is not None:
            yield out()

    return mapped(sides.select("bucket", "word").repartition("bucket").sortWithinPartitions("bucket"), run, "bucket int, bits binary")


def near_words(vocabulary: DataFrame, tables: Tables, least: int, rows: int = 4096) -> DataFrame:
    """word, n, n_near, near, near_n: how many words are one edit away, and the most frequent of them (null if none).

    ``vocabulary`` has distinct words of ``least`` code points or more and their n. ``rows`` bounds the words whose strings are made at once.
    """
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("a")).where("a <> ''").distinct()
    alphabet = np.array(sorted(ord(r["a"]) for r in letters.collect()), np.uint32)  # distinct code points: bounded by Unicode
    shared = min(3, least // 2)
    buckets = -(-2 * vocabulary.count() * BITS // (1 << PLACES)) or 1
    ends = F.array(*[F.struct(F.lit(k).alias("side"), F.pmod(F.xxhash64(F.lit(k), end), F.lit(buckets)).cast("int").alias("bucket")) for k, end in enumerate((F.left("word", F.lit(shared)), F.right("word", F.lit(shared))))])
    sides = vocabulary.select("word", "n", F.explode(ends).alias("s")).select("s.bucket", "s.side", "word", "n")
    bits = tables.put("filters", filters(sides))
    dealt = sides.groupBy("bucket").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("salts"))
    salts = F.broadcast(dealt) if buckets <= 10_000 else dealt
    asked = sides.join(salts, "bucket").select("bucket", F.pmod(F.xxhash64("word", F.lit(7)), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "side", "word", "n", F.lit(None).cast("binary").alias("bits"))
    first = bits.join(dealt, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n"), "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = None
        for whole in batches:
            kind = whole.column(2).to_numpy(zero_copy_only=False)
            side = whole.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            # a filter comes before its bucket's words
            cuts = [*np.flatnonzero(kind == 0), whole.num_rows]
            for lo, hi in zip([0, *cuts], cuts, strict=False):
                if lo < hi and kind[lo] == 0:
                    taken = np.frombuffer(whole.column(6)[lo].as_buffer(), np.uint8)
                    lo += 1
                for k in (0, 1):
                    own = lo + np.flatnonzero(side[lo:hi] == k)
                    for at in (own[x : x + rows] for x in range(0, len(own), rows)):
                        words_, counts = whole.column(4).take(pa.array(at)), whole.column(5).take(pa.array(at))
                        for of, codes in by_length(words_):
                            for found, strings in neighbours(codes, alphabet, taken, *((0, shared) if k else (shared, None))):
                                made = pa.array(of[found])
                                yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), words_.take(made), counts.take(made)], ["word", "near", "near_n"])

    emitted = mapped(asked.unionByName(first).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind"), run, "word string, near string, near_n long")
    best = emitted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    return vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def spelling_variants(docs: DataFrame, least: int = 7, at_least: int = 2, times: int = 10, rate: int = 31) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words have ``least`` code points and ``at_least`` occurrences. form: the most frequent near word, if ``times`` as frequent as the word. root: the last
    of the forms that follow each other from the word. ``rate``: one in so many runs loses a code point, by the checksum of id and run (0: none).
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    tables = Tables(docs.sparkSession)
    vocabulary = tables.put("vocabulary", word_counts(docs, least, rate).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least))
    near = near_words(vocabulary, tables, least)
    ok = F.col("near_n") >= times * F.col("n")
    forms = tables.put("forms", near.select("word", "n", "n_near", F.when(ok, F.col("near")).alias("form"), F.when(ok, F.col("near_n")).alias("form_n")))
    tables.drop("vocabulary", "filters")
    steps = tables.put("steps", forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = tables.put("steps", steps.select("word", "root").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = after
        if steps.where("moved").isEmpty():
            break
    out = forms.join(steps.select("word", "root"), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
