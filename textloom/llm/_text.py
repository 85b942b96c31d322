"""Vectorised reading of UTF-8 text columns.

Arrow string columns are read as one byte buffer plus offsets, so words, lines
and n-grams of a few hundred documents are found and hashed by numpy at once,
without a Python string for each. ``slices`` bounds the bytes handled together;
a single longer document is a slice of its own and is processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
_LONG_WORD = 64


def table(members: str | bytes | range) -> np.ndarray:
    """Lookup table of 256 booleans that is true for the given bytes."""
    out = np.zeros(256, bool)
    out[list(members.encode("latin-1") if isinstance(members, str) else members)] = True
    return out


#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = table(b" \t\n\x0b\x0c\r")
ALNUM = table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") | table(range(128, 256))
LETTER = table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | table(range(128, 256))
#: First bytes of code points.
LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Spans(NamedTuple):
    """Byte spans with the index of the document that each lies in."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def lower(buf: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z only."""
    return _LOWER[buf]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    at = batch.schema.get_field_index(name)
    return batch.column(at)


def slices(texts: pa.Array, most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) of at most ``rows`` rows; null reads as empty."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, len(texts), lo + (rows or len(texts)))
        yield lo, hi, whole[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray) -> Spans:
    """Runs of bytes that are no separators; none crosses a document's end."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Spans(z, z, z)
    inside = ~separator[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:n]
    start = np.flatnonzero(begin)
    return Spans(start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1)


def lines(buf: np.ndarray, off: np.ndarray) -> Spans:
    r"""The ``\n``-split lines of each document, empty ones included."""
    cut = np.flatnonzero(buf == 10)
    doc = np.searchsorted(off, cut, "right") - 1
    start = np.concatenate([off[:-1], cut + 1])
    owner = np.concatenate([np.arange(len(off) - 1), doc])
    end = np.concatenate([cut, off[1:]])
    own_end = np.concatenate([doc, np.arange(len(off) - 1)])
    a, b = np.lexsort((start, owner)), np.lexsort((end, own_end))
    return Spans(start[a], end[b], owner[a])


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    n = end - start
    out = np.full(len(start), 0xCBF29CE484222325, U64)
    if not len(start):
        return out
    order = np.argsort(-np.minimum(n, _LONG_WORD + 1), kind="stable")
    at, size = start[order], n[order]
    h = out.copy()
    for k in range(min(int(n.max()), _LONG_WORD)):
        live = int(np.searchsorted(-size, -k, "left"))
        h[:live] ^= buf[at[:live] + k]
        h[:live] *= U64(0x100000001B3)
    h = mix(h + size.astype(U64) * U64(0x9E3779B97F4A7C15))
    for i in range(int(np.searchsorted(-size, -_LONG_WORD, "left"))):
        h[i] = int.from_bytes(hashlib.blake2b(buf[at[i] : at[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    out[order] = h
    return out


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one document, and their first words' indices."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return ordered(h, at, n), at


def ordered(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(at), n, U64)
    for k in range(n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[at + k])
    return out


def per_doc(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Bounds of each document's items, which stand in order of documents."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted
