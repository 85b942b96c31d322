r"""Fill-in-the-middle: a text is cut twice and its middle moved to the end.

Method: each text is decoded to an array of code points (UTF-32). Units are runs of ASCII letters and single other code points:
a code point begins a unit unless it and the one before are both letters, so comparing neighbouring classes
and ``flatnonzero`` give all boundaries. Two ranks drawn from a hash of the row's id choose the cuts; the pieces are slices, encoded again.
A map over rows: no shuffle, and memory for one text at a time.

Forms: ``psm`` is prefix, suffix, middle, ``spm`` suffix, prefix, middle, each piece behind its mark;
``plain`` is the text as it is: an empty text, one that holds a mark, and the share that stays plain. ``restored`` gives the text back.

Nulls and ties: a null text reads as empty, so it is plain; a null id hashes as no digits. Repeated rows give equal rows. Cuts may
fall together (an empty middle) or at an end. Other columns stay as they are; a column of a result's name is replaced. An empty table gives no
rows. Very long texts are cut whole: five bytes a code point are held. Bytes that are no UTF-8 come back as they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import PREFIX, mapped

MARKS = ("<P>", "<S>", "<M>")
_FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def encoded(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where units begin, and the text's end."""
    folded = points | np.uint32(32)
    letter = (folded >= 97) & (folded <= 122)
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.r_[np.flatnonzero(begins), len(points)]


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(data: bytes, doc_id: int | None, seed: int = 1, plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text; plain and spm are shares in hundredths."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    points = codes(data)
    ends = boundaries(points)
    n = len(ends) - 1
    p, s, m = (x.encode() for x in marks)
    if not n or h3 % 100 >= 100 - plain or p in data or s in data or m in data:
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(ends[low]), int(ends[high])
    prefix, middle, suffix = encoded(points[:a]), encoded(points[a:b]), encoded(points[b:])
    if h4 % 100 < spm:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


def rebuilt(output: bytes, form: str, marks: tuple[str, str, str] = MARKS) -> bytes:
    """The text from its output and form alone."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in marks)
    first, second = (p, s) if form == "psm" else (s, p)
    head, middle = output[len(first) :].split(m)
    one, two = head.split(second)
    return one + middle + two if form == "psm" else two + middle + one


def _bytes(col: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in col.cast(pa.large_binary()))


def _strings(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary()).view(pa.string())


def _batches(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (b.slice(lo, rows) for lo in range(0, b.num_rows, rows))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows with n (units), form, prefix_chars, middle_chars (code points; null if plain) and output."""
    if len({m[:1] for m in marks} & {x for m in marks for x in m[1:]}) or len(set(marks)) < 3 or not all(marks):
        raise ValueError("marks must differ, and their first characters stand nowhere else in a mark: else a cut can make a mark")
    kept = [f for f in docs.schema.fields if f.name not in dict(_FIELDS)]
    src = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col("doc_id").cast("long").alias(PREFIX + "id"), F.col("text").cast("string").alias(PREFIX + "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _batches(whole)):
            made = [transformed(x, i, seed, plain, spm, marks) for x, i in zip(_bytes(b.column(len(kept) + 1)), b.column(len(kept)).to_pylist(), strict=True)]
            found = [pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(_FIELDS[:-1])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *found, _strings([m[-1] for m in made])], [*(f.name for f in kept), *dict(_FIELDS)])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n long, form string, prefix_chars long, middle_chars long, output string"])
    return mapped(src, run, schema)


def restored(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Adds ``restored``, the text that output and form give back."""
    kept = [f for f in rows.schema.fields if f.name != "restored"]
    src = rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col("output").alias(PREFIX + "output"), F.col("form").alias(PREFIX + "form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _batches(whole)):
            made = [rebuilt(x, f, marks) for x, f in zip(_bytes(b.column(len(kept))), b.column(len(kept) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], _strings(made)], [*(f.name for f in kept), "restored"])

    return mapped(src, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["restored string"]))
