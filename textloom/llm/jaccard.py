r"""Similarity join of documents on n-word shingles, by token-combination prefixes.

Tokens are shingles. All sets are put into one global order, rare tokens first, and of each only a prefix is
indexed. A partner with a Jaccard similarity of at least s lacks at most e = n - ceil(s * n) of a set's n tokens, so of two
linked sets the one whose prefix ends first shares all but e of its prefix tokens with the other's prefix. Prefixes of
single tokens are e + 1 long. A frequent token alone would make a bucket of all documents that have it, so tokens are
classed by frequency: a rare token is a key by itself, frequent ones are keys in pairs and very frequent ones in triples.
Losing all keys of a class of which the prefix has x tokens takes x - k + 1 missing ones (k: tokens in a key), so
the prefix is extended until these numbers sum up to e + 1 over the classes; then every linked pair shares a key.

* Of two linked sets the smaller lacks fewer: at most n - ceil(2 s / (1 + s) * n) of its tokens. So a shared key stands in the smaller
  one's short prefix for that number, the first part of its prefix. Keys that no document has in its short prefix are
  left out before anything is compared.
* A class is cut into subclasses by hash, and tokens combine within one only, so that combinations grow with
  the prefix and not with its square or cube. Their number goes by the size of the set: a set uses the scheme of
  its own size level (powers of four) and, if a partner may be in the next, of that one too; a key names its level.
* The frequency of a token is that of its place in a table of ``2 ** places`` counters: how many documents have a token there. Any
  total order gives the same links, so a shared place costs time only. What is broadcast are two bits a place (8 MB by default, whatever
  the input); larger inputs tell frequent from rare better with more places. Places of one document make keys as others do: few are
  left in a large input, so leaving them out would only make small inputs look cheap.
* Documents with equal keys are compared as in ``neardup``: an exact histogram bound inside sorted streams, then
  the whole sets; components are exact, as each key's members are compared until they are one component or all met.

Sets of fewer than s / (1 - s) tokens (4 at 0.8) are linked with equal sets only, which are one class from the start.

Nulls and ties: as in ``neardup``: a null, empty or wordless text is linked with nothing; repeated rows are
copies; a row without a doc_id takes part as a copy only; other columns are ignored, whatever their names; an empty
table gives no rows. Very long texts: a text's set must fit in a task, and its keys are fewer than its tokens.
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
from .neardup import Sketcher, grouped, shingle_sets, text_hash

U64 = T.U64
#: Classes of places, and how many of a class's tokens make a key.
RARE, FREQUENT, HOT = range(3)
TOGETHER = (1, 2, 3)


def place_of(tokens: np.ndarray, places: int) -> np.ndarray:
    return (T.mix(tokens ^ U64(0x2545F4914F6CDD1D)) >> U64(64 - places)).astype(np.int64)


def frequency_classes(docs: DataFrame, n: int, places: int) -> np.ndarray:
    """Two bits for each place, packed: its class by the number of documents that have a token there.

    Each task sums up its documents in one byte a place (255: that many or more) and sends blocks; the
    blocks' sums are made in sorted streams. Frequent: from 16 and four times the mean place; very frequent: from 16 times that.
    """
    blocks = 1 << max(0, places - 14)
    width = (1 << places) // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << places, np.uint8)
        some = False
        for b in batches:
            for s in shingle_sets(b.column(0), n):
                if len(s):
                    at = place_of(s, places)
                    seen[at] = np.minimum(seen[at], 254) + 1
                    some = True
        if some:
            rows = seen.reshape(blocks, width)
            for lo in range(0, blocks, 256):
                full = [k for k in range(lo, min(lo + 256, blocks)) if rows[k].any()]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(rows[k].tobytes(), 1) for k in full], pa.binary())], ["block", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != at:
                    if at is not None:
                        yield out(at, total)
                    at, total = k, np.zeros(width, np.int64)
                total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8)
        if at is not None:
            yield out(at, total)

    def out(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["block", "docs", "total"])

    tables = Tables(docs.sparkSession)
    seen = mapped(docs.select(F.col("text").cast("string").alias("text")), count, "block int, seen binary")
    sums = tables.put("places", mapped(seen.repartition("block").sortWithinPartitions("block"), add, "block int, docs long, total binary"))
    mean = (sums.agg(F.sum("docs")).first()[0] or 0) / (1 << places)
    bounds = np.array([1, 16]) * max(16.0, 4 * mean)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.searchsorted(bounds, np.frombuffer(zlib.decompress(x.as_buffer()), np.int64), "right").astype(np.uint8).reshape(-1, 4) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(c << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes() for c in found], pa.binary())], ["block", "bits"])

    bits = np.zeros((blocks, width // 4), np.uint8)
    for row in mapped(sums.select("block", "total"), classes, "block int, bits binary").toLocalIterator():
        bits[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    tables.drop("places")
    return bits.reshape(-1)


def level(size: float) -> int:
    return (int(size).bit_length() - 1) // 2


def keys(tokens: np.ndarray, classes: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, those in the short prefix) of a set (sorted, distinct) whose tokens have these classes, for similarity part / whole."""
    n = len(tokens)
    if n * (whole - part) < part:  # no different set is similar enough
        return np.zeros(0, U64), np.zeros(0, bool)
    order = np.argsort(classes, kind="stable")
    token, kind = tokens[order], classes[order].astype(np.int64)
    needed, short = n + 1 - -(-part * n // whole), n + 1 - -(-2 * part * n // (whole + part))
    made = [x for lv in sorted({level(n), level(n * whole // part)}) for x in _keys(token, kind, needed, short, lv)]
    return np.concatenate([k for k, _ in made]), np.concatenate([s for _, s in made])


def _keys(token: np.ndarray, kind: np.ndarray, needed: int, short: int, lv: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys under one level's scheme, and whether they stand in the short prefix; tokens are in the global order."""
    subs = max(1, 3 * 4**lv // 16)  # few enough for every set of this level, so that its keys can be taken until enough are worth it
    salt = T.mix(np.array([lv * 4 + k for k in range(len(TOGETHER))], U64) + U64(0x9E3779B97F4A7C15))
    size = np.array(TOGETHER)[kind]
    sub = np.where(size > 1, 1 + size * subs + (T.mix(token) % U64(subs)).astype(np.int64), 0)
    by = np.argsort(sub, kind="stable")
    first = np.r_[0, np.flatnonzero(np.diff(sub[by])) + 1]
    turn = np.empty(len(token), np.int64)
    turn[by] = np.arange(len(token)) - np.repeat(first, np.diff(np.r_[first, len(token)]))
    worth = np.cumsum((turn + 1 >= size) | (sub == 0))
    end, early = (int(np.searchsorted(worth, x)) + 1 for x in (needed, short))  # at most the whole set
    single = np.flatnonzero(kind[:end] == RARE)
    made = [(T.mix(token[single] ^ salt[RARE]), single < early)]
    for c in (FREQUENT, HOT):
        at = by[(kind[by] == c) & (by < end)]
        if len(at):
            made += [(k, at[last] < early) for k, last in _combined(token[at], sub[at], TOGETHER[c], salt[c])]
    return made


def _combined(token: np.ndarray, sub: np.ndarray, k: int, salt: np.uint64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of all combinations of k tokens inside each subclass, and their last tokens; a subclass's tokens stand together and in the global order."""
    made = []
    here, far = np.arange(len(token)), 0
    while True:
        far += 1
        here = here[(here + far < len(token))]
        here = here[sub[here] == sub[here + far]]
        if not len(here):
            return made
        pair = T.mix(T.mix(token[here] ^ salt) + token[here + far])
        if k == 2:
            made.append((pair, here + far))
            continue
        third, more = here, 0
        while True:
            more += 1
            ok = third + far + more < len(token)
            third, pair = third[ok], pair[ok]
            ok = sub[third] == sub[third + far + more]
            third, pair = third[ok], pair[ok]
            if not len(third):
                break
            made.append((T.mix(T.mix(pair) + token[third + far + more]), third + far + more))


def features(docs: DataFrame, n: int, similarity: float, places: int) -> DataFrame:
    """As ``neardup.features``: bands are the keys of the short prefix, more_bands the other keys."""
    part, whole = round(similarity * 100), 100
    packed = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, n, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, bits = Sketcher(), packed.value
        for b in batches:
            made: list[tuple] = []
            for s in shingle_sets(b.column(1), n):
                if len(s):
                    c1 = int(T.signed(np.bitwise_xor.reduce(T.mix(s), keepdims=True))[0])
                    c2 = int(T.signed(T.mix(s ^ U64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=U64))[0])
                    at = place_of(s, places)
                    kind = (bits[at >> 2] >> ((at & 3) * 2).astype(np.uint8)) & 3
                    found, early = keys(s, kind, part, whole)
                    made.append((len(s), c1, c2, T.signed(found[early]), T.signed(found[~early]), sketch.counts(s)))
                else:
                    made.append((0, None, None, None, None, None))
            kinds = [("n_shingles", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bands", pa.list_(pa.int64())), ("more_bands", pa.list_(pa.int64())), ("counts", pa.binary())]
            columns = [pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns], ["doc_id", "text_hash", *(name for name, _ in kinds)])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash())
    return mapped(src, run, "doc_id long, text_hash long, n_shingles long, c1 long, c2 long, bands array<long>, more_bands array<long>, counts binary")


def jaccard_join(docs: DataFrame, n: int = 5, similarity: float = 0.8, places: int = 25) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, n_links.

    component_id is the least doc_id reachable over links; n_links is the number of links of the document's class of equal sets
    to other classes that were confirmed on whole sets. Inside a component whose members are joined already, further pairs are not compared.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the prefixes are complete for similarities from 0.8 to 1")
    tables = Tables(docs.sparkSession)
    found = grouped(docs, tables.put("features", features(docs, n, similarity, places)), n, similarity, tables, first_hubs=1)
    return found.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("class_links").alias("n_links"))
