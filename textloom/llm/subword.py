"""Sampled subword segmentations by forward filtering and backward sampling.

A text starts with a space (as the piece model expects) and is cut before each run of
spaces: a run and the word after it are one unit, and no piece crosses such a cut (a piece
with a space after another sign is left out; the model has none). The pieces inside a unit form a lattice over its bytes. The
forward pass sums, for each place, the weights of all segmentations up to it; sampling
then goes backward from the end and draws the last piece, the one before, and so on, each
from its exact conditional distribution. Equal units share one lattice; each occurrence
draws by itself. The random numbers come from a hash of the row's key, the unit's place in
the text and the step, so a row's segmentation is the same in any run and batch.

A piece's log weight is ``-alpha * log(id)``: the model is a list of merges in order of
frequency, and ranks follow Zipf's law (its own scores are ranks, no probabilities). A
character that is no piece is written as byte pieces, so that every text can be written and
``decode`` gives it back byte for byte; a U+2581 in the text is written in bytes too and stays
apart from a space. A null or empty text has no pieces and decodes to an empty text. Repeated
rows are sampled each, alike where their keys are; a null key counts as one key. Columns named
like the results are replaced, others are kept. An empty table gives no rows. A very long text
is sampled in parts of half a megabyte, cut between units; only a single run without spaces is
held whole (its lattice takes about 250 bytes a byte).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import PREFIX, mapped

U64 = T.U64
_PRIME = U64(0x100000001B3)
_BASIS = U64(0xCBF29CE484222325)
_SLICE = 1 << 19
#: Bytes into a unit beyond which its places are passed one by one.
_DEEP = 512


@lru_cache(4)
def pieces(path: str, alpha: float = 1.0) -> Pieces:
    return Pieces(path, alpha)


class Pieces:
    """The pieces of a model: bytes, weights and a hash table of their prefixes by length."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte = np.zeros(256, np.int64)
        usable = []
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.text[i], self.byte[value] = bytes([value]), i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                t = model.id_to_piece(i).replace("\u2581", " ").encode()
                self.text[i] = t
                if b" " not in t.lstrip(b" "):
                    usable.append(i)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        self.data = np.frombuffer(b"".join(self.text), np.uint8)
        self.weight = -alpha * np.log(np.arange(n) + 1.0)
        self.most = int(self.size[usable].max())
        whole: list[dict[int, int]] = [{} for _ in range(self.most + 1)]
        begin: list[set[int]] = [set() for _ in range(self.most + 1)]
        for i in usable:
            h = int(_BASIS)
            for k, b in enumerate(self.text[i], 1):
                h = ((h ^ b) * int(_PRIME)) & (2**64 - 1)
                begin[k].add(h)
            whole[len(self.text[i])][h] = i
        self.begin = [np.array(sorted(s), U64) for s in begin]
        self.whole = [(np.array(sorted(d), U64), np.array([d[k] for k in sorted(d)], np.int64)) for d in whole]

    def edges(self, b: np.ndarray, unit: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) over the bytes of many units; end: of each byte's unit."""
        out: list[tuple] = []
        start = np.flatnonzero(T.LEAD[b])
        h = np.full(len(start), _BASIS, U64)
        char = np.diff(np.r_[start, len(b)])  # a unit starts with a space, so characters end where the next starts
        known = np.zeros(len(b), bool)
        live = start
        for k in range(1, self.most + 1):
            h = (h ^ b[live + k - 1]) * _PRIME
            _, ok = T.lookup(self.begin[k], h)
            live, h, char = live[ok], h[ok], char[ok]
            at, ok = T.lookup(self.whole[k][0], h)
            if ok.any():
                out.append((live[ok], live[ok] + k, self.whole[k][1][at[ok]]))
                known[live[ok & (char == k)]] = True
            room = live + k < end[live]
            live, h, char = live[room], h[room], char[room]
            if not len(live):
                break
        # bytes of characters that are no piece
        lead = np.maximum.accumulate(np.where(T.LEAD[b], np.arange(len(b)), 0))
        raw = np.flatnonzero(~known[lead])
        out.append((raw, raw + 1, self.byte[b[raw]]))
        f, t, p = (np.concatenate([o[k] for o in out]) for k in range(3))
        return f, t, p

    def sample(self, raw: np.ndarray, off: np.ndarray, key: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all documents in order, and how many each has."""
        docs = len(off) - 1
        full = np.diff(off) > 0
        buf = np.insert(raw, off[:-1][full], 32)
        at = off + np.r_[0, np.cumsum(full)]
        space = buf == 32
        begins = space & np.r_[True, ~space[:-1]][: len(space)]
        begins[at[:-1][full]] = True
        start = np.flatnonzero(begins)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(docs, np.int64)
        stop = np.r_[start[1:], len(buf)]
        doc = np.searchsorted(at, start, "right") - 1
        salt = T.mix(key[doc].astype(U64) ^ T.mix(np.full(1, seed, U64))) + (start - at[doc]).astype(U64) * U64(0x9E3779B97F4A7C15)
        ids, count = [], []
        lo = 0
        while lo < len(start):  # units are independent, so a very long text is sampled in parts
            hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + _SLICE, "right")))
            i, n = self._units(buf, start[lo:hi], stop[lo:hi], salt[lo:hi])
            ids.append(i)
            count.append(n)
            lo = hi
        return np.concatenate(ids), np.bincount(doc, weights=np.concatenate(count), minlength=docs).astype(np.int64)

    def _units(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the units in order, and how many each has."""
        _, first, inv = np.unique(T.hashes(buf, start, stop), return_index=True, return_inverse=True)
        a, n = start[first], (stop - start)[first]
        base = np.r_[0, np.cumsum(n)]
        unit = np.repeat(np.arange(len(n)), n)
        b = buf[np.repeat(a - base[:-1], n) + np.arange(int(base[-1]))]
        f, t, p = self.edges(b, unit, base[1:][unit])
        # a unit's places are its bytes' starts and its end: place = byte + number of units before it
        node_f, node_t = f + unit[f], t + unit[f]
        deep = t - base[:-1][unit[f]]
        order = np.lexsort((node_f, node_t, deep))
        node_f, node_t, p, deep = node_f[order], node_t[order], p[order], deep[order]
        places = len(b) + len(n)
        ahead = np.full(places, -np.inf)
        ahead[base[:-1] + np.arange(len(n))] = 0
        w = self.weight[p]
        value = np.empty(len(p))
        bound = np.searchsorted(deep, np.arange(1, min(int(deep[-1]), _DEEP) + 2))
        for lo, hi in zip(bound[:-1], bound[1:], strict=True):
            if lo < hi:
                v = ahead[node_f[lo:hi]] + w[lo:hi]
                to = node_t[lo:hi]
                cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                ahead[to[cut]] = np.logaddexp.reduceat(v, cut)
                value[lo:hi] = v
        if bound[-1] < len(p):  # the far places of very long units, few at each depth
            self._far(node_f, node_t, w, value, ahead, int(bound[-1]))
        # into each place the longest piece, most often the likeliest, comes first
        order = np.lexsort((node_f, node_t))
        node_f, node_t, p = node_f[order], node_t[order], p[order]
        upto = np.cumsum(np.bincount(node_t, minlength=places))
        begin = np.r_[0, upto[:-1]]
        # chances are summed inside each place, so that no sum depends on other units
        total = np.exp(value[order] - ahead[node_t])
        turn = np.arange(len(p)) - begin[node_t]
        by = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[by], np.arange(1, int(turn.max()) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            total[by[lo:hi]] += total[by[lo:hi] - 1]
        # backward, all occurrences at once
        here = base[1:][inv] + inv
        root = base[:-1][inv] + inv
        live = np.arange(len(start))
        got: list[tuple] = []
        step = 0
        while len(live):
            u = (T.mix(salt[live] ^ T.mix(np.full(1, step + 1, U64))) >> U64(11)).astype(float) * 2.0**-53
            v = here[live]
            e, end = begin[v], upto[v] - 1
            aim = u * total[end]
            more = np.flatnonzero((total[e] <= aim) & (e < end))
            while len(more):
                e[more] += 1
                more = more[(total[e[more]] <= aim[more]) & (e[more] < end[more])]
            got.append((live, p[e]))
            here[live] = node_f[e]
            live = live[node_f[e] != root[live]]
            step += 1
        who = np.concatenate([g[0] for g in reversed(got)])
        ids = np.concatenate([g[1] for g in reversed(got)])[np.argsort(who, kind="stable")]
        return ids, np.bincount(who, minlength=len(start))

    @staticmethod
    def _far(node_f: np.ndarray, node_t: np.ndarray, w: np.ndarray, value: np.ndarray, ahead: np.ndarray, lo: int) -> None:
        """The forward pass from edge ``lo`` on, place by place."""
        places = {int(k): float(ahead[k]) for k in np.unique(node_f[lo:])}
        v = w[lo:].tolist()
        at, came, n = 0, node_f[lo:].tolist(), len(v)
        to = node_t[lo:].tolist()
        while at < n:
            k = at
            while k < n and to[k] == to[at]:
                v[k] += places[came[k]]
                k += 1
            top = max(v[at:k])
            places[to[at]] = top + log(sum([exp(x - top) for x in v[at:k]]))
            at = k
        value[lo:] = v
        new = np.unique(node_t[lo:])
        ahead[new] = [places[int(k)] for k in new]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the pieces of one text write."""
        n = self.size[ids]
        out = self.data[np.repeat(self.first[ids] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))] if len(ids) else np.zeros(0, np.uint8)
        return out[1:].tobytes()


def sample_pieces(docs: DataFrame, model: str, key: str = "doc_id", column: str = "text", seed: int = 0, alpha: float = 1.0, verify: bool = False) -> DataFrame:
    """The input's columns and ids: the sampled pieces as little-endian unsigned 32-bit numbers (binary).

    ``verify`` adds lossless: whether the ids decode to the text, byte for byte (in the same pass, so that a task
    has one Python worker).
    """
    rest = [c for c in docs.columns if c not in ("ids", *(["lossless"] if verify else []))]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.xxhash64(F.col(key)), F.lit(0)).alias(PREFIX + "key"), F.col(column).alias(PREFIX + "text"))
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model, alpha)
        for b in batches:
            keys = b.column(n).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            for lo, hi, buf, off in T.slices(b.column(n + 1), _SLICE):
                ids, count = table.sample(buf, off, keys[lo:hi], seed)
                data = ids.astype("<u4").tobytes()
                at = 4 * np.r_[0, np.cumsum(count)]
                made = [pa.array([data[at[k] : at[k + 1]] for k in range(hi - lo)], pa.binary())]
                if verify:
                    cut = np.r_[0, np.cumsum(count)]
                    made.append(pa.array([table.decode(ids[cut[k] : cut[k + 1]]) == buf[off[k] : off[k + 1]].tobytes() for k in range(hi - lo)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:n]), *made], [*rest, "ids", *(["lossless"] if verify else [])])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n]] + ["ids binary"] + (["lossless boolean"] if verify else []))
    return mapped(src, run, schema)


def decode_pieces(df: DataFrame, model: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """The input's columns but the ids, and the text that they write."""
    rest = [c for c in df.columns if c not in (column, to)]
    src = df.select(*[F.col(f"`{c}`") for c in rest], F.col(column).alias(PREFIX + "ids"))
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model)
        for b in batches:
            out = [table.decode(np.frombuffer(x, "<u4").astype(np.int64)).decode() if x else "" for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.string())], [*rest, to])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n]] + [f"`{to}` string"])
    return mapped(src, run, schema)
