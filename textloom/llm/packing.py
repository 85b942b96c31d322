"""Packing documents into sequences of a fixed window.

Bounded-space online packing. Each partition keeps a fixed number of open windows. A
document goes into the open window that it fills best. When none fits, the fullest
window is emitted: if more than ``most_gap`` tokens of it are free, the head of the
document fills them first. Documents longer than a window are cut into whole windows
and a rest. The windows that are open when a partition ends are merged: a group of
``merge`` partitions' windows is packed tightly in one task, whose last window is cut
into sequences of a power of two, which need no padding. A group holds at most
``merge * windows`` windows.

A document's tokens are those of the tokenizer without special tokens, then ``end_id``.
The tokenizer splits at white space before it merges, so words are encoded apart and the
ids of a bounded number of words kept. A null or empty text is its end token only.
Repeated rows are packed each, under their id; a null id stays null. Other columns are ignored, whatever their
names. Windows that would be filled alike are taken in the order in which they were opened. A very long text
is encoded whole and must fit in a task; its pieces lie in as many sequences as they need. An empty table gives
no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import mapped, stored

_SCHEMA = "doc_id long, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long, grp int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("grp", pa.int32())])
_OUT = 4 << 20
U64 = T.U64


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _plain() -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes of a plain word: 1 letter, 2 digit, 3 other sign, 0 not plain."""
    kind = np.zeros(256, np.int8)
    kind[0x21:0x7F] = 3
    kind[48:58] = 2
    kind[65:91] = kind[97:123] = 1
    kind[0x27] = 0  # an apostrophe may start a contraction
    second = np.zeros(256, bool)  # after C3: letters from U+00C0 to U+00FF
    second[0x80:0xC0] = True
    second[[0x97, 0xB7]] = False
    return kind, second


class WordEncoder:
    """Token ids of whole texts, word by word.

    A word of ASCII and Latin-1 letters, digits and signs is split and merged here, many
    words at a time, by the tokenizer's own vocabulary and merges; any other word, and one
    with an added token's content, goes through the tokenizer itself. Words are known by a 64-bit hash; the ids of the first
    ``kept`` words stay for later texts.
    """

    NEVER = np.int32(1 << 30)

    def __init__(self, path: str, kept: int = 1 << 20):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        #: Added tokens are found in the text before it is split; a word that holds one in any case goes through the tokenizer as it was written.
        self.added = [t["content"].encode().lower() for t in whole.get("added_tokens") or []]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        end = model["end_of_word_suffix"]
        self.byte = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int32)
        key = np.array([vocab[x] << 16 | vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(key)
        self.pair, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.kind, self.second = _plain()
        self.kept = kept
        self.known, self.first, self.ids = np.zeros(0, U64), np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, ok = T.lookup(self.pair, left.astype(np.int64) << 16 | right)
        return np.where(ok, self.rank[at], self.NEVER)

    def merge(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges symbols within owners, least rank first and left to right; returns (symbols, owners)."""
        out_s, out_o = [], []
        rank = np.full(len(sym), self.NEVER)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        rank[same] = self._ranks(sym[same], sym[same + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            n = np.diff(np.r_[start, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, start), n)
            done = least == self.NEVER
            if done.any():
                out_s.append(sym[done])
                out_o.append(owner[done])
                go = ~done
                sym, owner, rank, least = sym[go], owner[go], rank[go], least[go]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            run = np.r_[True, np.diff(hit) > 1]  # of one symbol in a row, each second pair overlaps the one before
            head = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            fresh = np.unique(np.r_[at, at[at > 0] - 1])
            rank[fresh] = self.NEVER
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh] = self._ranks(sym[fresh], sym[fresh + 1])
        if not out_s:
            return sym, owner
        s, o = np.concatenate(out_s), np.concatenate(out_o)
        order = np.argsort(o, kind="stable")
        return s[order], o[order]

    def special(self, buf: np.ndarray, w: T.Spans) -> np.ndarray:
        """Which words of the lower-cased text hold an added token's content."""
        out, data = np.zeros(len(w.start), bool), buf.tobytes()
        for content in self.added:
            at = data.find(content)
            while at >= 0:
                k = int(np.searchsorted(w.start, at, "right")) - 1
                if k >= 0 and at + len(content) <= w.end[k]:
                    out[k] = True
                at = data.find(content, at + 1)
        return out

    def words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, raw: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids of words that are not known."""
        n = end - start
        word = np.repeat(np.arange(len(n)), n)
        b = buf[np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))]
        lead = b == 0xC3
        follow = np.r_[False, lead[:-1] & (word[1:] == word[:-1])] & self.second[b]
        kind = self.kind[b]
        kind[follow] = 1
        good = follow | (kind > 0)
        good[:-1] |= lead[:-1] & follow[1:]
        kind[lead] = 1
        odd = np.zeros(len(n), bool)
        odd[word[~good]] = True
        odd |= special
        use = ~odd[word]
        b, word, kind, follow = b[use].copy(), word[use], kind[use], follow[use]
        up = follow & (b >= 0x80) & (b <= 0x9E)
        b[up] += 0x20
        if len(b):
            new = np.r_[True, (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)]
            owner = np.cumsum(new) - 1
            last = np.r_[new[1:], True]
            sym, of = self.merge(np.where(last, self.last[b], self.byte[b]), owner)
            of = word[np.flatnonzero(new)][of]
        else:
            sym, of = np.zeros(0, np.int32), np.zeros(0, np.int64)
        strange = np.flatnonzero(odd)
        if len(strange):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([(raw if special[k] else buf)[start[k] : end[k]].tobytes().decode() for k in strange], add_special_tokens=False)]
            sym = np.concatenate([sym, *(np.array(g, np.int32) for g in got)])
            of = np.concatenate([of, np.repeat(strange, [len(g) for g in got])])
            order = np.argsort(of, kind="stable")
            sym, of = sym[order], of[order]
        return np.bincount(of, minlength=len(n)), sym.astype(np.uint16)

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[bytes, np.ndarray]:
        """Ids (little-endian unsigned 32-bit) of all documents, each with its end, and their offsets in ids."""
        buf = T.lower(raw)
        docs = len(off) - 1
        w = T.spans(buf, off, T.SPACE)
        h = T.hashes(buf, w.start, w.end)
        special = self.special(buf, w)
        if special.any():  # known by their own case
            h[special] = T.mix(T.hashes(raw, w.start[special], w.end[special]) ^ U64(0x5851F42D4C957F2D))
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        at, ok = T.lookup(self.known, uniq)
        new = np.flatnonzero(~ok)
        count, ids = self.words(buf, w.start[first[new]], w.end[first[new]], raw, special[first[new]])
        begin = np.zeros(len(uniq), np.int64)
        size = np.zeros(len(uniq), np.int64)
        begin[ok], size[ok] = self.first[at[ok]], self.first[at[ok] + 1] - self.first[at[ok]]
        begin[new], size[new] = len(self.ids) + np.r_[0, np.cumsum(count)[:-1]][: len(new)], count
        pool = np.concatenate([self.ids, ids, np.array([end_id], np.uint16)])
        if len(self.known) < self.kept and len(new):
            keys = np.concatenate([self.known, uniq[new]])
            order = np.argsort(keys, kind="stable")
            lens = np.concatenate([np.diff(self.first), count])[order]
            from_ = np.concatenate([self.first[:-1], begin[new]])[order]
            self.known, self.first = keys[order], np.r_[0, np.cumsum(lens)]
            self.ids = pool[np.repeat(from_ - self.first[:-1], lens) + np.arange(int(self.first[-1]))]
        n = np.bincount(w.doc, minlength=docs)
        b, s = np.full(len(h) + docs, len(pool) - 1, np.int64), np.ones(len(h) + docs, np.int64)
        place = np.arange(len(h)) + w.doc
        b[place], s[place] = begin[inv], size[inv]
        total = np.r_[0, np.cumsum(s)]
        out = pool[np.repeat(b - total[:-1], s) + np.arange(int(total[-1]))].astype("<u4")
        return out.tobytes(), total[np.r_[0, np.cumsum(n + 1)]]


class Packer:
    """Open windows of one task. A piece is (doc_id, start, ids, doc_tokens), ids as bytes of 4 a token."""

    def __init__(self, window: int, windows: int, most_gap: int, first_id: int):
        self.window, self.windows, self.most_gap, self.next_id = window, windows, most_gap, first_id
        self.open: dict[int, list] = {}
        self.free: list[tuple[int, int]] = []  # sorted (free tokens, key)
        self.key = 0

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, ids, n, total, self.next_id, at, None
            at += n
        self.next_id += 1

    def _place(self, piece: tuple, free: int, key: int) -> None:
        self.open[key].append(piece)
        insort(self.free, (free - len(piece[2]) // 4, key))

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total, at, w = len(ids) // 4, 0, self.window
        while total - at >= w:
            yield from self._emit([(doc, at, ids[4 * at : 4 * (at + w)], total)])
            at += w
        while at < total:
            n = total - at
            k = bisect_left(self.free, (n, -1))
            if k < len(self.free):
                free, key = self.free.pop(k)
                self._place((doc, at, ids[4 * at :], total), free, key)
                return
            if len(self.free) < self.windows:
                self.key += 1
                self.open[self.key] = []
                self._place((doc, at, ids[4 * at :], total), w, self.key)
                return
            free, key = self.free.pop(0)
            pieces = self.open.pop(key)
            if free > self.most_gap:
                pieces.append((doc, at, ids[4 * at : 4 * (at + free)], total))
                at += free
            yield from self._emit(pieces)

    def rest(self, group: int) -> Iterator[tuple]:
        """What is still open, marked with its group."""
        for key in sorted(self.open):
            for doc, start, ids, total in self.open[key]:
                yield doc, start, ids, len(ids) // 4, total, key, 0, group


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 64
        if size > _OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _merged(rows: list[tuple], window: int, first_id: int) -> Iterator[tuple]:
    """Rows of one group, packed tightly; the last window in powers of two."""
    total = sum(r[3] for r in rows)
    sizes = [window] * (total // window) + [1 << k for k in range(window.bit_length() - 1, -1, -1) if total % window >> k & 1]
    at, seq, room = 0, -1, 0
    for doc, start, ids, n, tokens, _, _, _ in rows:
        used = 0
        while used < n:
            if not room:
                seq, at = seq + 1, 0
                room = sizes[seq]
            take = min(room, n - used)
            yield doc, start + used, ids[4 * used : 4 * (used + take)], take, tokens, first_id + seq, at, None
            used, at, room = used + take, at + take, room - take


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, windows: int = 64, most_gap: int = 16, merge: int = 16) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian unsigned 32-bit), length, doc_tokens, sequence_id, offset."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(window, windows, most_gap, part << 32)
        words = encoder(tokenizer)

        def rows() -> Iterator[tuple]:
            for b in batches:
                ids = b.column(0).to_pylist()
                for lo, hi, buf, off in T.slices(b.column(1), 4 << 20):
                    data, at = words.encode(buf, off, end_id)
                    for k, doc in enumerate(ids[lo:hi]):
                        yield from packer.add(doc, data[4 * at[k] : 4 * at[k + 1]])
            yield from packer.rest(part // merge)

        yield from _batches(rows())

    def finish(table: pa.Table) -> pa.Table:
        t = table.combine_chunks().sort_by([("sequence_id", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        rows = list(zip(*(c.to_pylist() for c in t.columns), strict=True))
        out = list(_batches(_merged(rows, window, (1 << 62) + (rows[0][7] << 32))))
        return pa.Table.from_batches(out, _ARROW)

    first = stored(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SCHEMA), "packed")
    late = first.where("grp is not null").groupBy("grp").applyInArrow(finish, _SCHEMA)
    return first.where("grp is null").unionByName(late).drop("grp")


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
