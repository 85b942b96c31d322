r"""Near-duplicate documents by MinHash.

Method: one-permutation hashing (one hash of each shingle, 512 bins, the least
value of each bin) with optimal densification (an empty bin borrows from the
first occupied bin of its own random order of bins, the same order for every
document), banded buckets, and star-shaped candidate edges: a bucket gives one
edge from each member to a hub, so edges grow with members, not with pairs.

Whole results:

* exact copies of a shingle set are one class from the start, so a group of
  copies costs one row per band;
* every candidate edge is confirmed on the full shingle sets;
* a star can miss a link between two members that are both unlike the hub. All members of a
  hub's buckets form the hub's group; while a group holds members of several components, those
  outside its largest component are compared with the whole group. There is no cap on groups or rounds.
* the first hub of a bucket is the member that shares most bucket places with others:
  of a large group of changed copies that is the text they come from, so that one star
  joins the group and little is left for the rounds after it.

No pair is written out before it has passed an exact bound. A set's histogram is the number of
its shingles in each of 512 bins; the bins' smaller counts add up to an upper bound of the
intersection, so a pair whose bound lies under the similarity has no link, whatever its texts are.
Groups are sorted with their heads (the hub, or the members to compare) before the others and
stream through a task in Arrow batches: a group costs a row for each member and holds no more than its heads
(``HEADS``) in memory; large groups are cut by a salt, with a copy of the heads for each cut.
What is quadratic is only the comparing of histograms inside a batch, heads by members.
Pairs that pass are confirmed the same way on their whole texts, each text once for each group.

With 64 bands of 8 values a pair at similarity 0.8 shares no bucket with a
probability of (1 - 0.8^8)^64, about 8e-6. Bands of 4 values were tried and left:
frequent word pairs with low hashes filled buckets with hundreds of documents
that are not alike.

Nulls and ties: a null, empty or wordless text has an empty set and is linked
with nothing. Repeated rows are copies. Rows with one doc_id and different texts
are placed each by its own text. A row without a doc_id takes part as a copy only.
Other columns of the input are ignored, whatever their names. An empty table gives no rows.
Very long texts: a text's set must fit in a task; nothing else grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._io import PREFIX, Tables, mapped

U64 = T.U64
#: Members of a group that are compared with the whole group in one round; the rest follow in the next rounds.
HEADS = 4096
#: Members of a group between two cuts, at least; with many heads it is half as many as these, as each cut gets a copy of the heads.
CUT = 500


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles (A-Z lower-cased); of fewer words, one for all of them."""
    for lo, hi, raw, off in T.slices(texts):
        buf = T.lower(raw)
        w = T.spans(buf, off, T.SPACE)
        h = T.hashes(buf, w.start, w.end)
        s, at = T.windows(h, w.doc, n)
        word, shingle = T.per_doc(w.doc, hi - lo), T.per_doc(w.doc[at], hi - lo)
        for d in range(hi - lo):
            a, b = shingle[d], shingle[d + 1]
            if a < b:
                yield np.unique(s[a:b])
            elif (k := word[d + 1] - word[d]) > 0:
                yield T.ordered(h, np.array([word[d]]), int(k))
            else:
                yield np.zeros(0, U64)


class Sketcher:
    """One-permutation MinHash with optimal densification, cut into bands."""

    def __init__(self, bins: int = 512, rows: int = 8, seed: int = 7):
        if bins & (bins - 1) or bins % rows:
            raise ValueError("bins must be a power of two and a multiple of rows")
        rng = np.random.default_rng(seed)
        self.bins, self.rows, self.shift = bins, rows, U64(64 - bins.bit_length() + 1)
        #: Place of each bin in the order in which an empty bin looks for an occupied one.
        self.turn = np.argsort(rng.random((bins, bins)), axis=1)
        self.order = np.argsort(self.turn, axis=1).astype(np.int16)
        self.factor = rng.integers(1, 2**63, rows, dtype=np.int64).astype(U64) | U64(1)
        self.salt = T.mix(np.arange(1, bins // rows + 1, dtype=U64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """shingles: sorted, distinct, not empty."""
        x = np.sort(T.mix(shingles))
        at = (x >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        full = at[first]
        out = np.zeros(self.bins, U64)
        out[full] = x[first]
        if len(full) < self.bins:
            got = np.zeros(self.bins, bool)
            got[full] = True
            empty = np.flatnonzero(~got)
            if len(full) * 8 > self.bins:  # most find one within a few turns
                for k in range(10):
                    from_ = self.turn[empty, k]
                    hit = got[from_]
                    out[empty[hit]] = out[from_[hit]]
                    empty = empty[~hit]
            if len(empty):
                out[empty] = out[full[self.order[np.ix_(empty, full)].argmin(axis=1)]]
        return out

    def bands(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(-1, self.rows)
        return T.mix((rows * self.factor).sum(axis=1, dtype=U64) ^ self.salt)

    def counts(self, shingles: np.ndarray) -> bytes | None:
        """Shingles in each bin; None where one holds more than a byte can count."""
        n = np.bincount((T.mix(shingles) >> self.shift).astype(np.int64), minlength=self.bins)
        return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def text_hash() -> Column:
    """With doc_id, the key of a document's rows: one id may stand for several texts, and a row may have none."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def features(docs: DataFrame, n: int, bins: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, c1 and c2 (128 bits that name the set), bands and counts; the last four null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(bins, rows)
        for b in batches:
            made: list[tuple] = []
            for s in shingle_sets(b.column(1), n):
                if len(s):
                    c1 = int(T.signed(np.bitwise_xor.reduce(T.mix(s), keepdims=True))[0])
                    c2 = int(T.signed(T.mix(s ^ U64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=U64))[0])
                    made.append((len(s), c1, c2, T.signed(sketch.bands(sketch.signature(s))), sketch.counts(s)))
                else:
                    made.append((0, None, None, None, None))
            kinds = [("n_shingles", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bands", pa.list_(pa.int64())), ("counts", pa.binary())]
            found = [pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *found], ["doc_id", "text_hash", *(name for name, _ in kinds)])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash())
    return mapped(src, run, "doc_id long, text_hash long, n_shingles long, c1 long, c2 long, bands array<long>, counts binary")


def likely(df: DataFrame, keys: DataFrame, on: str, mark: str | None = None) -> DataFrame:
    """The rows of df whose ``on`` may be among keys, by a bit for each hash of a key; with ``mark``, all rows and a column that tells.

    The bits are at most 2^25 (4 MB) whatever the number of keys, which bounds what is
    broadcast; the more keys, the less it filters. It spares the shuffle most rows before
    the exact join.
    """
    place = F.xxhash64(on).bitwiseAND((1 << 25) - 1)
    bit = place.bitwiseAND((1 << 15) - 1)
    bits = keys.select(F.shiftright(place, 15).alias(PREFIX + "block"), bit.alias(PREFIX + "bit")).groupBy(PREFIX + "block").agg(F.bitmap_construct_agg(PREFIX + "bit").alias(PREFIX + "bits"))
    at = df.withColumn(PREFIX + "block", F.shiftright(place, 15)).join(F.broadcast(bits), PREFIX + "block", "left" if mark else "inner")
    byte = F.conv(F.hex(F.substring(PREFIX + "bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(7))), F.lit(2)) == 1, F.lit(False))
    return at.withColumn(mark, hit).select(*df.columns, mark) if mark else at.where(hit).select(df.columns)


def linked(n1, n2, both, part: int, whole: int):
    """Whether sets of n1 and n2 elements with ``both`` in common are similar enough."""
    return (both > 0) & (whole * both >= part * (n1 + n2 - both))


def meet(heads: DataFrame, members: DataFrame, items: DataFrame, prepare, judge) -> DataFrame:
    """(u, v) of heads and members (g, rep, label) of equal g for which ``judge`` finds a link; items has (rep, n, data) of each.

    ``prepare`` turns a batch's data into a list of arrays with an entry for each row. ``judge(heads, members)``
    takes [rep, label, n, *prepared] of both sides in one group and returns index arrays into both.
    """
    size = members.groupBy("g").agg(F.count("*").alias("m")).join(heads.groupBy("g").agg(F.count("*").alias("k")), "g")
    salts = size.select("g", F.ceil(F.col("m") / F.greatest(F.lit(CUT), F.col("k") / 2)).cast("int").alias("salts"))
    rest = members.join(salts, "g").select("g", F.pmod(F.xxhash64("rep"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "rep", "label")
    first = heads.join(salts, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "rep", "label")
    both = rest.unionByName(first).join(items, "rep").select("g", "salt", "kind", "rep", "label", "n", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            g, salt, kind, *own = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            rows = [*own, *prepare(b.column(6))]
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
            us, vs = [], []
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                part = [c[lo:hi] for c in rows]
                if group != (g[lo], salt[lo]):
                    group, held = (g[lo], salt[lo]), []
                if kind[lo] == 0:
                    held = [np.concatenate(x) for x in zip(held, part, strict=True)] if held else part
                elif held:
                    at, of = judge(held, part)
                    us.append(held[0][at])
                    vs.append(part[0][of])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], ["u", "v"])

    return mapped(both.repartition("g", "salt").sortWithinPartitions("g", "salt", "kind"), run, "u long, v long")


def histograms(col: pa.Array) -> list[np.ndarray]:
    """The counts as a matrix, and which rows have some."""
    some = np.asarray(col.is_valid())
    got = [x for x in col.to_pylist() if x is not None]
    out = np.zeros((len(col), len(got[0]) if got else 1), np.uint8)
    if got:
        out[some] = np.frombuffer(b"".join(got), np.uint8).reshape(len(got), -1)
    return [out, some]


def bounded(part: int, whole: int, each_label: bool = False):
    """Judges by sizes and histograms: no only where a link is impossible. Members of one label need no further link.

    With ``each_label`` a head gets only its likeliest member of each label in a batch: enough to join components that belong together, not to tell them apart.
    """

    def judge(heads: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v, labels, size, counts, some = rows
        at, of = [], []
        for i, (u, label, n, own, known) in enumerate(zip(*heads, strict=True)):
            near = np.flatnonzero((labels != label) & (v != u) & (whole * np.minimum(size, n) >= part * np.maximum(size, n)))
            alike = np.zeros(len(near))
            if known and len(near):
                ok = ~some[near]
                for lo in range(0, len(near), 4096):
                    j = near[lo : lo + 4096]
                    if counts.shape[1] == len(own):
                        most = np.minimum(counts[j], own).sum(axis=1, dtype=np.int64)
                        ok[lo : lo + 4096] |= linked(n, size[j], most, part, whole)
                        alike[lo : lo + 4096] = most / (n + size[j] - most)
                near, alike = near[ok], alike[ok]
            if each_label and len(near):
                order = np.lexsort((-alike, labels[near]))
                near = near[order[np.r_[True, np.diff(labels[near][order]) != 0]]]
            at.append(np.full(len(near), i))
            of.append(near)
        return np.concatenate(at), np.concatenate(of)

    return judge


def exact(part: int, whole: int):
    """Judges by whole sets; a group has one head."""

    def judge(heads: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = heads[3][0]
        ok = [i for i, s in enumerate(rows[3]) if linked(len(own), len(s), len(np.intersect1d(own, s, assume_unique=True)), part, whole)]
        return np.zeros(len(ok), np.int64), np.array(ok, np.int64)

    return judge


def objects(items: Iterator[np.ndarray], n: int) -> list[np.ndarray]:
    out = np.empty(n, object)
    for i, x in enumerate(items):
        out[i] = x
    return [out]


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, label): the least node of each component of the edges (u, v).

    Each round takes the least label among a node, its neighbours and their
    labels' labels. Sums over a hub's edges are partial aggregates; joins on a hub
    can be split by adaptive execution. Each round ends in a stored table.
    """
    both = tables.put("links", edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = tables.put("labels", both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        nearer = labels.join(near, "node").select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        up = nearer.select(F.col("node").alias("new"), F.col("new").alias("top"))
        after = tables.put("labels", nearer.join(up, "new").select("node", F.least("new", "top").alias("label"), "old"))
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            tables.drop("links")
            return labels


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, bins: int = 512, rows: int = 8) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept, class_links.

    component_id is the least doc_id reachable over links (sets of n-word shingles with
    a Jaccard similarity of at least ``similarity``, taken in hundredths); kept marks the row with that id.
    class_links is the number of confirmed links of the document's class of equal sets that were followed.
    """
    tables = Tables(docs.sparkSession)
    return grouped(docs, tables.put("features", features(docs, n, bins, rows)), n, similarity, tables)


def grouped(docs: DataFrame, feats: DataFrame, n: int, similarity: float, tables: Tables, first_hubs: int = 0) -> DataFrame:
    """The result of ``near_duplicates`` from a stored table of ``features``: documents that may be linked share a value in ``bands``, whatever it stands for.

    If there is a column ``more_bands``, a value may also stand there with one of the two. Where a document has many hubs, ``first_hubs`` rounds
    compare it with its most central hub outside its component only, so that confirmed links grow with the documents and not
    with documents times hubs; then with all hubs that are left. Members outside their group's largest component first meet the likeliest member of
    each component, so that those which belong there join it by one link; only then the whole group.
    """
    part, whole = round(similarity * 100), 100
    some = feats.where("n_shingles > 0 and doc_id is not null")
    # rep is a number of the class by itself: a doc_id may stand for several texts
    least = some.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.max("n_shingles").alias("n"))
    classes = tables.put("classes", least.select("c1", "c2", "n", "x.doc_id", "x.text_hash", F.monotonically_increasing_id().alias("rep")))
    # keys that more than one row has; then, of these few, each class once
    buckets = some.select("c1", "c2", F.explode("bands").alias("key"))
    counts = buckets.groupBy("key").agg(F.count("*").alias("m"))
    if "more_bands" in feats.columns:
        marked = F.transform("bands", lambda k: F.struct(k.alias("key"), F.lit(1).alias("first")))
        both = some.select("c1", "c2", F.explode(F.concat(marked, F.transform("more_bands", lambda k: F.struct(k.alias("key"), F.lit(0).alias("first"))))).alias("b")).select("c1", "c2", "b.key", "b.first")
        buckets, counts = both.drop("first"), both.groupBy("key").agg(F.count("*").alias("m"), F.max("first").alias("f")).where("f = 1")
    crowd = tables.put("crowd", counts.where("m > 1").select("key"))
    each = likely(buckets, crowd, "key").distinct().join(classes, ["c1", "c2"]).select("key", "rep")
    met = tables.put("buckets", each)
    size = met.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    # the hub is the member that meets most others over all its buckets: of copies of one text, the text rather than a copy
    central = met.join(size, "key").groupBy("rep").agg(F.sum(F.col("m") - 1).alias("meets"))
    placed = tables.put("placed", met.join(central, "rep").select("key", "rep", "meets"))
    hub = placed.groupBy("key").agg(F.min(F.struct((-F.col("meets")).alias("far"), "rep")).alias("hub")).select("key", F.col("hub.rep").alias("g"), *([F.col("hub.far").alias("far")] if first_hubs else []))
    group = tables.put("groups", placed.join(hub, "key").where("rep <> g").drop("key", "meets").distinct())
    tables.drop("crowd", "buckets", "placed")
    # only these take part in any round
    ids = group.select("rep").unionByName(group.select(F.col("g").alias("rep"))).distinct().join(classes.select("rep", "n", "doc_id", "text_hash"), "rep")
    ids = tables.put("ids", ids)
    key = ["doc_id", "text_hash"]

    def of_ids(rows: DataFrame) -> DataFrame:
        return likely(rows, ids, "doc_id").dropDuplicates(key).join(ids, key).select("rep", "n", "data")

    sketches = tables.put("sketches", of_ids(feats.select(*key, F.col("counts").alias("data"))))
    texts = tables.put("texts", of_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(), F.col("text").cast("string").alias("data"))))

    def possible(heads: DataFrame, members: DataFrame, each_label: bool = False) -> DataFrame:
        return meet(heads, members, sketches, histograms, bounded(part, whole, each_label))

    def confirmed(pairs: DataFrame) -> DataFrame:
        heads = pairs.select(F.col("u").alias("g"), F.col("u").alias("rep"), F.col("u").alias("label")).distinct()
        members = pairs.select(F.col("u").alias("g"), F.col("v").alias("rep"), F.col("v").alias("label"))
        return meet(heads, members, texts, lambda col: objects(shingle_sets(col, n), len(col)), exact(part, whole))

    hubs = group.select("g", F.col("g").alias("rep"), F.col("g").alias("label")).distinct()
    left, early, labels = group, None, None
    for k in range(first_hubs):
        if labels is not None:
            of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))  # noqa: B023, E731
            left = left.join(of("g"), "g", "left").join(of("rep"), "rep", "left").where("coalesce(l_g, g) <> coalesce(l_rep, rep)").select("g", "rep", "far")
            left = tables.put(f"left-{k}", left)
        one = left.groupBy("rep").agg(F.min(F.struct("far", "g")).alias("x")).select(F.col("x.g").alias("g"), "rep")
        found = tables.put(f"early-{k}", confirmed(tables.put("pairs", possible(hubs, one.select("g", "rep", F.col("rep").alias("label"))))))
        early = found if early is None else early.unionByName(found)
        labels = components(early, tables)
        left = left.join(one, ["g", "rep"], "left_anti")
    if early is not None:
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
        left = left.join(of("g"), "g", "left").join(of("rep"), "rep", "left").where("coalesce(l_g, g) <> coalesce(l_rep, rep)")
    star = possible(hubs, left.select("g", "rep", F.col("rep").alias("label")))
    edges = tables.put("edges-0", confirmed(tables.put("pairs", star)))
    if early is not None:
        edges = edges.unionByName(early)
    labels = components(edges, tables)
    group = group.select("g", "rep")
    # a hub has met its group; the group's members have yet to meet each other
    rest, rounds = group, 0
    sketched = first_hubs == 0
    while True:
        at = rest.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("g", "rep", F.coalesce("label", "rep").alias("label"))
        at = tables.put("open", at)
        by = at.groupBy("g", "label").agg(F.count("*").alias("m"), F.min("rep").alias("first"))
        top = by.groupBy("g").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("g", F.col("top.label").alias("largest"))
        small = by.join(top, "g").where("label <> largest").select("g", "label", "m", "first")
        apart = at.join(small, ["g", "label"])
        if rounds == 0 or rounds == 1 and first_hubs:  # one of each component first: components that belong together are then joined at little cost
            apart = apart.where("rep = first")
        rank = F.row_number().over(Window.partitionBy("g").orderBy("m", "rep"))
        turn = tables.put("turn", apart.withColumn("rank", rank).where(F.col("rank") <= HEADS).select("g", "rep", "label"))
        if turn.isEmpty():
            break
        rest = at.join(top.select("g"), "g", "left_semi")
        found = possible(turn, rest, not sketched).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        rounds += 1
        new = tables.put(f"edges-{rounds}", confirmed(tables.put("pairs", found)))
        if not new.isEmpty():
            edges = edges.unionByName(new)
            labels = components(edges, tables)
        if not sketched:  # likeliest links only, so nobody has met the whole group yet
            sketched, rest = True, rest.select("g", "rep")
            continue
        rest = rest.join(turn.select("g", "rep"), ["g", "rep"], "left_anti").select("g", "rep")
    degree = edges.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("class_links"))
    least = labels.join(classes.select(F.col("rep").alias("node"), "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("top"))
    tops = labels.join(least, "label").select(F.col("node").alias("rep"), "top")
    linked_ = classes.select("c1", "c2", "rep", F.col("doc_id").alias("own")).join(tops, "rep", "left").join(degree, "rep", "left")
    top = tables.put("members", linked_.select("c1", "c2", F.coalesce("top", "own").alias("top"), F.coalesce("class_links", F.lit(0)).alias("class_links")))
    tables.drop(*(f"{name}-{k}" for k in range(first_hubs) for name in ("early", "left")))
    tables.drop("classes", "groups", "ids", "sketches", "texts", "pairs", "open", "turn", "labels", *(f"edges-{i}" for i in range(rounds + 1)))
    placed = feats.select("doc_id", "text_hash", "n_shingles", "c1", "c2").join(top, ["c1", "c2"], "left")
    group = F.coalesce("top", "doc_id")
    return placed.select("doc_id", "text_hash", "n_shingles", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.col("doc_id").isNull() & group.isNull()).alias("kept"), F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links"))
