"""Similarity join, fill-in-the-middle and spelling variants against plain versions of themselves."""

import hashlib
import re
import string
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest

from textloom.llm import fim, jaccard, queries, spelling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def components(sets):
    """Least id reachable, of all pairs."""
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {i: root(i) for i in sets}


def oracle(name, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.sql(queries.oracle_sql()[name]).fetchall()


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.97, 1.0])
def test_linked_sets_share_a_key(similarity):
    rng = np.random.default_rng(3)
    part = round(similarity * 100)
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 11, 15, 16, 17, 20, 47, 63, 64, 66, 100, 300, 900]:
        for _ in range(40):
            frequent = rng.random()
            a = np.unique(rng.integers(1, 2**63, size, dtype=np.int64).astype(np.uint64))
            kind = dict(zip(a.tolist(), rng.choice(3, len(a), p=[(1 - frequent), frequent / 2, frequent / 2]), strict=True))
            most = size - -(-part * size // 100)
            lost, new = int(rng.integers(0, most + 1)), int(rng.integers(0, size // 4 + 1))
            b = a[np.sort(rng.permutation(len(a))[: len(a) - lost])]
            extra = rng.integers(1, 2**63, new, dtype=np.int64).astype(np.uint64)
            kind |= dict(zip(extra.tolist(), rng.choice(3, new), strict=True))
            b = np.unique(np.concatenate([b, extra]))
            both = len(np.intersect1d(a, b))
            if len(b) and len(np.setxor1d(a, b)) and 100 * both >= part * (len(a) + len(b) - both):
                of = [jaccard.keys(x, np.array([kind[t] for t in x.tolist()], np.uint8), part, 100) for x in (a, b)]
                (x, early_x), (y, early_y) = of
                assert len(np.intersect1d(x[early_x], y)) or len(np.intersect1d(x, y[early_y])), (size, lost, new)
                if len(a) != len(b):  # in the short prefix of the smaller one
                    assert len(np.intersect1d(x[early_x], y) if len(a) < len(b) else np.intersect1d(x, y[early_y]))


def test_combinations_grow_with_the_prefix():
    rng = np.random.default_rng(5)
    for size in (64, 1000, 20_000):
        tokens = np.unique(rng.integers(1, 2**63, size, dtype=np.int64).astype(np.uint64))
        for kind in range(3):
            assert len(jaccard.keys(tokens, np.full(size, kind, np.uint8), 80, 100)[0]) <= 3 * size


def test_jaccard_join_is_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: shingles(r.text, 5) for r in docs.collect()}
    same = components(want)
    for places in (25, 10):  # with few places, nearly every token counts as frequent
        got = jaccard.jaccard_join(docs, 5, 0.8, places=places).collect()
        assert {r.doc_id: r.component_id for r in got} == same and {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in want.items()}
    assert sum(i != c for i, c in same.items()) > 5
    assert sorted(oracle("op11_ngram_jaccard_join", docs)) == sorted((i, len(want[i]), same[i]) for i in want)


def test_jaccard_join_of_odd_rows(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in (0, 1, 58, 59)]
    rows = [(1, " ".join(words)), (2, near[0]), (3, near[1]), (4, near[2]), (5, near[3]), (6, None), (7, ""), (8, " \n\t"), (9, "a b"), (10, "A  b"), (11, "b a"), (12, " ".join(words * 300)), (12, " ".join(words * 300)), (None, " ".join(words)), (13, "x y z u v"), (14, "x y z u v w")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, rep string")
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in jaccard.jaccard_join(docs, 5).collect()}
    sets = {i: shingles(t, 5) for i, t in rows if i is not None}
    assert {(i, c) for i, c, _ in got if i is not None} == {(i, c) for i, c in components(sets).items()}
    assert (None, 1, 56) in got and (6, 6, 0) in got and (12, 1, 60) in got and (10, 9, 1) in got
    assert jaccard.jaccard_join(docs.limit(0)).columns == ["doc_id", "text_hash", "n_shingles", "component_id", "n_links"] and jaccard.jaccard_join(docs.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        jaccard.jaccard_join(docs, 5, 0.5)


def plain_fim(doc_id, text):
    """By the definition, on strings."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest, n = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest(), len(units)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_is_the_definition(spark, data):
    odd = [None, "", "a", "é", "<", "<S", "<S> in it", "a<P", "\n\n", "día 9 𝄞𝄞 x", "M>", "ab " * 40_000, "same", "same"]
    rows = [(i, t) for i, t in enumerate(odd * 20)] + [(1, "same"), (1, "same")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, output string, m int")
    made = fim.restored(fim.fill_in_middle(docs))
    got = [(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, r.m) for r in made.collect()]
    assert sorted(got, key=str) == sorted(((i, t, *plain_fim(i, t), t or "", 1) for i, t in rows), key=str)
    assert {g[3] for g in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).isEmpty()
    table = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    query = queries.op12_fill_in_middle(spark, data).collect()
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    want = [(r.doc_id, *(p := plain_fim(r.doc_id, r.text))[:4], sha(p[4]), sha(r.text)) for r in table.collect()]
    assert sorted(map(tuple, query)) == sorted(want) == sorted(oracle("op12_fill_in_middle", table))


def test_fill_in_middle_keeps_odd_bytes_and_refuses_marks_that_a_cut_can_make(spark):
    raw = b"ab \xff\xfe cd \xf0\x9f"
    for i in range(50):
        n, form, a, b, out = fim.transformed(raw, i)
        assert fim.rebuilt(out, form) == raw
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), marks=("aa", "b", "c"))


def plain_words(rows, least=7, rate=31):
    out = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % rate == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                out[w] = out.get(w, 0) + 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    """Every two words compared."""
    words = plain_words(rows)
    near = {w: [] for w in words}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for n, of in by_size.items():
        for a, b in [*combinations(of, 2), *((a, b) for a in of for b in by_size.get(n + 1, []))]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def test_spelling_variants_are_all_pairs(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op13_spelling_variants(spark, data).collect()]
    want = plain_variants(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(g[3] is not None for g in got) > 3 and sum(g[2] > 1 for g in got) > 10


def test_spelling_variants_of_odd_rows(spark):
    # chains of forms, ties by code points, repeated letters, every kind of edit
    chain = ["letterbox " * 1200, "lettebox " * 110, "lettebos " * 9]
    ties = ["marbles " * 30 + "narbles " * 30 + "zarbles " * 3, "balloonn ballooon balloon " * 2, "Ângström ângström ÂNGSTRÖM ångström×x" * 2]
    rows = [(None, chain[0]), (1, chain[1]), (2, chain[2]), (3, ties[0]), (4, ties[1]), (5, ties[2]), (6, None), (7, ""), (7, "1234567 \U0001d11e"), (8, "x" * 3000 + " " + "x" * 3000), (9, "short"), (3, ties[0])]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, word string")
    got = {tuple(r[c] for c in COLUMNS) for r in spelling.spelling_variants(docs).collect()}
    assert got == plain_variants(rows)
    found = {g[0]: g for g in got}
    assert found["lettebos"][3:] == ("lettebox", found["lettebox"][1], "letterbox") and found["zarbles"][3] == "marbles"
    assert spelling.spelling_variants(docs.limit(0)).isEmpty() and spelling.spelling_variants(docs.where("doc_id in (6, 7)")).isEmpty()


def test_neighbourhood_has_every_string_once():
    alphabet = np.array([ord(c) for c in "abé"], np.uint32)
    for word in ("aab", "bbbb", "é", "abé"):
        got = [s for _, strings in spelling.neighbours(np.array([[ord(c) for c in word]], np.uint32), alphabet, None) for s in strings]
        n = len(word)
        want = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + c + word[i + 1 :] for i in range(n) for c in "abé"} | {word[:i] + c + word[i:] for i in range(n + 1) for c in "abé"}
        assert sorted(got) == sorted(want - {word})
        for cut in range(n + 2):  # the two sides of a word share no string
            parts = [s for part in ((0, cut), (cut, None)) for _, strings in spelling.neighbours(np.array([[ord(c) for c in word]], np.uint32), alphabet, None, *part) for s in strings]
            assert sorted(parts) == sorted(got)


def test_a_filter_has_all_its_words():
    rng = np.random.default_rng(2)
    names = rng.integers(0, 2**63, 50_000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    taken = np.zeros(1 << spelling.PLACES, bool)
    for probe in range(spelling.PROBES):
        taken[spelling.places(names, probe)] = True
    bits = np.packbits(taken, bitorder="little")
    assert len(spelling.held(bits, names)) == len(names) and len(spelling.held(bits, names + np.uint64(1 << 20))) < 50
