"""Brute-force comparisons and edge cases of the operators on texts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import _text as T
from textloom.llm import chroma, htmltext, langid, linecrf, maxent, neardup, packing, quality, subword, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n\t ", "one", "one two", "a" * 5000, "é́ ▁ 日本\x00語 🙂", "x y " * 3000, "x y " * 3000, "\n\n\n", "don't DON'T ½ 12ab--"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that operators use themselves
        for c in ("score", "key", "rep", "label", "ids", "h", "row", "kept", "block"):
            df = df.withColumn(c, df["doc_id"] * 0)
    return df


def tokenizer(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_spans_lines_and_hashes():
    for lo, hi, buf, off in T.slices(pa.array(ODD), 64):
        w = T.spans(buf, off, T.SPACE)
        got = [[] for _ in range(hi - lo)]
        for a, b, d in zip(*w, strict=True):
            got[d].append(buf[a:b].tobytes().decode())
        assert got == [WORD.findall(t or "") for t in ODD[lo:hi]]
        ln = T.lines(buf, off)
        parts = [[] for _ in range(hi - lo)]
        for a, b, d in zip(*ln, strict=True):
            parts[d].append(buf[a:b].tobytes().decode())
        assert parts == [(t or "").split("\n") for t in ODD[lo:hi]]
        h = T.hashes(buf, w.start, w.end)
        words = [x for g in got for x in g]
        assert len(set(h.tolist())) == len(set(words)) and len({(a, b) for a, b in zip(h.tolist(), words, strict=True)}) == len(set(words))


def shingles(text, n):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def components_plainly(texts, n, part):
    sets = [shingles(t, n) for t in texts]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= part * len(sets[a] | sets[b]):
                lo, hi = sorted((top[a], top[b]))
                top = [lo if t == hi else t for t in top]
    return [(i, len(sets[i]), top[i]) for i in range(len(texts))]


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 60))]
        texts += [" ".join(base)] * 2
        for _ in range(5):  # a chain of changes, so that ends are linked only through the middle
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocab)
            texts.append(" ".join(base).title())
    got = neardup.near_duplicates(frame(spark, texts), n=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components_plainly(texts, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (1, "q r s t u v"), (0, "q r s t u v")], "doc_id bigint, text string")
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in neardup.near_duplicates(df, n=2).collect() if r.doc_id is not None) == [(False, 0, 0), (False, 1, 0), (False, 1, 1), (False, 1, 1)]


def test_one_id_for_two_texts(spark):
    """A unique text is not joined to the near copies of another text that has its id."""
    a = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (3, " ".join(a[:-1])), (3, " ".join(f"q{i}" for i in range(60)))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), n=2).collect()
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got) == [(58, 1, False), (59, 1, True), (59, 3, True)]


def test_a_hot_group_loses_no_link(spark):
    """Hundreds of changed copies of one text, many of them too far from it, over several rounds and cuts: all links of all pairs."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(70)]
    texts = [" ".join(base)] * 3
    for _ in range(420):
        t = list(base)
        for _ in range(rng.randint(1, 7)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [rng.choice(vocab), t[k]]])
        texts.append(" ".join(t))
    texts += [None, "", "alone here"]
    want = components_plainly(texts, 2, 80)
    assert len({c for _, _, c in want}) > 12
    heads, cut = neardup.HEADS, neardup.CUT
    try:
        neardup.HEADS, neardup.CUT = 25, 40
        got = neardup.near_duplicates(frame(spark, texts), n=2).collect()
    finally:
        neardup.HEADS, neardup.CUT = heads, cut
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_bounds_never_deny_a_link():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)) for _ in range(20)]
    for s in list(sets):
        for share in (0.02, 0.1, 0.15):
            keep = rng.random(len(s)) > share
            if keep.any():
                sets.append(np.unique(np.r_[s[keep], rng.integers(0, 2**63, int(share * len(s) / 4)).astype(np.uint64)]))
    k = neardup.Sketcher(bins=64, rows=1)
    rows = [np.arange(len(sets)), np.arange(len(sets)), np.array([len(s) for s in sets]), *neardup.histograms(pa.array([k.counts(s) if i % 7 else None for i, s in enumerate(sets)], pa.binary()))]
    at, of = neardup.bounded(80, 100)(rows, rows)
    passed = set(zip(at.tolist(), of.tolist(), strict=True))
    links = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and neardup.linked(len(a), len(b), len(np.intersect1d(a, b)), 80, 100)}
    assert links <= passed and len(links) > 20 and len(passed) < len(sets) ** 2 / 2


def test_a_star_alone_would_miss_a_link(spark):
    """Members of one bucket that are unlike its hub are compared with each other."""
    a = [f"w{i}" for i in range(100)]
    left = a[:70] + [f"l{i}" for i in range(30)]
    right = left[:-2] + ["z", "y"]
    texts = [" ".join(a), " ".join(left), " ".join(right)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts), n=2, rows=1, bins=64).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    k = neardup.Sketcher()
    for n, same in ((400, 320), (20, 16), (3, 2)):
        hits = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            a, b = np.sort(x[:n]), np.sort(np.r_[x[:same], x[n : 2 * n - same]])
            hits.append((k.signature(a) == k.signature(b)).mean())
        assert abs(np.mean(hits) - same / (2 * n - same)) < 0.08


def facts(text):
    text = text or ""
    w = WORD.findall(text)
    ln = [x for x in text.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    cover = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ln) - len(set(ln)), len(cover)


def test_quality_counts_are_exact(spark):
    rng = random.Random(1)
    texts = ODD + ["\n".join(" ".join(rng.choice("a b c # |x é".split()) for _ in range(rng.randint(0, 9))) for _ in range(12)) for _ in range(40)]
    model = quality.fit([("good words here", 1), ("BAD!! ## ||", 0)] * 30, 0.5)
    got = quality.quality_rules(frame(spark, texts), model).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [facts(t) for t in texts]
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.quality_rules(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, linecrf])
def test_scorers_on_odd_texts(spark, module):
    model = module.fit([(f"fine words {i} here", 0 if module is toxicity else 1) for i in range(40)] + [(f"utter scum {i} ## !!", 1 if module is toxicity else 0) for i in range(40)], *([0.5] if module is toxicity else []))
    run = module.toxicity if module is toxicity else module.line_quality
    rows = run(frame(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert run(frame(spark, []), model).count() == 0
    none = module.fit([], *([0.0] if module is toxicity else []))
    assert run(frame(spark, ["a"]), none).count() == 1


def test_learners_generalise_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    tox = toxicity.toxicity(docs.select("doc_id", "text"), toxicity.train(docs, labels, 1000)).where("held_out").join(labels, "doc_id").toPandas()
    assert (tox.predicted == tox.toxic).mean() > 0.93
    crf = linecrf.line_quality(docs.select("doc_id", "text"), linecrf.train(docs, labels, 600)).where("held_out").join(labels, "doc_id").toPandas()
    assert (crf.predicted == crf.quality).mean() > 0.97
    q = quality.quality_rules(docs, quality.train(docs, labels, 600)).join(labels, "doc_id").where("quality = 1 and not base_failed").toPandas()
    assert q.kept.mean() > 0.97
    lang = langid.language(docs, langid.train(docs, 100)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang.lang_pred == lang.lang).mean() > 0.97


def test_toxicity_scores_equal_plain_loops():
    """Distinct 1-, 2- and skip-grams of words, FTRL-proximal step by step and its score, by dictionaries."""
    import re
    from math import exp, sqrt

    rng = random.Random(5)
    vocab = "idiot fool nice day sun rain tree house".split()
    rows = [(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 8))), rng.randint(0, 1)) for _ in range(60)]
    model = toxicity.fit(rows, 0.5, epochs=2, least_docs=2)

    def grams(t):
        w = re.findall("[a-z0-9]+", t)
        return {(1, x) for x in w} | {(2, a, b) for a, b in zip(w, w[1:])} | {(3, a, b) for a, b in zip(w, w[2:])}  # noqa: B905

    n_docs = Counter(g for t, _ in rows for g in grams(t))
    z, n = Counter(), Counter()

    def weight(k):
        s = max(abs(z[k]) - 1, 0)
        return -np.sign(z[k]) * s / ((1 + sqrt(n[k])) / 0.3 + 1)

    active = lambda t: [g for g in grams(t) if n_docs[g] >= 2] + ["bias"]
    order = np.random.default_rng(3).permutation([i for i in range(len(rows)) if i % 5 != 4])
    for _ in range(2):
        for i in order:
            t, y = rows[i]
            w = {k: weight(k) for k in active(t)}
            g = 1 / (1 + exp(-sum(w.values()))) - y
            for k in w:
                z[k] += g - (sqrt(n[k] + g * g) - sqrt(n[k])) / 0.3 * w[k]
                n[k] += g * g
    raw = [sum(weight(k) for k in active(t)) for t, _ in rows]
    held = np.arange(len(rows)) % 5 == 4
    y = np.array([v for _, v in rows], float)
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    a, b = toxicity.platt(np.array(raw)[held], y[held], share[held])
    got = toxicity.score(model, pa.array([t for t, _ in rows]))
    assert np.allclose(got, [1 / (1 + exp(-(a * x + b))) for x in raw], atol=1e-9) and np.std(got) > 0.01


def test_chain_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    unary, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    p, expected = linecrf.marginals(unary, trans, np.array([0, 4, 4, 7]))
    want, count = np.zeros(7), np.zeros((2, 2))
    for lo, hi in ((0, 4), (4, 7)):
        z, m, c = 0.0, np.zeros(hi - lo), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=hi - lo):
            w = np.exp(sum(unary[lo + i] * x for i, x in enumerate(s)) + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False)))
            z += w
            m += w * np.array(s)
            for a, b in zip(s, s[1:], strict=False):
                c[a, b] += w
        want[lo:hi] = m / z
        count += c / z
    assert np.allclose(p, want) and np.allclose(expected, count)


def test_language_edges(spark):
    model = langid.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)
    got = {r.doc_id: r for r in langid.language(frame(spark, [None, "", "123 !!", "the dog", "die katze und", "x" * 9000]), model).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].lang_pred in ("en", "de")
    assert langid.language(frame(spark, []), langid.train(frame(spark, []))).count() == 0


def test_texts_without_a_letter_have_no_language(spark):
    """Letters are those of Unicode's categories L*; every language of the learning rows can be named."""
    model = langid.fit([("der hund und die katze", "de"), ("the dog and the cat", "en")])
    texts = ["\u2014", "\U0001f642\U0001f642", "\u0661\u0662\u0663", "\u00a9", "\uff0c\u3002", "\uff11\uff12", "12 !", "", None]
    got = langid.predict(model, pa.array([*texts, "\u00e9", "\u65e5\u672c", "the dog"]))
    assert got["lang_pred"].to_pylist()[: len(texts)] == ["und"] * len(texts) and got["score"][: len(texts)].sum() == 0
    assert "und" not in got["lang_pred"].to_pylist()[len(texts) :] and got["lang_pred"][-1].as_py() == "en"
    df = spark.createDataFrame([(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3, f"l{i:04d}") for i in range(600)], "doc_id long, text string, lang string")
    assert len(langid.train(df)["names"]) == len({r.lang for r in df.where("pmod(crc32(cast(doc_id as string)), 4) <> 2").collect()})


def test_nearest_centroid_equals_a_plain_search():
    """Ties go to the first language; vectors and cosines are those of plain loops."""
    from collections import Counter
    from math import log, sqrt

    rows = [("aa bb ab", "x"), ("ab ba aa", "x"), ("cc dd cd", "y"), ("cd dc", "y"), ("aa bb ab", "z")]
    model = langid.fit(rows, clusters=1)

    def grams(t):
        b = "".join(c if c.isalpha() else " " for c in t.lower())
        ids = []
        for n in (2, 3):
            for i in range(len(b) - n + 1):
                if b[i : i + n].count(" ") < n - 1:
                    ids.append(((int.from_bytes(b[i : i + n].encode(), "big") + (n << 24)) * 2654435761 % 2**32) >> 20)
        return Counter(ids)

    def plain(t):
        x = [log(1 + grams(t)[k]) * model["idf"][k] for k in range(langid.BUCKETS)]
        norm = sqrt(sum(v * v for v in x)) or 1
        return [v / norm for v in x]

    texts = ["aa bb", "cd cc dd", "ab aa bb cc", "zz"]
    got = langid.predict(model, pa.array(texts))
    for i, t in enumerate(texts):
        x = plain(t)
        sims = [sum(a * b for a, b in zip(x, c, strict=True)) for c in model["centroids"].tolist()]
        best = max(range(len(sims)), key=lambda k: (round(sims[k], 5), -k))
        assert got["lang_pred"][i].as_py() == model["names"][model["of"][best]] and got["score"][i] == pytest.approx(max(max(sims), 0), abs=1e-4)


def test_packing_is_whole(spark):
    path = tokenizer("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rng = random.Random(7)
    texts = ODD + [" ".join(rng.choice(["alpha", "Beta's", "c3", "über", "x!!"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = packing.pack(frame(spark, texts).repartition(3), path, window=256, windows=4, merge=2).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted(by[i], key=lambda r: r.start)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert np.frombuffer(b"".join(bytes(r.ids) for r in mine), "<u4").tolist() == ids and all(r.doc_tokens == len(ids) for r in mine)
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    total = pad = 0
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        n = sum(r.length for r in s)
        assert n <= 256
        total, pad = total + n, pad + (0 if n & (n - 1) == 0 else 256 - n)
    assert pad < 0.05 * total
    assert packing.pack(frame(spark, []), path).count() == 0


def test_added_tokens_are_found_as_the_tokenizer_does():
    path = tokenizer("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y <|endoftext|><|endoftext|>", "a <|ENDOFTEXT|> É<|EndOfText|> X<|startoftext|>Y", "<|endoftext|", "|> <|endoftext|>é", "<|ENDOFTEXT|> <|endoftext|>"]
    enc = packing.WordEncoder(path)
    for _ in range(2):  # unknown words, then known ones
        _, _, buf, off = next(T.slices(pa.array(texts)))
        data, at = enc.encode(buf, off, 2)
        ids = np.frombuffer(data, "<u4")
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_language_model_counts(spark):
    texts = ODD + ["the cat sat", "The cat ran", "a dog sat"] * 5
    rows = {r.doc_id: r for r in maxent.lm_scores(frame(spark, texts), most_top=4).collect()}
    tok = [WORD.findall(lower(t)) + ["\0"] for t in texts]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    c = Counter(w for i, t in enumerate(tok) if fold(i) != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tok):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, fold(i) == 2)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
    assert maxent.lm_scores(frame(spark, [])).count() == 0


def plain_contexts(texts):
    """(word, two words before) of each token, ends included, by plain loops."""
    out = []
    for t in texts:
        before = [None, None]
        for w in [*WORD.findall(lower(t)), None]:
            out.append((w, before[1], before[0]))
            before = [before[1], w]
    return out


def test_language_model_trains_on_every_row_and_scores_plainly(spark):
    """Weights and scores equal plain loops over all tokens of all learning rows."""
    rng = random.Random(7)
    vocab = [f"{a}{b}" for a in "kst" for b in ("agg", "ugg", "ing", "ed", "o")]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    df = frame(spark, texts, extra=False)
    model = maxent.learn(df, most_top=1000, steps=2)
    slots = model.slots
    step = {r.doc_id: r.k for r in df.selectExpr("doc_id", "pmod(xxhash64(9, doc_id), 2) as k").collect()}
    lore = {}
    for w in [*vocab, "unseen", None]:
        buf = np.frombuffer((w or "").encode(), np.uint8)
        h, b, _ = maxent.tokens(buf, np.array([0, len(buf)]))
        y, s, own = slots.find(h[:1], b[:1])
        lore[w] = (h[0], b[0], int(y[0]), int(s[0]), bool(own[0]))

    def active(one, two):
        h, b = np.array([lore[two][0], lore[one][0], 0], np.uint64), np.array([0, lore[one][1], 0])
        f = maxent.features(h, b, np.zeros(3, int))[:, 2:]
        return f, [int(x) for x in f[:, 0]]

    def softmax(table, prior, at):
        z = np.array(prior, float) + sum(table[i].astype(float) for i in at)
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    w, v = np.zeros_like(model.w), np.zeros_like(model.v)
    p, q = np.exp(slots.class_prior), np.exp(slots.slot_prior).mean(0)
    for k in range(2):
        ga, gb, na, nb = np.zeros(w.shape), np.zeros(v.shape), np.zeros(len(w)), np.zeros(len(v))
        for x, one, two in plain_contexts([t for i, t in enumerate(texts) if step[i] == k and zlib.crc32(str(i).encode()) % 7 != 2]):
            _, _, y, s, _ = lore[x]
            f, at = active(one, two)
            rows = [int(r) for r in maxent.rows_of(f, np.array([y]))[:, 0]]
            ea, eb = -softmax(w, slots.class_prior, at), -softmax(v, slots.slot_prior[y], rows)
            ea[y] += 1
            eb[s] += 1
            for i in at:
                ga[i] += ea
                na[i] += 1
            for i in rows:
                gb[i] += eb
                nb[i] += 1
        w = w + np.clip(0.3 * ga / (na[:, None] * p * (1 - p) + 4), -1, 1).astype(np.float32)
        v = v + np.clip(0.3 * gb / (nb[:, None] * q * (1 - q) + 4), -1, 1).astype(np.float32)
    assert np.allclose(w, model.w, atol=1e-4) and np.allclose(v, model.v, atol=1e-4) and np.abs(w).max() > 0.1
    count = {None: 0}
    for x, _, _ in plain_contexts([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]):
        count[x] = count.get(x, 0) + 1

    def chance(x, one, two):
        _, _, y, s, own = lore[x]
        f, at = active(one, two)
        got = softmax(w, slots.class_prior, at)[y] * softmax(v, slots.slot_prior[y], maxent.rows_of(f, np.array([y]))[:, 0])[s]
        same = [k for k in count if lore[k][2:] == (y, s, False)]
        return got if own else got * (count.get(x, 0) + 1) / (sum(count[k] + 1 for k in same) + 1)

    scores = {r.doc_id: r.score for r in maxent.lm_scores(df, most_top=1000).collect()}
    other = maxent.learn(df, most_top=1000)
    w, v = other.w, other.v
    for i, t in enumerate(texts):
        assert scores[i] == pytest.approx(sum(np.log10(chance(*c)) for c in plain_contexts([t])), abs=1e-3)
    assert sum(chance(x, "kagg", "so") for x in count) <= 1 + 1e-6  # the rest is the share of words never seen


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    w, prior, f = rng.normal(size=(maxent.FEATURES, maxent.CLASSES)), rng.normal(size=maxent.CLASSES), rng.integers(0, maxent.FEATURES, (3, 50))
    each = np.stack([np.exp(maxent.picked(w, prior, f, np.full(50, k))) for k in range(maxent.CLASSES)])
    assert np.allclose(each.sum(0), 1) and np.allclose(maxent.missed(w, prior, f, np.zeros(50, int))[:, 1:], -each[1:].T)


def test_subwords_are_lossless_and_reproducible(spark):
    path = tokenizer("piece_bpe_32k.model")
    df = frame(spark, ODD)
    a = {r.doc_id: bytes(r.ids) for r in subword.sample_pieces(df, path).collect()}
    b = {r.doc_id: bytes(r.ids) for r in subword.sample_pieces(df.repartition(5), path).collect()}
    assert a == b and a != {r.doc_id: bytes(r.ids) for r in subword.sample_pieces(df, path, seed=1, alpha=0.2).collect()}
    assert all(r.lossless for r in subword.sample_pieces(df, path, verify=True).collect())
    back = {r.doc_id: r.decoded for r in subword.decode_pieces(subword.sample_pieces(df, path), path).collect()}
    assert [back[i] for i in range(len(ODD))] == [t or "" for t in ODD]
    assert subword.sample_pieces(frame(spark, []), path).count() == 0


def test_subword_samples_follow_the_lattice():
    import itertools

    table = subword.Pieces(tokenizer("piece_bpe_32k.model"), 0.3)
    piece = {t: i for i, t in reversed(list(enumerate(table.text))) if i > 258}
    n = 20000
    buf = np.frombuffer(b"the" * n, np.uint8)
    ids, count = table.sample(buf, np.arange(n + 1) * 3, np.arange(n).astype(np.uint64), 0)
    at = np.r_[0, np.cumsum(count)]
    got = Counter(tuple(ids[at[i] : at[i + 1]]) for i in range(n))
    want = {}
    word = b" the"
    for cut in itertools.product((0, 1), repeat=3):
        ends = [i + 1 for i, c in enumerate(cut) if c] + [4]
        parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if all(p in piece for p in parts):
            want[tuple(piece[p] for p in parts)] = np.exp(sum(table.weight[piece[p]] for p in parts))
    z = sum(want.values())
    assert set(got) <= set(want) and all(abs(got[k] / n - w / z) < 0.015 for k, w in want.items())


def test_subword_samples_of_runs_of_spaces_follow_the_lattice():
    import itertools

    table = subword.Pieces(tokenizer("piece_bpe_32k.model"), 0.3)
    assert not any(b" " in t.strip(b" ") or t != b" " * len(t) and t.endswith(b" ") for t in table.text)
    piece = {t: i for i, t in reversed(list(enumerate(table.text))) if i > 258}
    n = 20000
    buf = np.frombuffer(b"   a" * n, np.uint8)
    ids, count = table.sample(buf, np.arange(n + 1) * 4, np.arange(n).astype(np.uint64), 0)
    at = np.r_[0, np.cumsum(count)]
    got = Counter(tuple(ids[at[i] : at[i + 1]]) for i in range(n))
    want, word = {}, b"    a"
    for cut in itertools.product((0, 1), repeat=4):
        ends = [i + 1 for i, c in enumerate(cut) if c] + [5]
        parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if all(p in piece for p in parts):
            want[tuple(piece[p] for p in parts)] = np.exp(sum(table.weight[piece[p]] for p in parts))
    z = sum(want.values())
    assert set(got) <= set(want) and all(abs(got[k] / n - w / z) < 0.015 for k, w in want.items())


def test_subword_samples_do_not_depend_on_neighbours(monkeypatch):
    """Alone, together, in parts and place by place: the same pieces."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.choice([1, 4, 9, 700]))) for _ in range(rng.randint(0, 12))) for _ in range(12)]
    table = subword.pieces(tokenizer("piece_bpe_32k.model"))

    def ids(some, keys):
        got = []
        for lo, hi, buf, off in T.slices(pa.array(some, pa.string())):
            i, n = table.sample(buf, off, np.array(keys[lo:hi], np.uint64), 5)
            got += [x.tolist() for x in np.split(i, np.cumsum(n)[:-1])]
        return got

    together = ids(texts, range(12))
    assert together == [ids([t], [k])[0] for k, t in enumerate(texts)]
    monkeypatch.setattr(subword, "_SLICE", 100)
    assert together == ids(texts, range(12))
    monkeypatch.setattr(subword, "_DEEP", 3)
    assert sum(a != b for a, b in zip(together, ids(texts, range(12)), strict=True)) <= 1  # one ulp may differ


def test_quotes_open_a_value_only_after_an_equals_sign():
    """An apostrophe in an unquoted value, or alone in a tag, swallows nothing."""
    for bad in ("<p class=don't>", "<p don't>", "<p class=a'b id=\"x\">", '<p title="a > b">', "<p title='say \"x\" > y'>"):
        nodes = htmltext.parse(f"<div>{bad}one</p><p>two</p></div>")
        assert ["".join(x for _, x in v.text) for v in nodes if v.tag == "p"] == ["one", "two"]


def test_stray_closing_tags_cost_no_walk():
    import time

    began = time.perf_counter()
    assert len(htmltext.parse("<div>" * 20000 + "x</p>" * 20000)) == 20001
    assert time.perf_counter() - began < 5


def test_tree_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    parent, kind = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 2, 1, 3, 2])
    unary, edge = rng.normal(size=6), rng.normal(size=(htmltext.N_KINDS, 2, 2))
    z, m = 0.0, np.zeros(6)
    for s in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(u * x for u, x in zip(unary, s, strict=True)) + sum(edge[kind[i], s[parent[i]], s[i]] for i in range(1, 6)))
        z += w
        m += w * np.array(s)
    p, _ = htmltext.marginals(unary, edge, parent, kind)
    assert np.allclose(p, m / z)
    assert np.allclose(htmltext.fast_marginals(unary.tolist(), edge.tolist(), parent.tolist(), kind.tolist()), m / z)


PAGE = """<html><head><title>T</title></head><body><header class=top><a href=/>Home page of the site</a></header><nav><ul><li><a href=/a>one</a><li><a href=/b>two</a></ul></nav>
<div class="cookie">We use cookies to improve things.</div><article><h1>Title of the piece</h1><p>First &amp; foremost,   a paragraph
with several words, and more to read.</p><script>var t = "<p>no</p>";</script><!-- <p>no</p> --><p>Second caf&eacute; para with <i>inline</i> text &lt;b&gt;.<p>Third, not closed, is here for reading.
</article><aside>Related stuff to click on.</aside><div class="comments"><p>Great post, I liked it a lot!</p></div><form><p>Subscribe please</p></form><footer>&copy; me</footer>"""


def test_hidden_is_an_attribute_of_its_own():
    seen = ['data-hidden="false"', 'data-overflow="hidden"', 'title="Hidden gems of the coast"', 'data-page-style="display: none"', "title='a hidden b' x", 'alt="style=display:none"', "data-x=hidden", 'aria-hidden="false"', 'class="hidden-x"']
    gone = ["hidden", "HIDDEN", 'hidden=""', "x hidden", 'style="color: red; display: none"', "style='visibility:hidden'", "aria-hidden=true", 'title="a" hidden']
    for attrs in seen:
        assert [v.hidden for v in htmltext.parse(f"<div {attrs}>text</div>") if v.tag == "div"] == [False], attrs
    for attrs in gone:
        assert [v.hidden for v in htmltext.parse(f"<div {attrs}>text</div>") if v.tag == "div"] == [True], attrs
    assert htmltext.Node("div", None, ' class="nav x" id=main').cues == htmltext.Node("div", None, " ID='main' data-class=ad CLASS=nav").cues != ()


def test_sentence_marks_of_a_whole_block_count():
    rows = [htmltext.node_features(htmltext.parse(f"<p>{'word ' * 100}{end}</p>"))[0][-1] for end in ("then", "one. Two. Three. Four.")]
    assert sum(v for _, v in rows[1]) > sum(v for _, v in rows[0]) + 0.5


def test_main_text(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (1, "u", PAGE), (5, "u", "<div>" * 3000 + "deep")], "page_id bigint, url string, html string")
    rows = htmltext.main_text(df).collect()
    want = "Title of the piece\n\nFirst & foremost, a paragraph with several words, and more to read.\n\nSecond café para with inline text <b>.\n\nThird, not closed, is here for reading."
    assert [r.text for r in rows if r.page_id == 1] == [want, want]
    assert all(r.n_chars == len(r.text) for r in rows) and [r.text for r in rows if r.page_id in (2, 3)] == ["", ""]
    assert htmltext.main_text(df.where("page_id > 9")).count() == 0


def test_main_text_of_articles_in_the_table(spark, data):
    import html

    rows = htmltext.main_text(spark.read.parquet(f"{data}/pages.parquet").withColumn("raw", __import__("pyspark").sql.functions.col("html"))).collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.raw, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"<p>|</p>|</h1>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_fingerprints_align_and_edges(spark):
    rng = np.random.default_rng(1)
    f = chroma.Fingerprinter()
    notes = rng.integers(0, 48, 90)
    whole = chroma.render(notes)
    part = whole[chroma.HOP * 10 + 200 : chroma.HOP * 60]
    off, err = chroma.align(f(whole), f(part + rng.normal(0, 0.03, len(part)).astype(np.float32)))
    assert off == 10 and err < 0.1
    assert chroma.align(f(whole), f(chroma.render(rng.integers(0, 48, 90))))[1] > 0.3
    songs = [(0, whole.tolist()), (1, whole.tolist()), (2, part.tolist()), (3, None), (4, []), (5, [0.0] * 50), (7, whole.tolist()), (100, part.tolist())]
    got = {r.id: r for r in chroma.aligned(chroma.fingerprints(spark.createDataFrame(songs, "id bigint, a array<double>"), "id", "a")).collect()}
    assert [got[i].class_id for i in (0, 1, 7, 2, 100, 3)] == [0, 0, 0, 2, 2, 3]
    assert (got[2].best_query, got[2].best_offset) == (0, -10) and (got[1].best_query, got[1].best_offset) == (2, 10)
    assert got[3].n_fp == 0 and got[4].best_query is None
    assert chroma.aligned(chroma.fingerprints(spark.createDataFrame([], "id bigint, a array<double>"), "id", "a")).count() == 0


def test_fingerprints_beside_clashing_names(spark):
    """Other columns change nothing, whatever their names; a row without an id is a copy or stands alone."""
    wave = chroma.render(np.random.default_rng(2).integers(0, 48, 40)).tolist()
    rows = spark.createDataFrame([(1, wave), (1, wave), (None, wave), (None, None), (200, wave)], "key bigint, a array<double>")
    wide = rows.selectExpr("key", "a", "0 AS id", "'x' AS fp", "1 AS rep", "2 AS code", "3 AS name")
    plain, named = (sorted(map(repr, chroma.aligned(chroma.fingerprints(x, "key", "a")).collect())) for x in (rows, wide))
    assert plain == named and len(named) == 5 and sum("class_id=1," in r for r in named) == 4


def test_aligned_equals_align_on_noisy_pairs(spark):
    rng = np.random.default_rng(5)
    songs, want = [], {}
    for k, rate in enumerate((0.05, 0.15, 0.2, 0.24)):
        a = rng.integers(0, 2**32, 48).astype(np.uint32)
        flips = (rng.random((48, 32)) < rate * 48 / 43) @ (1 << np.arange(32, dtype=np.uint64))
        flips[:5] = 0  # so that the pair is met
        b = a ^ flips.astype(np.uint32)
        songs += [(100 * k, a.view(np.int32).tolist()), (100 * k + 1, b.view(np.int32).tolist())]
        want[100 * k + 1] = (-0, chroma.align(b, a)[1])
    got = {r.id: r for r in chroma.aligned(spark.createDataFrame(songs, "id bigint, fp array<int>")).collect()}
    for i, (off, err) in want.items():
        assert got[i].n_links == (err <= 0.25) and (err > 0.25 or (got[i].best_query, got[i].best_offset) == (i - 1, off) and abs(got[i].best_error - err) < 1e-6)
    assert sum(e <= 0.25 for _, e in want.values()) >= 3


def test_elements_inside_sentences():
    """Unknown and hidden elements, and adverts inside a sentence, leave whole sentences; an unknown element that holds blocks is a block."""
    page = "<html><body><article><h1>A title of the page</h1><p>The first sentence stands here and it is long enough to count, surely. And a second one.</p><p>{}</p><p>The last sentence stands here and it is long enough to count as well. Another one ends it.</p></article></body></html>"
    w, e = htmltext.trained()
    for inner, want in {
        "A note <my-term>word</my-term> here is a part of the sentence.": ["A note word here is a part of the sentence."],
        "Press <button>go</button> now. <svg><text>zz</text></svg>Then <math><mi>q</mi></math> wait for <picture><source><img></picture> the end of it.": ["Press now. Then wait for the end of it."],
        'Some text <span hidden>secret</span>stays <span style="display:none">x</span> and <span class="ad">buy this now</span> this goes on for a while.': ["Some text stays and this goes on for a while."],
        'See <time class="date">today</time>, <meter>5</meter> of <progress>6</progress> and <output>seven</output>.': ["See today, 5 of 6 and seven."],
        "A <button><div>x</div> y</button> z is a sentence, long enough.": ["A z is a sentence, long enough."],
        "</p><my-box><p>Inner paragraph of a box that is long enough to be read.</p></my-box>Tail text.": ["Inner paragraph of a box that is long enough to be read.", "Tail text."],
        "A <br-x/>short <b>bold <i>both</b> words</i> and the rest of the sentence.": ["A short bold both words and the rest of the sentence."],
    }.items():
        got = htmltext.content(page.format(inner), w.tolist(), e.tolist()).split("\n\n")
        assert [x for x in got[2:-1] if x] == want and got[0] == "A title of the page", inner
    assert len(htmltext.parse("<x-a>" * 20000 + "<p>x" + "</x-a>" * 20000)) >= 2


def test_rows_of_pages_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>One sentence that is long enough to be text.</p>", "old", 7)] * 2, "page_id int, url string, html string, text string, n_chars int")
    got = htmltext.main_text(df).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_chars == len(got[0].text) and got[0].text != "old"


def test_a_language_of_long_rows_is_learned(spark):
    rows = [(i, "the cat sat on the mat and the dog ran " * 3, "en") for i in range(40)] + [(100 + i, "der hund und die katze sind nicht hier " * 1500, "de") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.lang_pred for r in langid.language(docs.where("lang = 'de'"), langid.train(docs)).collect()}
    assert got == {"de"}
