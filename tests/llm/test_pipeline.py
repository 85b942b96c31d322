import corpus_pipeline as P
from textloom.llm import neardup, quality, toxicity
from textloom.llm._io import table


def test_stages_take_effect(spark, data):
    docs = table(spark, data, "documents")
    labels = table(spark, data, "labels")
    good = {r.doc_id for r in quality.quality_rules(docs, quality.train(docs, labels)).where("kept").collect()}
    one = P.quality_stage(spark, docs, data)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == good
    two = P.toxicity_stage(spark, one, data)
    bad = {r.doc_id for r in toxicity.toxicity(one, toxicity.train(one, labels)).where("score >= 0.5").collect()}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == good - bad
    three = P.near_duplicate_stage(spark, two, data)
    kept = {r.doc_id for r in neardup.near_duplicates(two).where("kept").collect()}
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == kept
    pieces = P.run(spark, data).collect()
    assert {r.doc_id for r in pieces} == kept and [n for n, _ in P.STAGES] == ["quality_rules", "toxicity", "near_dedup", "packing"]


def test_near_duplicate_stage_keeps_rows_without_id_and_of_reused_ids(spark):
    a = [f"w{i}" for i in range(60)]
    q = " ".join(f"q{i}" for i in range(60))
    rows = [(1, " ".join(a)), (3, " ".join(a[:-1])), (3, q), (None, "a text of its own that has no id at all"), (None, " ".join(a)), (4, None)]
    got = P.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[5]]))


def test_near_duplicate_stage_on_repeated_rows_and_clashing_names(spark):
    """Of rows that repeat an id and its text one stays, the first by its other columns; further columns stay as they are."""
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t, "b", True), (1, t, "a", False), (2, t, "c", True), (3, "", "d", None), (3, "", "d", None), (4, "", "e", None), (5, "only this", "f", True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n boolean")
    got = sorted(map(tuple, P.near_duplicate_stage(spark, df, "").collect()))
    assert got == [(1, t, "a", False), (3, "", "d", None), (4, "", "e", None), (5, "only this", "f", True)]
    assert P.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def test_near_duplicate_stage_equals_plain_sets(spark, data):
    """Against sets of five words compared pair by pair in plain Python, for pairs that share a shingle."""
    import re
    from collections import defaultdict

    docs = table(spark, data, "documents")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {}
    for i, x in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    top = {i: i for i in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in sets.items():
        for j in {j for g in s for j in by[g] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    assert {r.doc_id for r in P.near_duplicate_stage(spark, docs, data).collect()} == {i for i in rows if find(i) == i}


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names; then empty tables."""
    import random

    rng = random.Random(4)

    def text(n, words="river stone light garden window letter morning winter paper silver"):
        return " ".join(rng.choice(words.split()) + rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(n)) + "."

    long = text(120_000)
    rows = [(i, text(60), "en", "s", i, True) for i in range(40)] + [(100 + i, "## || BUY NOW !! " * 20, None, None, None, None) for i in range(40)]
    odd = [(900, None, None, None, None, None), (901, "", "en", "s", 0, None), (902, "  \n ", "en", "s", 0, False), (903, "one two", "en", "s", 7, False), (904, long, None, "s", None, True)]
    again = [(905, rows[3][1], "en", "s", 3, True), (905, rows[3][1], "en", "s", 3, True), (None, text(70), "en", None, 9, None), (5, rows[5][1], "en", "s", 5, True)]
    df = spark.createDataFrame(rows + odd + again, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean").withColumn("score", __import__("pyspark").sql.functions.lit(0.5))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1 if i % 2 else 0) for i in range(40)] + [(None, 1, 1), (904, None, None), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    for at, take in (("full", True), ("none", False)):
        (df if take else df.limit(0)).coalesce(2).write.parquet(str(tmp_path / at / "documents.parquet"))
        (labels if take else labels.limit(0)).coalesce(1).write.parquet(str(tmp_path / at / "labels.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
    d = str(tmp_path / "full")
    docs = table(spark, d, "documents")
    one = P.quality_stage(spark, docs, d)
    left = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and not left & {900, 901, 902, 903} and {904, 905, None} <= left and set(range(40)) <= left
    pieces = P.run(spark, d).collect()
    assert {r.doc_id for r in pieces} == (left - {905}) - {i for i in left if i is not None and 100 <= i < 140}
    assert sum(r.length for r in pieces if r.doc_id == 904) == next(r.doc_tokens for r in pieces if r.doc_id == 904) > 100_000
    assert all(sum(r.length for r in pieces if r.doc_id == i) == next(r.doc_tokens for r in pieces if r.doc_id == i) for i in (5, None))
