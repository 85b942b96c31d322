"""Retrieval legs and routing on literal rows."""

from pyspark.sql import functions as F

from textloom import api
from textloom.functions import web
from textloom.operators import legs, links, routing, search
from textloom.providers import hashed_vector
from textloom.sources import records

LAWS = [
    (1, "Law Feline No. 5 of 1999", "1999", "article 1\ncats are animals\narticle 2\ncats sleep"),
    (2, "Law Canine No. 7 of 2001", "2001", "article 1\ndogs are animals\narticle 12\ndogs bark"),
    (3, "Amendment of Law Canine", "2005", "article 1\nbarking is changed"),
]


def store(spark):
    df = spark.createDataFrame(LAWS, "id bigint, title string, year string, text string")
    return api.build_store(df, "id", "text", "title")


def asked(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "qid string, question string")


def test_all_legs_reach_the_answer(spark):
    q = asked(spark, "article 12 law canine", "no. 7 of 2001", "what is law feline", "law canine and barking", "difference between law feline and law canine", "sleep")
    got = api.retrieve(q, store(spark), "id", year="year").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.qid, r.pos)):
        by.setdefault(r.qid, []).append((r.law_book_id, r.leg))
    assert by["0"][0] == (2, "article_exact")
    assert by["1"][0] == (2, "law_scoped")
    assert by["2"][0][0] == 1 and "defining_articles" in {leg for _, leg in by["2"]}
    assert by["3"][0][0] == 2
    assert by["4"][0][0] == 1 and {1, 2} <= {law for law, _ in by["4"]}
    assert "5" in by


def test_title_leg(spark):
    """Titles that hold what is named; the one with an amendment marker is too far behind."""
    rows = store(spark).select("chunk_id", F.col("id").alias("law"), "title", "year", "article_arr", "chunk_text", "vector")
    q = asked(spark, "law canine and barking", "nothing of that kind").withColumn("qvec", hashed_vector(F.col("question")))
    got = legs.title_leg(q, rows, "law", 5).collect()
    assert [(r.qid, r.leg, r.rank, r.chunk_id) for r in got] == [("0", "title_like", 0, "2#0")]


def test_routing_evidence(spark):
    rows = store(spark).select("chunk_id", F.col("id").alias("law"), "title", "year")
    registry = routing.registry_of(rows, "law")
    q = asked(spark, "law feline and rest", "no. 7 of 2001", "nothing").withColumn("qvec", F.array(F.lit(1.0)))
    got = {r.qid: r for r in routing.evidence(q, registry).collect()}
    assert got["0"].phrase_ids == [1] and got["1"].citation_ids == [2] and got["2"].phrase_ids == [] and got["2"].alias_len is None
    assert got["0"].alias_len == len("law feline")


def test_holding_equals_contains(spark):
    hays = ["abcabc", "xabcx", "", "ab", "zzz", "cab\u00e9abc"]
    needles = ["abc", "cab", "zzz", "q\u00e9z", "\u00e9ab", "abcabc", "ab"]
    h = spark.createDataFrame(list(enumerate(hays)), "h int, hay string")
    n = spark.createDataFrame(list(enumerate(needles)), "n int, needle string")
    got = sorted((r.h, r.n) for r in search.holding(h, n, "hay", "needle").collect())
    assert got == sorted((i, j) for i, a in enumerate(hays) for j, b in enumerate(needles) if len(b) >= 3 and b in a)


def test_matrix_and_join_give_the_same_rows(spark, monkeypatch):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "qid int, qvec array<float>")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [1.0]), ("f", [0.0, 0.0])], "chunk_id string, vector array<float>")
    fast = sorted(map(tuple, search.vector_top_k(q, rows, 3).collect()))
    monkeypatch.setattr(search, "BLOCK", 1)
    assert fast == sorted(map(tuple, search.vector_top_k(q, rows, 3).collect())) and len(fast) == 9
    assert search.vector_top_k(q.limit(0), rows, 3).count() == 0


def test_overview_order(spark):
    df = spark.createDataFrame([("a", ["2"], "2000", "xx"), ("b", ["1"], "1990", "x"), ("c", ["1"], "2001", "xxx"), ("d", ["1"], "2001", "x"), ("e", ["9"], None, "")], "k string, a array<string>, y string, t string")
    assert [r.k for r in df.orderBy(*legs.overview_order(F.col("a"), F.col("y"), F.col("t"))).collect()] == ["d", "c", "b", "a", "e"]


def test_warnings_are_newest_first_with_titles(spark):
    hits = spark.createDataFrame([("q", 0, 1, "Base", "A"), ("q", 1, 1, "Base", "A"), ("q", 2, 5, "Change", "B"), ("q", 3, 6, "Plain", None)], "qid string, pos int, law_book_id bigint, title string, law_flag string")
    edges = spark.createDataFrame([(1, 10 + i, "num_year", "high") for i in range(8)], "base bigint, amender bigint, method string, confidence string")
    rows = spark.createDataFrame([(10 + i, f"T{i}", str(2000 + i)) for i in range(8)], "law_book_id bigint, title string, year string")
    nested = links.nested(edges, edges.limit(0), rows)
    got = {r.law_book_id: r.warning for r in links.warnings(hits, nested, "qid").collect()}
    assert got == {1: "Base [A]\n" + "; ".join(f"T{i} ({2000 + i})" for i in (7, 6, 5, 4, 3, 2)) + " (+2)", 5: "Change [B]"}


def test_challenge_pages(spark):
    pages = ["<title>Just a moment...</title>", "<title>just a moment</title>", "cf-challenge", "cf-challenge var articles = []; lawBookID", None, ""]
    df = spark.createDataFrame([(p,) for p in pages], "p string").coalesce(1)
    assert [r[0] for r in df.select(web.is_challenge("p")).collect()] == [True, False, True, False, False, False]


def test_a_crash_inside_a_replacement_loses_no_table(spark, tmp_path):
    path = str(tmp_path / "t")
    records.write_atomic(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t._old")  # as if the process had ended between the two renames
    records.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    records.write_atomic(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t._old").exists()
