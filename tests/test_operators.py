import random

from pyspark.sql import functions as F

from textloom.functions.text import padded
from textloom.operators import articles, chunking, fusion, links, registry, reports, search, upsert
from textloom.plans import planner
from textloom.profile import GENERIC, LEGAL_AR


def pack_plainly(parts, target=1500, most=2500):
    out, buf = [], ""
    for s in parts:
        if buf and len(buf) + len(s) > target:
            out.append(buf)
            buf = s
        else:
            buf = buf + "\n\n" + s if buf else s
        while len(buf) > most:
            out.append(buf[:most])
            buf = buf[most:]
    return out + ([buf] if buf else [])


def test_pack_equals_a_loop(spark):
    rng = random.Random(2)
    cases = [["x" * rng.choice([1, 30, 700, 1499, 1500, 2501, 6000]) for _ in range(rng.randint(0, 8))] for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p array<string>")
    got = {r["i"]: r["o"] for r in df.select("i", chunking.packed(F.col("p")).alias("o")).collect()}
    assert all(got[i] == pack_plainly(c) for i, c in enumerate(cases))


def test_chunks_carry_numbers_and_ids(spark):
    text = "مقدمة\n١\n" + "نص " * 900 + "\n٢\nالمادة 438"
    df = spark.createDataFrame([(7, "t", text), (8, "t", ""), (9, "t", None)], "id bigint, title string, body string")
    rows = chunking.chunk_records(df, "id", "title", "body", LEGAL_AR).orderBy("chunk_no").collect()
    assert [r["chunk_id"] for r in rows] == [f"7#{i}" for i in range(len(rows))] and len(rows) > 1
    assert "438" in rows[-1]["article_arr"] and rows[-1]["article_nums"].startswith(",")
    assert all(r["chunk_text"].startswith("t\n\n") for r in rows)


def test_article_spans_slice_the_text(spark):
    text = "تمهيد\nالمادة 1\nنص أول المادة 9\nالمادة ٢ مكرر\n نص ثان  \n\nالمادة 3 أ\nنص المواد 4-6"
    df = spark.createDataFrame([(1, text), (2, "نص يذكر المادة 5 فقط"), (3, None)], "law_book_id bigint, full_text string")
    rows = articles.article_index(df, "law_book_id", "full_text", LEGAL_AR).collect()
    defines = {r["article_label"]: r for r in rows if r["role"] == "defines"}
    assert set(defines) == {"1", "2 مكرر", "3أ"}
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in defines.values())
    inside = [r for r in rows if r["role"] == "mentions" and r["law_book_id"] == 1]
    assert {(r["in_article"], r["article_label"]) for r in inside} == {("1", "9"), ("3أ", "4")}
    assert all(text[r["char_start"] : r["char_end"]] == r["article_label"] for r in inside)
    assert [(r["article_label"], r["parse_confidence"]) for r in rows if r["law_book_id"] == 2] == [("5", 0.5)]


def fuse_plainly(rows, legs, k, cap, promised=()):
    out = []

    def fits(c):
        quota = {n: q for n, _, q in legs}[c["leg"]]
        return len(out) < k and all(o["key"] != c["key"] for o in out) and sum(o["leg"] == c["leg"] for o in out) < quota and (not c["law"] or sum(o["law"] == c["law"] for o in out) < cap)

    w = {n: x for n, x, _ in legs}
    order = sorted((r for r in rows if r["leg"] in w), key=lambda r: (-w[r["leg"]] / (61 + r["rank"]), r["leg"], r["rank"]))
    for law in promised:
        for c in order:
            if c["leg"] == "law_scoped" and c["law"] == law and fits(c):
                out.append(c)
                break
    for c in order:
        if fits(c):
            out.append(c)
    return [c["chunk"] for c in out]


def test_fusion_equals_a_loop_however_rows_come(spark):
    rng = random.Random(5)
    legs, cap = planner.SHAPES["NAMED_INSTRUMENT"]
    rows, want = [], {}
    for q in range(25):
        mine = [{"leg": leg, "rank": i, "chunk": f"{leg}{i}", "law": rng.randint(0, 3), "key": str(rng.randint(0, 9))} for leg in ("hybrid", "law_scoped", "title_like", "unplanned") for i in range(rng.randint(0, 9))]
        want[q] = fuse_plainly(mine, legs, 6, 2, (2, 3))
        rows += [(q, r["leg"], r["rank"], r["chunk"], r["law"], r["key"]) for r in mine]
    rng.shuffle(rows)
    hits = spark.createDataFrame(rows, "qid int, leg string, rank int, chunk_id string, law_book_id bigint, key string")
    plans = spark.createDataFrame([(q, 6, 2, legs) for q in want], "qid int, k int, max_per_law int, legs array<struct<name:string,weight:double,quota:int>>")
    g = spark.createDataFrame([(q, s, law) for q in want for s, law in enumerate((2, 3))], "qid int, slot int, law_book_id bigint")
    got: dict = {q: [] for q in want}
    for r in fusion.fuse(hits, plans, g).orderBy("qid", "pos").collect():
        got[r["qid"]].append(r["chunk_id"])
    assert got == want


def plan_of(spark, text, **signals):
    df = spark.createDataFrame([("q", text)], "qid string, question string")
    for k, v in signals.items():
        df = df.withColumn(k, v)
    return planner.plan(planner.features(df, "question", LEGAL_AR)).first()


def test_shapes(spark):
    ids = F.array(F.lit(5).cast("bigint"))
    assert plan_of(spark, "صيغة عريضة دعوى").shape == "PROCEDURAL_DRAFT"
    assert plan_of(spark, "المادة 438 من قانون العقوبات").shape == "EXACT_ARTICLE"
    assert plan_of(spark, "كيف تطبق المادة 438").shape == "ARTICLE_ANALYTICAL"
    assert plan_of(spark, "رقم 111 لسنة 1969").shape == "CITATION_KEY"
    assert plan_of(spark, "الفرق بين قانون العمل و قانون الخدمة").shape == "MULTI_INSTRUMENT"
    r = plan_of(spark, "ما هو قانون العقوبات", phrase_ids=ids)
    assert (r.shape, r.scope_doc_ids, r.max_per_law) == ("DEFINITIONAL", [5], 4)
    assert plan_of(spark, "حكم السرقة", seed_ids=ids).shape == "NAMED_INSTRUMENT"
    assert plan_of(spark, "في من").shape == "OUT_OF_SCOPE"
    assert plan_of(spark, "عقوبة السرقة الموصوفة").shape == "TOPICAL"


def test_margin(spark):
    df = spark.createDataFrame([(None, None), (0.2, None), (0.5, None), (0.1, 0.4), (0.3, 0.2)], "a double, b double")
    assert [round(r[0], 6) for r in df.select(planner.margin(F.col("a"), F.col("b"))).collect()] == [0.0, 0.12, 0.02, 0.3, 0.0]


def test_merge_counts_every_change(spark):
    master = spark.createDataFrame([(1, "A"), (2, "B")], "id int, fp string")
    incoming = spark.createDataFrame([(1, "B", 0), (1, "A", 1), (2, "B", 2), (3, "C", 3), (3, "C", 4)], "id int, fp string, seq bigint")
    merged, delta, stats = upsert.merge(master, incoming, "id", "fp", "seq")
    assert sorted((r.id, r.fp) for r in merged.collect()) == [(1, "A"), (2, "B"), (3, "C")]
    assert stats.first().asDict() == {"inserted": 1, "updated": 2, "skipped": 2, "total_in": 5, "total_out": 3}
    assert delta.count() == 3
    again = upsert.merge(merged.select("id", "fp"), incoming.where("seq > 1"), "id", "fp", "seq")[2].first()
    assert (again.inserted, again.updated) == (0, 0)


def test_identity_and_fingerprint(spark):
    df = spark.createDataFrame([(7, None, "T", "x"), (None, " c ", "T", "x"), (None, None, " T ", "x"), (None, None, "t", None)], "lawBookID bigint, corpus_id string, lawTitle string, full_text string")
    got = [r.identity for r in upsert.with_identity(df).collect()]
    assert got[:2] == ["legislation:lawBookID:7", "legislation:corpus_id:c"] and got[2] == got[3] and len(got[2].split(":")[-1]) == 16
    prints = [r.fingerprint for r in upsert.with_fingerprint(df).collect()]
    assert prints[0] == prints[1] and len(set(prints)) == 3


def test_streak_stops_at_the_page(spark):
    known = {k for k in range(10, 60)}
    catalog = spark.createDataFrame([(k, k) for k in range(100)], "k int, pos int")
    got = upsert.until_known_streak(catalog, spark.createDataFrame([(k,) for k in known], "k int"), "k", "pos", 10)
    assert sorted(r.k for r in got.collect()) == list(range(10))


def test_links(spark):
    rows = [
        (1, "قانون العقوبات رقم 111 لسنة 1969", "111", "1969", "", ""),
        (2, "قانون تعديل قانون العقوبات رقم 111 لسنة 1969", "9", "2001", "A", ""),
        (3, "قانون العمل", "", "1970", "", ""),
        (4, "تعديل قانون العملة", "12", "2002", "A", ""),
        (5, "تعديل قانون العمل", "13", "2003", "A", ""),
        (6, "نظام قديم", "70", "1950", "", "الغي بموجب رقم 9 لسنة 2001"),
    ]
    b = links.briefs(spark.createDataFrame(rows, "law_book_id bigint, title string, code string, year string, flag string, notes string"), LEGAL_AR).cache()
    edges = links.amendment_edges(b, F.col("flag") == "A", LEGAL_AR)
    assert {(r.base, r.amender, r.method) for r in edges.collect()} == {(1, 2, "num_year"), (3, 5, "title_contain")}
    repeal = links.repeal_edges(b, LEGAL_AR)
    assert [(r.base, r.amender) for r in repeal.collect()] == [(6, 2)]
    n = {r.base: r for r in links.nested(edges, repeal, b).collect()}
    assert [x.law_book_id for x in n[1].amended_by] == [2] and n[6].replaced_by[0].law_book_id == 2


def test_registry_and_lexicon(spark):
    laws = spark.createDataFrame([(1, "قانون العقوبات رقم 111 لسنة 1969", "نافذ", "نص", "1969", 0), (2, "قانون العمل", "ملغى", "نص", "1970", 1), (3, "نظام السوق", "نافذ", " ", "1999", 2)], "law_book_id bigint, title string, status_label string, full_text string, year string, seq bigint")
    seeds = spark.createDataFrame([(1, "الجرائم", "قانون العقوبات")], "rule_id int, alias string, needle string")
    reg = registry.build_registry(laws, seeds, LEGAL_AR)
    r = reg.first()
    assert reg.count() == 1 and "الجرائم" in r.aliases and r.route_text.startswith(r.title)
    q = spark.createDataFrame([("a", "ما هي الجرائم"), ("b", "قانون العقوبات")], "qid string, question string")
    assert {x.qid for x in registry.seed_hits(q, reg, seeds, LEGAL_AR).collect()} == {"a"}
    assert {x.qid for x in registry.phrase_hits(q, reg, LEGAL_AR).collect()} == {"b"}
    cards = spark.createDataFrame([(1, "قانون تعديل قانون العقوبات", ["قانون العقوبات", "مسائل الجنايات العراقي"])], "law_book_id bigint, title string, colloquial_aliases array<string>")
    lex = registry.lexicon(cards, LEGAL_AR)
    assert {x.alias_norm for x in lex.collect()} == {"مسائل الجنايات العراقي", "مسائل الجنايات"}


def test_search_and_gates(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 0.0]), ("d", None)], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, qvec array<float>")
    got = search.vector_top_k(q, rows, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.distance) for r in got] == [("a", 0.0), ("b", 0.4), ("c", 1.0)]
    docs = spark.createDataFrame([("a", "red fox"), ("b", "red red dog"), ("c", None)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "Fox?"), (2, "nothing")], "qid int, question string")
    hits = search.bm25(asked, search.postings(docs, "chunk_id", "text"), search.index_stats(docs, "text"), 5)
    assert [(r.qid, r.chunk_id) for r in hits.collect()] == [(1, "a")]
    soft = spark.createDataFrame([(1, "x", True), (1, "y", False), (2, "z", False)], "g int, v string, ok boolean")
    assert {r.v for r in search.prefer(soft, "g", F.col("ok")).collect()} == {"x", "z"}
    assert {r.v for r in search.prefer(soft, "g", F.col("ok"), hard=True).collect()} == {"x"}
    answers = spark.createDataFrame([(1, ["5", "7"]), (2, ["1"])], "qid int, cited array<string>")
    have = spark.createDataFrame([(1, ["7", "8"])], "qid int, n array<string>")
    assert {r.qid: r.fabricated for r in reports.citation_gate(answers, have, "qid", "cited", "n").collect()} == {1: ["5"], 2: ["1"]}


def test_padded_of_nothing(spark):
    assert spark.range(1).select(padded(F.array().cast("array<string>")).alias("x")).first()["x"] == ""
    assert GENERIC.lower
