"""Registered queries of the retrieval legs, routing scores and page scans, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .functions import web
from .operators import fusion, legs, links, registry, routing
from .workloads import _DIST, _HTML, _STOPS, PARTS, query, read

#: The words of a question in order: longest first, then as they came.
_WORDS = rf"""SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, pos) AS i FROM (SELECT item_id, w, min(pos) AS pos FROM
 (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, string_split(trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[؟?!،,.;:()]', ' ', 'g')), '\s+', ' ', 'g')), ' ') AS t FROM benchmark))
 WHERE length(w) >= 3 AND w NOT IN ({_STOPS}) AND NOT regexp_full_match(w, '\p{{Nd}}+') GROUP BY 1, 2)"""


@query(rf"""WITH w AS ({_WORDS}), n AS (SELECT count(*) AS n FROM embeddings),
 c AS (SELECT d.doc_id AS chunk_id, d.doc_id % 7 AS law, coalesce(d.text, '') AS t, e.embedding FROM documents d, n JOIN embeddings e ON e.vec_id = d.doc_id % n.n),
 s AS (SELECT b.item_id AS qid, k.k AS pos, (b.item_id + 3 * k.k) % 7 AS law, e.embedding FROM benchmark b, n, (SELECT unnest([0, 1]) AS k) k JOIN embeddings e ON e.vec_id = b.item_id % n.n),
 m AS (SELECT q.qid, q.pos, v.chunk_id, v.t, {_DIST} AS d FROM s q JOIN c v USING (law)),
 o AS (SELECT m.*, row_number() OVER (PARTITION BY qid, pos ORDER BY d, chunk_id) AS r FROM m),
 f AS (SELECT DISTINCT w.item_id AS qid, unnest([w.w, upper(w.w[1]) || w.w[2:]]) AS n FROM w WHERE i <= 5),
 x AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid, n ORDER BY d, chunk_id) AS r FROM m JOIN f USING (qid) WHERE pos = 0 AND contains(t, n)),
 k AS (SELECT qid, chunk_id FROM o WHERE r <= CASE WHEN pos = 0 THEN 10 ELSE 3 END UNION SELECT qid, chunk_id FROM x WHERE r <= 3),
 g AS (SELECT m.qid, m.pos, m.chunk_id, round(m.d - least(0.30, 0.06 * (SELECT count(*) FROM w WHERE w.item_id = m.qid AND w.i <= 12 AND contains(lower(m.t), w.w))), 6) AS s FROM m JOIN k USING (qid, chunk_id))
 SELECT qid, leg, rank - 1 AS rank, chunk_id FROM (SELECT qid, 'law_scoped' AS leg, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY pos, s, chunk_id) AS rank FROM g) WHERE rank <= 12""")
def leg_law_chunks(spark, d):
    """The in-law leg over all documents as chunks of seven laws: nearest chunks, text rescue in the first law, topic bonus."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    n = e.count()
    rows = read(spark, d, "documents").join(e, F.col("doc_id") % n == F.col("v")).select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 7).alias("law"), F.coalesce("text", F.lit("")).alias("chunk_text"), F.col("embedding").alias("vector"))
    asked = read(spark, d, "benchmark").join(e, F.col("item_id") % n == F.col("v")).select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.col("embedding").alias("qvec"), F.array(F.col("item_id") % 7, (F.col("item_id") + 3) % 7).alias("scope"))
    return legs.law_leg(asked, rows, "law").withColumn("rank", F.col("rank").cast("long"))


@query(rf"""WITH w AS ({_WORDS}), f AS (SELECT DISTINCT unnest([w, upper(w[1]) || w[2:]]) AS needle FROM w WHERE i <= 5)
 SELECT doc_id, needle FROM documents JOIN f ON contains(coalesce(text, ''), needle)""")
def text_holding(spark, d):
    """Documents that hold a surface form of a question's longest words, in one pass over the texts."""
    from .operators.search import holding_by_scan

    words = read(spark, d, "benchmark").select(F.slice(T.content_tokens("text"), 1, 5).alias("t")).select(F.explode("t").alias("w")).distinct()
    needles = words.select(F.explode(T.surface_variants(F.col("w"))).alias("needle")).distinct()
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return holding_by_scan(docs, needles, "text", "needle").select("doc_id", "needle")


@query(f"SELECT page_id, md5('(1)' || coalesce(chr(10) || nullif(t, ''), '') || chr(10) || chr(10) || 'x]\"[' || coalesce(chr(10) || nullif(t, ''), '')) AS text, length(t) * 2 + 9 + 2 * CAST(t <> '' AS INT) AS n FROM (SELECT page_id, {_HTML} AS t FROM pages)")
def detail_page_text(spark, d):
    """Every page's html twice in an embedded array, with brackets, quotes and deeper arrays around it: articles in display order, as text."""
    item = lambda code, order: F.struct(F.lit(order).alias("displayOrder"), F.lit(code).alias("articleCodeTxt"), F.coalesce("html", F.lit("")).alias("articleText"), F.array(F.array(F.array(F.lit("]]"), F.lit('["\\')))).alias("notes"))
    page = F.concat(F.lit("<html><script>var other = [1, ']']; var articles = "), F.to_json(F.array(item('x]"[', 2), item("(1)", 1))), F.lit("; var lawbookid = [2];</script></html>"))
    got = read(spark, d, "pages").select("page_id", web.page_full_text(page).alias("t"))
    return got.select("page_id", F.md5("t").alias("text"), F.length("t").cast("long").alias("n"))


# --- routing scores: questions about parts, titles of four kinds ---
_KINDS = "['law ', 'regulation ', 'decision on ', 'notes on ']"
_ASKS = "['what does the law ', 'which regulation ', 'any decision on no ', 'about ']"
_T = f"t AS (SELECT p_partkey AS law, {_KINDS}[CAST(p_partkey % 4 AS BIGINT) + 1] || lower(p_name) AS t, lower(p_name) AS a, 1990 + p_size AS y FROM part), q AS (SELECT c_custkey AS qid, {_ASKS}[CAST(c_custkey % 4 AS BIGINT) + 1] || lower(p_name) || ', please' AS q, CASE c_custkey % 4 WHEN 0 THEN 'law ' || lower(p_name) WHEN 1 THEN 'regulation ' || lower(p_name) END AS ph FROM customer JOIN part ON p_partkey = c_custkey)"


def _fit(t: str, f: str) -> str:
    return rf"CASE WHEN NOT contains({t}, {f}) THEN 0.0 ELSE CASE WHEN starts_with({t}, {f}) AND length({t}) - length({f}) <= 12 THEN 22.0 WHEN starts_with({t}, {f}) THEN 16.0 ELSE -22.0 END - 8.0 * least(len(list_filter(string_split(replace({t}, {f}, ' '), ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '\p{{Nd}}+'))), 4) END"


def _lesser(asked: str) -> str:
    return f"CASE WHEN (contains(t, 'correction notice') OR contains(t, 'instructions') OR contains(t, 'decision')) AND NOT (contains({asked}, 'instructions') OR contains({asked}, 'decision') OR contains({asked}, 'notice')) THEN 14.0 ELSE 0 END"


_PENALTY = "(" + " + ".join(f"CASE WHEN contains(t, '{m}') AND NOT contains(q, '{m}') THEN {c} ELSE 0 END" for m, c in PARTS.title_penalties) + ")"
_BEST = "SELECT qid, law_book_id, score FROM (SELECT qid, law AS law_book_id, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, law DESC) AS r FROM (SELECT qid, law, max(s) AS s FROM m WHERE s > 0 GROUP BY 1, 2)) WHERE r <= 8"


def _routed(spark, d):
    p = read(spark, d, "part")
    pick = lambda words, k: F.get(F.array(*[F.lit(w) for w in words]), (k % 4).cast("int"))
    laws = p.select(F.col("p_partkey").alias("law_book_id"), F.concat(pick(("law ", "regulation ", "decision on ", "notes on "), F.col("p_partkey")), F.lower("p_name")).alias("title"), (1990 + F.col("p_size")).cast("string").alias("year"), F.array(F.lower("p_name")).alias("aliases"))
    text = F.concat(pick(("what does the law ", "which regulation ", "any decision on no ", "about "), F.col("c_custkey")), F.lower("p_name"), F.lit(", please"))
    asked = read(spark, d, "customer").join(p, F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("qid"), text.alias("question"))
    return laws, asked


@query(f"""WITH {_T}, s AS (SELECT p_partkey AS rule, unnest([lower(p_name), 'no ' || lower(p_name)]) AS a FROM part WHERE p_partkey % 40 = 0), n AS (SELECT p_partkey AS rule, unnest([lower(p_name), 'law ' || lower(p_name)]) AS n FROM part WHERE p_partkey % 40 = 0),
 f AS (SELECT qid, q, rule, max(length(a)) AS size FROM q JOIN s ON contains(q, a) WHERE length(a) >= 5 GROUP BY 1, 2, 3), l AS (SELECT rule, arg_max(a, length(a)) AS long FROM s GROUP BY 1),
 m AS (SELECT qid, law, size + CASE WHEN contains(q, 'law') AND starts_with(t, 'law') THEN 25.0 ELSE 0 END + CASE WHEN contains(q, 'regulation') AND contains(t, 'regulation') THEN 25.0 ELSE 0 END + y / 200.0
  + CASE WHEN contains(n, 'no') OR length(n) >= 18 THEN 12.0 ELSE 0 END + {_fit('t', 'long')} - {_PENALTY} - {_lesser('q')} AS s FROM f JOIN l USING (rule) JOIN n USING (rule) JOIN t ON contains(t, n)) {_BEST}""")
def seed_scores(spark, d):
    """Every customer asks about a part; seeds of every fortieth part name rules with two aliases and two needles."""
    laws, asked = _routed(spark, d)
    s = read(spark, d, "part").where("p_partkey % 40 = 0").select(F.col("p_partkey").alias("rule_id"), F.lower("p_name").alias("n"))
    seeds = s.select("rule_id", F.explode(F.array("n", F.concat(F.lit("no "), "n"))).alias("alias"), "n").select("rule_id", "alias", F.explode(F.array("n", F.concat(F.lit("law "), "n"))).alias("needle"))
    return registry.seed_hits(asked, laws, seeds, PARTS).select("qid", "law_book_id", "score")


@query(f"""WITH {_T}, m AS (SELECT qid, law, CASE WHEN contains(t, ph) THEN length(ph) ELSE least(length(a), length(ph)) END + CASE WHEN starts_with(ph, 'law') AND starts_with(t, 'law') THEN 20.0 ELSE 0 END + CASE WHEN starts_with(ph, 'regulation') AND contains(t, 'regulation') THEN 20.0 ELSE 0 END
  + y / 200.0 + {_fit('t', 'ph')} - {_PENALTY} - {_lesser('ph')} AS s FROM q JOIN t ON contains(t, ph) OR (length(a) >= 6 AND (contains(ph, a) OR contains(a, ph))) WHERE ph IS NOT NULL) {_BEST}""")
def phrase_scores(spark, d):
    """The instruments that customers' questions name, against titles and aliases of all parts."""
    laws, asked = _routed(spark, d)
    return registry.phrase_hits(asked, laws, PARTS).select("qid", "law_book_id", "score")


@query("""WITH c AS (SELECT o_custkey AS amender, o_orderkey AS base, lower(o_orderpriority) AS cls, lower(o_orderstatus) || ' idx' AS idx FROM orders), a AS (SELECT c_custkey AS amender, lower(c_mktsegment) || ' ' || (CASE c_custkey % 3 WHEN 0 THEN '2-high' WHEN 1 THEN 'f idx' ELSE '5-low o idx' END) AS blob FROM customer),
 s AS (SELECT amender, base, len(list_filter(string_split(cls || ' ' || idx, ' '), lambda w: length(w) >= 3 AND contains(blob, w))) + CASE WHEN contains(blob, cls) THEN 3 ELSE 0 END + CASE WHEN contains(blob, idx) THEN 2 ELSE 0 END AS s FROM c JOIN a USING (amender)),
 b AS (SELECT *, max(s) OVER (PARTITION BY amender) AS best, count(*) OVER (PARTITION BY amender) AS n FROM s), k AS (SELECT *, count(*) OVER (PARTITION BY amender) AS n2 FROM b WHERE n = 1 OR (s = best AND s > 0)) SELECT amender, base FROM k WHERE n2 = 1""")
def class_overlap(spark, d):
    """Every customer's orders as candidates for one base: words, whole classification and whole index entry count."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    cls, idx = F.lower("o_orderpriority"), F.concat(F.lower("o_orderstatus"), F.lit(" idx"))
    blob = F.concat_ws(" ", F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "2-high").when(F.col("c_custkey") % 3 == 1, "f idx").otherwise("5-low o idx"))
    cands = o.select(F.col("o_custkey").alias("amender"), F.col("o_orderkey").alias("base"), F.lit("").alias("base_core"), F.lit("").alias("base_kind"), F.concat_ws(" ", cls, idx).alias("base_class"), cls.alias("base_class_norm"), idx.alias("base_index_norm"), F.lit("").alias("kind"), F.lit("").alias("hay"))
    return links.decide(cands.join(c.select(F.col("c_custkey").alias("amender"), blob.alias("class_blob")), "amender")).select("amender", "base")


@query("""WITH d AS (SELECT o_custkey AS law, CAST(o_orderkey % 9 AS VARCHAR) AS label, min(o_orderkey) AS pos FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2), a AS (SELECT d.* FROM d LEFT JOIN customer ON c_custkey = law WHERE coalesce(c_nationkey, -1) <> 3),
 q AS (SELECT s_suppkey AS qid, CAST(s_suppkey % 9 AS VARCHAR) AS label, CASE WHEN s_suppkey % 2 = 0 THEN [s_suppkey * 3, s_suppkey * 3 + 1, s_suppkey * 3 + 2] ELSE [] END AS scope FROM supplier),
 i AS (SELECT qid, law, label, row_number() OVER (PARTITION BY qid ORDER BY law, pos) AS r FROM q JOIN a USING (label) WHERE len(scope) = 0 OR list_contains(scope, law)),
 b AS (SELECT qid, law, label, row_number() OVER (PARTITION BY qid ORDER BY law, pos) AS r FROM q JOIN a USING (label) WHERE len(scope) > 0 AND qid NOT IN (SELECT qid FROM i))
 SELECT qid, 'article_exact' AS leg, r - 1 AS rank, 'art:' || law || ':' || label AS chunk_id FROM (SELECT * FROM i UNION ALL SELECT * FROM b) WHERE r <= 5""")
def leg_article_index(spark, d):
    """Every supplier asks for an article, half of them inside three laws; orders are the article index, customers the laws and their status."""
    o = read(spark, d, "orders")
    index = o.select(F.col("o_custkey").alias("law"), (F.col("o_orderkey") % 9).cast("string").alias("article_label"), F.when(F.col("o_orderkey") % 4 != 0, "defines").otherwise("mentions").alias("role"), F.col("o_orderkey").alias("char_start"), F.col("o_orderpriority").alias("text"))
    laws = read(spark, d, "customer").select(F.col("c_custkey").alias("law"), F.col("c_name").alias("title"), F.lit("").alias("year"), F.when(F.col("c_nationkey") == 3, "repealed").when(F.col("c_nationkey") != 4, "in-force").alias("status_label"))
    k = F.col("s_suppkey")
    asked = read(spark, d, "supplier").select(k.alias("qid"), F.lit("an article").alias("question"), (k % 9).cast("string").alias("article_label"), F.when(k % 2 == 0, F.array(k * 3, k * 3 + 1, k * 3 + 2)).otherwise(F.array().cast("array<bigint>")).alias("scope"))
    return legs.article_index_leg(asked, legs.article_rows(index, laws, "law", "in-force"), "law", 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_T} SELECT qid, max(length(t.a)) AS alias_len FROM q JOIN t ON contains(q, t.a) GROUP BY 1""")
def routing_longest_aliases(spark, d):
    """The longest alias in each customer's question, over the aliases of all parts."""
    laws, asked = _routed(spark, d)
    return routing.longest_alias(asked, laws).select("qid", F.col("alias_len").cast("long").alias("alias_len"))


# --- what is shown of sources ---
def _sources(spark, d):
    c = read(spark, d, "conversations")
    t = F.col("turn")
    return c.select("conv_id", "turn", t.alias("pos"), (t % 5).alias("law_book_id"), F.when(t % 4 != 3, F.col("role")).alias("title"), (2000 + t).cast("string").alias("year"), F.concat(F.lit("u/"), t.cast("string")).alias("source_url"), "text",
        F.when(t % 2 == 0, "in-force").alias("status_label"), F.when(t % 3 == 1, "A").when(t % 3 == 2, "B").otherwise("").alias("law_flag"), F.when(t % 2 == 1, (t % 3).cast("string")).alias("article_label"), (t % 6 == 5).alias("pulled"),
        F.array((t % 3).cast("string"), ((t + 1) % 3).cast("string")).alias("article_arr"), F.concat(F.lit(","), (t % 3).cast("string"), F.lit(",")).alias("article_nums"))


_SRC = """s AS (SELECT conv_id, turn, turn % 5 AS law, coalesce(CASE WHEN turn % 4 <> 3 THEN role END, '') AS title, CAST(2000 + turn AS VARCHAR) AS year, 'u/' || turn AS url, coalesce(text, '') AS text,
 CASE WHEN turn % 2 = 0 THEN 'in-force' ELSE '' END AS status, CASE turn % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE '' END AS flag, CASE WHEN turn % 2 = 1 THEN CAST(turn % 3 AS VARCHAR) ELSE '' END AS label, turn % 6 = 5 AS pulled FROM conversations)"""


@query(f"""WITH {_SRC}, l AS (SELECT n_regionkey AS law, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) WHERE r <= 3 GROUP BY 1),
 b AS (SELECT s.*, names, row_number() OVER w AS n, lag(title) OVER w AS last, concat_ws(' | ', CASE WHEN status <> '' THEN 'status: ' || status END, CASE WHEN flag <> '' THEN 'may be amended (' || flag || ')' END, CASE WHEN pulled THEN 'from a linked amending law' END,
  CASE WHEN flag = 'A' AND names <> '' THEN 'amended by: ' || names END, CASE WHEN label <> '' THEN 'article: ' || label END) AS bits FROM s LEFT JOIN l USING (law) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, md5(string_agg(CASE WHEN title <> '' AND title = last THEN '[source ' || n || '] (same law' || CASE WHEN bits <> '' THEN ' | ' || bits ELSE '' END || ')' ELSE '[source ' || n || '] ' || title || ' (year ' || year || CASE WHEN bits <> '' THEN ' | ' || bits ELSE '' END || ') — ' || url END || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS context FROM b GROUP BY 1""")
def context_headers(spark, d):
    """Conversations as questions' sources, with status, flags, amenders and articles in their headers."""
    n = read(spark, d, "nation")
    one = F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("title"))))
    links_ = n.groupBy(F.col("n_regionkey").cast("bigint").alias("base")).agg(one.alias("amended_by"))
    return fusion.sourced_context(_sources(spark, d), "conv_id", ["turn"], links=links_).select("conv_id", F.md5("context").alias("context"))


@query(f"WITH {_SRC} SELECT conv_id, turn, title, year, status AS status_label, flag AS law_flag, CAST(turn % 3 AS VARCHAR) AS article_nums, md5(text[1:500]) AS text, length(text[1:500]) AS n FROM s")
def source_views(spark, d):
    got = fusion.source_view(_sources(spark, d), "lookup", keys=("conv_id", "turn"))
    return got.select("conv_id", "turn", "title", "year", "status_label", "law_flag", "article_nums", F.md5("text").alias("text"), F.length("text").cast("long").alias("n"))


@query(rf"""WITH {_SRC}, a AS (SELECT s.*, CAST(conv_id % 3 AS VARCHAR) AS asked FROM s), h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN label = '' THEN 1 ELSE 0 END, CASE WHEN label = asked THEN 0 ELSE 1 END, turn) AS n FROM a WHERE label = asked OR CAST(turn % 3 AS VARCHAR) = asked OR CAST((turn + 1) % 3 AS VARCHAR) = asked)
 SELECT conv_id, md5(string_agg('— ' || title || ' (' || year || ')' || chr(10) || url || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY n)) AS answer FROM h WHERE n <= 3 GROUP BY 1""")
def exact_hits(spark, d):
    """Every conversation asks for an article, and its turns are the sources."""
    rows = _sources(spark, d).withColumn("asked", (F.col("conv_id") % 3).cast("string"))
    return fusion.looked_up(rows, "conv_id").select("conv_id", F.md5("answer").alias("answer"))
