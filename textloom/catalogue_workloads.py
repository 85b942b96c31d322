"""Registered queries of catalogue, card and link operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import articles, cards, links, normalise, reports, search, sync
from .sources import records
from .workloads import PARTS, query, read

SITE = "https://laws.example/"


# --- catalogue ---
@query("""SELECT o_orderkey AS law, 'legislation:' || o_orderkey AS corpus_id, strftime(o_orderdate, '%Y-%m-%d') AS date_iso, CASE WHEN o_orderstatus = 'F' THEN 'repealed' ELSE 'in-force' END AS status,
 CAST(year(o_orderdate) AS VARCHAR) AS year, 'https://laws.example/legislations/showlegislation?lawbookid=' || o_orderkey AS source_url,
 CASE o_orderkey % 3 WHEN 0 THEN 'https://laws.example/img/' || o_orderkey WHEN 1 THEN 'http://files.example/' || o_orderkey END AS pdf_url, o_orderpriority AS title, '' AS notes, CAST(length(o_orderpriority) AS BIGINT) AS full_text_len, 31 AS n_fields FROM orders""")
def catalog_records(spark, d):
    """Catalogue items become records of all fields; half of the dates come from the second date field."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "d/M/yyyy")
    image = F.when(k % 3 == 0, F.concat(F.lit("/img/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("http://files.example/"), k.cast("string")))
    items = read(spark, d, "orders").select(k.cast("string").alias("lawBookID"), F.when(k % 2 == 0, day).alias("lawDate"), day.alias("tacksNewsDate"), F.when(F.col("o_orderstatus") == "F", "n").alias("lawValid"), F.year("o_orderdate").alias("lawYear"), image.alias("lawImage"), F.col("o_orderpriority").alias("lawTitle"), F.col("o_orderpriority").alias("full_text"))
    made = normalise.to_records(items, SITE)
    return made.select(F.col("lawBookID").alias("law"), "corpus_id", "date_iso", F.col("status_label").alias("status"), F.col("lawYear").alias("year"), "source_url", "pdf_url", F.col("lawTitle").alias("title"), F.col("lawNotes").alias("notes"), "full_text_len", F.lit(len(made.columns)).alias("n_fields"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'legislation' END AS source_type, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'legislation:' || doc_id END AS corpus_id FROM documents")
def extension_fields(spark, d):
    k = F.col("doc_id")
    rows = read(spark, d, "documents").select("doc_id", F.when(k % 3 == 0, F.col("source")).when(k % 3 == 1, "").alias("source_type"), F.when(k % 2 == 0, F.col("lang")).alias("corpus_id"))
    return normalise.with_extension_fields(rows, key="doc_id")


@query("""WITH p AS (SELECT o_orderkey // 50 AS page, 50 AS size, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT *, (SELECT count(*) // 2 FROM orders) AS total FROM p)
 SELECT page, n FROM t WHERE page >= 3 AND page <= coalesce((SELECT min(page) FROM t WHERE page >= 3 AND (n = 0 OR page * size >= total)), page)""")
def catalog_walk(spark, d):
    """Pages of a walk from the third page to the one where the stated total is reached."""
    o = read(spark, d, "orders")
    total = o.agg(F.floor(F.count("*") / 2).alias("total"))
    pages = o.groupBy(F.floor(F.col("o_orderkey") / 50).alias("page")).agg(F.count("*").alias("n")).withColumn("size", F.lit(50)).crossJoin(F.broadcast(total))
    return sync.walked(pages, 3).select("page", "n")


@query("SELECT o_custkey AS id, min(o_orderkey) AS pos FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY 1")
def catalog_pending(spark, d):
    """Ids that are not yet fetched, each at its first place in the catalogue."""
    items = read(spark, d, "orders").select(F.col("o_custkey").alias("lawBookID"), F.floor(F.col("o_orderkey") / 50).alias("page"), F.col("o_orderkey").alias("pos"))
    done = read(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("lawBookID"))
    return sync.pending(items, done).select(F.col("lawBookID").alias("id"), "pos")


@query("SELECT max(o_orderkey) AS watermark_id, max(strftime(o_orderdate, '%Y-%m-%d')) AS watermark_date FROM orders")
def catalog_watermark(spark, d):
    """The watermark of two runs, the first over finished orders."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("lawBookID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_iso"), "o_orderstatus")
    first = sync.watermark(o.where("o_orderstatus = 'F'"))
    return sync.advanced(first, sync.watermark(o.where("o_orderstatus <> 'F'")))


@query("SELECT p_partkey, p_size % 3 <> 0 AND (p_name LIKE '%cold%' OR p_name LIKE '%small w%' OR 1990 + p_size >= 2030) AS priority FROM part")
def priority_records(spark, d):
    """In force and either of a major title or recent."""
    status = F.when(F.col("p_size") % 3 != 0, " in-force ").otherwise("repealed")
    return read(spark, d, "part").select("p_partkey", normalise.is_priority(F.upper("p_name"), 1990 + F.col("p_size"), status, ("cold", "small w"), 2030).alias("priority"))


# --- cards ---
@query(r"""WITH x AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 7 = 0 THEN '' ELSE regexp_replace(coalesce(text, ''), '\s+', '', 'g') END AS scope FROM documents),
 y AS (SELECT *, CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 'no_object' WHEN scope = '' THEN 'scope_summary' WHEN doc_id % 5 = 0 THEN 'likely_questions' WHEN doc_id = 0 THEN 'law_book_id' END AS error FROM x)
 SELECT doc_id, error, CASE WHEN error = 'no_object' THEN '' WHEN doc_id % 2 = 0 THEN source || '+' || lang ELSE lang || '+' || source || '+x' END AS tags, CASE WHEN error = 'no_object' THEN 0 WHEN doc_id % 5 = 0 THEN 0 ELSE 10 END AS n_questions FROM y""")
def card_payloads(spark, d):
    """Payloads with and without a fence, with lists and strings, some of them unusable in one way or another."""
    k = F.col("doc_id")
    scope = F.when(k % 7 == 0, "  ").otherwise(F.col("text"))
    tags = F.when(k % 2 == 0, F.to_json(F.array("source", F.concat(F.lit(" "), "lang"), F.lit(""), "source"))).otherwise(F.concat(F.lit('"'), "lang", F.lit(" , "), "source", F.lit(';; x"')))
    asked = F.when(k % 5 == 0, F.lit('[" "]')).otherwise(F.to_json(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.concat(F.lit("question "), i.cast("string")))))
    body = F.concat(F.lit('{"scope_summary": '), F.get(F.regexp_extract_all(F.to_json(F.struct(F.coalesce(scope, F.lit("")).alias("s"))), F.lit(r"(?s)^\{.s.:(.*)\}$"), 1), F.lit(0)), F.lit(', "subject_tags": '), tags, F.lit(', "likely_questions": '), asked, F.lit("}"))
    raw = F.when(k % 13 == 0, F.concat(F.lit("sorry "), body)).when(k % 11 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    got = cards.parse_cards(read(spark, d, "documents").select(k.alias("law_book_id"), F.col("lang").alias("title"), raw.alias("raw")))
    return got.select(F.col("law_book_id").alias("doc_id"), "error", F.array_join("subject_tags", "+").alias("tags"), F.size("likely_questions").alias("n_questions"))


@query("SELECT p_partkey, p_name || ' of ' || (1990 + p_size) || ' (copy)+' || p_name || ' of ' || (1990 + p_size) || '+' || p_name AS variants FROM part")
def alias_endings(spark, d):
    """Endings of an alias come off one after another."""
    alias = F.concat(F.lit(" "), "p_name", F.lit(" of "), (1990 + F.col("p_size")).cast("string"), F.lit(" (copy)"))
    return read(spark, d, "part").select("p_partkey", F.array_join(cards.alias_variants(alias, (r"\(copy\)$", r"of [0-9]{4}$", r"\(none\)$")), "+").alias("variants"))


@query("""WITH a AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two FROM part)
 SELECT count(*) AS cards, count(*) FILTER (one IN ('cold', 'small')) AS marked, count(*) FILTER (one IN ('cold', 'small')) AS stripped, count(*) FILTER (one IN ('cold', 'small') AND (contains(two, 'widget') OR contains('widget', two))) AS claims_base FROM a""")
def card_alias_risk(spark, d):
    """Aliases that lose the marker of their title: each title's first word is kept by one alias and lost by another."""
    words = F.split("p_name", " ")
    c = read(spark, d, "part").select(F.col("p_partkey").alias("law_book_id"), F.col("p_name").alias("title"), F.array(F.concat(F.get(words, F.lit(0)), F.lit(" thing")), F.get(words, F.lit(1)), F.lit("")).alias("colloquial_aliases"))
    return cards.alias_risk(c, ("cold", "small"), ("widget",))


# --- links ---
def _nested(spark, d):
    o = read(spark, d, "orders")
    edges = o.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("base"), F.col("o_orderkey").alias("amender"), F.col("o_orderpriority").alias("method"), F.lit("high").alias("confidence"))
    gone = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("base"), F.col("o_orderkey").alias("amender"), F.lit("law_notes").alias("method"), F.lit("medium").alias("confidence"))
    info = o.select(F.col("o_orderkey").alias("law_book_id"), F.col("o_orderstatus").alias("title"), F.year("o_orderdate").cast("string").alias("year"))
    return links.nested(edges, gone, info).withColumns({"base_num": (F.col("base") % 100).cast("string"), "base_year": F.lit("1999")})


_MAJORS = [("1", "1999", "first"), ("7", "1999", "second"), ("7", "1900", "none")]


def _summary(spark, d):
    return reports.link_summary(_nested(spark, d), spark.createDataFrame(_MAJORS, "num string, year string, label string"))


@query("SELECT count(DISTINCT o_custkey) AS bases_with_links, count(*) FILTER (o_orderkey % 3 <> 0) AS amendment_edges, count(*) FILTER (o_orderkey % 3 = 0) AS replace_edges FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def link_summary_totals(spark, d):
    return _summary(spark, d)[0]


@query("SELECT o_orderpriority AS method, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def link_summary_methods(spark, d):
    return _summary(spark, d)[1]


@query("""WITH b AS (SELECT o_custkey AS base, count(*) FILTER (o_orderkey % 3 <> 0) AS n FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 GROUP BY 1), m(num, label) AS (VALUES (1, 'first'), (7, 'second'))
 SELECT label, min(base) AS base, min_by(n, base) AS amended_by FROM m LEFT JOIN b ON base % 100 = num GROUP BY 1 UNION ALL SELECT 'none', NULL, 0""")
def link_summary_majors(spark, d):
    return _summary(spark, d)[2].withColumn("amended_by", F.col("amended_by").cast("long"))


# --- retrieval ---
_LAW = "(SELECT p_brand AS qid, p_partkey AS pos, 'law ' || p_name AS t, CASE WHEN p_brand LIKE '%1' THEN 'law small w' WHEN p_brand LIKE '%2' THEN 'law nothing' ELSE '' END AS f FROM part)"
_PEN = "(CASE WHEN contains(t, 'small') AND NOT contains(f, 'small') THEN 48.0 ELSE 0 END + CASE WHEN contains(t, 'ring') THEN 38.0 ELSE 0 END + CASE WHEN contains(t, 'red') THEN 30.0 ELSE 0 END)"


@query(f"""WITH a AS (SELECT *, f <> '' AND contains(t, f) AS inside, {_PEN} AS pen FROM {_LAW}), b AS (SELECT *, bool_or(inside) OVER (PARTITION BY qid) AS hit, min(pen) FILTER (inside) OVER (PARTITION BY qid) AS least FROM a)
 SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN hit THEN pen END, CASE WHEN hit THEN length(t) - length(replace(t, ' ', '')) END, pos) - 1 AS place FROM b WHERE CASE WHEN hit THEN inside AND pen <= least + 20 ELSE f = '' END""")
def titled_rows_first(spark, d):
    """A brand's question names an instrument that titles hold, one that none holds, or none at all."""
    p = read(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("qid"), F.col("p_partkey").alias("pos"), F.concat(F.lit("Law "), "p_name").alias("title"))
    name = F.when(F.col("qid").endswith("1"), "law small w?").when(F.col("qid").endswith("2"), "law nothing?").otherwise("anything")
    asked = rows.select("qid").distinct().withColumn("question", name)
    return search.prefer_titled(rows, asked, PARTS, hard=True).select("qid", "pos", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT o_custkey AS qid, max(o_orderkey) AS gold FROM orders GROUP BY 1), h AS (SELECT o_custkey AS qid, o_orderkey AS k, v.variant, row_number() OVER (PARTITION BY o_custkey, v.variant ORDER BY CASE v.variant WHEN 'newest' THEN -o_orderkey ELSE o_orderkey END) AS rank FROM orders, (VALUES ('newest'), ('oldest')) v(variant))
 SELECT variant, count(DISTINCT qid) AS cases, count(*) FILTER (k = gold AND rank <= 3) AS passed, round(count(*) FILTER (k = gold AND rank <= 3) / count(DISTINCT qid), 6) AS recall FROM h JOIN c USING (qid) GROUP BY 1""")
def recall_matrix(spark, d):
    """Two orders of each customer's orders, judged by whether the newest is among the first three."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("k"))
    cases = o.groupBy("qid").agg(F.max("k").alias("gold"))
    ranked = [search.top_k(o, "qid", [by], 3).withColumn("variant", F.lit(name)) for name, by in (("newest", F.desc("k")), ("oldest", F.asc("k")))]
    return reports.matrix(ranked[0].unionByName(ranked[1]), cases, 3, F.col("k") == F.col("gold"))


@query("""WITH a AS (SELECT p_brand AS qid, p_partkey AS k, contains(p_name, CASE WHEN p_brand LIKE '%3' THEN 'nothing' ELSE 'cold' END) AS m FROM part), b AS (SELECT *, bool_or(m) OVER (PARTITION BY qid) AS hit FROM a) SELECT qid, k FROM b WHERE m OR NOT hit""")
def marked_rows_or_all(spark, d):
    """Rows with the cited word, or all of a brand where no row has it."""
    rows = read(spark, d, "part").select(F.col("p_brand").alias("qid"), F.col("p_partkey").alias("k"), "p_name")
    word = F.when(F.col("qid").endswith("3"), F.lit("nothing")).otherwise("cold")
    return search.prefer_marked(rows, F.col("p_name").contains(word)).select("qid", "k")


@query("""WITH h AS (SELECT o_custkey AS qid, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderstatus = 'F'),
 x AS (SELECT o_custkey AS qid, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'F')
 SELECT qid, k, pos FROM h UNION ALL SELECT x.qid, x.k, coalesce((SELECT max(pos) + 1 FROM h WHERE h.qid = x.qid), 0) + row_number() OVER (PARTITION BY x.qid ORDER BY x.k DESC) - 1 FROM x""")
def leg_gap_fill(spark, d):
    """A second leg's rows follow those that the first has."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("k"), "o_orderstatus")
    at = lambda df, by: search.top_k(df, "qid", [by], 1 << 30, "pos").select("qid", "k", (F.col("pos") - 1).cast("long").alias("pos"))
    return search.not_yet(at(o.where("k % 2 = 0"), F.desc("k")), at(o.where("o_orderstatus = 'F'"), F.asc("k")), ["qid", "k"])


@query("SELECT o_orderkey, c_name AS title, CASE WHEN c_custkey IS NULL THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS year FROM (SELECT o_orderkey, c_custkey, coalesce(c_name, '') AS c_name, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey > 4) ON c_custkey = o_custkey WHERE o_orderstatus = 'O')")
def index_with_titles(spark, d):
    """Rows of one role with their law's title and year, empty where the law is unknown."""
    index = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("law_book_id"), F.col("o_orderstatus").alias("role"), F.lit("1").alias("article_label"))
    laws = read(spark, d, "customer").where("c_nationkey > 4").select(F.col("c_custkey").alias("law_book_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("year"))
    return articles.with_titles(articles.lookup(index, role="O", label="1"), laws, ("title", "year")).select("o_orderkey", "title", "year")


@query("SELECT p_partkey, p_size % 5 = 0 OR contains(p_name, 'cold') OR contains(p_name, 'ring') AS amending FROM part")
def amending_rows(spark, d):
    flag = F.when(F.col("p_size") % 5 == 0, " B ")
    return read(spark, d, "part").select("p_partkey", links.is_amending(flag, F.upper("p_name"), "B", ("cold", "ring")).alias("amending"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY c_custkey LIMIT 25")
def first_new_rows(spark, d):
    """The next 25 records that have no card yet; the limit is the feature."""
    return records.first_new(read(spark, d, "customer").select("c_custkey", "c_name"), read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 25, "c_custkey")


@query("""SELECT o_orderkey AS qid, '{"answer":"' || o_orderpriority || '","rows":' || o_custkey || ',"error":' || CASE WHEN o_orderstatus = 'F' THEN '"F"' ELSE 'null' END || ',"disclaimer":"no advice"}' AS result FROM orders""")
def answers_as_json(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("answer"), F.col("o_custkey").alias("rows"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("error"))
    return records.results_json(o, "no advice")
