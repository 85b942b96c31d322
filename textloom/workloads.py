"""Registered queries over the test tables, each over its whole tables, with DuckDB oracles where SQL can say it.

``documents`` stand for records, ``labels`` for their status, ``benchmark`` for questions, ``embeddings`` for vectors
(label = gold), ``orders`` for upserts and catalogues, ``part`` for titles, ``events`` for logs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import api
from .functions import text as T
from .functions import web
from .operators import articles, chunking, fusion, legs, links, registry, reports, routing, search, upsert
from .plans import planner
from .profile import GENERIC
from .shared import stored
from .streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINES = replace(GENERIC, marker_line=r"^.*$")
PATHS = replace(GENERIC, reference=r"/([0-9]{1,6})(?:-([0-9]{1,6}))?", shorthand=r"#([0-9]+)")
SPANS = replace(GENERIC, reference=r"section ([0-9]{1,4})(?:-([0-9]{1,4}))?")
SHORT = replace(GENERIC, min_core=3)


# --- scans, filters, joins ---
@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality = 1")
def inforce_filter(spark, d):
    """Unknown status is kept; known and not in force is dropped."""
    return read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").where("quality is null or quality = 1")


@query("SELECT d.doc_id, d.source, coalesce(CAST(l.quality AS VARCHAR), '') AS status, coalesce(CAST(l.toxic AS VARCHAR), '') AS flag FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_left_join(spark, d):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", text("quality").alias("status"), text("toxic").alias("flag"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_rows_anti_join(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT vec_id, label FROM embeddings WHERE label IN (SELECT toxic + quality FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)")
def cited_semi_join(spark, d):
    cited = read(spark, d, "labels").select((F.col("toxic") + F.col("quality")).alias("label")).distinct()
    return read(spark, d, "embeddings").select("vec_id", "label").join(cited, "label", "left_semi")


# --- text functions ---
@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS norm FROM documents")
def text_normalise(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalize("text")).alias("norm"))


_STOPS = ", ".join(f"'{w}'" for w in GENERIC.stop_words)
_TOKENS = rf"list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[؟?!،,.;:()]', ' ', 'g')), '\s+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND w NOT IN ({_STOPS}) AND NOT regexp_full_match(w, '\p{{Nd}}+')))"


@query(rf"SELECT doc_id, len({_TOKENS}) AS n_tokens, md5(array_to_string(list_sort({_TOKENS}), ' ')) AS tokens FROM documents")
def content_tokens(spark, d):
    return read(spark, d, "documents").withColumn("t", T.content_tokens("text")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens"))


@query(rf"SELECT d.doc_id, round(least(0.30, 0.06 * len(list_filter(q.t, lambda w: contains(lower(d.text), w)))), 6) AS bonus FROM documents d JOIN (SELECT item_id, {_TOKENS} AS t FROM benchmark) q ON q.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark)")
def token_topic_bonus(spark, d):
    """Every document meets one question, and all questions are met in turn."""
    q = read(spark, d, "benchmark").select("item_id", T.content_tokens("text").alias("t"))
    n = read(spark, d, "benchmark").agg((F.max("item_id") + 1).alias("n"))
    both = read(spark, d, "documents").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(q, "item_id")
    return both.select("doc_id", F.round(T.topic_bonus(F.lower("text"), F.col("t"), first=1_000_000), 6).alias("bonus"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(url, '/([0-9]{1,6})', 1), lambda x: CAST(CAST(x AS INT) AS VARCHAR)))), ',') AS numbers FROM pages")
def number_refs_extract(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(F.array_sort(T.reference_numbers("url", PATHS)), ",").alias("numbers"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 30 THEN array_to_string(range(p_partkey % 1000, p_partkey % 1000 + p_size + 1), ',')
          ELSE concat(p_partkey % 1000, ',', p_partkey % 1000 + p_size) END AS numbers FROM part""")
def range_expand(spark, d):
    text = F.concat(F.lit("see section "), (F.col("p_partkey") % 1000).cast("string"), F.lit("-"), (F.col("p_partkey") % 1000 + F.col("p_size")).cast("string"))
    return read(spark, d, "part").select("p_partkey", F.array_join(T.reference_numbers(text, SPANS), ",").alias("numbers"))


@query("SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '/([0-9]{1,6})', 1), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS numbers FROM pages")
def article_mentions(spark, d):
    m = articles.mentions(F.col("url"), PATHS)
    return read(spark, d, "pages").select("page_id", F.array_join(F.transform(m, lambda x: x["number"]), ",").alias("numbers"))


@query("""SELECT doc_id, line_no - 1 AS line_no, start, n FROM (SELECT doc_id, line_no, length(line) AS n,
          sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) - 1 AS start
          FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents))""")
def line_offsets(spark, d):
    return articles.text_lines(read(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("start").cast("long").alias("start"), F.length("line").cast("long").alias("n"))


_LINES_SQL = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents"


@query(rf"""WITH l AS ({_LINES_SQL}), o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) - 1 AS start FROM l),
      h AS (SELECT doc_id, start, regexp_extract(line, '^([A-Z][a-z]?)[a-z]* .*$', 1) AS article_label, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS nxt FROM o WHERE regexp_matches(line, '^([A-Z][a-z]?)[a-z]* .*$'))
      SELECT doc_id, article_label, start AS char_start, start + length(body) AS char_end, md5(body) AS body FROM
      (SELECT h.*, regexp_replace(substring(d.text, CAST(start AS BIGINT) + 1, CAST(coalesce(nxt, length(d.text)) - start AS BIGINT)), '\s+$', '') AS body FROM h JOIN documents d USING (doc_id))""")
def header_spans(spark, d):
    got = articles.header_spans(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", GENERIC, r"^([A-Z][a-z]?)[a-z]* .*$")
    return got.select("doc_id", "article_label", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.md5("body").alias("body"))


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents),
  g AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), lambda x: length(x)) AS z FROM s WHERE length(t) > 2500),
  r(doc_id, z, i, n, o) AS (SELECT doc_id, z, 1, 0, CAST([] AS BIGINT[]) FROM g UNION ALL
    SELECT doc_id, z, i + 1, CASE WHEN n2 > 2500 THEN n2 - ((n2 - 1) // 2500) * 2500 ELSE n2 END, CASE WHEN n2 > 2500 THEN list_concat(o2, list_transform(range((n2 - 1) // 2500), lambda q: 2500)) ELSE o2 END FROM
    (SELECT doc_id, z, i, CASE WHEN n > 0 AND n + z[i] > 1500 THEN z[i] ELSE n + z[i] + CASE WHEN n > 0 THEN 2 ELSE 0 END END AS n2, CASE WHEN n > 0 AND n + z[i] > 1500 THEN list_append(o, n) ELSE o END AS o2 FROM r WHERE i <= len(z)))
  SELECT doc_id, array_to_string(list_append(o, n), ',') AS sizes FROM r WHERE i = len(z) + 1
  UNION ALL SELECT doc_id, CAST(length(t) AS VARCHAR) FROM s WHERE length(t) BETWEEN 1 AND 2500""")
def chunk_pack(spark, d):
    """Lengths of a record's chunks, each line a segment."""
    body = T.strip(F.coalesce(F.col("text"), F.lit("")))
    parts = F.when(F.length(body) <= chunking.MOST, F.array(body)).otherwise(chunking.packed(chunking.segments(body, LINES)))
    return read(spark, d, "documents").where(body != "").select("doc_id", F.array_join(F.transform(parts, lambda x: F.length(x).cast("string")), ",").alias("sizes"))


def _unescape_sql(x: str) -> str:
    for a, b in web.ENTITIES:
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


_HTML = f"""array_to_string(list_filter(list_transform(string_split(replace(replace({_unescape_sql("regexp_replace(regexp_replace(regexp_replace(" + _unescape_sql("coalesce(html, '')") + ", '<br[ ]*/?>', chr(10), 'gi'), '</p[ ]*>', chr(10), 'gi'), '<[^>]+>', '', 'g')")}, chr(160), ' '), chr(13), ''), chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10))"""


@query(f"SELECT page_id, length({_HTML}) AS n, md5({_HTML}) AS text FROM pages")
def html_to_text(spark, d):
    return read(spark, d, "pages").withColumn("t", web.html_to_text("html")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("text"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def date_iso(spark, d):
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d-M-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read(spark, d, "orders").select("o_orderkey", web.date_iso(written).alias("iso"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'repealed' ELSE 'in-force' END AS status FROM orders")
def status_map(spark, d):
    return read(spark, d, "orders").select("o_orderkey", web.status_of(F.when(F.col("o_orderstatus") == "F", " n ").when(F.col("o_orderstatus") == "O", "Y"), F.lit(None).cast("string"), "R", "in-force", "repealed").alias("status"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


# --- identity and upsert ---
_LAWS = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS law, CASE WHEN doc_id % 3 = 1 THEN source END AS corpus, lang, coalesce(text, '') AS text FROM documents"""


def _laws(spark, d):
    m = F.col("doc_id") % 3
    return read(spark, d, "documents").select("doc_id", F.when(m == 0, F.col("doc_id")).alias("lawBookID"), F.when(m == 1, F.col("source")).alias("corpus_id"), F.col("lang").alias("lawTitle"), F.lit("1999").alias("lawYear"), F.col("doc_id").cast("string").alias("lawCode"), F.col("text").alias("full_text"))


@query(f"SELECT doc_id, CASE WHEN law IS NOT NULL THEN 'legislation:lawBookID:' || law WHEN corpus IS NOT NULL THEN 'legislation:corpus_id:' || corpus ELSE 'legislation:title_year:' || substring(sha256(doc_id || '|1999|' || lang), 1, 16) END AS identity FROM ({_LAWS})")
def identity_key(spark, d):
    return upsert.with_identity(_laws(spark, d)).select("doc_id", "identity")


@query(rf"SELECT doc_id, sha256(concat_ws(chr(10), 'legislation', lang, '', '', '', '', '', '1999', CAST(doc_id AS VARCHAR), '', CAST(length(text) AS VARCHAR), sha256(text))) AS fingerprint FROM ({_LAWS})")
def content_fingerprint(spark, d):
    return upsert.with_fingerprint(_laws(spark, d)).select("doc_id", "fingerprint")


_MERGE = """WITH m AS (SELECT o_custkey AS id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
 b AS (SELECT id, 0 AS side, -1 AS seq, o.o_orderstatus AS fp FROM m JOIN orders o ON o.o_orderkey = m.k UNION ALL SELECT o_custkey, 1, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1),
 c AS (SELECT *, lag(fp) OVER (PARTITION BY id ORDER BY side, seq) AS prev FROM b),
 k AS (SELECT *, CASE WHEN prev IS NULL THEN 'inserted' WHEN prev = fp THEN 'skipped' ELSE 'updated' END AS change FROM c)"""


def _merge(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("fp"))
    master = upsert.last_wins(o.where("seq % 2 = 0"), ["id"], "seq").drop("seq")
    return upsert.merge(master, o.where("seq % 2 = 1"), "id", "fp", "seq")


@query(_MERGE + " SELECT id, fp, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side DESC, seq DESC) AS r FROM k WHERE side = 0 OR change <> 'skipped') WHERE r = 1")
def merge_upsert(spark, d):
    return _merge(spark, d)[0].select("id", "fp", "seq")


@query(_MERGE + " SELECT id, seq, fp, change FROM k WHERE side = 1 AND change <> 'skipped'")
def merge_delta(spark, d):
    return _merge(spark, d)[1].select("id", "seq", "fp", "change")


@query(_MERGE + " SELECT count(*) FILTER (side = 1 AND change = 'inserted') AS inserted, count(*) FILTER (side = 1 AND change = 'updated') AS updated, count(*) FILTER (side = 1 AND change = 'skipped') AS skipped, count(*) FILTER (side = 1) AS total_in, count(*) FILTER (side = 0) + count(*) FILTER (side = 1 AND change = 'inserted') AS total_out FROM k")
def merge_stats(spark, d):
    return _merge(spark, d)[2]


@query("SELECT n.o_orderkey, CASE WHEN n.o_orderkey % 4 = 0 THEN 'new' WHEN n.o_orderkey % 4 = 1 THEN 'stale' ELSE 'same' END AS state FROM orders n")
def stale_route_diff(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    old = o.where("o_orderkey % 4 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 4 == 1, F.lit("old")).otherwise(F.col("o_orderpriority")))
    return upsert.stale_routes(old, o, "o_orderkey", "o_orderpriority")


@query("SELECT conv_id, turn, role, md5(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def last_wins_dedupe(spark, d):
    return upsert.last_wins(read(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("""SELECT qid, key, pos_out FROM (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY s, p, key) AS pos_out FROM (SELECT o_custkey AS qid, o_orderkey % 7 AS key, min(struct_pack(s := o_orderkey % 3, p := o_orderkey)).s AS s, min(struct_pack(s := o_orderkey % 3, p := o_orderkey)).p AS p FROM orders GROUP BY 1, 2)) WHERE pos_out <= 4""")
def priority_union(spark, d):
    lists = read(spark, d, "orders").select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 3).alias("source"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 7).alias("key"))
    return search.priority_union(lists, "qid", "source", "pos", "key", 4).withColumn("pos_out", F.col("pos_out").cast("long"))


@query("""WITH c AS (SELECT o_orderpriority AS src, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) - 1 AS pos, CASE WHEN o_custkey % 8 <> 0 THEN 1 ELSE 0 END AS known FROM orders),
 i AS (SELECT *, sum(1 - known) OVER (PARTITION BY src ORDER BY pos) AS isle FROM c), s AS (SELECT *, sum(known) OVER (PARTITION BY src, isle ORDER BY pos) AS streak, pos // 10 AS page FROM i),
 e AS (SELECT src, page, max_by(streak, pos) AS fin FROM s GROUP BY 1, 2), t AS (SELECT src, min(page) AS stop FROM e WHERE fin >= 20 GROUP BY 1)
 SELECT s.src, s.k, s.pos FROM s LEFT JOIN t USING (src) WHERE known = 0 AND (stop IS NULL OR page <= stop)""")
def known_streak_stop(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("src"), F.col("o_orderkey").alias("k"), "o_custkey")
    catalog = o.withColumn("pos", (F.row_number().over(Window.partitionBy("src").orderBy(F.desc("k"))) - 1).cast("long"))
    return upsert.until_known_streak(catalog.drop("o_custkey"), o.where("o_custkey % 8 <> 0"), "k", "pos", 10, by=["src"]).select("src", "k", "pos")


@query("""SELECT event_id AS id, unnest(list_filter([CASE WHEN NOT (value BETWEEN 0 AND 100) THEN 'value' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'type' END, CASE WHEN user_id < 10 THEN 'user' END], lambda x: x IS NOT NULL)) AS rule FROM events""")
def schema_violations(spark, d):
    e = read(spark, d, "events")
    return upsert.violations(e.withColumnRenamed("event_id", "id"), "id", {"value": F.col("value").between(0, 100), "type": F.col("event_type").isin("click", "view"), "user": F.col("user_id") >= 10})


# --- aggregates ---
_SUMMARY = """(SELECT count(*) AS records, min(doc_id) AS min_id, max(doc_id) AS max_id, count(*) FILTER (trim(coalesce(text, '')) <> '') AS with_text, count(*) FILTER (trim(coalesce(text, '')) = '') AS without_text, count(DISTINCT source) AS years FROM documents)"""
_COUNTS = "(SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) AS status_counts FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1))"


def _entries(c: str):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@query(f"SELECT * FROM {_SUMMARY} CROSS JOIN {_COUNTS}")
def corpus_summary(spark, d):
    return reports.corpus_summary(read(spark, d, "documents"), "doc_id", "text", "lang", "source").withColumn("status_counts", _entries("status_counts"))


@query(f"SELECT *, '2026.1' AS corpus_version FROM {_SUMMARY} CROSS JOIN {_COUNTS}")
def manifest(spark, d):
    return reports.manifest(read(spark, d, "documents"), "doc_id", "text", "lang", "source", "2026.1").withColumn("status_counts", _entries("status_counts"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def counts_by_role(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


@query("SELECT event_type, count(*) AS calls, round(sum(round(value, 2)), 4) AS cost_usd, sum(user_id) AS prompt_tokens, sum(event_id) AS completion_tokens FROM events GROUP BY 1")
def usage_cost_report(spark, d):
    e = read(spark, d, "events").withColumn("value", F.round("value", 2).cast("decimal(18,2)"))
    return reports.usage_report(e, ["event_type"], "value", "user_id", "event_id").select("event_type", "calls", F.round("cost_usd", 4).cast("double").alias("cost_usd"), "prompt_tokens", "completion_tokens")


@query("""SELECT kind, count(*) AS n, count(DISTINCT p_partkey) AS titles FROM (SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_brand), lower(p_name)) THEN 'substring' END AS kind FROM part UNION ALL
  SELECT p_partkey, CASE WHEN contains(lower(p_type), lower(p_name)) THEN 'substring' WHEN len(list_filter(string_split(lower(p_name), ' '), lambda w: NOT list_contains(string_split(lower(p_type), ' '), w))) = 0 THEN 'token_subset' ELSE 'novel' END FROM part) GROUP BY 1""")
def alias_redundancy(spark, d):
    p = read(spark, d, "part")
    both = p.select("p_partkey", F.col("p_name").alias("alias"), F.concat_ws(" ", "p_name", "p_brand").alias("title")).unionByName(p.select("p_partkey", F.col("p_name").alias("alias"), F.col("p_type").alias("title")))
    return reports.alias_redundancy(both, "p_partkey", "alias", "title")


@query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey) AS orders FROM orders GROUP BY 1")
def newest_first_collect(spark, d):
    item = F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), "o_orderkey")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["o_orderkey"].cast("string")), ",").alias("orders"))


# --- search ---
_DIST = "round(1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6)"


def _topk_sql(where: str) -> str:
    return f"SELECT qid, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, {_DIST} AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id{where})) WHERE rank <= 6"


def _vectors(spark, d, where=None, k=6):
    e = read(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    rows = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    return search.vector_top_k(q, rows, k, where, others=True).withColumn("rank", F.col("rank").cast("long"))


@query(_topk_sql(""))
def vector_topk(spark, d):
    return _vectors(spark, d)


@query(_topk_sql(" AND v.label < 5"))
def vector_topk_prefilter(spark, d):
    return _vectors(spark, d, F.col("label") < 5)


@query(f"WITH t AS ({_topk_sql('')}) SELECT qid, round(greatest(max(distance) FILTER (rank = 2) - max(distance) FILTER (rank = 1), 0), 6) AS margin FROM t GROUP BY 1")
def route_margin(spark, d):
    t = _vectors(spark, d, k=2).groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    return t.select("qid", F.round(planner.margin(F.col("d1"), F.col("d2")), 6).alias("margin"))


_TERMS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"
_BM25 = rf"""t AS (SELECT doc_id AS chunk_id, {_TERMS} AS w FROM documents), p AS (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM t), tf AS (SELECT term, chunk_id, dl, count(*) AS tf FROM p GROUP BY 1, 2, 3),
 s AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_dl FROM t), q AS (SELECT item_id AS qid, unnest(list_distinct({_TERMS})) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 r AS (SELECT qid, chunk_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 4) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM r)"""


def _bm25(spark, d, k):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return search.bm25_texts(q, docs, k)


@query(f"WITH {_BM25} SELECT qid, chunk_id, score, rank FROM b WHERE rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).withColumn("rank", F.col("rank").cast("long"))


@query(rf"WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY 1")
def postings_index(spark, d):
    return search.postings(read(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_HYBRID = f"WITH {_BM25}, v AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) AS rank FROM (SELECT item_id AS qid, v.vec_id AS chunk_id, {_DIST} AS distance FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings v)), h AS (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS relevance FROM (SELECT qid, chunk_id, rank FROM b WHERE rank <= 20 UNION ALL SELECT qid, chunk_id, rank FROM v WHERE rank <= 20) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, chunk_id) AS rank FROM h)"


def _hybrid(spark, d):
    """Each question's vector is that of the embedding with its id; documents' vectors are those with theirs."""
    e = read(spark, d, "embeddings")
    q = read(spark, d, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), F.col("embedding").alias("qvec"))
    near = search.vector_top_k(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), 20)
    return search.hybrid(_bm25(spark, d, 20), near, 6), near


@query(_HYBRID + " SELECT qid, chunk_id, relevance, rank FROM o WHERE rank <= 6")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d)[0].withColumn("rank", F.col("rank").cast("long"))


@query(_HYBRID + " SELECT qid, chunk_id, rank FROM o WHERE rank <= 6 AND qid % 2 = 0 UNION ALL SELECT qid, chunk_id, rank FROM v WHERE rank <= 20 AND qid % 2 = 1")
def hybrid_fallback(spark, d):
    first, second = _hybrid(spark, d)
    return search.with_fallback(first.where("qid % 2 = 0").select("qid", "chunk_id", "rank"), second.select("qid", "chunk_id", "rank")).withColumn("rank", F.col("rank").cast("long"))


# --- legs ---
def _leg_sql(leg: str, where: str, order: str, limit: int) -> str:
    return f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), m AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, v.label AS law, v.vec_id % 5 AS art, {_DIST} AS d FROM q CROSS JOIN embeddings v WHERE {where})
 SELECT qid, '{leg}' AS leg, rank - 1 AS rank, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM m) WHERE rank <= {limit}"""


def _leg_rows(spark, d):
    e = read(spark, d, "embeddings")
    article = F.array((F.col("vec_id") % 5).cast("string"))
    rows = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("law"), F.lit("").alias("title"), (2000 + F.col("label")).cast("string").alias("year"), article.alias("article_arr"), F.repeat(F.lit("x"), (F.col("vec_id") % 3).cast("int")).alias("chunk_text"), F.col("embedding").alias("vector"))
    scope = F.when(F.col("vec_id") % 200 == 0, F.array(F.col("label").cast("bigint"), (F.col("label") + 1).cast("bigint") % 10)).otherwise(F.array().cast("array<bigint>"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), scope.alias("scope"), F.lit("3").alias("article_label"))
    return asked, rows


def _ranks(df):
    return df.withColumn("rank", F.col("rank").cast("long"))


_IN_SCOPE = "v.label IN (q.label, (q.label + 1) % 10)"


@query(_leg_sql("law_scoped", f"q.vec_id % 200 = 0 AND {_IN_SCOPE}", "d, chunk_id", 6))
def leg_law_scoped(spark, d):
    asked, rows = _leg_rows(spark, d)
    return _ranks(legs.scoped_leg(asked, rows, "law", 6))


@query(_leg_sql("article_exact", f"v.vec_id % 5 = 3 AND (q.vec_id % 200 <> 0 OR {_IN_SCOPE})", "d, chunk_id", 4))
def leg_article_exact(spark, d):
    asked, rows = _leg_rows(spark, d)
    return _ranks(legs.article_leg(asked, rows, "law", 4))


_POINTS = "CASE WHEN qid % 200 <> 0 THEN 0 ELSE CASE art WHEN 1 THEN -5 WHEN 2 THEN -3 ELSE -1 END END, CASE WHEN qid % 200 <> 0 THEN 0 ELSE -law END, CASE WHEN qid % 200 <> 0 THEN 0 ELSE chunk_id % 3 END, d, chunk_id"


@query(_leg_sql("defining_articles", f"v.vec_id % 5 IN (1, 2, 3) AND (q.vec_id % 200 <> 0 OR {_IN_SCOPE})", _POINTS, 5))
def leg_defining_articles(spark, d):
    asked, rows = _leg_rows(spark, d)
    return _ranks(legs.defining_leg(asked, rows, "law", 5))


@query(f"WITH t AS ({_leg_sql('card_route', f'q.vec_id % 200 = 0 AND {_IN_SCOPE}', 'd, chunk_id', 1000000)}), o AS (SELECT t.*, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS r FROM t JOIN embeddings ON vec_id = chunk_id) SELECT qid, leg, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS rank, chunk_id FROM o WHERE r = 1")
def leg_card_route(spark, d):
    """The nearest chunk of each law of the scope."""
    asked, rows = _leg_rows(spark, d)
    return _ranks(legs.scoped_leg(asked, rows, "law", 6, "card_route", each=1))


@query("WITH n AS (SELECT DISTINCT substring(lower(p_name), 2, 6) AS needle FROM part) SELECT p_partkey, needle FROM part JOIN n ON contains(lower(p_name), needle)")
def title_holding(spark, d):
    """Titles that contain a needle, by the needle's rarest three characters and not pair by pair."""
    p = read(spark, d, "part").select("p_partkey", F.lower("p_name").alias("title"))
    needles = p.select(F.substring("title", 2, 6).alias("needle")).distinct()
    return search.holding(p, needles, "title", "needle").select("p_partkey", "needle")


@query("""WITH q AS (SELECT r_regionkey AS qid, 'the law of ' || (SELECT min(lower(p_name)) FROM part) AS t FROM region), r AS (SELECT p_partkey AS law, lower(p_name) AS n FROM part WHERE length(trim(p_name)) >= 4)
 SELECT qid, CAST(max(length(n)) AS BIGINT) AS alias_len FROM q JOIN r ON contains(t, n) GROUP BY 1""")
def routing_longest_alias(spark, d):
    first = read(spark, d, "part").agg(F.min(F.lower("p_name")).alias("first"))
    q = read(spark, d, "region").crossJoin(F.broadcast(first)).select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("the law of "), "first").alias("question"))
    laws = read(spark, d, "part").select(F.col("p_partkey").alias("law_book_id"), F.array("p_name").alias("aliases"))
    return routing.longest_alias(q, laws).select("qid", F.col("alias_len").cast("long").alias("alias_len"))


@query("""WITH a AS (SELECT o_orderkey AS law, CAST(o_custkey AS VARCHAR) AS num, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
 SELECT DISTINCT c_custkey AS qid, law AS law_book_id FROM customer JOIN a ON num = CAST(c_custkey AS VARCHAR) AND y = CAST(1992 + c_custkey % 7 AS VARCHAR)""")
def routing_cited_laws(spark, d):
    laws = read(spark, d, "orders").select(F.col("o_orderkey").alias("law_book_id"), F.concat(F.lit("Item no. "), F.col("o_custkey").cast("string"), F.lit(" of "), F.year("o_orderdate").cast("string")).alias("title"))
    q = read(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("what says no. "), F.col("c_custkey").cast("string"), F.lit(" of "), (1992 + F.col("c_custkey") % 7).cast("string"), F.lit("?")).alias("question"))
    return routing.cited_laws(q, laws).select("qid", "law_book_id")


# --- scored matching ---
@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS b FROM part) WHERE p_size >= b - 3")
def near_best_filter(spark, d):
    return search.near_best(read(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size")), "p_brand", "p_size", 3)


PARTS = replace(GENERIC, title_penalties=(("small", 48.0), ("ring", 38.0), ("red", 30.0)), amendment_markers=("small",), base_codes=("ring",))
_PEN = "(CASE WHEN contains(lower(p_name), 'small') THEN 48.0 ELSE 0 END + CASE WHEN contains(lower(p_name), 'ring') THEN 38.0 ELSE 0 END + CASE WHEN contains(lower(p_name), 'red') AND NOT contains('the red one', 'red') THEN 30.0 ELSE 0 END)"


@query(f"SELECT p_partkey, CAST({_PEN} AS DOUBLE) AS penalty, row_number() OVER (PARTITION BY p_brand ORDER BY {_PEN}, p_partkey) AS rank FROM part QUALIFY rank <= 20")
def title_penalty_rank(spark, d):
    p = read(spark, d, "part").withColumn("penalty", T.title_penalty(T.normalize("p_name"), F.lit("the red one"), PARTS))
    return search.top_k(p, "p_brand", [F.col("penalty"), F.col("p_partkey")], 20).select("p_partkey", "penalty", F.col("rank").cast("long").alias("rank"))


@query(r"""SELECT p_partkey, CASE WHEN NOT contains(t, f) THEN 0.0 ELSE CASE WHEN starts_with(t, f) AND length(t) - length(f) <= 12 THEN 22.0 WHEN starts_with(t, f) THEN 16.0 ELSE -22.0 END - 8.0 * least(len(list_filter(string_split(replace(t, f, ' '), ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '\p{Nd}+'))), 4) END AS fit
  FROM (SELECT p_partkey, lower(p_name) AS t, CASE WHEN p_partkey % 2 = 0 THEN split_part(lower(p_name), ' ', 1) ELSE split_part(lower(p_name), ' ', 2) END AS f FROM part)""")
def phrase_title_fit(spark, d):
    words = F.split(F.lower("p_name"), " ")
    return read(spark, d, "part").select("p_partkey", T.phrase_fit(F.lower("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.get(words, F.lit(0))).otherwise(F.get(words, F.lit(1)))).alias("fit"))


_LEX = "x AS (SELECT p_name AS alias_norm, min(p_partkey) AS law FROM part GROUP BY 1)"


@query(f"""WITH {_LEX}, q AS (SELECT c_custkey AS qid, (SELECT min(alias_norm) FROM x) AS a, 'about ' || (SELECT min(alias_norm) FROM x) || ' number' AS t FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, (SELECT max(alias_norm) FROM x), (SELECT max(alias_norm) FROM x) FROM customer WHERE c_custkey % 2 = 1)
 SELECT qid, law AS law_book_id, CAST(length(alias_norm) AS DOUBLE) AS score FROM q JOIN x ON contains(' ' || t || ' ', ' ' || alias_norm || ' ') WHERE length(alias_norm) >= 4""")
def lexicon_match(spark, d):
    x = read(spark, d, "part").groupBy(F.col("p_name").alias("alias_norm")).agg(F.min("p_partkey").alias("law_book_id")).withColumn("title", F.lit("plain"))
    ends = x.agg(F.min("alias_norm").alias("lo"), F.max("alias_norm").alias("hi"))
    q = read(spark, d, "customer").select(F.col("c_custkey").alias("qid")).crossJoin(F.broadcast(ends)).select("qid", F.when(F.col("qid") % 2 == 0, F.concat(F.lit("about "), F.col("lo"), F.lit(" number"))).otherwise(F.col("hi")).alias("question"))
    return registry.lexicon_hits(q, x, GENERIC, least=4).select("qid", "law_book_id", F.col("score").cast("double").alias("score"))


@query("""WITH s AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS a FROM part WHERE length(split_part(p_name, ' ', 1)) >= 4), q AS (SELECT r_regionkey AS qid, 'any ' || (SELECT min(a) FROM s) || ' or ' || (SELECT max(a) FROM s) AS t FROM region),
 m AS (SELECT qid, p_partkey, max(length(a) + CASE WHEN starts_with(lower(p_name), a) AND length(p_name) - length(a) <= 12 THEN 22.0 WHEN starts_with(lower(p_name), a) THEN 16.0 ELSE -22.0 END - 8.0 * least(len(list_filter(string_split(replace(lower(p_name), a, ' '), ' '), lambda w: w <> '')), 4)) AS score FROM q JOIN s ON contains(t, a) JOIN part ON contains(lower(p_name), a) GROUP BY 1, 2)
 SELECT qid, p_partkey AS law_book_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p_partkey DESC) AS r FROM m WHERE score > 0) WHERE r <= 8""")
def seed_alias_match(spark, d):
    p = read(spark, d, "part")
    seeds = p.select(F.get(F.split(F.lower("p_name"), " "), F.lit(0)).alias("alias")).distinct().where(F.length("alias") >= 4).select(F.col("alias").alias("rule_id"), "alias", F.col("alias").alias("needle"))
    ends = seeds.agg(F.min("alias").alias("lo"), F.max("alias").alias("hi"))
    q = read(spark, d, "region").select(F.col("r_regionkey").alias("qid")).crossJoin(F.broadcast(ends)).select("qid", F.concat(F.lit("any "), F.col("lo"), F.lit(" or "), F.col("hi")).alias("question"))
    laws = p.select(F.col("p_partkey").alias("law_book_id"), F.col("p_name").alias("title"), F.lit("").alias("year"))
    plain = replace(GENERIC, title_penalties=())
    return registry.seed_hits(q, laws, seeds, plain, least=4).select("qid", "law_book_id", "score")


# --- links ---
_BRIEF = "b AS (SELECT o_orderkey AS base, CAST(o_custkey AS VARCHAR) AS num, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE o_orderkey % 5 <> 0), a AS (SELECT o_orderkey AS amender, CAST(o_custkey AS VARCHAR) AS own, CAST(year(o_orderdate) AS VARCHAR) AS own_year, CAST((o_orderkey * 7) % 1500 + 1 AS VARCHAR) AS num, CAST(year(o_orderdate) - 1 AS VARCHAR) AS year FROM orders WHERE o_orderkey % 5 = 0)"


def _briefs(spark, d):
    o = read(spark, d, "orders")
    y, amends = F.year("o_orderdate"), F.col("o_orderkey") % 5 == 0
    cite = F.when(amends, F.concat(F.lit("see no. "), ((F.col("o_orderkey") * 7) % 1500 + 1).cast("string"), F.lit(" of "), (y - 1).cast("string"))).otherwise("")
    laws = o.select(F.col("o_orderkey").alias("law_book_id"), F.lit("item").alias("title"), F.col("o_custkey").cast("string").alias("code"), y.cast("string").alias("year"), cite.alias("notes"), F.when(amends, "A").otherwise("").alias("flag"))
    return links.briefs(laws, GENERIC)


@query(f"WITH {_BRIEF}, m AS (SELECT base, amender, count(*) OVER (PARTITION BY amender) AS n FROM a JOIN b USING (num, year) WHERE NOT (a.num = own AND a.year = own_year)) SELECT base, amender, 'num_year' AS method, 'high' AS confidence FROM m WHERE n = 1")
def link_unique_num_year(spark, d):
    """Ties are refused here, as titles and classes are all alike."""
    return links.amendment_edges(_briefs(spark, d), F.col("flag") == "A", GENERIC)


@query(r"SELECT p_partkey, w AS core, length(w) >= 3 AND regexp_matches(h, '(^|[^\p{L}])' || w || '($|[^\p{L}])') AS inside FROM (SELECT p_partkey, substring(split_part(lower(p_name), ' ', 1), 1, 4 + CAST(p_partkey % 3 AS INT)) AS w, lower(p_name || ' ' || p_type) AS h FROM part)")
def link_boundary_containment(spark, d):
    w = F.substr(F.get(F.split(F.lower("p_name"), " "), F.lit(0)), F.lit(1), (4 + F.col("p_partkey") % 3).cast("int"))
    return read(spark, d, "part").select("p_partkey", w.alias("core"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("h")).select("p_partkey", "core", T.bounded_in(F.col("core"), F.col("h"), SHORT).alias("inside"))


@query("""WITH c AS (SELECT p_partkey AS amender, s_suppkey AS base, CASE WHEN s_suppkey % 3 = p_partkey % 3 THEN 1 ELSE 0 END AS kind, ((s_suppkey // 10) * 13) % 5 AS cls FROM part JOIN supplier ON s_suppkey % 10 = p_partkey % 10),
 k AS (SELECT *, max(kind) OVER (PARTITION BY amender) AS any_kind FROM c), f AS (SELECT * FROM k WHERE kind = 1 OR any_kind = 0), n AS (SELECT *, count(*) OVER (PARTITION BY amender) AS n, max(cls) OVER (PARTITION BY amender) AS best FROM f),
 l AS (SELECT *, count(*) OVER (PARTITION BY amender) AS n2 FROM n WHERE n = 1 OR (cls = best AND cls > 0)) SELECT amender, base FROM l WHERE n2 = 1""")
def link_ladder(spark, d):
    """Several candidates for each part: kind first, then class words in common, else refused."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("base"), F.lit("").alias("base_core"), F.concat(F.lit("k"), (F.col("s_suppkey") % 3).cast("string")).alias("base_kind"), F.array_join(F.slice(F.array(*[F.lit(f"word{i}") for i in range(5)]), 1, (F.floor(F.col("s_suppkey") / 10) * 13 % 5).cast("int")), " ").alias("base_class"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("amender"), F.concat(F.lit("k"), (F.col("p_partkey") % 3).cast("string")).alias("kind"), F.lit("word0 word1 word2 word3 word4").alias("class_blob"), F.lit("").alias("hay"))
    return links.decide_between(p.withColumn("slot", F.col("amender") % 10), s.withColumn("slot", F.col("base") % 10), ["slot"], SHORT)


# --- planning and fusion ---
def _asked(spark, d):
    c = F.col("conv_id") * 31 + F.col("turn") * 17
    return read(spark, d, "conversations").select(
        "conv_id", "turn", (c % 9 == 0).alias("draft"), F.when(c % 7 == 1, F.lit("12")).alias("article_label"), (c % 2 == 0).alias("exact_lookup"), F.when(c % 11 == 2, F.lit("x")).alias("citation"), (c % 4).cast("int").alias("instruments"),
        (c % 13 == 3).alias("comparative"), (c % 5 == 4).alias("overview"), (c % 3).cast("int").alias("n_tokens"), (c % 15).cast("int").alias("alias_len"), ((c % 10) / 20.0).alias("d1"), ((c % 10) / 20.0 + (c % 6) / 40.0).alias("d2"),
        F.when(c % 6 == 0, F.array(F.lit(5), F.col("conv_id"))).otherwise(F.array().cast("array<bigint>")).alias("phrase_ids"),
    )


_ASKED = "z AS (SELECT conv_id, turn, conv_id * 31 + turn * 17 AS c FROM conversations), s AS (SELECT *, greatest((c % 6) / 40.0, 0) AS gap, CASE WHEN c % 9 = 0 AND c % 7 <> 1 THEN 'PROCEDURAL_DRAFT' WHEN c % 7 = 1 AND c % 2 = 0 THEN 'EXACT_ARTICLE' WHEN c % 7 = 1 THEN 'ARTICLE_ANALYTICAL' WHEN c % 11 = 2 AND c % 6 <> 0 THEN 'CITATION_KEY' WHEN c % 4 >= 2 OR c % 13 = 3 THEN 'MULTI_INSTRUMENT' WHEN c % 5 = 4 AND c % 6 = 0 THEN 'DEFINITIONAL' WHEN c % 6 = 0 OR c % 15 >= 10 OR (round((c % 6) / 40.0, 9) >= 0.08 AND (c % 10) / 20.0 <= 0.40) THEN 'NAMED_INSTRUMENT' WHEN c % 3 = 0 THEN 'OUT_OF_SCOPE' ELSE 'TOPICAL' END AS shape FROM z)"


@query(f"WITH {_ASKED} SELECT conv_id, turn, shape, round(least(1.0, 0.15 + CASE WHEN c % 7 = 1 AND c % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN c % 11 = 2 THEN 0.25 ELSE 0 END + CASE WHEN c % 6 = 0 THEN 0.20 ELSE 0 END + least(0.2, (c % 15) / 50.0) + least(0.2, 2 * gap)), 4) AS confidence, CASE WHEN c % 6 = 0 AND shape IN ('EXACT_ARTICLE', 'ARTICLE_ANALYTICAL', 'MULTI_INSTRUMENT', 'DEFINITIONAL', 'NAMED_INSTRUMENT') THEN len(list_distinct([5, conv_id])) ELSE 0 END AS n_scope FROM s")
def plan_shape(spark, d):
    return planner.plan(_asked(spark, d)).select("conv_id", "turn", "shape", F.round("confidence", 4).alias("confidence"), F.size("scope_doc_ids").cast("long").alias("n_scope"))


_QUOTAS = " UNION ALL ".join(f"SELECT '{s}' AS shape, '{n}' AS leg, {q} AS base, {cap} AS max_per_law" for s, (rows, cap) in planner.SHAPES.items() for n, _, q in rows)


@query(f"WITH {_ASKED}, q AS ({_QUOTAS}) SELECT conv_id, turn, leg, CAST(CASE WHEN 1 + turn % 10 = 6 THEN base ELSE greatest(1, round_even(base * (1 + turn % 10) / 6.0, 0)) END AS BIGINT) AS quota, max_per_law FROM s JOIN q USING (shape)")
def plan_quotas_scaled(spark, d):
    p = planner.plan(_asked(spark, d), (1 + F.col("turn") % 10).cast("int"))
    return p.select("conv_id", "turn", F.explode("legs").alias("l"), "max_per_law").select("conv_id", "turn", F.col("l.name").alias("leg"), F.col("l.quota").cast("long").alias("quota"), F.col("max_per_law").cast("long").alias("max_per_law"))


def _hits(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", (F.col("label")).alias("qid"), F.element_at(F.array(F.lit("hybrid"), F.lit("law_scoped"), F.lit("title_like")), (F.col("vec_id") % 3 + 1).cast("int")).alias("leg"))
    w = Window.partitionBy("qid", "leg").orderBy((F.col("vec_id") * 7919) % 1009, "vec_id")
    h = e.withColumn("rank", F.row_number().over(w) - 1).where("rank < 15")
    return h.select("qid", "leg", "rank", F.col("vec_id").cast("string").alias("chunk_id"), (F.col("vec_id") % 4).alias("law_book_id"), F.concat_ws(":", (F.col("vec_id") % 4).cast("string"), (F.col("vec_id") % 6).cast("string")).alias("key"))


def _plans(spark, d):
    rows, _ = planner.SHAPES["NAMED_INSTRUMENT"]
    return read(spark, d, "embeddings").select(F.col("label").alias("qid")).distinct().select("qid", F.lit(6).alias("k"), F.lit(2).alias("max_per_law"), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(q).alias("quota")) for n, w, q in rows]).alias("legs"))


def _fuse_sql(guaranteed: bool) -> str:
    weights = "CASE leg WHEN 'law_scoped' THEN 1.3 WHEN 'hybrid' THEN 0.9 ELSE 1.0 END"
    quota = "CASE c.leg WHEN 'law_scoped' THEN 4 ELSE 2 END"
    ok = f"len(r.ks) < 6 AND NOT list_contains(r.ks, c.key) AND len(list_filter(r.ls, lambda x: x = c.leg)) < {quota} AND (c.law = 0 OR len(list_filter(r.ws, lambda x: x = c.law)) < 2)"
    base = f"""e AS (SELECT vec_id, label AS qid, ['hybrid', 'law_scoped', 'title_like'][CAST(vec_id % 3 AS INT) + 1] AS leg FROM embeddings), h AS (SELECT *, row_number() OVER (PARTITION BY qid, leg ORDER BY (vec_id * 7919) % 1009, vec_id) - 1 AS rank FROM e),
 c0 AS (SELECT qid, leg, rank, vec_id, vec_id % 4 AS law, (vec_id % 4) || ':' || (vec_id % 6) AS key, {weights} / (61 + rank) AS score FROM h WHERE rank < 15)"""
    if guaranteed:
        cand = "c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ph, slot, -score, leg, rank) AS i FROM (SELECT *, 0 AS ph, CASE law WHEN 3 THEN 0 ELSE 1 END AS slot FROM c0 WHERE leg = 'law_scoped' AND law IN (3, 1) UNION ALL SELECT *, 1, 0 FROM c0))"
        ok = f"({ok}) AND (c.ph = 1 OR NOT list_contains(r.gs, c.slot))"
        gs, more = "CASE WHEN c.ph = 0 AND " + ok + " THEN list_append(r.gs, c.slot) ELSE r.gs END", "CAST([] AS INT[])"
    else:
        cand = "c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY -score, leg, rank) AS i FROM c0)"
        gs, more = "r.gs", "CAST([] AS INT[])"
    return f"""WITH RECURSIVE {base}, {cand}, r(qid, i, ks, ls, ws, cs, gs) AS (SELECT DISTINCT qid, 0::BIGINT, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), {more} FROM c UNION ALL
  SELECT c.qid, c.i, CASE WHEN {ok} THEN list_append(r.ks, c.key) ELSE r.ks END, CASE WHEN {ok} THEN list_append(r.ls, c.leg) ELSE r.ls END, CASE WHEN {ok} THEN list_append(r.ws, c.law) ELSE r.ws END, CASE WHEN {ok} THEN list_append(r.cs, c.vec_id) ELSE r.cs END, {gs} FROM r JOIN c ON c.qid = r.qid AND c.i = r.i + 1),
 f AS (SELECT qid, max_by(cs, i) AS cs, max_by(ls, i) AS ls FROM r GROUP BY 1) SELECT qid, CAST(unnest(cs) AS VARCHAR) AS chunk_id, unnest(ls) AS leg, generate_subscripts(cs, 1) - 1 AS pos FROM f"""


@query(_fuse_sql(False))
def fuse_quota_diversity(spark, d):
    return fusion.fuse(_hits(spark, d), _plans(spark, d)).select("qid", "chunk_id", "leg", F.col("pos").cast("long").alias("pos"))


@query(_fuse_sql(True))
def fuse_multi_guarantee(spark, d):
    g = _plans(spark, d).select("qid", F.posexplode(F.array(F.lit(3), F.lit(1))).alias("slot", "law_book_id"))
    return fusion.fuse(_hits(spark, d), _plans(spark, d), g.withColumn("law_book_id", F.col("law_book_id").cast("long"))).select("qid", "chunk_id", "leg", F.col("pos").cast("long").alias("pos"))


@query("""WITH f AS (SELECT label AS qid, vec_id AS chunk_id, vec_id % 5 AS law, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings QUALIFY pos < 6), l AS (SELECT * FROM (VALUES (0, 7, 0), (1, 8, 0), (1, 7, 1), (2, 9, 0)) t(law, amender, o)),
 n AS (SELECT f.*, unnest([1, 2]) AS number, generate_subscripts([1, 2], 1) - 1 AS n_pos FROM f), r AS (SELECT e.label AS qid, 7 + e.vec_id % 3 AS amender, 1 + e.vec_id % 2 AS number, e.vec_id AS chunk_id, (e.vec_id * 31) % 97 AS dist FROM embeddings e),
 c AS (SELECT n.qid, n.pos, l.o, n.n_pos, l.amender, r.chunk_id, row_number() OVER (PARTITION BY n.qid, l.amender, n.number, n.pos ORDER BY r.dist, r.chunk_id) AS k FROM n JOIN l USING (law) JOIN r ON r.qid = n.qid AND r.amender = l.amender AND r.number = n.number),
 t AS (SELECT qid, chunk_id, amender, min((pos, o, n_pos)) AS s FROM c WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.qid = c.qid AND f.chunk_id = c.chunk_id) GROUP BY 1, 2, 3)
 SELECT qid, chunk_id, amender AS law_book_id, row_number() OVER (PARTITION BY qid ORDER BY s, chunk_id) AS extra FROM t QUALIFY extra <= 2""")
def amender_pull(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("label").alias("qid"))
    f = e.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("vec_id")) - 1).where("pos < 6")
    f = f.select("qid", "pos", F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 5).alias("law_book_id"), F.array(F.lit(2), F.lit(1)).alias("numbers"))
    lk = spark.createDataFrame([(0, 7, 0), (1, 8, 0), (1, 7, 1), (2, 9, 0)], "law_book_id bigint, amender bigint, order int")
    r = e.select("qid", (7 + F.col("vec_id") % 3).alias("law_book_id"), (1 + F.col("vec_id") % 2).cast("int").alias("number"), F.col("vec_id").alias("chunk_id"), ((F.col("vec_id") * 31) % 97).alias("distance"))
    return fusion.amender_pull(f, lk, r).withColumn("extra", F.col("extra").cast("long"))


@query("""SELECT conv_id, md5(string_agg('[' || n || '] ' || CASE WHEN role IS NOT DISTINCT FROM prev AND n > 1 THEN 'same source' ELSE coalesce(role, '') END || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1""")
def context_builder(spark, d):
    return fusion.context(read(spark, d, "conversations"), "conv_id", ["turn"], "role", "text").select("conv_id", F.md5("context").alias("context"))


# --- gates, evaluation, metering ---
@query("""WITH h AS (SELECT conv_id, list(DISTINCT CAST(length(text) % 10 AS VARCHAR)) AS have FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, turn, list_distinct(['1', CAST(length(text) % 10 AS VARCHAR), '7']) AS cited FROM conversations WHERE role <> 'user')
 SELECT conv_id, turn, array_to_string(list_sort(list_filter(cited, lambda x: NOT list_contains(coalesce(have, CAST([] AS VARCHAR[])), x))), ',') AS fabricated FROM a LEFT JOIN h USING (conv_id)""")
def citation_gate(spark, d):
    c = read(spark, d, "conversations")
    n = (F.length("text") % 10).cast("string")
    answers = c.where("role <> 'user'").select("conv_id", "turn", F.array(F.lit("1"), n, F.lit("7")).alias("cited"))
    rows = c.where("role = 'user'").select("conv_id", F.array(n).alias("numbers"))
    return reports.citation_gate(answers, rows, "conv_id", "cited", "numbers").select("conv_id", "turn", F.array_join(F.array_sort("fabricated"), ",").alias("fabricated"))


@query("SELECT count(*) AS n, count(DISTINCT lower(trim(text))) AS keys FROM conversations")
def cache_key_join(spark, d):
    """Equal questions meet the answer that was stored under their key."""
    c = read(spark, d, "conversations").withColumn("key", reports.cache_key(F.lower(F.trim("text")), F.array(F.lit("a")), "m", False, "en"))
    cache = upsert.last_wins(c.select("key", F.struct("conv_id", "turn").alias("o"), F.md5("text").alias("answer")), ["key"], "o")
    return c.join(cache.select("key", "answer"), "key").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query(f"WITH t AS ({_topk_sql('')}), g AS (SELECT t.qid, bool_or(q.label = v.label) AS ok FROM t JOIN embeddings q ON q.vec_id = qid JOIN embeddings v ON v.vec_id = chunk_id WHERE rank <= 6 GROUP BY 1) SELECT count(*) AS cases, count(*) FILTER (ok) AS passed, round(count(*) FILTER (ok) / count(*), 6) AS recall FROM g")
def recall_at_k(spark, d):
    e = read(spark, d, "embeddings")
    cases = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("gold"))
    hits = _vectors(spark, d).join(e.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")
    return reports.recall_at_k(hits, cases, 6, F.col("label") == F.col("gold"))


_PREC = f"WITH t AS ({_topk_sql('')}), h AS (SELECT t.qid, rank, v.label AS law, q.label AS gold FROM t JOIN embeddings q ON q.vec_id = qid JOIN embeddings v ON v.vec_id = chunk_id)"


def _precision(spark, d):
    e = read(spark, d, "embeddings")
    cases = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.array("label").alias("must"), F.array().cast("array<string>").alias("articles"), F.lit(3).alias("law_at"), F.lit(6).alias("article_at"), F.array(((F.col("label") + 1) % 10).cast("int")).alias("forbid"))
    hits = _vectors(spark, d).join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("law_book_id")), "chunk_id").withColumn("numbers", F.array().cast("array<string>"))
    return reports.precision_cases(hits, cases)


@query(_PREC + " SELECT qid, min(rank) FILTER (law = gold AND rank <= 3) AS first_rank FROM h GROUP BY 1")
def precision_first_rank(spark, d):
    return _precision(spark, d).select("qid", "first_rank")


@query(_PREC + " SELECT qid, coalesce(min(rank) FILTER (law = (gold + 1) % 10) < coalesce(min(rank) FILTER (law = gold AND rank <= 3), 1000), false) AS outranked FROM h GROUP BY 1")
def forbid_outrank(spark, d):
    return _precision(spark, d).select("qid", "outranked")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 r(user_id, i, event_id, seen, ok) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, CAST([] AS DOUBLE[]), true FROM (SELECT DISTINCT user_id FROM e) UNION ALL
  SELECT e.user_id, e.i, e.event_id, CASE WHEN len(list_filter(r.seen, lambda x: x > e.t - 86400)) < 2 THEN list_append(list_filter(r.seen, lambda x: x > e.t - 86400), e.t) ELSE list_filter(r.seen, lambda x: x > e.t - 86400) END, len(list_filter(r.seen, lambda x: x > e.t - 86400)) < 2 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
 SELECT user_id, event_id, ok FROM r WHERE i > 0""")
def rate_limit_accept(spark, d):
    return jobs.accepted(read(spark, d, "events"), "user_id", "ts", 2, 86400.0, "event_id").select("user_id", "event_id", "ok")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events")
def requests_in_window(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return read(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    """An extension: the reference has no event-time windows."""
    return jobs.windowed_counts(read(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 2))


@query()
def article_index_roles(spark, d):
    """Header spans and mentions of documents, with capitalised first words as headers and mentions."""
    p = replace(GENERIC, header=r"^([0-9]{1,4})()()$", reference=r"(?:\+1 \()([0-9]{1,4})(?:\)-([0-9]{1,4}))?")
    return articles.article_index(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", p).groupBy("role", "parse_confidence").agg(F.count("*").alias("n"))


@query()
def ask_end_to_end(spark, d):
    """Flagship: in-force documents are chunked and indexed; each benchmark question is routed, planned, retrieved over six legs and fused."""
    docs = inforce_filter(spark, d).select("doc_id").join(read(spark, d, "documents").select("doc_id", "text", F.col("source").alias("title")), "doc_id")
    store = stored(api.build_store(docs, "doc_id", "text"), "store")  # each leg reads it
    questions = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"))
    return api.retrieve(questions, store, "doc_id")
