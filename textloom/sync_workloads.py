"""Registered queries of the stores and jobs: bucketed routes, generations, append logs by line, cards and answers of scripted models."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from . import model_jobs
from .functions.text import reference_numbers
from .operators import reports
from .providers import Reply
from .shared import scratch
from .sources import generations, records
from .workloads import query, read


@query("""SELECT o_orderkey AS law, o_orderpriority AS route_text, CAST(length(o_orderpriority) AS BIGINT) AS size FROM orders WHERE o_orderkey % 7 <> 0""")
def routes_append_stale(spark, d):
    """A table of routes in 32 buckets, brought up to date: new, stale and gone rows are written, and the table equals one that is written anew."""
    o = read(spark, d, "orders")
    path = scratch(spark, "routes")
    make = lambda df: df.withColumn("size", F.length("route_text").cast("bigint"))
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("law"), F.when(F.col("o_orderkey") % 1000 == 1, "old").otherwise(F.col("o_orderpriority")).alias("route_text"))
    generations.append_routes(old, path, "law", "route_text", 32, make)
    generations.append_routes(o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("law"), F.col("o_orderpriority").alias("route_text")), path, "law", "route_text", 32, make, remove_absent=True)
    return spark.read.parquet(path).select("law", "route_text", "size")


@query("SELECT lang, count(*) AS n, sum(length(text)) AS chars FROM documents WHERE coalesce(text, '') <> '' GROUP BY 1")
def refresh_generations(spark, d):
    """Two generations of records and their summary: the first over half of the documents, the second brings the others."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "text").where("coalesce(text, '') <> ''")
    root = scratch(spark, "generations")
    summary = ("summary", lambda get: get("records").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))
    generations.refresh(spark, root, [("records", lambda get: docs.where("doc_id % 2 = 0")), summary])
    generations.refresh(spark, root, [("records", lambda get: get("records").unionByName(records.new_rows(docs, get("records"), "doc_id"))), summary])
    return generations.table(spark, root, "summary")


@query("SELECT o_custkey AS law_book_id, max_by(o_orderpriority, o_orderkey) AS title FROM orders GROUP BY 1")
def log_last_wins(spark, d):
    """Orders as an append log of JSON lines, in order of their keys over several files: the last line of each customer."""
    path = scratch(spark, "log")
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("law_book_id"), F.col("o_orderpriority").alias("title"))
    o.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").drop("o_orderkey").write.json(path)
    return records.read_last_wins(spark, path, "law_book_id BIGINT, title STRING", ["law_book_id"])


class Scripted:
    """A model without a network: what it says depends on the prompt alone."""

    def __init__(self, name: str, say):
        self.name, self.say = name, say

    def answer(self, prompt: str) -> Reply:
        return self.say(prompt)


def _card(prompt: str, every: int) -> Reply:
    n = int(prompt.split()[0])
    if n % every == 0:
        return Reply("no endpoints found", 404) if n % 2 else Reply('{"scope_summary": ""}', 200, 0.25)
    return Reply(json.dumps({"scope_summary": f"scope {n}", "subject_tags": ["a"], "likely_questions": ["q"]}), 200, 0.25)


@query("""SELECT doc_id AS law_book_id, CASE WHEN doc_id % 5 = 0 THEN 'second' ELSE 'first' END AS model, 'scope ' || doc_id AS scope_summary, coalesce(lang, '') AS title FROM documents WHERE doc_id > 0 AND NOT (doc_id % 5 = 0 AND doc_id % 3 = 0)""")
def cards_from_ledger(spark, d):
    """Cards of all documents by two scripted models: what the first can't do the second does, and what neither can is left out."""
    chain = [Scripted("first", lambda p: _card(p, 5)), Scripted("second", lambda p: _card(p, 3))]
    laws = read(spark, d, "documents").select(F.col("doc_id").alias("law_book_id"), F.coalesce("lang", F.lit("")).alias("title"))
    path = scratch(spark, "ledger")
    model_jobs.generate_cards(laws, F.concat_ws(" ", F.col("law_book_id").cast("string"), "title"), chain, path, wave=1_000_000)
    return model_jobs.cards(model_jobs.ledger(spark, path)).select("law_book_id", "model", "scope_summary", "title")


def _say(prompt: str) -> Reply:
    words = prompt.split()
    return Reply("", 400) if len(words) % 10 == 9 else Reply(f"section {len(words) % 4}. section 2.", 200, finish="stop")


@query("""WITH u AS (SELECT conv_id, turn, text, length(trim(text)) AS z FROM conversations WHERE role = 'user'), w AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D\\x1C-\\x1F\\x{85}\\x{A0}]+'), lambda x: x <> '')) AS n FROM u WHERE trim(coalesce(text, '')) <> '')
 SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'cached' ELSE 'generated' END AS mode, CASE WHEN conv_id % 2 = 0 THEN 'kept' WHEN n % 10 = 9 THEN '[http_400]' ELSE 'section ' || (n % 4) || '. section 2.' END AS answer,
  CASE WHEN conv_id % 2 = 1 AND n % 10 <> 9 THEN CASE WHEN n % 4 = 2 THEN '' ELSE CAST(n % 4 AS VARCHAR) END ELSE '' END AS fabricated, CASE WHEN conv_id % 2 = 1 AND n % 10 <> 9 THEN concat_ws(chr(10), CASE WHEN n % 4 <> 2 THEN CAST(n % 4 AS VARCHAR) END, 'section 2 differs') END AS warning FROM w""".replace("\\\\", "\\"))
def answers_checked(spark, d):
    """Users' turns as questions, half of them in the cache: new answers go through the citation gate and the check, and no error is kept."""
    u = read(spark, d, "conversations").where("role = 'user' and trim(coalesce(text, '')) <> ''")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    asked = u.select(key.alias("qid"), F.lit("").alias("question"), F.col("text").alias("context"), reports.cache_key(key, F.array(key), "m", False, "en").alias("cache_key"), "conv_id", "turn")
    path, work = scratch(spark, "answers"), scratch(spark, "work")
    model_jobs.put_answers(asked.where("conv_id % 2 = 0").select("cache_key", "question", F.lit("kept").alias("answer"), F.lit("m").alias("model")), path)
    rows = asked.select("qid", F.array(F.lit("2")).alias("numbers"))
    check = Scripted("check", lambda p: Reply("section 2 differs", 200))
    got = model_jobs.answer(asked.select("qid", "question", "context", "cache_key"), path, work, [Scripted("m", _say)], check, numbers=lambda c: reference_numbers(c), rows=rows)
    return got.join(asked.select("qid", "conv_id", "turn"), "qid").select("conv_id", "turn", "mode", "answer", F.array_join("fabricated", ",").alias("fabricated"), "warning")
