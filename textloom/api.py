"""From questions to fused passages and contexts: one plan for a whole batch of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import legs, routing
from .operators.chunking import chunk_records
from .operators.fusion import context, fuse, slot_key
from .operators.search import bm25_texts, hybrid, vector_top_k
from .plans.planner import features, plan
from .profile import GENERIC, Profile
from .providers import hashed_vector
from .shared import stored


def build_store(records: DataFrame, key: str, text: str, title: str | None = None, status: str | None = None, p: Profile = GENERIC, dim: int = 64) -> DataFrame:
    """Chunks with vectors. Write it partitioned by the status column: the in-force filter then prunes whole folders."""
    chunks = chunk_records(records, key, title, text, p)
    return chunks.withColumn("vector", hashed_vector(F.col("chunk_text"), dim))


def retrieve(
    questions: DataFrame, store: DataFrame, law: str, k: int = 6, depth: int = 20, in_force=None, p: Profile = GENERIC, dim: int = 64,
    title: str = "title", year: str | None = None, seeds: DataFrame | None = None, lexicon: DataFrame | None = None, text_index: DataFrame | None = None,
    articles: DataFrame | None = None,
) -> DataFrame:
    """(qid, pos, chunk_id, law_book_id, leg, score). in_force: a predicate of the store, applied before any ranking.

    Routing evidence (phrases, seeds, cards, citations, aliases, nearest routes) decides a question's shape, scope and legs; each of
    the six legs runs over the questions whose plan has it and is cut at ``depth``. A question whose only legs find
    nothing gets the hybrid leg under their name, so that every plan has rows. text_index: ``gram_index`` of the store's chunks as
    stored (by law); without it the in-law leg indexes the first laws' chunks. articles: ``legs.article_rows``; with them the asked
    article is looked up in the article index first, and such rows (chunk_id ``art:...``) are among the results.
    """
    some = store.where(in_force) if in_force is not None else store
    text = lambda c: F.col(c).cast("string") if c and c in store.columns else F.lit(None).cast("string")
    rows = some.select("chunk_id", F.col(law).cast("bigint").alias("law"), text(title).alias("title"), text(year).alias("year"), "article_arr", "chunk_text", "vector")
    asked = questions.select("qid", "question", hashed_vector(F.col("question"), dim).alias("qvec"))
    # each kind of evidence reads it; stored with its vectors, so that no task holds a worker that makes them beside one that ranks them
    registry = stored(routing.registry_of(rows, "law", p).withColumn("vector", hashed_vector(F.col("title"), dim)), "registry")
    routes = registry.select("law_book_id", "vector")
    known = routing.evidence(asked, registry, routes, seeds, lexicon, p)
    planned = plan(features(known, "question", p), k).withColumn("scope", F.when(F.size("scope_doc_ids") > 0, F.col("scope_doc_ids")).otherwise(F.col("route_ids")))
    plans = stored(planned, "plans")  # a row a question; each leg reads it
    wants = lambda leg: plans.where(F.exists("legs", lambda x: x["name"] == leg))
    near = vector_top_k(asked.select("qid", "qvec"), rows, depth)
    mixed = hybrid(bm25_texts(asked, rows, depth, text="chunk_text"), near, depth)
    found = [
        legs.article_leg(wants("article_exact"), rows, "law", depth) if articles is None else legs.article_index_leg(wants("article_exact"), articles, "law", depth, p, rows),
        legs.law_leg(wants("law_scoped"), rows, "law", depth, p=p, index=text_index),
        legs.title_leg(wants("title_like"), rows, "law", depth, p),
        legs.defining_leg(wants("defining_articles"), rows, "law", depth),
        legs.scoped_leg(wants("card_route").select("qid", "qvec", F.array_distinct(F.concat("card_ids", "phrase_ids", "seed_ids")).alias("scope")), rows, "law", depth, "card_route", each=1),
    ]
    hits = reduce(DataFrame.unionByName, found).withColumn("spare", F.lit(False))
    # the hybrid ranking is a leg of its own, and a spare for the first leg of a plan whose legs find nothing
    names = plans.select("qid", F.transform("legs", lambda x: x["name"]).alias("names"))
    use = F.when(F.array_contains("names", "hybrid"), F.array(F.struct(F.lit("hybrid").alias("leg"), F.lit(False).alias("spare")))).otherwise(F.array(F.struct(F.get("names", F.lit(0)).alias("leg"), F.lit(True).alias("spare"))))
    general = mixed.join(names, "qid").select("qid", "chunk_id", (F.col("rank") - 1).cast("int").alias("rank"), F.explode(F.array_distinct(use)).alias("u"))
    hits = hits.unionByName(general.select("qid", "u.leg", "rank", "chunk_id", "u.spare"))
    hits = stored(hits, "hits")  # a union of legs says that it is dealt by question; what follows must not build on that
    hits = hits.withColumn("bare", F.min("spare").over(Window.partitionBy("qid"))).where("not spare or bare")
    known_rows = rows.select("chunk_id", "law", "article_arr")
    known_rows = known_rows if articles is None else known_rows.unionByName(articles.select("chunk_id", "law", "article_arr"))
    full = hits.join(known_rows.select("chunk_id", F.col("law").alias("law_book_id"), "article_arr"), "chunk_id")
    full = full.withColumn("key", slot_key(F.col("law_book_id"), F.lit(None).cast("string"), F.col("article_arr"), F.col("chunk_id")))
    # comparisons of several laws give each law of the scope a place first
    sure = plans.where("shape = 'MULTI_INSTRUMENT'").select("qid", F.posexplode("scope").alias("slot", "law_book_id"))
    return fuse(full, plans.select("qid", "k", "max_per_law", "legs"), sure)


def contexts(fused: DataFrame, store: DataFrame, title: str) -> DataFrame:
    """One context per question."""
    full = fused.join(store.select("chunk_id", F.col(title).cast("string").alias("title"), "chunk_text"), "chunk_id")
    return context(full, "qid", ["pos"], "title", "chunk_text")
