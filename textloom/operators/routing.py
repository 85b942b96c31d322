"""Evidence that names laws for a question: phrases, seeds, cards, citations, the longest alias, the two nearest routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import citations, first_citation, instrument_phrases, normalize, title_aliases
from ..profile import GENERIC, Profile
from .registry import lexicon_hits, phrase_hits, seed_hits
from .search import holding, vector_top_k


def registry_of(rows: DataFrame, law: str, p: Profile = GENERIC) -> DataFrame:
    """law_book_id, title, year and aliases of the laws of chunk rows."""
    one = rows.groupBy(F.col(law).alias("law_book_id")).agg(F.min("title").alias("title"), F.min(F.col("year").cast("string")).alias("year"))
    return one.where("title is not null").withColumn("aliases", title_aliases("title", p))


def longest_alias(questions: DataFrame, registry: DataFrame, p: Profile = GENERIC, seeds: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """(qid, alias_len): of the longest alias of registry, seeds (five characters or more) or cards that stands in the question; questions without one are left out."""
    hays = questions.select("qid", normalize("question", p).alias("_q"))
    needles = registry.select(F.explode("aliases").alias("_a")).select(normalize("_a", p).alias("_n")).where(F.length("_n") >= 4)
    for more, name in ((seeds, "alias"), (lexicon, "alias_norm")):
        if more is not None:
            needles = needles.unionByName(more.select(normalize(name, p).alias("_n")).where(F.length("_n") >= 5))
    needles = needles.distinct()
    found = holding(hays.select("_q").distinct(), needles, "_q", "_n").groupBy("_q").agg(F.max(F.length("_n")).cast("int").alias("alias_len"))
    return hays.join(found, "_q").select("qid", "alias_len").groupBy("qid").agg(F.max("alias_len").alias("alias_len"))


def cited_laws(questions: DataFrame, registry: DataFrame, p: Profile = GENERIC) -> DataFrame:
    """(qid, law_book_id) of the laws whose title has the number and year that a question cites; whole numbers are compared."""
    own = registry.select("law_book_id", F.explode(citations("title", p)).alias("c")).select("law_book_id", "c.num", "c.year").distinct()
    asked = questions.select("qid", first_citation("question", p).alias("c")).where("c is not null").select("qid", "c.num", "c.year")
    return asked.join(own, ["num", "year"]).select("qid", "law_book_id")


def evidence(questions: DataFrame, registry: DataFrame, routes: DataFrame | None = None, seeds: DataFrame | None = None, lexicon: DataFrame | None = None, p: Profile = GENERIC, most: int = 12, merged: int = 8, near: float = 0.28) -> DataFrame:
    """questions (qid, question, qvec) with phrase_ids, seed_ids, card_ids, near_ids, citation_ids (best first), route_ids, alias_len, d1, d2 and sure.

    routes: law_book_id, vector. At most ``most`` ids of a kind are kept for a question, as each list is a scope. route_ids are the
    first ``merged`` of phrases, seeds, cards and nearest routes, each law once, in that order. ``sure``: the question names an
    instrument, has a long alias or a near route (distance of at most ``near``), so that routed laws go before the general ranking.
    """
    out = questions

    def add(hits: DataFrame | None, name: str) -> None:
        nonlocal out
        if hits is None:
            out = out.withColumn(name, F.array().cast("array<bigint>"))
            return
        place = F.struct((-F.col("score")).alias("s") if "score" in hits.columns else F.lit(0.0).alias("s"), F.col("law_book_id").cast("bigint").alias("law"))
        ids = hits.groupBy("qid").agg(F.slice(F.transform(F.array_sort(F.collect_set(place)), lambda x: x["law"]), 1, most).alias(name))
        out = out.join(ids, "qid", "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))

    add(phrase_hits(questions, registry, p), "phrase_ids")
    add(seed_hits(questions, registry, seeds, p) if seeds is not None else None, "seed_ids")
    add(lexicon_hits(questions, lexicon, p) if lexicon is not None else None, "card_ids")
    add(cited_laws(questions, registry, p), "citation_ids")
    out = out.join(longest_alias(questions, registry, p, seeds, lexicon), "qid", "left")
    if routes is not None:
        found = vector_top_k(questions.select("qid", "qvec"), routes, max(2 * merged, 16), key="law_book_id")
        ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("law_book_id").cast("bigint").alias("law")))), lambda x: x["law"])
        two = found.groupBy("qid").agg(F.min(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"), F.min(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"), ids.alias("near_ids"))
        out = out.join(two, "qid", "left")
    else:
        out = out.withColumns({"d1": F.lit(None).cast("double"), "d2": F.lit(None).cast("double"), "near_ids": F.lit(None).cast("array<bigint>")})
    out = out.withColumn("near_ids", F.coalesce("near_ids", F.array().cast("array<bigint>")))
    named = (F.size(instrument_phrases("question", p)) > 0) | (F.size("phrase_ids") > 0)
    return out.withColumns({
        "route_ids": F.slice(F.array_distinct(F.concat("phrase_ids", "seed_ids", "card_ids", "near_ids")), 1, merged),
        "sure": named | F.coalesce(F.col("alias_len") >= 10, F.lit(False)) | F.coalesce(F.col("d1") <= near, F.lit(False)),
    })
