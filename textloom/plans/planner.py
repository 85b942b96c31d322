"""The query planner: a question's features decide its shape, quotas and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_asked, contains_any, content_tokens, cues, first_citation, instrument_count, is_exact_lookup, is_overview, normalize
from ..profile import GENERIC, Profile

#: Fixed values: (leg, weight, quota at k = 6) and the most rows of one law, for each shape.
SHAPES: dict[str, tuple[list[tuple[str, float, int]], int]] = {
    "PROCEDURAL_DRAFT": ([("hybrid", 1.0, 3), ("law_scoped", 1.0, 2), ("article_exact", 1.0, 1)], 3),
    "EXACT_ARTICLE": ([("article_exact", 1.5, 3)], 99),
    "ARTICLE_ANALYTICAL": ([("article_exact", 1.4, 2), ("hybrid", 1.0, 3), ("law_scoped", 0.9, 1)], 3),
    "CITATION_KEY": ([("law_scoped", 1.4, 5), ("article_exact", 1.0, 1)], 4),
    "MULTI_INSTRUMENT": ([("law_scoped", 1.2, 4), ("hybrid", 0.9, 2)], 2),
    "DEFINITIONAL": ([("defining_articles", 1.5, 3), ("law_scoped", 1.1, 2), ("hybrid", 0.8, 1)], 4),
    "NAMED_INSTRUMENT": ([("law_scoped", 1.3, 4), ("hybrid", 0.9, 2), ("title_like", 1.0, 2)], 4),
    "OUT_OF_SCOPE": ([("hybrid", 1.0, 3)], 2),
    "TOPICAL": ([("hybrid", 1.2, 4), ("card_route", 0.9, 1), ("title_like", 0.8, 1), ("law_scoped", 0.7, 1)], 2),
}


def features(questions: DataFrame, text: str = "question", p: Profile = GENERIC) -> DataFrame:
    """The question's own features. Signals of routing (id lists, distances) are columns that callers join in."""
    q = F.col(text)
    norm = normalize(q, p)
    return questions.withColumns(
        {
            "article_label": article_asked(q, p),
            "exact_lookup": is_exact_lookup(q, p),
            "citation": first_citation(q, p),
            "instruments": instrument_count(q, p),
            "comparative": contains_any(norm, cues(p.comparative, p)),
            "draft": contains_any(norm, cues(p.draft_cues, p)),
            "overview": is_overview(q, p),
            "n_tokens": F.size(content_tokens(q, p)),
        }
    )


def margin(first: Column, second: Column) -> Column:
    """Of the two nearest routes: none 0; one 0.12 if near (0.28), else 0.02; else the difference."""
    one = F.when(first <= 0.28, 0.12).otherwise(0.02)
    return F.when(first.isNull(), 0.0).when(second.isNull(), one).otherwise(F.greatest(second - first, F.lit(0.0)))


def _size(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) if name in df.columns else F.lit(0)


def _ids(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<bigint>")) if name in df.columns else F.array().cast("array<bigint>")


def plan(df: DataFrame, k: int | Column = 6) -> DataFrame:
    """Adds shape, confidence, scope_doc_ids, legs, max_per_law and k to rows of ``features``.

    Optional signal columns: phrase_ids, seed_ids, card_ids, citation_ids (arrays), alias_len (int), d1, d2 (distances of
    the two nearest routes). The first condition that holds names the shape.
    """
    k = F.lit(k) if isinstance(k, int) else k
    null = F.lit(None).cast("double")
    d1, d2 = (F.col(c) if c in df.columns else null for c in ("d1", "d2"))
    alias = F.coalesce(F.col("alias_len"), F.lit(0)) if "alias_len" in df.columns else F.lit(0)
    phrase, seed, card, cited = (_size(df, c) > 0 for c in ("phrase_ids", "seed_ids", "card_ids", "citation_ids"))
    named = phrase | seed | card
    gap = margin(d1, d2)
    has_article, has_citation = F.col("article_label").isNotNull(), F.col("citation").isNotNull()
    shape = (
        F.when(F.col("draft") & ~has_article, "PROCEDURAL_DRAFT")
        .when(has_article & F.col("exact_lookup"), "EXACT_ARTICLE")
        .when(has_article, "ARTICLE_ANALYTICAL")
        .when(has_citation & (cited | ~named), "CITATION_KEY")
        .when((F.col("instruments") >= 2) | F.col("comparative"), "MULTI_INSTRUMENT")
        .when(F.col("overview") & named, "DEFINITIONAL")
        .when(named | (alias >= 10) | F.coalesce((gap >= 0.08) & (d1 <= 0.40), F.lit(False)), "NAMED_INSTRUMENT")
        .when(F.col("n_tokens") == 0, "OUT_OF_SCOPE")
        .otherwise("TOPICAL")
    )
    out = df.withColumn("shape", shape).withColumn("k", k.cast("int"))
    quota = lambda n: F.when(F.col("k") == 6, n).otherwise(F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("k") / 6.0).cast("int"))).cast("int")
    legs, most = F.lit(None), F.lit(None).cast("int")
    for name, (rows, cap) in SHAPES.items():
        made = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), quota(q).alias("quota")) for n, w, q in rows])
        legs = F.when(F.col("shape") == name, made).otherwise(legs)
        most = F.when(F.col("shape") == name, F.lit(cap)).otherwise(most)
    num = lambda b, v: F.when(b, v).otherwise(0.0)
    sure = 0.15 + num(has_article & F.col("exact_lookup"), 0.35) + num(has_citation, 0.25) + num(phrase, 0.20) + num(card, 0.15) + F.least(F.lit(0.2), alias / 50.0) + F.least(F.lit(0.2), 2 * gap)
    scoped = F.col("shape").isin("EXACT_ARTICLE", "ARTICLE_ANALYTICAL", "MULTI_INSTRUMENT", "DEFINITIONAL", "NAMED_INSTRUMENT")
    scope = F.when(F.col("shape") == "CITATION_KEY", F.array_distinct(_ids(df, "citation_ids"))).when(scoped, F.array_distinct(F.concat(_ids(df, "phrase_ids"), _ids(df, "seed_ids")))).otherwise(F.array().cast("array<bigint>"))
    return out.withColumns({"legs": legs, "max_per_law": most, "confidence": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)), 6), "scope_doc_ids": scope})
