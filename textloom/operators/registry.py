"""Registry of titles and aliases, routing of questions to titles, card lexicon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_score, contains_any, dangerous_alias, instrument_phrases, normalize, phrase_fit, title_aliases, title_penalty
from ..profile import GENERIC, Profile
from ..shared import stored
from .search import holding, near_best, top_k
from .upsert import last_wins


def build_registry(laws: DataFrame, seeds: DataFrame | None = None, p: Profile = GENERIC, key: str = "law_book_id", seq: str = "seq") -> DataFrame:
    """One row per law in force with text, last wins: title, aliases (rules, then seeds whose needle the title holds), route_text.

    seeds: rule_id, alias, needle (a dimension table that the caller gives).
    """
    rows = last_wins(laws.where((F.col("status_label") == p.in_force) & (F.trim(F.coalesce("full_text", F.lit(""))) != "")), [key], seq)
    out = rows.withColumn("aliases", title_aliases("title", p)).withColumn("_t", normalize("title", p))
    if seeds is not None:
        s = seeds.select(normalize("needle", p).alias("_n"), "alias")
        more = out.join(F.broadcast(s), F.col("_t").contains(F.col("_n"))).groupBy(key).agg(F.sort_array(F.collect_set("alias")).alias("_more"))
        out = out.join(more, key, "left").withColumn("aliases", F.array_distinct(F.concat("aliases", F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")
    return out.withColumn("aliases_joined", F.array_join("aliases", " | ")).withColumn("route_text", F.concat_ws(" | ", "title", F.array_join(F.slice("aliases", 1, 8), " | "))).drop("_t")


def with_cards(registry: DataFrame, cards: DataFrame, p: Profile = GENERIC, key: str = "law_book_id") -> DataFrame:
    """Card aliases whose normal form is new are added; route_text takes the first ten."""
    have = F.transform("aliases", lambda a: normalize(a, p))
    both = registry.join(cards.select(key, F.col("colloquial_aliases").alias("_c")), key, "left")
    new = F.filter(F.array_distinct(F.coalesce("_c", F.array().cast("array<string>"))), lambda a: (normalize(a, p) != "") & ~F.array_contains(have, normalize(a, p)))
    out = both.withColumn("aliases", F.concat("aliases", new)).drop("_c")
    return out.withColumn("aliases_joined", F.array_join("aliases", " | ")).withColumn("route_text", F.concat_ws(" | ", "title", F.array_join(F.slice("aliases", 1, 10), " | ")))


def lexicon(cards: DataFrame, p: Profile = GENERIC, least: int = 4, key: str = "law_book_id") -> DataFrame:
    """(alias, alias_norm, key, title, source): cards exploded, suffixes stripped, dangerous aliases left out."""
    all_ = cards.select(key, "title", F.explode("colloquial_aliases").alias("alias"))
    short = all_.withColumn("alias", F.regexp_replace("alias", p.alias_suffix, ""))
    rows = all_.unionByName(short).withColumn("alias_norm", normalize("alias", p))
    ok = (F.length("alias_norm") >= least) & ~dangerous_alias(normalize("title", p), F.col("alias_norm"), p)
    return rows.where(ok).groupBy(key, "alias_norm").agg(F.min_by("alias", F.length("alias")).alias("alias"), F.first("title").alias("title")).withColumn("source", F.lit("card"))


def grams(words, most: int):
    """All runs of 1 to ``most`` words."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.concat(*[F.when(F.size(words) >= n, one(n)).otherwise(F.array().cast("array<string>")) for n in range(1, most + 1)]))


def lexicon_hits(questions: DataFrame, lex: DataFrame, p: Profile = GENERIC, least: int = 8, within: float = 3.0, first: int = 12, qid: str = "qid", text: str = "question", key: str = "law_book_id") -> DataFrame:
    """(qid, key, score, rank). Aliases of whole words meet the question's word runs in an equi-join, so a large lexicon is
    never compared with every question. Runs are as long as the lexicon's longest alias."""
    most_words = lex.agg(F.max(F.size(F.split("alias_norm", " ")))).first()[0] or 1
    q = questions.withColumn("_q", normalize(text, p)).withColumn("alias_norm", F.explode(grams(F.split("_q", " "), most_words)))
    met = q.where(F.length("alias_norm") >= least).join(lex, "alias_norm").withColumn("_s", alias_score(F.col("alias_norm"), normalize("title", p), F.col("_q"), p, least)).where("_s > 0")
    best = met.groupBy(qid, key).agg(F.max("_s").alias("score"))
    return top_k(near_best(best, qid, "score", within), qid, [F.desc("score"), F.desc(key)], first)


def lesser(title_norm: Column, asked: Column, p: Profile = GENERIC) -> Column:
    """14 points off a title of a lesser act that is not asked for."""
    return F.when(contains_any(title_norm, p.lesser_titles) & ~contains_any(asked, p.lesser_asked), 14.0).otherwise(0.0)


def year_points(year: Column) -> Column:
    """The first four digits of the year over 200: newer titles first, mildly."""
    return F.coalesce(F.substring(year.cast("string"), 1, 4).try_cast("int"), F.lit(0)) / 200.0


def seed_boost(title_norm: Column, question_norm: Column, p: Profile = GENERIC) -> Column:
    """Points for a title of the kind that the question speaks of. Words are compared as they are in the profile, unfolded."""
    total = F.lit(0.0)
    for asked, words, begins, points in p.seed_boosts:
        fits = reduce(lambda a, w: a | title_norm.startswith(w), words, F.lit(False)) if begins else contains_any(title_norm, words)
        total = total + F.when(contains_any(question_norm, asked) & fits, points).otherwise(0.0)
    return total


def phrase_kind(title_norm: Column, phrase: Column, p: Profile = GENERIC) -> Column:
    """20 points where phrase and title are of one kind: the first kind at the title's beginning, the others anywhere in it."""
    total = F.lit(0.0)
    for i, kind in enumerate(p.phrase_kinds):
        fits = title_norm.startswith(kind) if i == 0 else title_norm.contains(kind)
        total = total + F.when(phrase.startswith(kind) & fits, 20.0).otherwise(0.0)
    return total


def _likeliest(registry: DataFrame, alike: list[str], year: str, limit: int, key: str) -> DataFrame:
    """Of laws whose columns ``alike`` are equal, the ``limit`` newest, of one year the last by key: of equal titles no other is among a question's first ``limit``."""
    one = registry.groupBy(*alike, key).agg(F.max(year).alias(year))
    w = Window.partitionBy(*alike).orderBy(F.desc(year), F.desc(key))
    return one.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def seed_hits(questions: DataFrame, registry: DataFrame, seeds: DataFrame, p: Profile = GENERIC, least: int = 5, limit: int = 8, qid: str = "qid", text: str = "question", key: str = "law_book_id") -> DataFrame:
    """Rules whose alias stands in the question (``least`` characters), then titles that hold one of the rule's needles.

    A title scores the longest alias that the question has, kind and recency, 12 for an exact needle, how the rule's longest alias fits it,
    less penalties. Aliases meet questions, and needles titles, through their rarest three characters. Distinct questions meet distinct
    titles, of which the newest laws go on; equal questions share what is found.
    """
    s = seeds.select("rule_id", normalize("alias", p).alias("_a"), normalize("needle", p).alias("_n"))
    asked_by = questions.select(qid, normalize(text, p).alias("_q"))
    fired = holding(asked_by.select("_q").distinct(), s.where(F.length("_a") >= least).select("rule_id", "_a").distinct(), "_q", "_a")
    size = fired.groupBy("_q", "rule_id").agg(F.max(F.length("_a")).alias("_size"))
    # equal lengths: the first in order of code points
    longest = s.groupBy("rule_id").agg(F.min(F.struct((-F.length("_a")).alias("n"), "_a")).alias("_l")).select("rule_id", F.col("_l._a").alias("_long"))
    rule = size.join(longest, "rule_id").join(s.select("rule_id", "_n").distinct(), "rule_id")
    r = stored(_likeliest(registry.select(key, normalize("title", p).alias("_t"), year_points(F.col("year")).alias("_y")), ["_t"], "_y", limit, key), "titles")
    met = holding(r.select("_t").distinct(), rule, "_t", "_n")
    exact = F.when(F.col("_n").contains(p.number_word) | (F.length("_n") >= 18), 12.0).otherwise(0.0)
    t, asked = F.col("_t"), F.col("_q")
    score = F.col("_size") + seed_boost(t, asked, p) + F.col("_y") + exact + phrase_fit(t, F.col("_long")) - title_penalty(t, asked, p) - lesser(t, asked, p)
    best = met.join(r, "_t").withColumn("_s", score).where("_s > 0").groupBy("_q", key).agg(F.round(F.max("_s"), 6).alias("score"))
    return _to_each(asked_by, top_k(best, "_q", [F.desc("score"), F.desc(key)], limit), qid, key)


def _to_each(asked_by: DataFrame, found: DataFrame, qid: str, key: str) -> DataFrame:
    """(qid, key, score, rank): what was found for a question's text, for each question that asks it."""
    lists = found.groupBy("_q").agg(F.collect_list(F.struct(key, "score", "rank")).alias("_found"))
    return asked_by.join(lists, "_q").select(qid, F.inline("_found"))


def phrase_hits(questions: DataFrame, registry: DataFrame, p: Profile = GENERIC, limit: int = 8, qid: str = "qid", text: str = "question", key: str = "law_book_id") -> DataFrame:
    """Named phrases against titles (either way) and their first six aliases of at least six characters.

    Distinct questions meet distinct titles with their aliases, of which the newest laws go on; equal questions share what is found.
    """
    named = questions.select(qid, normalize(text, p).alias("_q"), instrument_phrases(text, p).alias("_ps")).where(F.size("_ps") > 0)
    # texts that differ in case or spaces alone may name different phrases
    asked_by = named.select(qid, F.struct("_q", "_ps").alias("_q"))
    q = stored(asked_by.select("_q").distinct().select("_q", F.explode("_q._ps").alias("_p")), "phrases")
    laws = registry.select(key, normalize("title", p).alias("_t"), year_points(F.col("year")).alias("_y"), F.filter(F.transform(F.slice("aliases", 1, 6), lambda a: normalize(a, p)), lambda a: F.length(a) >= 6).alias("_al"))
    r = stored(_likeliest(laws, ["_t", "_al"], "_y", limit, key), "titles")
    kinds = r.select("_t", "_al").distinct()
    hit = F.get(F.filter("_al", lambda a: F.col("_p").contains(a) | a.contains(F.col("_p"))), F.lit(0))
    p1, al = q.select("_p").distinct(), kinds.select("_t", "_al", F.explode("_al").alias("_a"))
    pairs = holding(kinds, p1, "_t", "_p").select("_t", "_al", "_p")
    pairs = pairs.unionByName(holding(al, p1, "_a", "_p").select("_t", "_al", "_p")).unionByName(holding(p1, al, "_p", "_a").select("_t", "_al", "_p")).distinct()
    met = pairs.join(q, "_p")
    size = F.when(F.col("_t").contains(F.col("_p")), F.length("_p")).otherwise(F.least(F.length(hit), F.length("_p")))
    t, phrase = F.col("_t"), F.col("_p")
    score = size + phrase_kind(t, phrase, p) + phrase_fit(t, phrase) - title_penalty(t, F.col("_q._q"), p) - lesser(t, phrase, p)
    # one score for a question and a kind of title, to which a law adds its year
    most = met.withColumn("_s", score).groupBy("_q", "_t", "_al").agg(F.max("_s").alias("_s"))
    best = most.join(r, ["_t", "_al"]).withColumn("_s", F.col("_s") + F.col("_y")).where("_s > 0").groupBy("_q", key).agg(F.round(F.max("_s"), 6).alias("score"))
    return _to_each(asked_by, top_k(best, "_q", [F.desc("score"), F.desc(key)], limit), qid, key)


def card_order(laws: DataFrame, major: dict[str, str], p: Profile = GENERIC, key: str = "law_book_id") -> DataFrame:
    """Candidates for cards: major codes first, then plain titles, then newest (years outside 1900-2030 count as 0), then id."""
    t = normalize("title", p)
    year = F.coalesce(F.col("year").try_cast("int"), F.lit(0))
    y = F.when(year.between(1900, 2030), year).otherwise(0)
    big = F.lit(False)
    for num, yr in major.items():
        big = big | (t.contains(num) & t.contains(yr))
    plain = F.lit(True)
    for m, _ in p.title_penalties:
        plain = plain & ~t.contains(m)
    w = Window.orderBy(F.desc("_b"), F.desc("_p"), F.desc("_y"), key)
    return laws.withColumns({"_b": big, "_p": plain, "_y": y}).withColumn("place", F.row_number().over(w)).drop("_b", "_p", "_y")
