"""Cards that a model wrote: payloads to rows, checks, and how far aliases mislead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, strip
from ..profile import GENERIC, Profile

#: How many entries of each list are kept, and what separates entries written as one string.
MOST = {"subject_tags": 12, "colloquial_aliases": 16, "likely_questions": 10}
SEPARATORS = "[,،;؛|/]"


def unfenced(raw: Column) -> Column:
    """The payload without a Markdown fence around it."""
    t = strip(raw)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(t.startswith("```"), inner).otherwise(t)


def entries(card: Column, name: str) -> Column:
    """A list of trimmed, non-empty strings: an array's distinct entries, or the parts of a string; else none."""
    path, most = f"$.{name}", MOST[name]
    kind = F.schema_of_variant(F.try_variant_get(card, path, "variant"))
    none = F.array().cast("array<string>")
    clean = lambda xs: F.filter(F.transform(xs, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    many = F.array_distinct(clean(F.try_variant_get(card, path, "array<string>")))
    one = clean(F.split(F.try_variant_get(card, path, "string"), SEPARATORS))
    return F.slice(F.coalesce(F.when(kind.startswith("ARRAY"), many).when(kind == "STRING", one), none), 1, most)


def parse_cards(payloads: DataFrame, key: str = "law_book_id", title: str = "title", raw: str = "raw") -> DataFrame:
    """key, title, the card's fields and ``error``: the first check that fails, null for a usable card. No row is lost.

    The title of the row goes before the payload's own.
    """
    card = payloads.withColumn("_c", F.try_parse_json(unfenced(F.col(raw))))
    text = lambda name: F.coalesce(strip(F.try_variant_get("_c", f"$.{name}", "string")), F.lit(""))
    own = F.coalesce(F.nullif(F.col(title), F.lit("")), text("title"))
    out = card.select(F.col(key), strip(own).alias("title"), text("scope_summary").alias("scope_summary"), *[entries(F.col("_c"), n).alias(n) for n in MOST], F.nullif(text("title_en"), F.lit("")).alias("title_en"), (F.col("_c").isNotNull() & F.schema_of_variant("_c").startswith("OBJECT")).alias("_ok"))
    error = (
        F.when(~F.coalesce("_ok", F.lit(False)), "no_object")
        .when(F.col("scope_summary") == "", "scope_summary")
        .when(F.size("subject_tags") == 0, "subject_tags")
        .when(F.size("likely_questions") == 0, "likely_questions")
        .when(~F.coalesce(F.col(key) > 0, F.lit(False)), "law_book_id")
    )
    return out.withColumn("error", error).drop("_ok")


def alias_variants(alias: Column, endings: tuple[str, ...]) -> Column:
    """The alias, then what is left as each ending (a pattern) is taken off what the one before left. Empty ones are left out."""
    cur, out = strip(F.coalesce(alias, F.lit(""))), []
    out.append(cur)
    for e in endings:
        cut = F.regexp_replace(F.regexp_replace(cur, e, ""), r"^[\s\-–—]+|[\s\-–—]+$", "")
        cur = F.when(cut != "", cut).otherwise(cur)
        out.append(cur)
    return F.filter(F.array_distinct(F.array(*out)), lambda x: x != "")


def alias_risk(cards: DataFrame, markers: tuple[str, ...], bases: tuple[str, ...], p: Profile = GENERIC, key: str = "law_book_id") -> DataFrame:
    """One row: cards, titles with a marker, aliases that lose the marker, and those of them that claim a base title.

    An alias claims a base if one contains the other. Only partial sums are shuffled.
    """
    fold = lambda xs: [normalize(F.lit(x), p) for x in xs]
    held = F.filter(F.array(*fold(markers)), lambda m: F.col("_t").contains(m))
    c = cards.select(key, normalize("title", p).alias("_t"), "colloquial_aliases").withColumn("_m", held)
    aliases = F.filter(F.transform(F.coalesce("colloquial_aliases", F.array().cast("array<string>")), lambda a: normalize(a, p)), lambda a: (a != "") & ~F.exists("_m", lambda m: a.contains(m)))
    lost = c.withColumn("_lost", F.when(F.size("_m") > 0, aliases).otherwise(F.array().cast("array<string>")))
    claims = F.filter("_lost", lambda a: F.exists(F.array(*fold(bases)), lambda b: a.contains(b) | b.contains(a)))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return lost.agg(F.count("*").alias("cards"), F.count_if(F.size("_m") > 0).alias("marked"), n(F.size("_lost")).alias("stripped"), n(F.size(claims)).alias("claims_base"))
