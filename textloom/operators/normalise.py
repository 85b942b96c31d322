"""Catalogue items to records: the fields of ``schemas.LAW``, identity fields and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_digits_wide, contains_any, cues, normalize
from ..functions.web import date_iso, status_of
from ..profile import GENERIC, Profile

#: Fields that are taken over as text, null as empty.
PLAIN = ("category", "classification", "country", "groupsNewsDate", "groupsNewsNum", "groupsNewsPage", "lawDate", "lawDoc", "lawFlag", "lawIndex", "lawNotes", "lawTitle", "tacksNewsDate", "tacksNewsNum", "tacksNewsPage", "tacksPageCount", "tacksPartNum")


def detail_url(base: str, key: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/legislations/showlegislation?lawbookid="), key.cast("bigint").cast("string"))


def pdf_url(base: str, image: Column) -> Column:
    """Null without an image; a whole address stays."""
    return F.when(image.startswith("http"), image).when(image != "", F.concat(F.lit(base.rstrip("/")), image))


def to_records(items: DataFrame, base_url: str, p: Profile = GENERIC, repealed_flag: str | None = None, repealed: str = "repealed", source: str = "legislation") -> DataFrame:
    """One record for each item that has a whole number as lawBookID; others are left out, as no page can be asked for.

    Fields that the items lack are empty. full_text is taken from the items where they carry it (see ``with_texts``).
    ``repealed_flag`` is the value of lawFlag that marks a repealed record; by default the label itself.
    """
    has = set(items.columns)
    raw = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    text = lambda c: F.coalesce(raw(c), F.lit(""))
    key = raw("lawBookID").try_cast("bigint")
    made = {
        "lawBookID": key,
        "lawYear": ascii_digits_wide(text("lawYear")),
        "lawCode": ascii_digits_wide(text("lawCode")),
        "lawValid": raw("lawValid"),
        "lawImage": raw("lawImage"),
        "articles": raw("articles"),
        "date_iso": date_iso(text("lawDate"), text("tacksNewsDate")),
        "status_label": status_of(raw("lawValid"), raw("lawFlag"), repealed if repealed_flag is None else repealed_flag, p.in_force, repealed),
        "full_text": text("full_text"),
        "full_text_len": F.length(text("full_text")).cast("bigint"),
        "source_url": detail_url(base_url, key),
        "pdf_url": pdf_url(base_url, raw("lawImage")),
        "source_type": F.lit(source),
        "corpus_id": F.concat(F.lit(source + ":"), key.cast("string")),
    } | {c: text(c) for c in PLAIN}
    return items.where(key.isNotNull()).select(*[made[c].alias(c) for c in sorted(made, key=str.lower)])


def with_texts(items: DataFrame, pages: DataFrame, text: Column, key: str = "lawBookID") -> DataFrame:
    """Adds full_text from the detail pages (key and what ``text`` reads); an item without a page or a whole number as key gets an empty one."""
    found = pages.select(F.col(key).cast("bigint").alias("_k"), text.alias("full_text"))
    joined = items.drop("full_text").withColumn("_k", F.col(key).try_cast("bigint")).join(found, "_k", "left")
    return joined.drop("_k").withColumn("full_text", F.coalesce("full_text", F.lit("")))


def with_extension_fields(records: DataFrame, source: str = "legislation", key: str = "lawBookID") -> DataFrame:
    """source_type and corpus_id where they are missing or empty; others stay."""
    old = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit(None).cast("string")
    made = F.concat(F.lit(source + ":"), F.col(key).try_cast("bigint").cast("string"))
    return records.withColumns({"source_type": F.coalesce(old("source_type"), F.lit(source)), "corpus_id": F.coalesce(old("corpus_id"), made)})


def is_priority(title: Column, year: Column, status: Column, patterns: tuple[str, ...], year_from: int, p: Profile = GENERIC) -> Column:
    """In force, and a major title or recent. Patterns are normalised as titles are."""
    recent = F.coalesce(F.substring(F.coalesce(year.cast("string"), F.lit("0")), 1, 4).try_cast("int") >= year_from, F.lit(False))
    major = contains_any(normalize(title, p), cues(patterns, p)) if patterns else F.lit(False)
    return (F.trim(F.coalesce(status, F.lit(""))) == p.in_force) & (F.coalesce(major, F.lit(False)) | recent)
