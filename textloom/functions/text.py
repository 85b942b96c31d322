"""Column expressions over text: normalising, references, citations, tokens, titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import GENERIC, Profile

ASCII = "0123456789"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: str | Column) -> Column:
    """Runs of (Unicode) white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normalize(c: str | Column, p: Profile = GENERIC) -> Column:
    """For matching only. Null reads as empty."""
    out = F.coalesce(col(c), F.lit(""))
    if p.fold_from or p.deleted:
        out = F.translate(out, p.fold_from + p.deleted, p.fold_to)
    if p.lower:
        out = F.lower(out)
    return squeeze(out)


def fold(text: str, p: Profile) -> str:
    """``normalize`` of a constant."""
    text = text.translate(str.maketrans(p.fold_from, p.fold_to, p.deleted))
    return " ".join((text.lower() if p.lower else text).split())


def ascii_digits(c: str | Column, p: Profile = GENERIC) -> Column:
    return F.translate(col(c), p.digits, ASCII) if p.digits != ASCII else col(c)


def ascii_digits_wide(c: str | Column) -> Column:
    """Arabic-Indic and Persian digits."""
    return F.translate(F.coalesce(col(c).cast("string"), F.lit("")), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", ASCII * 2)


def plain_number(c: str | Column, p: Profile = GENERIC) -> Column:
    """Digits without leading zeros; empty if there are none."""
    digits = F.regexp_replace(ascii_digits(c, p), "[^0-9]", "")
    return F.when(digits == "", "").otherwise(F.regexp_replace(digits, "^0+(?=[0-9])", ""))


def cues(words: tuple[str, ...], p: Profile) -> list[str]:
    """Cue words as normalised text has them; spaces at their ends are kept, as they mark whole words."""
    return [w.translate(str.maketrans(p.fold_from, p.fold_to, p.deleted)) for w in words]


def contains_any(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, w: a | c.contains(w), words, F.lit(False))


def reference_numbers(c: str | Column, p: Profile = GENERIC) -> Column:
    """Ordered distinct article numbers of a text: references, ranges of at most 30 filled, then bare-number lines."""
    text = F.coalesce(col(c), F.lit(""))
    lo = F.regexp_extract_all(text, F.lit(p.reference), F.lit(1))
    hi = F.regexp_extract_all(text, F.lit(p.reference), F.lit(2))
    a, b = lambda x: plain_number(x, p).cast("int"), lambda y: F.when(y == "", None).otherwise(plain_number(y, p)).cast("int")
    named = F.flatten(F.zip_with(lo, hi, lambda x, y: _span(a(x), b(y))))
    bare = F.transform(F.filter(F.split(text, "\n"), lambda s: s.rlike("(?U)" + p.marker_line)), lambda s: plain_number(s, p))
    return F.array_distinct(F.concat(named, bare))


def _span(a: Column, b: Column) -> Column:
    gap = b - a
    filled = F.transform(F.sequence(a, F.when((gap > 0) & (gap <= 30), b).otherwise(a)), lambda n: n.cast("string"))
    return F.when(b.isNull() | ((gap > 0) & (gap <= 30)), filled).otherwise(F.array(a.cast("string"), b.cast("string")))


def padded(c: str | Column) -> Column:
    """``,31,57,``: a set as text, exact under LIKE; empty for an empty set."""
    return F.when(F.size(col(c)) > 0, F.concat(F.lit(","), F.array_join(col(c), ","), F.lit(","))).otherwise("")


def unpadded(c: str | Column) -> Column:
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: x != "")


def article_asked(c: str | Column, p: Profile = GENERIC) -> Column:
    """The first article a question refers to, or null."""
    first = F.regexp_extract(col(c), p.reference, 1)
    short = F.regexp_extract(col(c), p.shorthand, 1)
    found = F.when(first != "", first).otherwise(short)
    return F.when(found != "", plain_number(found, p))


def citations(c: str | Column, p: Profile = GENERIC) -> Column:
    """Ordered distinct (num, year) pairs; two-digit years pivot at 50."""
    text = F.coalesce(col(c), F.lit(""))
    n, y = (F.regexp_extract_all(text, F.lit(p.citation), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.zip_with(n, y, lambda a, b: F.struct(plain_number(a, p).alias("num"), full_year(ascii_digits(b, p)).alias("year"))))


def full_year(y: Column) -> Column:
    return F.when(F.length(y) == 2, F.concat(F.when(y.cast("int") >= 50, "19").otherwise("20"), y)).otherwise(y)


def first_citation(c: str | Column, p: Profile = GENERIC) -> Column:
    return F.try_element_at(citations(c, p), F.lit(1))


def core_title(c: str | Column, p: Profile = GENERIC) -> Column:
    """A title without its citation, parentheses and year; empty if short or generic."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s*" + p.citation, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", ""), p.year_tail, "")
    t = F.regexp_replace(t, r"(?U)\s*[–—-]\s*$", "")
    t = F.regexp_replace(normalize(t, p), r"^[ \-–—،,]+|[ \-–—،,]+$", "")
    return F.when((F.length(t) < p.min_core) | t.isin(*p.generic_cores), "").otherwise(t)


def bounded_in(core: Column, hay: Column, p: Profile = GENERIC) -> Column:
    """core stands in hay with no letter right before or after it (some occurrence)."""
    parts = F.split(hay, F.concat(F.lit(r"\Q"), core, F.lit(r"\E")), -1)
    end = F.concat(F.lit("(?s)^.*"), F.lit(p.word_chars), F.lit("$"))
    begin = F.concat(F.lit("(?s)^"), F.lit(p.word_chars), F.lit(".*$"))
    hit = F.exists(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (F.size(parts) > 1) & ~F.regexp_like(F.get(parts, i - 1), end) & ~F.regexp_like(F.coalesce(F.get(parts, i), F.lit("")), begin))
    return (F.length(core) >= p.min_core) & hay.contains(core) & hit


def instrument_kind(c: str | Column, p: Profile = GENERIC) -> Column:
    n = normalize(c, p)
    return reduce(lambda rest, k: F.when(n.contains(k), k).otherwise(rest), reversed(p.kinds), F.lit(""))


def strip_number_year(c: str | Column, p: Profile = GENERIC) -> Column:
    return F.regexp_replace(squeeze(F.regexp_replace(col(c), p.citation, " ")), r"^[ \-–—]+|[ \-–—]+$", "")


def title_aliases(c: str | Column, p: Profile = GENERIC) -> Column:
    """Deterministic aliases of a title: itself, without its number, normalised, and its tail after the kind."""
    raw = strip(c)
    short = strip_number_year(raw, p)
    n = normalize(F.when(short != "", short).otherwise(raw), p)
    tail = reduce(lambda rest, k: F.when(n.startswith(k + " "), F.substr(n, F.lit(len(k) + 2))).otherwise(rest), reversed(p.title_kinds), F.lit(""))
    kind = reduce(lambda rest, k: F.when(n.startswith(k + " "), F.lit(k)).otherwise(rest), reversed(p.title_kinds), F.lit(""))
    more = F.when(F.length(tail) >= 4, F.array(tail, F.concat_ws(" ", kind, tail))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(F.array(raw, short, n), more)), lambda a: a != "")


def instrument_phrases(c: str | Column, p: Profile = GENERIC) -> Column:
    """Named instruments in a question, cut at filler words, of at least 6 characters; then the uncut "according to" forms."""
    q = F.translate(normalize(c, p), "؟?", "  ")
    kinds = "|".join(p.phrase_kinds)
    cut = r"(?U)\s+(?:" + "|".join(p.fillers) + r")\s+"
    named = F.transform(F.regexp_extract_all(q, F.lit(rf"(?U)(?:{kinds})\s+[^،,.]{{3,50}}"), F.lit(0)), lambda m: F.trim(F.get(F.split(F.trim(m), cut), F.lit(0))))
    under = F.transform(F.regexp_extract_all(q, F.lit(rf"(?U){p.according}\s+((?:{kinds})\s+[^،,.]{{3,50}})"), F.lit(1)), F.trim)
    return F.array_distinct(F.concat(F.filter(named, lambda m: F.length(m) >= 6), under))


def title_needles(c: str | Column, p: Profile = GENERIC) -> Column:
    """Substrings to look for in titles, longest first."""
    q = F.trim(F.translate(normalize(c, p), "؟?", ""))
    q = F.trim(F.regexp_replace(q, r"(?U)^(?:" + "|".join(p.question_prefixes) + r")\s+", ""))
    rest = reduce(lambda r, k: F.when(q.startswith(k + " "), F.trim(F.substr(q, F.lit(len(k) + 2)))).otherwise(r), reversed(p.title_kinds), F.lit(""))
    tail = F.array_join(F.slice(F.split(rest, " "), 1, 6), " ")
    all_ = F.concat(
        instrument_phrases(c, p),
        F.when(F.length(q).between(6, 80), F.array(q)).otherwise(F.array().cast("array<string>")),
        F.when(F.length(tail) >= 6, F.array(tail)).otherwise(F.array().cast("array<string>")),
    )
    fit = F.filter(F.array_distinct(all_), lambda n: (F.length(n) >= 6) & ~n.isin(*p.generic_needles) & (F.size(F.split(n, " ")) <= 10))
    return longest_first(fit)


def longest_first(a: Column) -> Column:
    """Stable: equal lengths keep their order."""
    keyed = F.transform(a, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def content_tokens(c: str | Column, p: Profile = GENERIC, least: int = 3) -> Column:
    """Distinct tokens that are no stop words or numbers, longest first."""
    words = F.split(normalize(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[؟?!،,.;:()]", " "), p), " ")
    return longest_first(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*p.stop_words) & ~w.rlike(r"^\p{Nd}+$"))))


def topic_bonus(text_norm: Column, tokens: Column, each: float = 0.06, most: float = 0.30, first: int = 12) -> Column:
    return F.least(F.lit(most), F.lit(each) * F.size(F.filter(F.slice(tokens, 1, first), lambda t: text_norm.contains(t))))


def surface_variants(token: Column, p: Profile = GENERIC) -> Column:
    """How a normalised token may stand in stored text: as it is, with the other ending, with letters that normalising folds, capitalised."""
    ends = [F.when(token.endswith(a), F.concat(F.substr(token, F.lit(1), F.length(token) - len(a)), F.lit(b))) for a, b in p.ending_variants]
    letters = [F.when(token.contains(a), F.replace(token, F.lit(a), F.lit(b))) for a, b in p.letter_variants]
    capital = [F.initcap(token)] if p.lower else []
    return F.filter(F.array_distinct(F.array(token, *ends, *letters, *capital)), lambda v: v.isNotNull() & (v != ""))


def is_overview(c: str | Column, p: Profile = GENERIC) -> Column:
    """A definitional cue, and nothing left but named instruments and stop words."""
    q = normalize(c, p)
    no_cue = reduce(lambda r, w: F.when(q.contains(w), F.replace(q, F.lit(w), F.lit(" "))).otherwise(r), reversed(p.overview_cues), q)
    rest = F.aggregate(instrument_phrases(c, p), no_cue, lambda r, x: F.replace(r, x, F.lit(" ")))
    left = F.filter(F.split(F.trim(F.regexp_replace(rest, r"(?U)[\s؟?!،,]+", " ")), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*p.overview_stops) & ~w.rlike(r"^\p{Nd}+$"))
    return contains_any(q, p.overview_cues) & (F.size(left) == 0)


def is_exact_lookup(c: str | Column, p: Profile = GENERIC) -> Column:
    left = normalize(F.regexp_replace(F.regexp_replace(col(c), p.reference, " "), p.shorthand, " "), p)
    return article_asked(c, p).isNotNull() & ~contains_any(left, cues(p.analytical_cues, p))


def instrument_count(c: str | Column, p: Profile = GENERIC) -> Column:
    n = F.size(F.filter(instrument_phrases(c, p), lambda x: F.length(x) >= 6))
    return F.when(contains_any(normalize(c, p), cues(p.comparative, p)), F.greatest(n, F.lit(2))).otherwise(n)


def title_penalty(title_norm: Column, question_norm: Column, p: Profile = GENERIC) -> Column:
    """The cost of markers that the title has and the question has not."""
    return reduce(lambda s, mc: s + F.when(title_norm.contains(fold(mc[0], p)) & ~question_norm.contains(fold(mc[0], p)), mc[1]).otherwise(0.0), p.title_penalties, F.lit(0.0))


def phrase_fit(title_norm: Column, phrase_norm: Column) -> Column:
    """How well a phrase stands in a title: at its start, further in, and what is left over."""
    short = F.trim(title_norm)
    begins = short.startswith(phrase_norm)
    tight = (F.length(short) - F.length(phrase_norm)) <= 12
    place = F.when(begins & tight, 22.0).when(begins, 16.0).otherwise(-22.0)
    rest = F.filter(F.split(F.replace(short, phrase_norm, F.lit(" ")), " "), lambda w: (w != "") & ~w.rlike(r"^\p{Nd}+$"))
    return F.when((phrase_norm == "") | ~short.contains(phrase_norm), 0.0).otherwise(place - 8.0 * F.least(F.size(rest), F.lit(4)))


def dangerous_alias(title_norm: Column, alias_norm: Column, p: Profile = GENERIC) -> Column:
    """The title has an amendment marker that the alias drops, and the alias claims the name of a base code."""
    codes = [fold(c, p) for c in p.base_codes]
    claims = reduce(lambda a, c: a | alias_norm.contains(c) | F.lit(c).contains(alias_norm), codes, F.lit(False))
    return contains_any(title_norm, p.amendment_markers) & ~contains_any(alias_norm, p.amendment_markers) & (alias_norm != "") & claims


def alias_score(alias_norm: Column, title_norm: Column, question_norm: Column, p: Profile = GENERIC, least: int = 8) -> Column:
    """Length less penalty; null if dangerous or short."""
    ok = (F.length(alias_norm) >= least) & ~dangerous_alias(title_norm, alias_norm, p)
    return F.when(ok, F.length(alias_norm) - title_penalty(title_norm, question_norm, p))


def label(base: Column, letter: Column, bis: Column, p: Profile = GENERIC) -> Column:
    return F.concat_ws(" ", F.concat(plain_number(base, p), F.coalesce(letter, F.lit(""))), F.when(bis != "", F.lit(p.bis)))


def truncated(c: str | Column, most: int = 4500) -> Column:
    """At most ``most`` characters, cut at the last newline if that is past the half, with an ellipsis."""
    head = F.substring(col(c), 1, most)
    at = F.length(head) - F.locate("\n", F.reverse(head))
    cut = F.when((F.locate("\n", F.reverse(head)) > 0) & (at > most // 2), F.substr(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(col(c)) <= most, col(c)).otherwise(F.concat(cut, F.lit("…")))


def looks_truncated(c: str | Column) -> Column:
    last = F.right(F.regexp_replace(col(c), r"(?U)\s+$", ""), F.lit(1))
    return (last != "") & ~last.isin(".", "!", "?", "؟", "…", ")", "»", '"', ":", "]")


def usd(c: str | Column) -> Column:
    """Dollars with more decimals for smaller amounts."""
    v = col(c)
    return F.when(v >= 1, F.format_string("$%.2f", v)).when(v >= 0.01, F.format_string("$%.4f", v)).otherwise(F.format_string("$%.6f", v))


def cents(c: str | Column) -> Column:
    v = col(c) * 100
    return F.when(v >= 1, F.format_string("%.2f¢", v)).otherwise(F.format_string("%.4f¢", v))
