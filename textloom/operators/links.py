"""Links from amending to amended records: numbers first, then titles, then a ladder that would rather refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bounded_in, citations, contains_any, core_title, cues, instrument_kind, normalize
from ..profile import GENERIC, Profile
from .search import holding


def briefs(laws: DataFrame, p: Profile = GENERIC, key: str = "law_book_id", title: str = "title") -> DataFrame:
    """key, title, num, year, core, kind, class_blob, cites, notes, flag."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in laws.columns else F.lit("")
    own = citations(F.concat_ws(" ", F.col(title)), p)
    year = F.substring(F.regexp_replace(text("year"), "[^0-9]", ""), 1, 4)
    code = F.regexp_replace(F.regexp_replace(text("code"), "[^0-9]", ""), "^0+", "")
    match = F.coalesce(F.get(F.filter(own, lambda c: c["year"] == year), F.lit(0)), F.get(own, F.lit(0)))
    num = F.when(code != "", code).otherwise(F.coalesce(match["num"], F.lit("")))
    return laws.where(F.col(key).isNotNull() & (F.col(key) != 0)).select(
        key, F.col(title).alias("title"), num.alias("num"), year.alias("year"), core_title(title, p).alias("core"), instrument_kind(title, p).alias("kind"),
        normalize(F.concat_ws(" ", text("classification"), text("law_index"), text("category"), F.col(title)), p).alias("class_blob"), normalize(text("classification"), p).alias("class_norm"), normalize(text("law_index"), p).alias("index_norm"),
        F.array_distinct(F.concat(own, citations(text("notes"), p))).alias("cites"), normalize(text("notes"), p).alias("notes"), text("flag").alias("flag"), normalize(title, p).alias("title_norm"),
    )


def _narrow(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """A rung of the ladder: keeps the rows with the flag where a group has some, else the group as it is."""
    w = Window.partitionBy(*by)
    return df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_any", F.max("_f").over(w)).where("_f or not _any").drop("_f", "_any")


def decide(cands: DataFrame, p: Profile = GENERIC, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One base of several, or none: the longest core in title and notes; of those held, equal kind; then class overlap, strictly best.

    Columns: the keys of ``by``, base, base_core, base_kind, base_class, kind, class_blob, hay; if there are, base_class_norm and base_index_norm: a
    whole classification in the amender's words is worth 3 points, a whole index entry 2, a word of three letters 1. ``weight``: a column with the
    number of like bases that a row stands for.
    """
    by = by or ["amender"]
    each = F.col(weight) if weight else F.lit(1)
    w = Window.partitionBy(*by)
    inside = bounded_in(F.col("base_core"), F.col("hay"), p)
    size = F.when(inside, F.length("base_core")).otherwise(0)
    one = cands.withColumn("_s", size).withColumn("_m", F.max("_s").over(w))
    # a single longest core decides; of several equally long, all that are held stay
    one = one.withColumn("_l", F.sum(F.when((F.col("_s") == F.col("_m")) & (F.col("_m") > 0), each).otherwise(0)).over(w))
    two = _narrow(one, by, F.when(F.col("_l") == 1, F.col("_s") == F.col("_m")).otherwise(F.col("_s") > 0))
    three = _narrow(two, by, (F.col("base_kind") == F.col("kind")) & (F.col("kind") != ""))
    tokens = F.filter(F.split("base_class", " "), lambda t: F.length(t) >= 3)
    whole = lambda c, n: F.when((F.col(c) != "") & F.col("class_blob").contains(F.col(c)), n).otherwise(0) if c in cands.columns else F.lit(0)
    score = F.size(F.filter(tokens, lambda t: F.col("class_blob").contains(t))) + whole("base_class_norm", 3) + whole("base_index_norm", 2)
    four = three.withColumn("_c", score).withColumn("_n", F.sum(each).over(w)).withColumn("_b", F.max("_c").over(w))
    left = four.where("_n = 1 or (_c = _b and _c > 0)").withColumn("_n2", F.sum(each).over(w))
    return left.where("_n2 = 1").drop("_s", "_m", "_l", "_c", "_n", "_b", "_n2")


def decide_between(amenders: DataFrame, bases: DataFrame, on: list[str], p: Profile = GENERIC) -> DataFrame:
    """(amender, base): ``decide`` where an amender's candidates are all bases that equal it in ``on``.

    amenders: amender, ``on``, kind, class_blob, hay. bases: base, ``on`` and their columns. Like bases are one candidate with their number, as
    none of several is ever held, and like amenders are decided once: pairs are those of different kinds, not of rows.
    """
    like = [c for c in bases.columns if c != "base"]
    some = bases.groupBy(*like).agg(F.min("base").alias("base"), F.count("*").alias("_many"))
    who = F.struct(*on, "kind", "class_blob", "hay")
    kinds = amenders.select(*on, "kind", "class_blob", "hay").distinct().withColumn("_who", who)
    held = decide(kinds.join(some, on), p, ["_who"], "_many").select("_who", "base")
    return amenders.select("amender", who.alias("_who")).join(held, "_who").select("amender", "base")


def amendment_edges(rows: DataFrame, amending: Column, p: Profile = GENERIC, key: str = "law_book_id") -> DataFrame:
    """(base, amender, method, confidence), at most one base for each amender; its own number is no citation.

    Citations are an equi-join on (num, year). Titles are compared only for amenders whose citations match
    nothing: cores meet titles through their rarest three characters, an equi-join as well.
    """
    base = rows.where(~amending).select(F.col(key).alias("base"), F.col("num").alias("b_num"), F.col("year").alias("b_year"), F.col("core").alias("base_core"), F.col("kind").alias("base_kind"), F.col("class_blob").alias("base_class"), F.col("class_norm").alias("base_class_norm"), F.col("index_norm").alias("base_index_norm"))
    amend = rows.where(amending).select(F.col(key).alias("amender"), "num", "year", "kind", "class_blob", "cites", F.concat_ws(" ", "title_norm", "notes").alias("hay"), "title_norm")
    cited = amend.select("*", F.posexplode("cites").alias("prio", "c")).where(~((F.col("c.num") == F.col("num")) & (F.col("c.year") == F.col("year"))))
    met = cited.join(base, (F.col("c.num") == F.col("b_num")) & (F.col("c.year") == F.col("b_year")) & (F.col("base") != F.col("amender")))
    w = Window.partitionBy("amender")
    first = met.withColumn("_p", F.min("prio").over(w)).where("prio = _p").withColumn("n", F.count("*").over(w))
    sure = first.where("n = 1").select("base", "amender", F.lit("num_year").alias("method"), F.lit("high").alias("confidence"))
    tied = decide(first.where("n > 1"), p).select("base", "amender", F.lit("classification").alias("method"), F.lit("medium").alias("confidence"))
    rest = amend.join(first.select("amender").distinct(), "amender", "left_anti")
    # distinct cores meet titles; the bases of a core are joined to what is found
    held = holding(rest.select("amender", "title_norm"), base.where("base_core <> ''").select("base_core").distinct(), "title_norm", "base_core").where(bounded_in(F.col("base_core"), F.col("title_norm"), p)).select("amender", "base_core")
    top = held.withColumn("_l", F.max(F.length("base_core")).over(w)).where(F.length("base_core") == F.col("_l")).drop("_l")
    own = rest.select("amender", F.col("kind"), "class_blob", "hay", "title_norm")
    named = top.join(base, "base_core").where(F.col("base") != F.col("amender")).join(own, "amender")
    longest = named.withColumn("n", F.count("*").over(w))
    single = longest.where("n = 1").select("base", "amender", F.lit("title_contain").alias("method"), F.when(F.length("base_core") >= 12, "high").otherwise("medium").alias("confidence"))
    several = decide(longest.where("n > 1"), p).select("base", "amender", F.lit("title_contain").alias("method"), F.lit("medium").alias("confidence"))
    return sure.unionByName(tied).unionByName(single).unionByName(several)


def repeal_edges(rows: DataFrame, p: Profile = GENERIC, key: str = "law_book_id") -> DataFrame:
    """(base, amender): a record's notes say that it was repealed and cite exactly one other record."""
    cued = rows.where(contains_any(F.col("notes"), cues(p.repeal_cues, p))).select(F.col(key).alias("base"), "num", "year", F.explode("cites").alias("c"))
    other = rows.select(F.col(key).alias("amender"), F.col("num").alias("o_num"), F.col("year").alias("o_year"))
    met = cued.where(~((F.col("c.num") == F.col("num")) & (F.col("c.year") == F.col("year")))).join(other, (F.col("c.num") == F.col("o_num")) & (F.col("c.year") == F.col("o_year")) & (F.col("amender") != F.col("base")))
    n = F.count("*").over(Window.partitionBy("base"))
    return met.withColumn("n", n).where("n = 1").select("base", "amender", F.lit("law_notes").alias("method"), F.lit("medium").alias("confidence"))


def nested(edges: DataFrame, replaced: DataFrame, rows: DataFrame, key: str = "law_book_id", version: str = "1.1.0") -> DataFrame:
    """One row per base: amended_by newest first, replaced_by without those already there."""
    info = rows.select(F.col(key).alias("amender"), "title", "year")

    def lists(e: DataFrame, name: str) -> DataFrame:
        full = e.join(info, "amender")
        item = F.struct((-F.coalesce(F.col("year").try_cast("int"), F.lit(0))).alias("o"), F.col("amender").alias("law_book_id"), "title", "year", "method", "confidence")
        return full.groupBy("base").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["law_book_id"].alias("law_book_id"), s["title"].alias("title"), s["year"].alias("year"), s["method"].alias("method"), s["confidence"].alias("confidence"))).alias(name))

    both = lists(edges, "amended_by").join(lists(replaced.join(edges, ["base", "amender"], "left_anti"), "replaced_by"), "base", "full")
    return both.withColumn("builder_version", F.lit(version))


def warnings(hits: DataFrame, links: DataFrame, by: str, amended: str = "A", amending: str = "B", key: str = "law_book_id", most: int = 12, shown: int = 6) -> DataFrame:
    """One warning for each flagged law among a question's hits, in order of its first hit: by, pos, key, warning.

    hits: ``by``, pos, key, title, law_flag. links: ``nested`` rows. A law flagged ``amended`` lists its amenders newest first
    (at most ``most``, the first ``shown`` by title and year, then "(+n)"); without known amenders, and for laws flagged ``amending``, the
    warning is the title with the flag.
    """
    flagged = hits.where(F.trim("law_flag").isin(amended, amending))
    first = flagged.groupBy(by, key).agg(F.min(F.struct("pos", F.coalesce("title", F.lit("")).alias("title"), F.trim("law_flag").alias("flag"))).alias("h"))
    known = first.join(links.select(F.col("base").alias(key), F.slice("amended_by", 1, most).alias("_a")), key, "left")
    name = lambda a: F.concat(F.substring(F.coalesce(a["title"], F.lit("")), 1, 70), F.when(F.coalesce(a["year"], F.lit("")) != "", F.concat(F.lit(" ("), a["year"], F.lit(")"))).otherwise(""))
    names = F.array_join(F.transform(F.slice("_a", 1, shown), name), "; ")
    more = F.when(F.size("_a") > shown, F.concat(F.lit(" (+"), (F.size("_a") - shown).cast("string"), F.lit(")"))).otherwise("")
    head = F.concat(F.substring("h.title", 1, 120), F.lit(" ["), F.col("h.flag"), F.lit("]"))
    listed = (F.col("h.flag") == amended) & (F.coalesce(F.size("_a"), F.lit(0)) > 0)
    return known.select(by, F.col("h.pos").alias("pos"), key, F.when(listed, F.concat(head, F.lit("\n"), names, more)).otherwise(head).alias("warning"))


def is_amending(flag: Column, title: Column, amending: str, markers: tuple[str, ...], p: Profile = GENERIC) -> Column:
    """A record that changes others: by its flag, or by a marker in its title."""
    return (F.trim(F.coalesce(flag, F.lit(""))) == amending) | contains_any(normalize(title, p), cues(markers, p))
