"""Quota- and diversity-aware fusion of retrieval legs, and what follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60
_OUT = "array<struct<neg:double,leg:string,rank:int,key:string,law:bigint,chunk_id:string,slot:int>>"


def slot_key(law: Column, label: Column, numbers: Column, chunk: Column) -> Column:
    """law:label, else law:first number, else the chunk."""
    first = F.try_element_at(numbers, F.lit(1))
    name = F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(first)
    return F.when(name.isNotNull() & law.isNotNull() & (law != 0), F.concat_ws(":", law.cast("string"), name)).otherwise(chunk)


def fuse(hits: DataFrame, plans: DataFrame, guaranteed: DataFrame | None = None) -> DataFrame:
    """(qid, pos, chunk_id, law_book_id, leg, score): greedy admission until the plan's k.

    hits: qid, leg, rank (0-based), chunk_id, law_book_id, key. plans: qid, k, max_per_law, legs (array of name,
    weight, quota). A row scores weight / (60 + rank + 1); scores of two legs are not added. Rows go in order of
    (-score, leg, rank); a row is left out if its key is taken, its leg's quota is used up or its law has its
    share (law 0 or null has no limit), and leaves no trace. guaranteed: qid, slot, law_book_id — each such law
    first gets its first admissible law_scoped row.

    Admission depends on what was admitted before, so it is a fold over each question's few candidates.
    """
    legs = plans.select("qid", F.explode("legs").alias("l")).select("qid", F.col("l.name").alias("leg"), F.col("l.weight").alias("w"))
    scored = hits.join(legs, ["qid", "leg"])
    if guaranteed is not None:
        scored = scored.join(guaranteed.select("qid", "law_book_id", "slot"), ["qid", "law_book_id"], "left")
    else:
        scored = scored.withColumn("slot", F.lit(None).cast("int"))
    row = F.struct((-(F.col("w") / (RRF + F.col("rank") + 1))).cast("double").alias("neg"), "leg", F.col("rank").cast("int").alias("rank"), F.col("key"), F.coalesce("law_book_id", F.lit(0)).cast("bigint").alias("law"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("slot").cast("int").alias("slot"))
    by = scored.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("c")).join(plans, "qid")
    quota = F.map_from_arrays(F.transform("legs", lambda x: x["name"]), F.transform("legs", lambda x: x["quota"]))
    first = F.array_sort(F.transform(F.filter("c", lambda x: x["slot"].isNotNull() & (x["leg"] == "law_scoped")), lambda x: F.struct(x["slot"].alias("s"), x.alias("x"))))
    empty = F.array().cast(_OUT)

    def fits(out: Column, c: Column) -> Column:
        law = F.size(F.filter(out, lambda o: o["law"] == c["law"]))
        return (F.size(out) < F.col("k")) & ~F.exists(out, lambda o: o["key"] == c["key"]) & (F.size(F.filter(out, lambda o: o["leg"] == c["leg"])) < F.col("q")[c["leg"]]) & ((c["law"] == 0) | (law < F.col("max_per_law")))

    def add(out: Column, c: Column, more: Column) -> Column:
        return F.when(more & fits(out, c), F.concat(out, F.array(c))).otherwise(out)

    start = F.aggregate(F.col("first"), empty, lambda out, g: add(out, g["x"], ~F.exists(out, lambda o: o["slot"] == g["s"])))
    done = by.withColumn("q", quota).withColumn("first", first).withColumn("start", start).withColumn("out", F.aggregate(F.col("c"), F.col("start"), lambda out, c: add(out, c, F.lit(True))))
    rows = done.select("qid", F.posexplode("out").alias("pos", "o"))
    return rows.select("qid", "pos", F.col("o.chunk_id").alias("chunk_id"), F.col("o.law").alias("law_book_id"), F.col("o.leg").alias("leg"), F.round(-F.col("o.neg"), 8).alias("score"))


def amender_pull(fused: DataFrame, links: DataFrame, ranked: DataFrame, most: int = 2, articles: int = 4) -> DataFrame:
    """Up to ``most`` more rows (so k + most in all): for each amended hit, each amender newest first, each of its
    ``articles`` least numbers, the amender's nearest chunk with that article, unless it is there already.

    fused: qid, pos, chunk_id, law_book_id, numbers. links: law_book_id, amender, order. ranked: qid, law_book_id,
    number, chunk_id, distance.
    """
    cell = fused.select("qid", "pos", "law_book_id", F.posexplode(F.slice(F.array_sort("numbers"), 1, articles)).alias("n_pos", "number")).join(links, "law_book_id")
    w = Window.partitionBy("qid", "amender", "number", "pos").orderBy("distance", "chunk_id")
    top = cell.join(ranked.withColumnRenamed("law_book_id", "amender"), ["qid", "amender", "number"]).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    new = top.join(fused.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    one = new.groupBy("qid", "chunk_id", "amender").agg(F.min(F.struct("pos", "order", "n_pos")).alias("o"))
    first = Window.partitionBy("qid").orderBy("o", "chunk_id")
    return one.withColumn("extra", F.row_number().over(first)).where(F.col("extra") <= most).select("qid", "chunk_id", F.col("amender").alias("law_book_id"), "extra")


def context(hits: DataFrame, by: str, order: list[str], title: str, text: str, to: str = "context") -> DataFrame:
    """One text per question: numbered blocks in order, a repeated title named as such, joined by a rule."""
    w = Window.partitionBy(by).orderBy(*order)
    n = F.row_number().over(w)
    head = F.when(F.lag(title).over(w).eqNullSafe(F.col(title)), F.lit("same source")).otherwise(F.coalesce(F.col(title), F.lit("")))
    blocks = hits.withColumn("_n", n).withColumn("_b", F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), head, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))))
    return blocks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_b"))), lambda s: s["_b"]), "\n\n---\n\n").alias(to))


#: What the parts of a source's header are called.
WORDS = {"source": "source", "year": "year", "same": "same law", "status": "status", "careful": "may be amended", "pulled": "from a linked amending law", "amended_by": "amended by", "article": "article"}


def sourced_context(hits: DataFrame, by: str, order: list[str], amended: str = "A", amending: str = "B", links: DataFrame | None = None, words: dict[str, str] = WORDS, law: str = "law_book_id", to: str = "context") -> DataFrame:
    """One text per question: a block for each source with its title, year, address and what is to be known of it, joined by a rule.

    hits: ``by``, law, title, year, source_url, text, status_label, law_flag, article_label and pulled (a row that an amendment brought in); nulls
    read as empty. links: ``links.nested`` rows, whose first three amenders are named for laws flagged ``amended``. A title that repeats the one
    before is not written again.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    full = hits
    if links is not None:
        names = F.array_join(F.transform(F.slice("amended_by", 1, 3), lambda a: F.substring(F.coalesce(a["title"], F.lit("")), 1, 50)), "; ")
        full = hits.join(links.select(F.col("base").alias(law), names.alias("_names")), law, "left")
    else:
        full = hits.withColumn("_names", F.lit(None).cast("string"))
    w = Window.partitionBy(by).orderBy(*order)
    bit = lambda ok, name, value=None: F.when(ok, F.lit(words[name]) if value is None else F.concat(F.lit(words[name] + ": "), value))
    bits = F.concat_ws(
        " | ",
        bit(text("status_label") != "", "status", text("status_label")),
        F.when(text("law_flag").isin(amended, amending), F.concat(F.lit(words["careful"] + " ("), text("law_flag"), F.lit(")"))),
        bit(F.coalesce("pulled", F.lit(False)), "pulled"),
        bit((text("law_flag") == amended) & (text("_names") != ""), "amended_by", text("_names")),
        bit(text("article_label") != "", "article", text("article_label")),
    )
    full = full.withColumns({"_n": F.row_number().over(w), "_last": F.lag(text("title")).over(w), "_bits": F.when(bits != "", F.concat(F.lit(" | "), bits)).otherwise("")})
    number = F.concat(F.lit(f"[{words['source']} "), F.col("_n").cast("string"), F.lit("] "))
    whole = F.concat(number, text("title"), F.lit(f" ({words['year']} "), text("year"), F.col("_bits"), F.lit(") — "), text("source_url"))
    same = F.concat(number, F.lit(f"({words['same']}"), F.col("_bits"), F.lit(")"))
    head = F.when((text("title") != "") & F.coalesce(text("title") == F.col("_last"), F.lit(False)), same).otherwise(whole)
    blocks = full.withColumn("_b", F.concat(head, F.lit("\n"), text("text")))
    return blocks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_b"))), lambda s: s["_b"]), "\n\n---\n\n").alias(to))


#: Characters of a source's text that are shown beside a looked-up and a generated answer.
SHOWN = {"lookup": 500, "generated": 400}


def source_view(rows: DataFrame, mode: str = "generated", whole: bool = False, keys: tuple[str, ...] = ("qid", "pos")) -> DataFrame:
    """keys and the columns that are shown of a source; nulls are empty texts. Texts are cut unless ``whole``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    number = lambda c: F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")
    shown = text("text") if whole else F.substring(text("text"), 1, SHOWN[mode])
    plain = [text(c).alias(c) for c in ("chunk_id", "title", "year", "status_label", "law_flag", "source_url")]
    return rows.select(*keys, *plain, F.trim(text("article_nums"), F.lit(",")).alias("article_nums"), shown.alias("text"), number("distance").alias("distance"), number("relevance").alias("relevance"))


def looked_up(rows: DataFrame, by: str = "qid", asked: str = "asked", most: int = 3) -> DataFrame:
    """(by, answer): an asked article answered by the sources that have it, articles before chunks, the label itself before mentions, then as they came.

    rows: by, pos, asked (the article), article_label, article_arr, title, year, source_url, text. Questions whose sources lack the article are left out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = F.coalesce(F.col("article_label") == F.col(asked), F.lit(False))
    has = rows.where(own | F.coalesce(F.array_contains("article_arr", F.col(asked)), F.lit(False)))
    w = Window.partitionBy(by).orderBy((text("article_label") == "").cast("int"), (~own).cast("int"), "pos")
    part = F.concat(F.lit("— "), text("title"), F.lit(" ("), text("year"), F.lit(")\n"), text("source_url"), F.lit("\n"), F.regexp_replace(text("text"), r"(?U)^\s+|\s+$", ""))
    top = has.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).withColumn("_p", part)
    return top.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_p"))), lambda s: s["_p"]), "\n\n").alias("answer"))
