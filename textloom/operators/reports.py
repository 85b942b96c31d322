"""Summaries, evaluation, metering and citation gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_summary(df: DataFrame, key: str, text: str, status: str, year: str) -> DataFrame:
    """One row: counts, ids, rows with and without text, distinct years, counts by status as a map. One pass and a small second one."""
    whole = df.agg(F.count("*").alias("records"), F.min(key).alias("min_id"), F.max(key).alias("max_id"), F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").alias("with_text"), F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("without_text"), F.count_distinct(year).alias("years"))
    by = df.groupBy(F.coalesce(F.col(status).cast("string"), F.lit("")).alias("s")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("status_counts"))
    return whole.crossJoin(by)


def manifest(df: DataFrame, key: str, text: str, status: str, year: str, version: str, files: DataFrame | None = None) -> DataFrame:
    """The summary with a version; files: (path, content) of the packaged files, whose checksums are added."""
    out = corpus_summary(df, key, text, status, year).withColumn("corpus_version", F.lit(version))
    if files is None:
        return out
    sums = files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size_bytes")).agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "size_bytes"))).alias("files"))
    return out.crossJoin(sums)


def usage_report(calls: DataFrame, by: list[str], cost: str, prompt: str, completion: str) -> DataFrame:
    """Totals with projections to 10 and 100 times the calls."""
    t = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.sum(cost), 8).alias("cost_usd"), F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"))
    return t.withColumns({"cost_x10": F.round(F.col("cost_usd") * 10, 6), "cost_x100": F.round(F.col("cost_usd") * 100, 6)})


def recall_at_k(hits: DataFrame, cases: DataFrame, k: int, found: Column, qid: str = "qid") -> DataFrame:
    """Cases, passed, recall: a case passes if some hit of its first k has ``found``; cases without hits fail."""
    ok = hits.where(F.col("rank") <= k).join(cases, qid).groupBy(qid).agg(F.bool_or(found).alias("ok"))
    return cases.select(qid).distinct().join(ok, qid, "left").agg(F.count("*").alias("cases"), F.count_if(F.coalesce("ok", F.lit(False))).alias("passed")).withColumn("recall", F.round(F.col("passed") / F.col("cases"), 6))


def precision_cases(hits: DataFrame, cases: DataFrame, qid: str = "qid", law: str = "law_book_id") -> DataFrame:
    """For each case: first rank of a wanted law within law_at, whether its article is there, and whether a forbidden law outranks it.

    cases: qid, must (array), articles (array), law_at, article_at, forbid (array). hits: qid, rank, law, numbers.
    """
    both = cases.join(hits, qid, "left")
    want = F.array_contains("must", F.col(law))
    g = both.groupBy(qid).agg(
        F.min(F.when(want & (F.col("rank") <= F.col("law_at")), F.col("rank"))).alias("first_rank"),
        F.bool_or(F.coalesce(want & (F.col("rank") <= F.col("article_at")) & (F.arrays_overlap("articles", "numbers") | (F.size("articles") == 0)), F.lit(False))).alias("article_ok"),
        F.min(F.when(F.array_contains("forbid", F.col(law)), F.col("rank"))).alias("first_bad"),
    )
    outranked = F.coalesce(F.col("first_bad") < F.coalesce("first_rank", F.lit(1 << 30)), F.lit(False))
    return g.withColumn("outranked", outranked).withColumn("passed", F.col("first_rank").isNotNull() & F.col("article_ok") & ~outranked)


def alias_redundancy(aliases: DataFrame, key: str, alias: str, title: str) -> DataFrame:
    """Counts of aliases that restate their title: as a substring, as a subset of its words, or not."""
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), " "), lambda w: w != "")
    inside = F.lower(F.col(title)).contains(F.lower(F.col(alias)))
    subset = F.size(F.array_except(words(alias), words(title))) == 0
    kind = F.when(inside, "substring").when(subset, "token_subset").otherwise("novel")
    return aliases.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("titles"))


def citation_gate(answers: DataFrame, rows: DataFrame, qid: str, cited: str, numbers: str) -> DataFrame:
    """qid, fabricated: cited numbers that no retrieved row of the question has, in order."""
    have = rows.groupBy(qid).agg(F.array_distinct(F.flatten(F.collect_list(numbers))).alias("_have"))
    out = answers.join(have, qid, "left")
    return out.select(*[F.col(c) for c in answers.columns], F.array_except(F.col(cited), F.coalesce("_have", F.array().cast("array<string>"))).alias("fabricated"))


def cache_key(question: Column, chunks: Column, model: str, detailed: bool, lang: str, version: int = 5) -> Column:
    """A stable digest of what an answer depends on."""
    return F.sha2(F.to_json(F.struct(F.array_sort(chunks).alias("chunks"), F.lit(detailed).alias("detailed"), F.lit(lang).alias("lang"), F.lit(model).alias("model"), F.lit(version).alias("prompt_v"), question.alias("question"))), 256)


def checks(parts: dict[str, DataFrame]) -> DataFrame:
    """(check, ok, detail): each part is a one-row frame with ok and detail."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("check"), F.col("ok").cast("boolean").alias("ok"), F.col("detail").cast("string").alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out


def link_summary(rows: DataFrame, majors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, edges by method, amenders of the major records). rows: ``links.nested`` with base_num and base_year; majors: num, year, label.

    The totals are sums over each base's lists. Of several bases with a major's number and year the least id counts.
    """
    size = lambda c: F.coalesce(F.sum(F.size(F.coalesce(c, F.array()))), F.lit(0)).cast("bigint")
    totals = rows.agg(F.count("*").alias("bases_with_links"), size(F.transform("amended_by", lambda a: a["law_book_id"])).alias("amendment_edges"), size(F.transform("replaced_by", lambda a: a["law_book_id"])).alias("replace_edges"))
    methods = rows.select(F.explode("amended_by").alias("a")).groupBy(F.col("a.method").alias("method")).agg(F.count("*").alias("n"))
    of = rows.select("base", F.col("base_num").alias("num"), F.col("base_year").alias("year"), F.coalesce(F.size("amended_by"), F.lit(0)).alias("n"))
    hit = majors.join(of, ["num", "year"], "left").groupBy("label").agg(F.min(F.struct("base", "n")).alias("x"))
    return totals, methods, hit.select("label", F.col("x.base").alias("base"), F.coalesce(F.greatest("x.n", F.lit(0)), F.lit(0)).alias("amended_by"))


def matrix(hits: DataFrame, cases: DataFrame, k: int, found: Column, variant: str = "variant", qid: str = "qid") -> DataFrame:
    """``recall_at_k`` for each variant (a retrieval with or without a leg, say) over the same cases, in one plan."""
    each = cases.select(qid).distinct().crossJoin(F.broadcast(hits.select(variant).distinct()))
    ok = hits.where(F.col("rank") <= k).join(cases, qid).groupBy(variant, qid).agg(F.bool_or(found).alias("ok"))
    out = each.join(ok, [variant, qid], "left").groupBy(variant).agg(F.count("*").alias("cases"), F.count_if(F.coalesce("ok", F.lit(False))).alias("passed"))
    return out.withColumn("recall", F.round(F.col("passed") / F.col("cases"), 6))
