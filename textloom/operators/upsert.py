"""Identity, fingerprints, upsert and incremental discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed order of the parts of a record's fingerprint.
FINGERPRINT = ("lawTitle", "status_label", "lawFlag", "lawValid", "date_iso", "lawDate", "lawYear", "lawCode", "lawNotes")


def text_of(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def with_identity(df: DataFrame, default_source: str = "legislation", to: str = "identity") -> DataFrame:
    """source:lawBookID:n, else source:corpus_id:x, else source:title_year:16 hex digits of number|year|title."""
    source = F.coalesce(F.nullif(F.trim(text_of(df, "source_type")), F.lit("")), F.lit(default_source))
    law, corpus = F.trim(text_of(df, "lawBookID")), F.trim(text_of(df, "corpus_id"))
    title = F.lower(F.trim(F.regexp_replace(text_of(df, "lawTitle"), r"(?U)\s+", " ")))
    digest = F.substring(F.sha2(F.concat_ws("|", F.trim(text_of(df, "lawCode")), F.trim(text_of(df, "lawYear")), title), 256), 1, 16)
    return df.withColumn(to, F.when(law != "", F.concat_ws(":", source, F.lit("lawBookID"), law.try_cast("bigint").cast("string"))).when(corpus != "", F.concat_ws(":", source, F.lit("corpus_id"), corpus)).otherwise(F.concat_ws(":", source, F.lit("title_year"), digest)))


def with_fingerprint(df: DataFrame, default_source: str = "legislation", to: str = "fingerprint") -> DataFrame:
    """A hash of what matters for "same id, changed content"."""
    text = text_of(df, "full_text")
    size = F.coalesce(F.nullif(text_of(df, "full_text_len"), F.lit("")), F.length(text).cast("string"))
    source = F.coalesce(F.nullif(F.trim(text_of(df, "source_type")), F.lit("")), F.lit(default_source))
    return df.withColumn(to, F.sha2(F.concat_ws("\n", source, *[text_of(df, c) for c in FINGERPRINT], size, F.sha2(text, 256)), 256))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order of each key. Partial aggregation: no window over a hot key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def classify(master: DataFrame, incoming: DataFrame, key: str, fingerprint: str, seq: str) -> DataFrame:
    """Incoming rows in order with change = inserted, updated or skipped, each compared with its key's value just before.

    A skipped row has its predecessor's fingerprint, so the row before is the current value.
    """
    both = master.withColumn("_side", F.lit(0)).withColumn(seq, F.lit(-1).cast("bigint")).unionByName(incoming.withColumn("_side", F.lit(1)).withColumn(seq, F.col(seq).cast("bigint")), allowMissingColumns=True)
    prev = F.lag(fingerprint).over(Window.partitionBy(key).orderBy("_side", seq))
    change = F.when(prev.isNull(), "inserted").when(prev == F.col(fingerprint), "skipped").otherwise("updated")
    return both.withColumn("change", change)


def merge(master: DataFrame, incoming: DataFrame, key: str, fingerprint: str, seq: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged rows, delta rows, stats)."""
    rows = classify(master, incoming, key, fingerprint, seq)
    kept = rows.where("_side = 0 or change <> 'skipped'")
    order = F.struct("_side", seq).alias("_o")
    merged = last_wins(kept.withColumn("_o", order), [key], "_o").drop("_o", "_side", "change")
    delta = rows.where("_side = 1 and change <> 'skipped'").drop("_side")
    one = lambda c: F.count_if((F.col("_side") == 1) & (F.col("change") == c))
    stats = rows.agg(one("inserted").alias("inserted"), one("updated").alias("updated"), one("skipped").alias("skipped"), F.count_if(F.col("_side") == 1).alias("total_in"), (F.count_if(F.col("_side") == 0) + one("inserted")).alias("total_out"))
    return merged, delta, stats


def stale_routes(old: DataFrame, new: DataFrame, key: str, payload: str) -> DataFrame:
    """key and state: new, stale (payload differs) or same."""
    both = new.select(key, F.col(payload).alias("_n")).join(old.select(key, F.col(payload).alias("_p")), key, "left")
    return both.select(key, F.when(F.col("_p").isNull(), "new").when(F.col("_p").eqNullSafe(F.col("_n")), "same").otherwise("stale").alias("state"))


def until_known_streak(catalog: DataFrame, known: DataFrame, key: str, pos: str, page: int, least: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Unknown rows of a newest-first catalogue up to the first page whose end has ``least`` known ids in a row.

    ``by`` splits the catalogue into independent ones (a source each); without it the order is one sequence.
    """
    least = least or max(2 * page, 20)
    by = by or []
    flag = catalog.join(known.select(key).distinct().withColumn("_known", F.lit(1)), key, "left").withColumn("_known", F.coalesce("_known", F.lit(0)))
    w = Window.partitionBy(*by).orderBy(pos)
    isle = flag.withColumn("_isle", F.sum(1 - F.col("_known")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = isle.withColumn("_streak", F.sum("_known").over(Window.partitionBy(*by, "_isle").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    paged = streak.withColumn("_page", F.floor(F.col(pos) / page))
    ends = paged.groupBy(*by, "_page").agg(F.max_by("_streak", pos).alias("_end"))
    stop = ends.where(F.col("_end") >= least).groupBy(*by).agg(F.min("_page").alias("_stop"))
    both = paged.join(stop, by, "left") if by else paged.crossJoin(F.broadcast(stop.agg(F.min("_stop").alias("_stop"))))
    return both.where((F.col("_known") == 0) & (F.col("_stop").isNull() | (F.col("_page") <= F.col("_stop")))).drop("_known", "_isle", "_streak", "_page", "_stop")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))
