"""The article index: defining headers with their spans, and mentions inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label, plain_number
from ..profile import GENERIC, Profile


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line, start (0-based offset of the line in code points). A map over rows in Arrow batches, linear in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256))):
            lines = pc.split_pattern(pc.fill_null(b.column(1), ""), "\n")
            flat, of = lines.flatten(), pc.list_parent_indices(lines)
            size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            first = np.r_[0, np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))][:-1]
            row = of.to_numpy(zero_copy_only=False)
            before = np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array((np.arange(len(row)) - first[row]).astype(np.int32)), flat, pa.array((before - before[first][row]).astype(np.int32))], [key, "line_no", "line", "start"])

    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, line_no int, line string, start int")


def header_spans(df: DataFrame, key: str, text: str, p: Profile = GENERIC, header: str | None = None) -> DataFrame:
    """key, article_label, char_start, char_end, body: from each header to the next (trailing space off), by one window per record."""
    pattern = header or p.header
    lines = text_lines(df, key, text)
    part = lambda k: F.regexp_extract("line", pattern, k)
    bare = F.col("line").rlike(p.marker_line)
    found = lines.where(F.col("line").rlike(pattern) | bare).withColumn("article_label", F.when(bare, plain_number("line", p)).otherwise(label(part(1), part(2), part(3), p) if header is None else part(1)))
    indent = F.length(F.regexp_extract("line", r"^([ \t]*)", 1))
    starts = found.select(key, "article_label", (F.col("start") + indent).alias("char_start"))
    w = Window.partitionBy(key).orderBy("char_start")
    spans = starts.withColumn("next", F.lead("char_start").over(w))
    whole = spans.join(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), key)
    raw = F.substr("_text", F.col("char_start") + 1, F.coalesce("next", F.length("_text")) - F.col("char_start"))
    body = F.regexp_replace(raw, r"(?U)\s+$", "")
    return whole.select(key, "article_label", "char_start", (F.col("char_start") + F.length(body)).alias("char_end"), body.alias("body"))


def mentions(c: Column, p: Profile = GENERIC, shift: Column | None = None) -> Column:
    """array<struct<number, char_start, char_end>> of references in a body, in order.

    Each match is found again from the end of the one before, which is exact because matches are leftmost.
    """
    all_ = F.regexp_extract_all(c, F.lit(p.reference), F.lit(0))
    first = F.regexp_extract_all(c, F.lit(p.reference), F.lit(1))
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<number:string,char_start:int,char_end:int>>").alias("out"))
    base = shift if shift is not None else F.lit(0)

    def add(a: Column, m: Column) -> Column:
        pos = F.call_function("locate", m["whole"], c, a["at"])
        at = pos + F.call_function("locate", m["first"], m["whole"]) - 2
        hit = F.struct(plain_number(m["first"], p).alias("number"), (at + base).cast("int").alias("char_start"), (at + F.length(m["first"]) + base).cast("int").alias("char_end"))
        return F.struct((pos + F.length(m["whole"])).cast("int").alias("at"), F.concat(a["out"], F.array(hit)).alias("out"))

    return F.aggregate(F.arrays_zip(all_.alias("whole"), first.alias("first")), zero, add, lambda a: a["out"])


def article_index(df: DataFrame, key: str, text: str, p: Profile = GENERIC, version: str = "1.0.0") -> DataFrame:
    """``defines`` rows with their text and mentions; ``mentions`` rows inside them; records without headers give mentions at confidence 0.5."""
    spans = header_spans(df, key, text, p)
    got = spans.withColumn("m", mentions(F.col("body"), p, F.col("char_start"))).withColumn("m", F.filter("m", lambda x: x["char_start"] > F.col("char_start") + F.length(F.get(F.split("body", "\n"), F.lit(0)))))
    defines = got.select(key, "article_label", F.lit("defines").alias("role"), "char_start", "char_end", F.col("body").alias("text"), F.array_distinct(F.transform("m", lambda x: x["number"])).alias("mentions_articles"), F.lit(None).cast("string").alias("in_article"), F.lit(1.0).alias("parse_confidence"))
    inside = got.select(key, F.col("article_label").alias("in_article"), F.explode("m").alias("x")).select(key, F.col("x.number").alias("article_label"), F.lit("mentions").alias("role"), F.col("x.char_start").alias("char_start"), F.col("x.char_end").alias("char_end"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("mentions_articles"), "in_article", F.lit(1.0).alias("parse_confidence"))
    loose = df.join(spans.select(key).distinct(), key, "left_anti").select(key, F.explode(mentions(F.coalesce(F.col(text), F.lit("")), p)).alias("x")).select(key, F.col("x.number").alias("article_label"), F.lit("mentions").alias("role"), F.col("x.char_start").alias("char_start"), F.col("x.char_end").alias("char_end"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("mentions_articles"), F.lit(None).cast("string").alias("in_article"), F.lit(0.5).alias("parse_confidence"))
    return defines.unionByName(inside).unionByName(loose).withColumn("builder_version", F.lit(version))


def lookup(index: DataFrame, role: str | None = None, law: int | None = None, label: str | None = None) -> DataFrame:
    """Rows of the article index with a role, of a law, with a label (compared as text); what is None is not asked for."""
    for name, value in (("role", role), ("law_book_id", law), ("article_label", None if label is None else str(label))):
        index = index.where(F.col(name) == value) if value is not None else index
    return index


def with_titles(rows: DataFrame, laws: DataFrame, fields: tuple[str, ...] = ("title", "year", "status_label", "law_flag", "source_url"), key: str = "law_book_id") -> DataFrame:
    """Adds a law's fields; a law without a row of its own has empty ones, and rows are never lost or repeated."""
    one = laws.groupBy(key).agg(F.min(F.struct(*fields)).alias("_l"))
    return rows.join(one, key, "left").select("*", *[F.coalesce(F.col(f"_l.{f}").cast("string"), F.lit("")).alias(f) for f in fields]).drop("_l")
