"""Splitting records into chunks: segments at marker lines, greedy packing, hard wraps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, padded, reference_numbers, strip
from ..profile import GENERIC, Profile

TARGET, MOST = 1500, 2500


def segments(c: str | Column, p: Profile = GENERIC) -> Column:
    """Pieces that each start at a marker line (a line of only a number); empty pieces are dropped."""
    cut = "(?md)(?=" + p.marker_line + ")"
    return F.filter(F.transform(F.split(col(c), cut), strip), lambda s: s != "")


def packed(parts: Column, target: int = TARGET, most: int = MOST) -> Column:
    """Greedy: a segment joins the buffer unless both together pass the target; then buffers over ``most`` are cut.

    The buffer is a list of segments and a length, joined once when it is closed, so a fold over a long text
    does not copy its text again and again.
    """
    text = "array<string>"
    zero = F.struct(F.array().cast(text).alias("out"), F.array().cast(text).alias("buf"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + F.length(s) > target)
        whole = F.array_join(acc["buf"], "\n\n")
        start = F.when(full, F.array(s)).otherwise(F.concat(acc["buf"], F.array(s)))
        n = F.when(full, F.length(s)).otherwise(acc["n"] + F.length(s) + F.when(acc["n"] > 0, 2).otherwise(0))
        out = F.when(full, F.concat(acc["out"], F.array(whole))).otherwise(acc["out"])
        # what is over the hard cap leaves in slices; the last slice stays the buffer
        joined = F.array_join(start, "\n\n")
        k = F.floor((n - 1) / most).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.substr(joined, i * most + 1, F.lit(most)))
        over = n > most
        tail = F.substr(joined, k * most + 1)
        return F.struct(F.when(over, F.concat(out, cut)).otherwise(out).alias("out"), F.when(over, F.array(tail)).otherwise(start).alias("buf"), F.when(over, F.length(tail)).otherwise(n).cast("int").alias("n"))

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["buf"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["buf"], "\n\n")))).otherwise(acc["out"])

    return F.aggregate(parts, zero, add, finish)


def chunk_records(df: DataFrame, key: str, title: str | None, text: str, p: Profile = GENERIC, target: int = TARGET, most: int = MOST) -> DataFrame:
    """One row per chunk: the record's other columns, chunk_no, chunk_id ``key#no``, chunk_text, article_arr, article_nums.

    Empty text gives no chunk; text within ``most`` one; article numbers are read from title and body together.
    A map over rows: no shuffle.
    """
    body = strip(F.coalesce(F.col(text), F.lit("")))
    pieces = F.when(body == "", F.array().cast("array<string>")).when(F.length(body) <= most, F.array(body)).otherwise(packed(segments(body, p), target, most))
    rows = df.select("*", F.posexplode(pieces).alias("chunk_no", "chunk_body"))
    head = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n\n")) if title else F.lit("")
    out = rows.withColumn("chunk_id", F.concat_ws("#", F.col(key).cast("string"), F.col("chunk_no").cast("string"))).withColumn("chunk_text", F.concat(head, F.col("chunk_body")))
    return out.withColumn("article_arr", reference_numbers("chunk_text", p)).withColumn("article_nums", padded("article_arr")).drop("chunk_body", text)
