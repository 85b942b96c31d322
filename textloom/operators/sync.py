"""Walking a paged catalogue: where it ends, what is left to fetch, how far it got."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walked(pages: DataFrame, start: int = 1, page: str = "page", size: str = "size", total: str = "total", count: str = "n") -> DataFrame:
    """The pages that a walk from ``start`` reads: up to the first without items or at the catalogue's end, that one included.

    One row for each page: its number, the asked page size, the stated total and its number of items.
    """
    from_ = pages.where(F.col(page) >= start)
    last = from_.where((F.col(count) == 0) | (F.col(page) * F.col(size) >= F.col(total))).agg(F.min(page).alias("_last"))
    return from_.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(page) <= F.col("_last"))).drop("_last")


def pending(items: DataFrame, done: DataFrame, key: str = "lawBookID", page: str = "page", pos: str = "pos") -> DataFrame:
    """Items to fetch: with a whole number as id, not yet done, each id once (its first place)."""
    known = items.withColumn(key, F.col(key).try_cast("bigint")).where(F.col(key).isNotNull())
    left = known.join(done.select(F.col(key).cast("bigint").alias(key)).distinct(), key, "left_anti")
    rest = [c for c in left.columns if c != key]
    return left.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(page, pos)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def watermark(records: DataFrame, key: str = "lawBookID", date: str = "date_iso") -> DataFrame:
    """One row: the greatest id and the latest date that is not blank."""
    day = F.nullif(F.trim(date), F.lit(""))
    return records.agg(F.max(F.col(key).try_cast("bigint")).alias("watermark_id"), F.max(day).alias("watermark_date"))


def advanced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The watermark after a run; it never goes back."""
    return old.unionByName(new).agg(F.max("watermark_id").alias("watermark_id"), F.max("watermark_date").alias("watermark_date"))
