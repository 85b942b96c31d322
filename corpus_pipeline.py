"""The corpus pipeline: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each
stage's result as Parquet in the shared folder and reads it back as the next stage's
docs, so a lost executor never recomputes an earlier stage. All stages but the last
return the columns of ``documents``, and further columns as they are.

A null, empty or very short text fails the quality rules, so it goes in the first stage. A null
id counts as others do (of fold 0) and is packed under a null id. Repeated rows pass the first two stages
together; near_dedup keeps one. Very long texts are judged and packed whole. Empty tables give
no rows; without labels the models give one verdict for all: everything is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import neardup, packing, quality, toxicity
from textloom.llm._io import PREFIX, scored, stored, table
from textloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = scored(docs, lambda texts: {PREFIX + "kept": quality.verdicts(model, texts)["kept"]}, PREFIX + "kept boolean")
    return found.where(PREFIX + "kept").select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = scored(docs, lambda texts: {PREFIX + "score": toxicity.score(model, texts)}, PREFIX + "score double")
    return found.where(F.col(PREFIX + "score") < 0.5).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the least doc_id.

    Rows are told apart by id and text; one without an id stays unless it is a copy of a text that has one. Of rows that repeat an
    id and its text, one stays: the first by its other columns. Rows that nothing touches (told by a bitmap of bounded
    size) stay where they are, so only copies and the few rows that share a bit with them are shuffled.
    """
    key, text = PREFIX + "id", PREFIX + "text_hash"
    found = neardup.near_duplicates(docs, n=5, similarity=0.8)
    groups = found.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(text)).agg(F.bool_or("kept").alias(PREFIX + "kept"), F.count("*").alias(PREFIX + "n"))
    touched = stored(groups.where(f"not {PREFIX}kept or {PREFIX}n > 1").select(key, text, PREFIX + "kept"), "touched")
    rows = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(text, neardup.text_hash())
    some = neardup.likely(rows, touched, text, PREFIX + "hit")
    apart = some.where(PREFIX + "hit").alias("r").join(touched.alias("t"), F.expr(f"r.{key} <=> t.{key} AND r.{text} = t.{text}"), "left").select("r.*", f"t.{PREFIX}kept")
    alone = apart.where(f"{PREFIX}kept is null").select(docs.columns)
    again = apart.where(PREFIX + "kept").groupBy(key, text).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*").select(docs.columns)
    return some.where(f"not {PREFIX}hit").select(docs.columns).unionByName(alone).unionByName(again)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents; one row per piece."""
    return packing.digests(packing.pack(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_duplicate_stage), ("packing", packing_stage)]

#: Learned models and a tokenizer are not SQL; tests/llm holds run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
