"""Intermediate tables, folds and bounded samples."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Names of working columns start with this, so that none clashes with a column of the input.
PREFIX = "__tl_"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all machines share; where it is unset, one of our own in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, so the loss of an executor costs no recomputation.

    The folder goes when the driver's Python ends.
    """
    return _written(df, what, codec)[0]


def _written(df: DataFrame, what: str, codec: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/textloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


class Tables:
    """Stored tables by name. A new table of a name takes the place of the old one, whose files go at once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        made, path = _written(df, name, codec)
        self.drop(name)
        self.paths[name] = path
        return made

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                _remove(self.spark, self.paths.pop(name))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended already; its folder goes with the cluster's
        pass


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % parts, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, spread: tuple[int, ...] = (0, 1), most_chars: int = 50_000) -> list[tuple[str, int]]:
    """(text, label) of at most ``most`` labelled training rows for each label value.

    Training rows are those whose fold of 5 is not 0. Rows are taken in the order of a
    hash of their ids, so the sample is the same at each run. Null texts read as empty.
    The bound is what makes the collected rows and the broadcast ids small; for the same reason
    rows of more than ``most_chars`` characters are no part of the sample (they are scored as all others).
    """
    known = labels.where(F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", F.col(label).alias("y"))
    parts = [known.where(F.col("y") == v).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in spread]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    got = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most * len(spread)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
    return [(r["text"], int(r["y"])) for r in got.collect()]


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow, with this package on the executors' path."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def scored(df: DataFrame, fn, fields: str, keep: list[str] | None = None) -> DataFrame:
    """Adds what ``fn(texts) -> dict of arrays`` gives for column text, in Arrow batches; no shuffle."""
    kept = [c for c in (df.columns if keep is None else keep)]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(PREFIX + "text"))
    at = len(kept)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:at]] + [fields])
    names = [x.strip().split()[0] for x in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = fn(b.column(at))
                cols = [*b.columns[:at], *(v if isinstance(v, pa.Array) else pa.array(v) for v in (made[n] for n in names))]
                yield pa.RecordBatch.from_arrays(cols, [*kept, *names])

    return mapped(src, run, schema)
