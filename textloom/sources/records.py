"""Reading and writing JSON-lines records, side tables and small state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.upsert import last_wins
from ..schemas import LAW


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and value of every line of text files, empty ones included, however the files are split.

    A task numbers the lines of each split it reads; the number of a split's first line is the sum of the lines of the splits
    before it. Only a count for each split is shuffled.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            file, start = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            # rows of a split stand together and in its order
            new = [0, *(i for i in range(1, len(file)) if start[i] != start[i - 1] or file[i] != file[i - 1])]
            place = np.empty(len(file), np.int64)
            for lo, hi in zip(new, [*new[1:], len(file)], strict=True):
                n = n if at == (file[lo], start[lo]) else 0
                at = (file[lo], start[lo])
                place[lo:hi] = np.arange(n, n + hi - lo)
                n += hi - lo
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], ["file", "_start", "value", "_place"])

    placed = lines.mapInArrow(run, "file string, _start long, value string, _place long")
    counts = lines.groupBy("file", "_start").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("file").orderBy("_start")) - F.col("_n")).drop("_n")
    return placed.join(before, ["file", "_start"]).select("file", (F.col("_before") + F.col("_place") + 1).alias("line_no"), "value")


def read_lenient(spark: SparkSession, path: str, schema: str = LAW) -> DataFrame:
    """Objects of a JSON-lines file; bad and blank lines are left out (``quarantine`` has them)."""
    lines = spark.read.text(path).select("value", F.lit(None).cast("string").alias("file"), F.lit(0).alias("line_no"))
    return _parsed(lines, schema).where("_corrupt_record is null").drop("_corrupt_record", "value", "file", "line_no")


def quarantine(spark: SparkSession, path: str, schema: str = LAW) -> DataFrame:
    """_file, line_no and _line of what ``read_lenient`` leaves out, blank lines apart."""
    return _parsed(numbered_lines(spark, path), schema).where("_corrupt_record is not null").select(F.col("file").alias("_file"), "line_no", F.col("value").alias("_line"))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    got = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", schema + ", _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return got.select("r.*", "value", "file", "line_no").withColumn("_corrupt_record", F.when(~F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(F.col("_corrupt_record")))


def read_strict(spark: SparkSession, path: str, schema: str = LAW) -> DataFrame:
    """Fails at a line that is no JSON object of the schema, with ``path:line``. Blank lines are passed over."""
    got = _parsed(numbered_lines(spark, path), schema)
    where = F.concat(F.regexp_replace("file", "^.*/", ""), F.lit(":"), F.col("line_no").cast("string"), F.lit(" is no JSON object of the schema"))
    names = [c for c in got.columns if c not in ("_corrupt_record", "value", "file", "line_no")]
    # the check stands in every column, so that none can be read around it
    checked = [F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(where).cast(got.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in names]
    return got.select(*checked)


def read_side_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A side table, or an empty one if there is no such file."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_last_wins(spark: SparkSession, path: str, schema: str, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key: by a column, or by place: the later file by name, then the later line, however the files are split.

    An append log of Spark's own parts has no order of lines between its files: give it an order column.
    """
    if order:
        return last_wins(read_side_table(spark, path, schema), keys, order)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = _parsed(numbered_lines(spark, path), schema).where("_corrupt_record is null")
    return last_wins(rows.withColumn("_seq", F.struct("file", "line_no")).drop("_corrupt_record", "value", "file", "line_no"), keys, "_seq").drop("_seq")


def master_order(df: DataFrame, key: str = "lawBookID", identity: str = "identity") -> DataFrame:
    """Sorted as master files are: by whole number of the key, then records without one by identity. Written, the parts follow each other in this order."""
    number = F.col(key).cast("string").try_cast("bigint")
    return df.orderBy(number.isNull(), number, F.when(number.isNull(), F.col(identity)))


def first_records(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def write_json(df: DataFrame, path: str, append: bool = False, single: bool = False) -> None:
    """JSON lines without nulls; ``single`` for side files that are known to be small."""
    (df.coalesce(1) if single else df).write.mode("append" if append else "overwrite").option("ignoreNullFields", "true").json(path)


def write_atomic(df: DataFrame, path: str) -> None:
    """Replaces a table by two renames: the old one aside, the new one in its place. df may read from the old one.

    A failed second rename puts the old one back. After a crash in between, the next call (or ``recover``) does so.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old, aside = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("._new", "", "._old"))
    fs = old.getFileSystem(conf)
    recover(spark, path)
    df.write.mode("overwrite").parquet(path + "._new")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"can't rename to {path}")
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """Ends what a crash inside ``write_atomic`` left: the old table goes back if no new one took its place."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, aside = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", "._old"))
    fs = old.getFileSystem(conf)
    if fs.exists(aside):
        if fs.exists(old):
            fs.delete(aside, True)
        else:
            fs.rename(aside, old)


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def new_rows(df: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows whose key the store lacks; only the key column of the store is read."""
    return df.join(store.select(key), key, "left_anti")


def first_new(df: DataFrame, store: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """The first n rows that the store lacks: the limit holds after the known ones are left out."""
    return first_records(new_rows(df, store, key), n, order)


def results_json(df: DataFrame, note: str, qid: str = "qid") -> DataFrame:
    """qid and ``result``: the answer's fields and a note as one JSON object, nulls included."""
    rest = [c for c in df.columns if c != qid]
    return df.select(qid, F.to_json(F.struct(*rest, F.lit(note).alias("disclaimer")), {"ignoreNullFields": "false"}).alias("result"))


def mirror(df: DataFrame, path: str, other: str) -> None:
    if path != other:
        df.write.mode("overwrite").parquet(other)


def save_state(spark: SparkSession, state: dict, path: str) -> None:
    """A run's small state (last page, total, watermark, notes) as one JSON row; ids that were fetched are a table of their own."""
    write_atomic(spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "state STRING").coalesce(1), path)


def load_state(spark: SparkSession, path: str) -> dict:
    """The saved state; an empty one if there is none."""
    recover(spark, path)
    return json.loads(spark.read.parquet(path).first()["state"]) if exists(spark, path) else {}


def backfill(spark: SparkSession, path: str, column: str, value: Column) -> None:
    """Sets a column of a stored table, new or old, from its other columns; readers see the old table until the new one is whole."""
    write_atomic(spark.read.parquet(path).withColumn(column, value), path)
