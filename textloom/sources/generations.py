"""Tables that change together: generations behind a pointer, a lock, steps that a restarted run takes up; and tables in key buckets.

Layout under a root: ``commits/<n>`` names the path of each table of generation n, ``data/<n>/<table>`` holds what generation n wrote, ``lock``
is there while a run works. A commit is one rename of a whole file, so readers see all new tables or none; tables that
a run leaves alone stay where they are.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import last_wins, stale_routes
from .records import exists


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file; False if it is there already."""
    fs, at = _fs(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as e:  # noqa: BLE001
        if fs.exists(at):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _read_small(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class Locked(Exception):
    """Another run works on these tables."""


class Lock:
    """``with Lock(spark, root):``. The lock file is created only if it is not there; one older than ``stale`` seconds is a dead run's."""

    def __init__(self, spark: SparkSession, root: str, stale: float = 6 * 3600.0):
        self.spark, self.path, self.stale, self.owner = spark, f"{root}/lock", stale, uuid.uuid4().hex

    def __enter__(self) -> Lock:
        text = json.dumps({"owner": self.owner, "at": time.time()})
        if not _write_new(self.spark, self.path, text):
            held = self.holder()
            if held is not None and time.time() - held.get("at", 0) < self.stale:
                raise Locked(f"held by {held.get('owner')}")
            fs, at = _fs(self.spark, self.path)
            aside = _fs(self.spark, f"{self.path}-{self.owner}")[1]
            if fs.exists(at) and fs.rename(at, aside):  # one of several that see it wins
                fs.delete(aside, False)
            if not _write_new(self.spark, self.path, text):
                raise Locked("taken by another run")
        return self

    def __exit__(self, *_) -> None:
        held = self.holder()
        if held is not None and held.get("owner") == self.owner:
            fs, at = _fs(self.spark, self.path)
            fs.delete(at, False)

    def holder(self) -> dict | None:
        if not exists(self.spark, self.path):
            return None
        try:
            return json.loads(_read_small(self.spark, self.path) or "{}")
        except ValueError:  # it is being written
            return {"at": time.time()}


def generation(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The last committed generation and its tables' paths; (0, {}) before the first."""
    fs, at = _fs(spark, f"{root}/commits")
    if not fs.exists(at):
        return 0, {}
    last = max((int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()), default=0)
    return last, json.loads(_read_small(spark, f"{root}/commits/{last}")) if last else {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(generation(spark, root)[1][name])


Step = tuple[str, Callable[[Callable[[str], DataFrame]], DataFrame]]


def refresh(spark: SparkSession, root: str, steps: list[Step], stale: float = 6 * 3600.0, between: Callable[[str], None] | None = None) -> int:
    """Runs the steps and commits their tables as one generation; gives its number.

    A step is (table, make): ``make(read)`` gives the table's new rows, and ``read(name)`` is that table as of this run: new if a step
    before made it, else the committed one (KeyError if there is none). Each table is written whole. A run that ended early left
    whole tables and no commit: the next run keeps them and goes on. Readers keep the old generation until the
    commit. ``between`` is called after each step and before the commit (for tests).
    """
    with Lock(spark, root, stale):
        last, paths = generation(spark, root)
        n, made = last + 1, {}

        def read(name: str) -> DataFrame:
            return spark.read.parquet(made.get(name) or paths[name])

        for name, make in steps:
            at = f"{root}/data/{n}/{name}"
            if not exists(spark, f"{at}/_SUCCESS"):
                make(read).write.mode("overwrite").parquet(at)
            made[name] = at
            if between:
                between(name)
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        _write_new(spark, draft, json.dumps(paths | made, sort_keys=True))
        if between:
            between("commit")
        fs, target = _fs(spark, f"{root}/commits/{n}")
        fs.mkdirs(_fs(spark, f"{root}/commits")[1])
        if fs.exists(target) or not fs.rename(_fs(spark, draft)[1], target):
            raise Locked(f"generation {n} was committed by another run")
        return n


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Removes commits before the last ``keep`` and the tables that none of those left names; gives the paths removed."""
    with Lock(spark, root):
        last, _ = generation(spark, root)
        fs, _ = _fs(spark, root)
        numbers = [k for k in range(1, last + 1) if exists(spark, f"{root}/commits/{k}")]
        used = {p for k in numbers[-keep:] for p in json.loads(_read_small(spark, f"{root}/commits/{k}")).values()}
        old = {p for k in numbers[:-keep] for p in json.loads(_read_small(spark, f"{root}/commits/{k}")).values()} - used
        for p in sorted(old):
            fs.delete(_fs(spark, p)[1], True)
        for k in numbers[:-keep]:
            fs.delete(_fs(spark, f"{root}/commits/{k}")[1], False)
        return sorted(old)


# --- tables in buckets ---
def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A table dealt into folders by a hash of its key, so that an upsert touches the buckets of its keys only."""
    df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def rewrite_touched(spark: SparkSession, path: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame], schema: str) -> int:
    """Writes the buckets in ``touched`` (column bucket) anew as ``change`` of their rows; gives their number. Other buckets' files stay as they are.

    A bucket that is left without rows is dropped. The folders are replaced when all new ones are written.
    """
    numbers = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())  # at most as many as there are buckets
    if not numbers:
        return 0
    old = spark.read.schema(f"{schema}, bucket int").parquet(path).where(F.col("bucket").isin(numbers)) if exists(spark, path) else spark.createDataFrame([], f"{schema}, bucket int")
    changed = change(old)
    left = {r["bucket"] for r in changed.select("bucket").distinct().collect()}
    changed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    fs, _ = _fs(spark, path)
    for b in set(numbers) - left:
        fs.delete(_fs(spark, f"{path}/bucket={b}")[1], True)
    return len(numbers)


def append_routes(new: DataFrame, path: str, key: str, payload: str, buckets: int, make: Callable[[DataFrame], DataFrame] | None = None, remove_absent: bool = False) -> dict[str, int]:
    """Brings a bucketed table of routes to ``new``: rows whose payload is the same stay, stale ones are replaced, new ones added.

    ``make`` completes the rows to write (an embedding, say) and is called for new and stale ones only. Keys that ``new`` lacks stay, or go
    with ``remove_absent``. A key that ``new`` repeats counts once, with its greatest payload. Gives counts by state and the buckets written.
    """
    spark = new.sparkSession
    one = last_wins(new.withColumn("_order", F.col(payload)), [key], "_order").drop("_order")
    had = exists(spark, path)
    old = spark.read.parquet(path) if had else spark.createDataFrame([], one.select(key, payload).schema)
    state = stale_routes(old, one, key, payload)
    gone = old.join(one, key, "left_anti").select(key, F.lit("gone").alias("state")) if remove_absent else state.limit(0)
    state = state.unionByName(gone)
    counts = {r["state"]: r["n"] for r in state.groupBy("state").agg(F.count("*").alias("n")).collect()}
    todo = state.where("state <> 'same'").withColumn("bucket", bucket_of(key, buckets))
    rows = one.join(todo.where("state <> 'gone'").select(key, "bucket"), key)
    full = make(rows.drop("bucket")) if make else rows.drop("bucket")
    columns = full.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema.fields)

    def change(held: DataFrame) -> DataFrame:
        kept = held.join(todo.select(key), key, "left_anti").select(*columns, "bucket")
        return kept.unionByName(full.withColumn("bucket", bucket_of(key, buckets)).select(*columns, "bucket"))

    written = rewrite_touched(spark, path, todo, change, schema)
    return {"new": 0, "stale": 0, "same": 0, "gone": 0} | counts | {"buckets": written}
