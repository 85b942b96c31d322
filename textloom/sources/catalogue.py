"""Catalogue pages as a batch and streaming data source, detail pages, and the two ways to walk: in full with resume, and newest first.

Both walks keep what they did in tables and a small state under one path, so that a run that ended anywhere, killed or
failed, is taken up by the next call, and the tables end the same.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import CATALOG_ITEM
from ..shipping import ship
from .records import exists, load_state, save_state
from .transport import Challenge, Refused, Transport, sender, share

FORMAT = "catalog_pages"


class CatalogSource(DataSource):
    """``spark.read.format("catalog_pages").option("template", "https://host/list?page={page}")``, or ``spark.readStream``.

    A page is a JSON object with ``items`` and ``totalCount``. Options: template (an address, or a path that all
    machines have), pagesize, first (number of the first page, 0), from (the page to begin with), pages (how many; by default to
    the stated total), parallel (tasks that ask at a time, 8), delay (seconds between two requests, of all tasks together), tries.
    A page that is missing before the stated total is an error, not an empty page.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CATALOG_ITEM + ", page INT, pos BIGINT, total BIGINT"

    def reader(self, schema) -> DataSourceReader:
        return CatalogReader(schema, self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CatalogStreamReader(schema, self.options)


class Pages(InputPartition):
    def __init__(self, numbers: list[int], task: int, tasks: int):
        super().__init__(task)
        self.numbers, self.task, self.tasks = numbers, task, tasks


class _Reader:
    def __init__(self, schema, options):
        self.fields = [f.name for f in schema.fields][:-3]
        self.types = {f.name: f.dataType.typeName() for f in schema.fields}
        self.template, self.size = options["template"], int(options.get("pagesize", "20"))
        self.first = int(options.get("first", "0"))
        self.begin = int(options.get("from", self.first))
        self.pages = int(options["pages"]) if options.get("pages") is not None else None
        self.parallel, self.delay, self.tries = int(options.get("parallel", "8")), float(options.get("delay", "0")), int(options.get("tries", "4"))

    def transport(self, task: int = 0, tasks: int = 1) -> Transport:
        delay, wait = share(self.delay, tasks, task)
        return Transport(sender(self.template), self.tries, delay, wait)

    def fetch(self, page: int, over: Transport) -> dict:
        try:
            return over.get_json(self.template.format(page=page))
        except Refused as e:
            if e.status != 404 or page == self.first:
                raise
            total = int(over.get_json(self.template.format(page=self.first)).get("totalCount") or 0)
            if (page - self.first) * self.size < total:
                raise
            return {"items": [], "totalCount": total}

    def dealt(self, begin: int, end: int) -> list[Pages]:
        tasks = max(1, min(self.parallel, end - begin))
        return [Pages(list(range(begin + k, end, tasks)), k, tasks) for k in range(tasks)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        over = self.transport(partition.task, partition.tasks)
        for page in partition.numbers:
            got = self.fetch(page, over)
            for i, item in enumerate(got.get("items") or []):
                row = [item.get(f) for f in self.fields]
                row = [(int(v) if str(v).lstrip("-").isdigit() else None) if v is not None and self.types[f] == "long" else None if v is None else str(v) for f, v in zip(self.fields, row, strict=True)]
                yield (*row, page, (page - self.first) * self.size + i, int(got.get("totalCount") or 0))


class CatalogReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Pages]:
        end = self.begin + self.pages if self.pages is not None else self.first + -(-int(self.fetch(self.first, self.transport()).get("totalCount") or 0) // self.size)
        return self.dealt(self.begin, max(end, self.begin + 1))


class CatalogStreamReader(_Reader, DataSourceStreamReader):
    """Offsets are page numbers; each batch is ``step`` pages. Option from: the first page that is not yet done."""

    def __init__(self, schema, options):
        super().__init__(schema, options)
        self.step, self.at = int(options.get("step", "5")), self.begin

    def initialOffset(self) -> dict:
        return {"page": self.begin}

    def latestOffset(self) -> dict:
        self.at += self.step
        return {"page": self.at}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.dealt(start["page"], end["page"])

    def commit(self, end: dict) -> None: ...


def source(spark: SparkSession, options: dict, streaming: bool = False):
    """A reader of the catalogue, with the package on the executors' path."""
    ship(spark)
    spark.dataSource.register(CatalogSource)
    return (spark.readStream if streaming else spark.read).format(FORMAT).options(**{k: str(v) for k, v in options.items()})


def ids_of(spark: SparkSession, path: str, key: str) -> DataFrame:
    found = spark.read.parquet(path).select(F.col(key).cast("bigint").alias(key)) if exists(spark, path) else spark.createDataFrame([], f"`{key}` bigint")
    return found.where(F.col(key).isNotNull()).distinct()


# --- newest first, as a stream ---
def discover(spark: SparkSession, options: dict, known: DataFrame, path: str, key: str = "lawBookID", least: int | None = None, limit: int | None = None, poll: float = 0.2, between: Callable[[int], None] | None = None) -> dict:
    """Reads the catalogue newest first as a stream until ``least`` known ids stand in a row at a page's end; gives the final state.

    path/found has the unknown items, each once. A batch of pages is read once, into path/pages; what it found and
    the new state follow. The state names the last batch that is done, so a batch that Spark runs again after a crash is
    passed over without a request. When the state says stopped, no further page is asked for. known: a frame with ``key``.
    A finished discovery stays finished: begin the next one at another path. ``between`` is called after each batch is stored (for tests).
    """
    size = int(options.get("pagesize", 20))
    least = least or max(2 * size, 20)
    start = {"page": int(options.get("first", 0)), "streak": 0, "found": 0, "batch": -1, "stopped": ""}
    state = start | load_state(spark, f"{path}/state")
    if state["stopped"]:
        return state
    step = int(options.get("step", 5))
    last: dict = {}  # the state as this run has saved it: the table itself is being replaced while the loop below looks

    def each(batch: DataFrame, number: int) -> None:
        now = start | load_state(spark, f"{path}/state")
        if now["stopped"] or number <= now["batch"]:
            return
        at = f"{path}/pages/batch={number}"
        if not exists(spark, f"{at}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(at)
        if between:
            between(number)
        after = now | _digest(spark, at, known, path, number, now, key, size, least, limit, step, start["page"])
        save_state(spark, after, f"{path}/state")
        last.update(after)

    stream = source(spark, options | {"from": state["page"], "step": step}, True).load()
    run = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        while run.isActive and not last.get("stopped"):
            run.awaitTermination(poll)
    finally:
        run.stop()
    if run.exception() is not None:
        raise run.exception()
    return start | load_state(spark, f"{path}/state")


def _digest(spark: SparkSession, at: str, known: DataFrame, path: str, number: int, now: dict, key: str, size: int, least: int, limit: int | None, step: int, first: int) -> dict:
    """Writes what a batch of pages found; gives the state after it. One window over the rows of a batch: a few pages."""
    rows = spark.read.parquet(at).where(F.col(key).isNotNull())
    before = known.select(F.col(key).cast("bigint").alias(key)).unionByName(ids_of(spark, f"{path}/found", key)) if number else known.select(F.col(key).cast("bigint").alias(key))
    flagged = rows.join(before.distinct().withColumn("_old", F.lit(1)), key, "left")
    again = F.row_number().over(Window.partitionBy(key).orderBy("pos")) > 1
    flagged = flagged.withColumn("_known", F.when(again | F.col("_old").isNotNull(), 1).otherwise(0))
    order = Window.orderBy("pos")
    isle = flagged.withColumn("_isle", F.sum(1 - F.col("_known")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = isle.withColumn("_streak", F.sum("_known").over(Window.partitionBy("_isle").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("_isle") == 0, now["streak"]).otherwise(0))
    ends = {r["page"]: r["s"] for r in run.groupBy("page").agg(F.max_by("_streak", "pos").alias("s")).collect()}  # a row a page of the batch
    total = spark.read.parquet(at).agg(F.max("total")).first()[0]
    stop = min((p for p, s in ends.items() if s >= least), default=None)
    new = run.where((F.col("_known") == 0) & (F.col("page") <= stop if stop is not None else F.lit(True))).select(*rows.columns)
    if limit is not None:
        new = new.orderBy("pos").limit(max(0, limit - now["found"]))
    new.write.mode("overwrite").parquet(f"{path}/found/batch={number}")
    found = now["found"] + spark.read.parquet(f"{path}/found/batch={number}").count()
    last = now["page"] + step
    why = "known" if stop is not None else "limit" if limit is not None and found >= limit else "end" if total is None or (last - first) * size >= total else ""
    return {"page": last, "streak": ends[max(ends)] if ends else now["streak"], "found": found, "batch": number, "stopped": why}


# --- in full, with resume ---
def fetched(items: DataFrame, url: Column, tasks: int = 8, delay: float = 0.0, tries: int = 4, make: Callable[[int, int], Transport] | None = None) -> DataFrame:
    """Adds body and error (type and message) of each item's page. After a challenge page a task asks for nothing more: error ``not asked``.

    The frame is dealt out to ``tasks`` tasks, which share the pace. ``make(task, tasks)`` gives another transport.
    """
    ship(items.sparkSession)
    names = items.columns

    def over(task: int) -> Transport:
        if make is not None:
            return make(task, tasks)
        each, wait = share(delay, tasks, task)
        return Transport(lambda u: sender(u)(u), tries, each, wait)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport, blocked = None, False
        for f in frames:
            bodies, errors = [], []
            for u in f["_url"]:
                transport = transport or over(TaskContext.get().partitionId())
                body, error = None, None
                if blocked:
                    error = "not asked"
                else:
                    try:
                        body = transport.get(u)
                    except Challenge as e:
                        blocked, error = True, f"Challenge: {e}"
                    except Exception as e:  # noqa: BLE001  one page's fault is that row's
                        error = f"{type(e).__name__}: {e}"
                bodies.append(body)
                errors.append(error)
            yield f.drop(columns="_url").assign(body=bodies, error=errors)[[*names, "body", "error"]]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields] + ["body string", "error string"])
    return items.withColumn("_url", url).repartition(tasks).mapInPandas(run, schema)


def walk(spark: SparkSession, options: dict, path: str, url: Column | None = None, known: DataFrame | None = None, key: str = "lawBookID", step: int = 20, tasks: int = 8, make: Callable[[int, int], Transport] | None = None, between: Callable[[int], None] | None = None) -> dict:
    """Reads the whole catalogue, ``step`` pages at a time, and each new item's detail page; gives the final state.

    path/items has the items with ``body``, path/errors the ids that failed, with their error, and path/state how far the walk is. A
    step's tables are written whole before the state moves on, and a step that was cut short is done again over the same
    files. Ids in ``known`` or in an earlier step are not fetched. A challenge page ends the run with ``blocked``; the next call goes on
    with that step. ``between`` is called after a step's tables, before its state (for tests).
    """
    from ..operators.sync import pending

    first = int(options.get("first", 0))
    state = {"page": first, "step": 0, "total": None, "blocked": "", "done": False} | load_state(spark, f"{path}/state")
    if state["done"]:
        return state
    state["blocked"] = ""
    size = int(options.get("pagesize", 20))
    while True:
        n, at = state["step"], state["page"]
        pages = f"{path}/pages/step={n}"
        if not exists(spark, f"{pages}/_SUCCESS"):
            source(spark, options | {"from": at, "pages": step}).load().write.mode("overwrite").parquet(pages)
        rows = spark.read.parquet(pages)
        total = rows.agg(F.max("total")).first()[0]
        earlier = spark.createDataFrame([], f"`{key}` bigint")
        for name in ("items", "errors"):
            if n and exists(spark, f"{path}/{name}"):
                earlier = earlier.unionByName(spark.read.parquet(f"{path}/{name}").where(F.col("step") < n).select(F.col(key).cast("bigint").alias(key)))
        if known is not None:
            earlier = earlier.unionByName(known.select(F.col(key).cast("bigint").alias(key)))
        todo = pending(rows, earlier.distinct(), key)
        if url is None:
            todo.withColumns({"body": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).write.mode("overwrite").parquet(f"{path}/fetched")
        else:
            fetched(todo, url, tasks, float(options.get("delay", 0)), int(options.get("tries", 4)), make).write.mode("overwrite").parquet(f"{path}/fetched")
        got = spark.read.parquet(f"{path}/fetched")
        blocked = got.where("error like 'Challenge%'").agg(F.min("error")).first()[0]
        if blocked:
            state["blocked"] = blocked
            save_state(spark, state, f"{path}/state")
            return state
        got.where("error is null").drop("error").write.mode("overwrite").parquet(f"{path}/items/step={n}")
        got.where("error is not null").select(key, "page", "error").write.mode("overwrite").parquet(f"{path}/errors/step={n}")
        if between:
            between(n)
        state |= {"page": at + step, "step": n + 1, "total": total, "done": total is None or (at + step - first) * size >= total}
        save_state(spark, state, f"{path}/state")
        if state["done"]:
            return state


def retry_errors(spark: SparkSession, path: str, url: Column, key: str = "lawBookID", tasks: int = 8, delay: float = 0.0, make: Callable[[int, int], Transport] | None = None) -> DataFrame:
    """Asks again for the ids in path/errors that no later run has fetched; adds what came to path/items as a step of its own; gives what is left."""
    errors = spark.read.parquet(f"{path}/errors")
    left = errors.select(F.col(key).cast("bigint").alias(key)).distinct().join(ids_of(spark, f"{path}/items", key), key, "left_anti")
    items = spark.read.parquet(f"{path}/pages").drop("step").join(left, key, "left_semi")
    one = items.groupBy(key).agg(F.min_by(F.struct(*[c for c in items.columns if c != key]), "pos").alias("_r")).select(key, "_r.*")
    name = f"{path}/retried-{time.time_ns()}"
    fetched(one, url, tasks, delay, make=make).write.parquet(name)
    got = spark.read.parquet(name)
    step = (spark.read.parquet(f"{path}/items").agg(F.max("step")).first()[0] or 0) + 1
    got.where("error is null").drop("error").write.mode("overwrite").parquet(f"{path}/items/step={step}")
    return got.where("error is not null").select(key, "page", "error")
