"""Jobs that ask models: cards from an attempt ledger, answers with a cache and a check of their citations.

What a model said is written before it is used, so a run that is cut short, or a batch that is run again, asks nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .functions.text import looks_truncated
from .operators.cards import parse_cards
from .operators.reports import citation_gate
from .operators.upsert import last_wins
from .providers import Chat, asked
from .shipping import ship
from .sources.generations import bucket_of, rewrite_touched
from .sources.records import exists

LEDGER = "law_book_id BIGINT, title STRING, run INT, round INT, model STRING, calls INT, status INT, error STRING, raw STRING, cost DOUBLE, prompt_tokens BIGINT, completion_tokens BIGINT"


def called(rows: DataFrame, prompt: Column, chat: Chat, tries: int = 7, tasks: int = 8, pause: Callable[[float], None] | None = None) -> DataFrame:
    """rows with raw, calls, status, error, cost, prompt_tokens, completion_tokens and finish of one model's answer to ``prompt``."""
    ship(rows.sparkSession)
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [asked(chat, p or "", tries, **({"sleep": pause} if pause else {})) for p in f["_prompt"]]
            more = {
                "raw": [g[0].text for g in got], "calls": [g[1] for g in got], "status": [g[0].status for g in got], "error": [g[2] for g in got], "cost": [float(g[0].cost) for g in got],
                "prompt_tokens": [g[0].prompt_tokens for g in got], "completion_tokens": [g[0].completion_tokens for g in got], "finish": [g[0].finish for g in got],
            }
            yield f.drop(columns="_prompt").assign(**more)[[*names, *more]]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["raw string, calls int, status int, error string, cost double, prompt_tokens long, completion_tokens long, finish string"])
    return rows.withColumn("_prompt", prompt).repartition(tasks).mapInPandas(run, schema)


# --- cards ---
def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All attempts; an empty table before the first."""
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def finished(attempts: DataFrame) -> DataFrame:
    """The last attempt of each record that has a usable card."""
    return last_wins(attempts.where("error is null").withColumn("_o", F.struct("run", "round")), ["law_book_id"], "_o").drop("_o")


def cards(attempts: DataFrame) -> DataFrame:
    """The cards of the finished records, with the model that wrote them."""
    done = finished(attempts)
    return parse_cards(done).where("error is null").drop("error").join(done.select("law_book_id", "model"), "law_book_id")


def generate_cards(records: DataFrame, prompt: Column, chain: list[Chat], path: str, limit: int | None = None, wave: int = 1000, tasks: int = 8, tries: int = 7, dry: bool = False, pause: Callable[[float], None] | None = None, between: Callable[[int, int], None] | None = None) -> dict:
    """Asks for the cards that the ledger at path lacks; gives counts and costs of this run.

    records: law_book_id, title and what ``prompt`` reads. The first ``limit`` new records by id count, after the finished ones are left
    out. They go in waves; in a wave the next model of the chain is asked only for records whose answer failed or is no
    usable card (``parse_cards``). Each round is appended to the ledger before the next is decided, so a run that ends early
    loses at most the round it was in, and finished records are never asked for again. With ``dry`` nothing is asked.
    """
    spark = records.sparkSession
    before = ledger(spark, path)
    new = records.where("law_book_id is not null").dropDuplicates(["law_book_id"]).join(finished(before).select("law_book_id"), "law_book_id", "left_anti")
    new = new.orderBy("law_book_id").limit(limit) if limit is not None else new
    todo, already = new.count(), finished(before).count()
    if dry or not todo:
        return {"todo": todo, "done_before": already, "written": 0, "failed": 0, "calls": 0, "cost": 0.0}
    number = (before.agg(F.max("run")).first()[0] or 0) + 1
    ids = f"{path}-todo/run={number}"
    waves = -(-todo // wave)
    new.select("law_book_id", F.pmod(F.xxhash64("law_book_id"), F.lit(waves)).cast("int").alias("wave")).write.mode("overwrite").parquet(ids)
    dealt = spark.read.parquet(ids)
    for w in range(waves):
        for k, chat in enumerate(chain):
            mine = ledger(spark, path).where(F.col("run") == number)
            left = records.dropDuplicates(["law_book_id"]).join(dealt.where(F.col("wave") == w).select("law_book_id"), "law_book_id", "left_semi").join(finished(mine).select("law_book_id"), "law_book_id", "left_anti")
            got = called(left, prompt, chat, tries, tasks, pause)
            got = got.select("law_book_id", "title", F.lit(number).alias("run"), F.lit(k).alias("round"), F.lit(chat.name).alias("model"), "calls", "status", "error", "raw", "cost", "prompt_tokens", "completion_tokens")
            raw = f"{path}-rounds/run={number}/wave={w}/round={k}"
            got.write.mode("overwrite").parquet(raw)
            said = spark.read.schema(LEDGER).parquet(raw)
            faults = parse_cards(said).select("law_book_id", F.col("error").alias("_fault"))
            said.join(faults, "law_book_id").withColumn("error", F.coalesce("error", F.concat(F.lit("card: "), F.col("_fault")))).drop("_fault").write.mode("append").parquet(path)
            if between:
                between(w, k)
            if said.join(faults, "law_book_id").where("error is not null or _fault is not null").isEmpty():
                break
    mine = ledger(spark, path).where(F.col("run") == number)
    n = finished(mine).count()
    t = mine.agg(F.sum("calls").alias("calls"), F.round(F.sum("cost"), 8).alias("cost")).first()
    return {"todo": todo, "done_before": already, "written": n, "failed": todo - n, "calls": t["calls"], "cost": t["cost"]}


# --- answers ---
CACHE = "cache_key STRING, question STRING, answer STRING, model STRING"
#: Fixed value: an answer that begins so is an error in brackets, not an answer.
ERROR_MARK = "["


def cached(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CACHE}, bucket int").parquet(path).drop("bucket") if exists(spark, path) else spark.createDataFrame([], CACHE)


def put_answers(answers: DataFrame, path: str, buckets: int = 64) -> int:
    """Adds answers to the cache, one for each key; a key that is there stays as it is, and errors are never kept. Gives the buckets written.

    Done again it changes nothing, so it can follow a batch that may be run twice.
    """
    spark = answers.sparkSession
    fit = answers.where(F.col("answer").isNotNull() & (F.trim("answer") != "") & ~F.col("answer").startswith(ERROR_MARK))
    one = fit.groupBy("cache_key").agg(F.min(F.struct("question", "answer", "model")).alias("r")).select("cache_key", "r.*")
    new = one.join(cached(spark, path).select("cache_key"), "cache_key", "left_anti").withColumn("bucket", bucket_of("cache_key", buckets))
    return rewrite_touched(spark, path, new, lambda held: held.unionByName(new.select(held.columns)), CACHE)


def answer(asked_: DataFrame, path: str, work: str, chain: list[Chat], check: Chat | None = None, clean: tuple[str, ...] = ("ok",), prompt: Column | None = None, check_prompt: Column | None = None, numbers: Callable[[Column], Column] | None = None, rows: DataFrame | None = None, tries: int = 4, tasks: int = 8, pause: Callable[[float], None] | None = None) -> DataFrame:
    """(qid, question, answer, mode, model, finish, truncated, fabricated, warning): answers from the cache at path, or from the first model that gives one.

    asked_: qid, question, context, cache_key. A question without a context is ``empty``. Questions with one key are asked once. Rounds are written under
    ``work`` before they are used: with the same ``work``, a second call asks nothing again. With ``check`` (and ``numbers``, the
    cited numbers of an answer, and ``rows``: qid and numbers of what was retrieved) a new answer's citations go through
    the gate: numbers that no row has are fabricated and cost no call; the second model is called only for answers that cite a number which is there, and its
    answer is a warning unless it begins with a word of ``clean``.
    """
    spark = asked_.sparkSession
    none = lambda t="string": F.lit(None).cast(t)
    full = asked_.where(F.coalesce("context", F.lit("")) != "")
    # what the cache has now: it is written to below, and its old files go then
    if not exists(spark, f"{work}/known/_SUCCESS"):
        cached(spark, path).select("cache_key", "answer", "model").join(full.select("cache_key").distinct(), "cache_key").write.mode("overwrite").parquet(f"{work}/known")
    old = spark.read.parquet(f"{work}/known")
    hits = full.join(old, "cache_key").select("qid", "question", "answer", F.lit("cached").alias("mode"), "model", F.lit("stop").alias("finish"), F.lit(False).alias("fresh"))
    fresh = full.join(old, "cache_key", "left_anti")
    once = fresh.groupBy("cache_key").agg(F.min(F.struct("question", "context")).alias("r")).select("cache_key", "r.*")
    prompt = prompt if prompt is not None else F.concat_ws("\n\n", "context", "question")
    said, left = None, once
    for k, chat in enumerate(chain):
        at = f"{work}/answer-{k}"
        if not exists(spark, f"{at}/_SUCCESS"):
            called(left, prompt, chat, tries, tasks, pause).withColumn("model", F.lit(chat.name)).write.mode("overwrite").parquet(at)
        got = spark.read.parquet(at)
        good = got if k + 1 == len(chain) else got.where("error is null")
        said = good if said is None else said.unionByName(good)
        left = once.join(got.where("error is not null").select("cache_key"), "cache_key", "left_semi")
    told = said.select("cache_key", F.when(F.col("error").isNull(), F.col("raw")).otherwise(F.concat(F.lit(ERROR_MARK), F.col("error"), F.lit("]"))).alias("answer"), "model", "finish")
    put_answers(told.join(once.select("cache_key", "question"), "cache_key").select("cache_key", "question", "answer", "model"), path)
    new = fresh.join(told, "cache_key").select("qid", "question", "answer", F.lit("generated").alias("mode"), "model", "finish", F.lit(True).alias("fresh"))
    nothing = asked_.where(F.coalesce("context", F.lit("")) == "").select("qid", "question", none().alias("answer"), F.lit("empty").alias("mode"), none().alias("model"), none().alias("finish"), F.lit(False).alias("fresh"))
    out = hits.unionByName(new).unionByName(nothing)
    fits = F.coalesce(~F.col("answer").startswith(ERROR_MARK), F.lit(False))
    out = out.withColumn("truncated", fits & (F.lower(F.coalesce("finish", F.lit(""))).isin("length", "max_tokens") | looks_truncated("answer")))
    if check is None:
        return out.withColumns({"fabricated": F.array().cast("array<string>"), "warning": none()}).drop("fresh")
    cites = F.when(F.col("fresh") & fits, numbers(F.col("answer"))).otherwise(F.array().cast("array<string>"))
    gated = citation_gate(out.withColumn("cited", cites), rows, "qid", "cited", "numbers")
    some = gated.where(F.size(F.array_except("cited", "fabricated")) > 0)
    at = f"{work}/check"
    if not exists(spark, f"{at}/_SUCCESS"):
        asks = some.join(asked_.select("qid", "context"), "qid").select("qid", "context", "answer")
        called(asks, check_prompt if check_prompt is not None else F.concat_ws("\n\n", "context", "answer"), check, tries, tasks, pause).write.mode("overwrite").parquet(at)
    verdict = spark.read.parquet(at).where("error is null").select("qid", F.trim("raw").alias("v"))
    note = verdict.where(~F.arrays_overlap(F.transform(F.array(*[F.lit(w) for w in clean]), lambda w: F.col("v").startswith(w)), F.array(F.lit(True))))
    listed = F.when(F.size("fabricated") > 0, F.array_join("fabricated", ", "))
    both = F.concat_ws("\n", listed, "v")
    return gated.join(note, "qid", "left").withColumn("warning", F.when(both != "", both)).drop("v", "cited", "fresh")


def answer_stream(stream: DataFrame, path: str, out: str, checkpoint: str, chain: list[Chat], **how) -> StreamingQuery:
    """Answers arriving questions (columns of ``answer``). A batch writes its own folder under out, so one that is run again changes nothing and asks nothing."""

    def each(batch: DataFrame, number: int) -> None:
        answer(batch, path, f"{out}-work/batch={number}", chain, **how).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
