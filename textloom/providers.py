"""Model calls are behind this interface; the stubs are deterministic and need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.search import terms
from .shipping import ship
from .sources.records import exists


class Busy(Exception):
    """A provider that asks for patience: ``after`` seconds, or a doubling pause without it."""

    def __init__(self, after: float | None = None):
        super().__init__(f"busy, again after {after}")
        self.after = after


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reply(NamedTuple):
    """A chat model's answer. An empty text counts as status -1."""

    text: str
    status: int
    cost: float = 0.0
    prompt_tokens: int = 0
    completion_tokens: int = 0
    finish: str | None = None


class Chat(Protocol):
    name: str

    def answer(self, prompt: str) -> Reply | tuple[str, int]: ...


#: What a provider says of a model that it doesn't have.
NO_MODEL = ("not a valid model", "invalid model", "no endpoints")


def asked(chat: Chat, prompt: str, tries: int = 7, sleep: Callable[[float], None] = time.sleep) -> tuple[Reply, int, str | None]:
    """(last reply, calls, error) of one model: asked again after 429, 500, 502, 503, a broken connection and an empty answer.

    Error is None for a usable answer, ``bad_model`` where another model has to be asked, else what went wrong last.
    """
    got, error = Reply("", -1), "no try"
    cost = pin = pout = 0
    for tried in range(tries):
        try:
            got = Reply(*chat.answer(prompt))
        except (OSError, Busy) as e:
            got, error, pause = Reply("", -1), f"{type(e).__name__}: {e}", min(2.0**tried, 20.0)
        else:
            cost, pin, pout = cost + got.cost, pin + got.prompt_tokens, pout + got.completion_tokens
            got = got._replace(cost=cost, prompt_tokens=pin, completion_tokens=pout)
            if got.status == 200 and got.text.strip():
                return got, tried + 1, None
            if any(m in got.text.lower() for m in NO_MODEL) and got.status != 200:
                return got, tried + 1, "bad_model"
            if got.status == 429:
                error, pause = "http_429", min(2.0**tried, 45.0)
            elif got.status in (500, 502, 503):
                error, pause = f"http_{got.status}", min(2.0**tried, 30.0)
            elif got.status in (200, -1):
                error, pause = "empty", min(2.0**tried, 15.0)
            else:
                return got, tried + 1, f"http_{got.status}"
        if tried + 1 < tries:
            sleep(pause)
    return got, tries, error


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A bag of hashed words as a vector: the offline stand-in for an embedding model. Words are hashed in the JVM and counted in Arrow batches."""
    return F.arrow_udf(counter(dim), "array<float>")(F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")))


def counter(dim: int, at_once: int = 512) -> Callable[[pa.Array], pa.Array]:
    """A function of lists: how often each number below ``dim`` stands in each; ``at_once`` lists are widened at a time.

    It is made here, and so pickled whole: a column has no session whose executors could be sent the package.
    """

    def counted(part):
        n = len(part)
        at = np.repeat(np.arange(n) * dim, np.asarray(pc.list_value_length(part))) + np.asarray(pc.list_flatten(part))
        flat = np.bincount(at, minlength=n * dim).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(flat))

    def whole(slots: pa.Array) -> pa.Array:
        return pa.concat_arrays([counted(slots.slice(lo, at_once)) for lo in range(0, max(len(slots), 1), at_once)])

    return whole


def embed_all(texts: list[str], provider: Embedder, batch: int = 64, workers: int = 4, tries: int = 5, halvings: int = 3, sleep: Callable[[float], None] = time.sleep) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text, in order: batches go through a bounded pool of threads.

    A busy provider is asked again after a pause. A batch that fails otherwise is halved, at most ``halvings`` times; what still fails has an error.
    """

    def tried(part: list[str], left: int) -> list:
        error = "no try"
        for n in range(tries):
            try:
                got = provider.embed(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                return [(v, None) for v in got]
            except Busy as e:
                error = "Busy"
                if n + 1 < tries:
                    sleep(e.after if e.after is not None else min(2.0**n, 45.0))
            except Exception as e:  # noqa: BLE001  a text's fault must not lose the others
                error = f"{type(e).__name__}: {e}"
                break
        if error == "Busy" or len(part) == 1 or not left:
            return [(None, error)] * len(part)
        half = len(part) // 2
        return tried(part[:half], left - 1) + tried(part[half:], left - 1)

    parts = [texts[k : k + batch] for k in range(0, len(texts), batch)]
    if len(parts) < 2 or workers < 2:
        return [x for p in parts for x in tried(p, halvings)]
    with ThreadPoolExecutor(workers) as pool:
        return [x for got in pool.map(lambda p: tried(p, halvings), parts) for x in got]


def embedded(df: DataFrame, text: str, provider: Embedder, to: str = "vector", batch: int = 64, cap: int = 6000, workers: int = 4, tries: int = 5, halvings: int = 3, error: str | None = None) -> DataFrame:
    """Embeds the first ``cap`` characters of the stripped text (``embed_all``); a row that failed has a null vector and, with ``error``, a column that says why."""
    ship(df.sparkSession)
    names = df.columns
    more = [error] if error else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t.strip()[:cap] if isinstance(t, str) else "" for t in f[text]]
            got = embed_all(texts, provider, batch, workers, tries, halvings)
            yield f.assign(**{to: [v for v, _ in got]} | ({error: [e for _, e in got]} if error else {}))[[*names, to, *more]]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{to}` array<float>", *(f"`{m}` string" for m in more)])
    return df.mapInPandas(run, schema)


def embed_new(rows: DataFrame, path: str, failed: str, key: str, text: str, provider: Embedder, run: str, **how) -> dict[str, int]:
    """Embeds the rows that the table at path lacks and appends them; ids that failed go to ``failed``, with their error. Gives counts.

    ``run`` names this run: done again, it writes the same folders again, so a crash leaves no row twice. Rows that failed are tried by the next run.
    """
    spark = rows.sparkSession
    at = F.col("run") != run
    have = spark.read.parquet(path).where(at).select(key) if exists(spark, path) else rows.select(key).limit(0)
    made = embedded(rows.join(have, key, "left_anti"), text, provider, error="error", **how)
    part = f"{path}/run={run}"
    both = f"{failed}-{run}"
    made.write.mode("overwrite").parquet(both)  # the provider is asked once
    got = spark.read.parquet(both)
    got.where("error is null").drop("error").write.mode("overwrite").parquet(part)
    got.where("error is not null").select(key, "error").write.mode("overwrite").parquet(f"{failed}/run={run}")
    n = got.selectExpr("count_if(error is null) AS a", "count_if(error is not null) AS b").first()
    return {"embedded": n[0], "failed": n[1]}


def answered(prompts: DataFrame, chain: list[Chat], prompt: str = "context") -> DataFrame:
    """Adds answer, model and status: the next model is asked only after status 400 or an empty answer."""
    ship(prompts.sparkSession)
    names = prompts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p in f[prompt]:
                got = ("", -1, None)
                for chat in chain:
                    text, status = chat.answer(p or "")[:2]
                    got = (text, status if text else -1, chat.name)
                    if got[1] not in (400, -1):
                        break
                rows.append(got)
            yield f.assign(answer=[r[0] for r in rows], status=[r[1] for r in rows], model=[r[2] for r in rows])[[*names, "answer", "status", "model"]]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields] + ["answer string", "status int", "model string"])
    return prompts.mapInPandas(run, schema)
