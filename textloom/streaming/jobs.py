"""Streaming forms: rate limits with state, upserts of arriving files, windowed counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.upsert import merge
from ..shipping import ship
from ..sources.generations import bucket_of, rewrite_touched


def accepted(df: DataFrame, key: str, ts: str, limit: int = 8, seconds: float = 60.0, tie: str | None = None) -> DataFrame:
    """(key, ts as epoch seconds, ok) of each request in order: ok while fewer than ``limit`` accepted ones lie in the window before.

    Rejected requests leave no trace, so this is a fold over a key's requests, not a range window. Sorted requests stream
    through a task in batches; of a key, however many requests it has, only the last ``limit`` accepted times are held. A request without a time
    is ok and leaves no trace.
    """
    rows = df.select(key, F.col(ts).cast("timestamp").cast("double").alias("t"), *([tie] if tie else []))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = object(), deque()
        for b in batches:
            ok = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != at:
                    at, seen = k, deque()
                if t is None:
                    ok.append(True)
                    continue
                while seen and seen[0] <= t - seconds:
                    seen.popleft()
                ok.append(len(seen) < limit)
                if ok[-1]:
                    seen.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], [*b.schema.names, "ok"])

    schema = StructType([*rows.schema.fields, StructField("ok", BooleanType())])
    return rows.repartition(key).sortWithinPartitions(*rows.columns).mapInArrow(run, schema)


def limited_stream(stream: DataFrame, key: str, ts: str, limit: int = 8, seconds: float = 60.0) -> DataFrame:
    """The streaming form of ``accepted``: state per key holds the accepted times of the window; idle keys expire.

    Requests are judged as they arrive: inside a frame of a micro-batch in order of time, frames in their order. A request without a time is ok and leaves no trace.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        for f in frames:
            f = f.sort_values("t", kind="stable")
            ok = []
            for t in f["t"]:
                if t != t:  # no time: as in ``accepted``
                    ok.append(True)
                    continue
                seen = [x for x in seen if x > t - seconds]
                ok.append(len(seen) < limit)
                if ok[-1]:
                    seen.append(float(t))
            yield pd.DataFrame({key: f[key], "t": f["t"], "ok": ok})
        state.update((seen,))
        state.setTimeoutDuration(int(seconds * 1000))

    src = stream.select(F.col(key).cast("string").alias(key), F.col(ts).cast("timestamp").cast("double").alias("t"))
    return src.groupBy(key).applyInPandasWithState(run, f"{key} string, t double, ok boolean", "seen array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def merge_stream(stream: DataFrame, path: str, checkpoint: str, key: str, fingerprint: str, seq: str, buckets: int = 64) -> StreamingQuery:
    """Upserts each micro-batch into the table at path, which is dealt into buckets by key: only those with a key of the batch are written.

    A batch that is run again changes nothing, as its fingerprints are there. The table has a column ``bucket`` besides those of the stream.
    """

    def each(batch: DataFrame, _: int) -> None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
        at = bucket_of(key, buckets)

        def change(held: DataFrame) -> DataFrame:
            return merge(held.drop("bucket"), batch, key, fingerprint, seq)[0].select(batch.columns).withColumn("bucket", at)

        rewrite_touched(batch.sparkSession, path, batch.select(at.alias("bucket")), change, schema)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time tumbling counts and sums (an extension: batch and stream alike)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
