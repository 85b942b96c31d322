"""Generations, lock, resumable steps; bucketed tables."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from textloom.sources import generations as G


def steps(spark, k, ran):
    def records(read):
        ran.append("records")
        return spark.range(k)

    def counts(read):
        ran.append("counts")
        return read("records").agg(F.count("*").alias("n"))

    def note(read):
        ran.append("note")
        return read("counts").withColumn("twice", F.col("n") * 2)

    return [("records", records), ("counts", counts), ("note", note)]


def seen(spark, root):
    n, paths = G.generation(spark, root)
    return n, {name: spark.read.parquet(p).agg(F.max(spark.read.parquet(p).columns[0])).first()[0] for name, p in paths.items()}


def test_a_crash_between_any_two_steps_leaves_the_old_generation(spark, tmp_path):
    root = str(tmp_path / "r")
    assert G.generation(spark, root) == (0, {})
    assert G.refresh(spark, root, steps(spark, 3, [])) == 1
    old = (1, {"records": 2, "counts": 3, "note": 3})
    assert seen(spark, root) == old
    done = 0
    for point in ("records", "counts", "note", "commit"):
        ran = []

        def between(name, point=point):
            if name == point:
                raise RuntimeError("crash")

        with pytest.raises(RuntimeError, match="crash"):
            G.refresh(spark, root, steps(spark, 5, ran), between=between)
        assert seen(spark, root) == old and not os.path.exists(f"{root}/lock")
        assert len(ran) == (1 if point != "commit" else 0)  # what an earlier try finished is not done again
        done += len(ran)
    assert done == 3 and G.refresh(spark, root, steps(spark, 5, ran := [])) == 2 and not ran
    assert seen(spark, root) == (2, {"records": 4, "counts": 5, "note": 5})
    # a run over one table carries the others on
    assert G.refresh(spark, root, [("counts", lambda read: read("records").agg((F.count("*") + 10).alias("n")))]) == 3
    assert seen(spark, root) == (3, {"records": 4, "counts": 15, "note": 5})
    assert len(G.expire(spark, root, 1)) == 4 and seen(spark, root)[1] == {"records": 4, "counts": 15, "note": 5}


def test_one_run_at_a_time(spark, tmp_path):
    root = str(tmp_path / "r")
    inside, go = threading.Event(), threading.Event()

    def slow(read):
        inside.set()
        go.wait(60)
        return spark.range(1)

    first = threading.Thread(target=G.refresh, args=(spark, root, [("t", slow)]))
    first.start()
    inside.wait(60)
    with pytest.raises(G.Locked):
        G.refresh(spark, root, [("t", lambda read: spark.range(9))])
    assert G.generation(spark, root)[0] == 0
    go.set()
    first.join()
    assert seen(spark, root) == (1, {"t": 0})
    # a dead run's lock is taken over once it is old
    G._write_new(spark, f"{root}/lock", '{"owner": "dead", "at": %s}' % (time.time() - 100))
    with pytest.raises(G.Locked):
        G.refresh(spark, root, [("t", lambda read: spark.range(9))])
    assert G.refresh(spark, root, [("t", lambda read: spark.range(9))], stale=50) == 2


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_routes_rewrite_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "routes")
    rows = lambda items: spark.createDataFrame(items, "law bigint, route string")
    made = []
    vector = lambda df: (made.append(df.count()), df.withColumn("vector", F.length("route")))[1]
    all_ = [(i, f"r{i}") for i in range(200)]
    assert G.append_routes(rows(all_), path, "law", "route", 16, vector) == {"new": 200, "stale": 0, "same": 0, "gone": 0, "buckets": 16}
    before = files(path)
    assert G.append_routes(rows(all_), path, "law", "route", 16, vector)["buckets"] == 0 and files(path) == before
    now = [(i, f"r{i}") for i in range(200) if i != 7] + [(7, "seven"), (7, "r7"), (500, "new")]
    got = G.append_routes(rows(now), path, "law", "route", 16, vector)
    assert got["new"] == 1 and got["stale"] == 1 and got["same"] == 199 and got["buckets"] <= 2 and made[-1] == 2
    assert len(set(before.items()) & set(files(path).items())) >= 14
    want = {(i, f"r{i}") for i in range(200) if i != 7} | {(7, "seven"), (500, "new")}
    held = spark.read.parquet(path).collect()
    assert {(r.law, r.route) for r in held} == want and len(held) == 201 and all(r.vector == len(r.route) for r in held)
    got = G.append_routes(rows(now[:-1]), path, "law", "route", 16, vector, remove_absent=True)
    assert got["gone"] == 1 and {r.law for r in spark.read.parquet(path).collect()} == set(range(200))
    one = str(tmp_path / "one")
    G.append_routes(rows([(1, "a")]), one, "law", "route", 4)
    G.append_routes(rows([(2, "b")]).where("law = 2"), one, "law", "route", 4, remove_absent=True)
    assert [(r.law, r.route) for r in spark.read.parquet(one).collect()] == [(2, "b")]
