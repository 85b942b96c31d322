"""Cards, answers and embeddings with scripted models that log their calls."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textloom import model_jobs as M
from textloom import providers
from textloom.functions.text import reference_numbers

CARD = json.dumps({"scope_summary": "s", "subject_tags": ["t"], "likely_questions": ["q"], "colloquial_aliases": ["a"]})


def scripted(tmp_path, name, script):
    """A model that answers by a prompt's first word: the n-th call for a prompt gets the script's n-th entry (the last one again)."""
    log = str(tmp_path / f"calls-{name}")

    class Scripted:
        def answer(self, prompt):
            word = prompt.split()[0]
            key = f"{log}-{word}"
            n = os.path.getsize(key) if os.path.exists(key) else 0
            with open(key, "ab") as f:
                f.write(b"x")
            entries = script.get(word, script["*"])
            got = entries[min(n, len(entries) - 1)]
            if isinstance(got, Exception):
                raise got
            return got

    model = Scripted()
    model.name = name

    def calls(word):
        return os.path.getsize(f"{log}-{word}") if os.path.exists(f"{log}-{word}") else 0

    return model, calls


quick = lambda _: None  # noqa: E731  a function of this module could not be sent to workers


OK = providers.Reply(CARD, 200, 0.5, 10, 2)


def test_cards_from_the_ledger(spark, tmp_path):
    first, a = scripted(tmp_path, "first", {"*": [OK], "l2": [providers.Reply("", 429), providers.Reply("", 503), OK], "l3": [("no endpoints for it", 404)], "l4": [("{}", 200)], "l5": [("bad", 400)], "l7": [OSError("reset"), ("", 200), OK]})
    second, b = scripted(tmp_path, "second", {"*": [OK], "l5": [("worse", 400)]})
    laws = spark.createDataFrame([(i, f"title {i}") for i in range(1, 9)] + [(None, "x"), (1, "title 1")], "law_book_id bigint, title string")
    prompt = F.concat(F.lit("l"), F.col("law_book_id").cast("string"))
    path = str(tmp_path / "ledger")
    run = lambda **k: M.generate_cards(laws, prompt, [first, second], path, wave=100, tasks=2, pause=quick, **k)
    assert run(dry=True)["todo"] == 8 and a("l1") == 0
    got = run(limit=7)
    assert got == {"todo": 7, "done_before": 0, "written": 6, "failed": 1, "calls": 14, "cost": 3.0}
    assert [a(f"l{i}") for i in range(1, 9)] == [1, 3, 1, 1, 1, 1, 3, 0] and [b(f"l{i}") for i in range(1, 9)] == [0, 0, 1, 1, 1, 0, 0, 0]
    log = {(r.law_book_id, r.model): r.error for r in M.ledger(spark, path).collect()}
    assert log[3, "first"] == "bad_model" and log[4, "first"] == "card: scope_summary" and log[5, "second"] == "http_400" and log[2, "first"] is None
    made = {r.law_book_id: (r.model, r.title) for r in M.cards(M.ledger(spark, path)).collect()}
    assert made == {i: ("second" if i in (3, 4) else "first", f"title {i}") for i in (1, 2, 3, 4, 6, 7)}
    again = run()
    assert again["todo"] == 2 and again["written"] == 1 and again["done_before"] == 6 and a("l1") == 1 and a("l8") == 1 and a("l5") == 2


def test_a_killed_card_run_asks_nothing_twice(spark, tmp_path):
    model, calls = scripted(tmp_path, "m", {"*": [OK]})
    laws = spark.createDataFrame([(i, "t") for i in range(20)], "law_book_id bigint, title string")
    prompt = F.concat(F.lit("l"), F.col("law_book_id").cast("string"))

    def between(w, _):
        if w == 2:
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        M.generate_cards(laws, prompt, [model], str(tmp_path / "l"), wave=4, tasks=1, pause=quick, between=between)
    n = M.finished(M.ledger(spark, str(tmp_path / "l"))).count()
    assert 0 < n < 20
    got = M.generate_cards(laws, prompt, [model], str(tmp_path / "l"), wave=4, tasks=1, pause=quick)
    # a card needs an id above zero
    assert got["done_before"] == n and M.finished(M.ledger(spark, str(tmp_path / "l"))).count() == 19 and all(calls(f"l{i}") == 1 for i in range(1, 20))


def questions(spark, *rows):
    return spark.createDataFrame(rows, "qid string, question string, context string").withColumn("cache_key", F.md5(F.concat_ws("|", "question", "context")))


def test_answers_are_checked_and_kept(spark, tmp_path):
    cites = lambda c: reference_numbers(c)
    first, a = scripted(tmp_path, "first", {"*": [("see article 4.", 200)], "c2": [("", 200)], "c3": [("see article 9.", 200)], "c5": [("no numbers here", 200)], "c6": [("broken", 400)], "c7": [providers.Reply("article 4 and", 200, finish="length")]})
    second, b = scripted(tmp_path, "second", {"*": [("article 4 and 9 of articles 9.", 200)], "c6": [("broken", 400)]})
    check, v = scripted(tmp_path, "check", {"*": [("ok, all fine", 200)], "c2": [("article 4: wrong", 200)]})
    rows = spark.createDataFrame([(f"q{i}", ["4"]) for i in range(9)], "qid string, numbers array<string>")
    path = str(tmp_path / "cache")
    asked = questions(spark, ("q1", "one", "c1"), ("q1b", "one", "c1"), ("q2", "two", "c2"), ("q3", "three", "c3"), ("q4", "four", None), ("q5", "five", "c5"), ("q6", "six", "c6"), ("q7", "seven", "c7"))
    run = lambda q, work: {r.qid: r for r in M.answer(q, path, str(tmp_path / work), [first, second], check, numbers=cites, rows=rows, tries=2, tasks=2, pause=quick).collect()}
    got = run(asked, "w1")
    assert a("c1") == 1 and a("c2") == 2 and b("c2") == 1 and b("c1") == 0 and a("c6") == 1
    assert got["q1"].answer == got["q1b"].answer == "see article 4." and got["q1"].warning is None and got["q1"].mode == "generated"
    assert got["q2"].model == "second" and got["q2"].fabricated == ["9"] and got["q2"].warning == "9\narticle 4: wrong"
    assert got["q3"].fabricated == ["9"] and got["q3"].warning == "9" and v("c3") == 0  # nothing cited is there: no call
    assert got["q4"].mode == "empty" and got["q4"].answer is None
    assert got["q5"].warning is None and v("c5") == 0 and got["q5"].truncated
    assert got["q6"].answer == "[http_400]" and not got["q6"].truncated and v("c6") == 0
    assert got["q7"].truncated and not got["q1"].truncated and v("c1") == 1
    kept = {r.question: r.answer for r in M.cached(spark, path).collect()}
    assert set(kept) == {"one", "two", "three", "five", "seven"}
    assert run(asked, "w1").keys() == got.keys() and a("c6") == 1  # the same work folder: nothing is asked
    later = run(asked, "w2")
    assert later["q1"].mode == "cached" and a("c1") == 1 and v("c1") == 1 and later["q1"].warning is None and later["q6"].mode == "generated" and a("c6") == 2


def test_put_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("k1", "q", "a", "m"), ("k1", "q", "b", "m"), ("k2", "q", "[API error] x", "m"), ("k3", "q", " ", "m"), ("k4", "q", None, "m")], M.CACHE)
    assert M.put_answers(rows, path, 8) == 1 and M.put_answers(rows, path, 8) == 0
    assert [(r.cache_key, r.answer) for r in M.cached(spark, path).collect()] == [("k1", "a")]


def test_answer_stream(spark, tmp_path):
    model, calls = scripted(tmp_path, "m", {"*": [("fine.", 200)]})
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    questions(spark, ("q1", "one", "c1"), ("q2", "two", "c2")).coalesce(1).write.parquet(src)
    stream = lambda: M.answer_stream(spark.readStream.schema("qid string, question string, context string, cache_key string").parquet(src), str(tmp_path / "cache"), out, str(tmp_path / "cp"), [model], tasks=1, pause=quick).awaitTermination(180)
    stream()
    questions(spark, ("q3", "one", "c1")).coalesce(1).write.mode("append").parquet(src)
    stream()
    got = {r.qid: (r.mode, r.answer) for r in spark.read.parquet(out).collect()}
    assert got == {"q1": ("generated", "fine."), "q2": ("generated", "fine."), "q3": ("cached", "fine.")} and calls("c1") == 1


def counting():
    class Counting:
        dim = 1

        def __init__(self):
            self.calls, self.busy = [], {}

        def embed(self, texts):
            self.calls.append(list(texts))
            left = self.busy.get(texts[0], 0)
            if left:
                self.busy[texts[0]] = left - 1
                raise providers.Busy(3.0)
            if any(t.startswith("bad") for t in texts):
                raise ValueError("bad text")
            return [[float(len(t))] for t in texts]

    return Counting()


def test_embedding_halves_waits_and_keeps_the_order():
    p, waits = counting(), []
    texts = ["x" * k for k in range(16)]
    texts[5] = "bad"
    p.busy = {texts[8]: 2}
    got = providers.embed_all(texts, p, batch=8, workers=3, sleep=waits.append)
    assert waits == [3.0, 3.0] and [g[0] for g in got] == [None if k == 5 else [float(k)] for k in range(16)] and got[5][1] == "ValueError: bad text"
    assert len(p.calls) == 3 + 7  # two waits and one; eight, four and four, two and two, one and one
    p = counting()
    got = providers.embed_all(["bad", *["y"] * 15], p, batch=16, workers=1, halvings=3)
    assert [g[0] is None for g in got] == [True] * 2 + [False] * 14 and len(p.calls) == 7
    p = counting()
    p.busy = {"z": 99}
    assert providers.embed_all(["z", "z"], p, tries=3, sleep=quick) == [(None, "Busy")] * 2 and len(p.calls) == 3


def test_new_rows_are_embedded_once_and_faults_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, None)], "id bigint, t string")
    path, failed = str(tmp_path / "v"), str(tmp_path / "f")
    assert providers.embed_new(rows, path, failed, "id", "t", counting(), "r1", batch=1) == {"embedded": 2, "failed": 1}
    assert providers.embed_new(rows, path, failed, "id", "t", counting(), "r1", batch=1) == {"embedded": 2, "failed": 1}
    more = rows.unionByName(spark.createDataFrame([(4, "dddd")], "id bigint, t string")).replace("bad", "good", "t")
    assert providers.embed_new(more, path, failed, "id", "t", counting(), "r2") == {"embedded": 2, "failed": 0}
    assert sorted((r.id, r.vector) for r in spark.read.parquet(path).collect()) == [(1, [2.0]), (2, [4.0]), (3, [0.0]), (4, [4.0])]
    assert [(r.id, r.error) for r in spark.read.parquet(failed).collect()] == [(2, "ValueError: bad text")]
