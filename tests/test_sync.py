"""Transport, catalogue source, discovery as a stream and the full walk, against a server on this machine."""

import json
import threading
import time
from collections import Counter
from datetime import UTC, datetime, timedelta
from email.utils import format_datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from textloom.sources import catalogue
from textloom.sources.records import load_state
from textloom.sources.transport import Answer, Challenge, Refused, Transport, share


class Clock:
    """Time that passes by sleeping only."""

    def __init__(self):
        self.at, self.log = 0.0, []

    def sleep(self, s):
        self.at += s
        self.log.append(round(s, 3))

    def __call__(self):
        return self.at


def scripted(clock, *answers, **more):
    asked = []

    def send(url):
        asked.append(clock.at)
        a = answers[len(asked) - 1]
        if isinstance(a, Exception):
            raise a
        return a

    return Transport(send, sleep=clock.sleep, clock=clock, **more), asked


def test_retries_wait_as_the_server_asks():
    clock = Clock()
    over, asked = scripted(clock, Answer(429, "", {"retry-after": "7"}), Answer(503, ""), OSError("reset"), Answer(200, "ok"))
    assert over.get("u") == "ok" and clock.log == [7.0, 4.0, 8.0] and len(asked) == 4
    start = datetime(2026, 1, 1, tzinfo=UTC)
    clock = Clock()
    over, _ = scripted(clock, Answer(429, "", {"retry-after": format_datetime(start + timedelta(seconds=12), usegmt=True)}), Answer(429, "", {"retry-after": "soon"}), Answer(200, "ok"), now=lambda: start)
    assert over.get("u") == "ok" and clock.log == [12.0, 4.0]


def test_retries_end():
    clock = Clock()
    over, asked = scripted(clock, *[Answer(500, "")] * 9)
    with pytest.raises(Refused, match="HTTP 500"):
        over.get("u")
    assert len(asked) == 4
    for answer, error, n in ((Answer(404, ""), Refused, 1), (Answer(503, "<p>Just a moment</p>"), Challenge, 1), (Answer(200, "Just a moment"), Challenge, 1)):
        over, asked = scripted(Clock(), answer)
        with pytest.raises(error):
            over.get("u")
        assert len(asked) == n
    over, asked = scripted(Clock(), *[OSError("down")] * 4)
    with pytest.raises(OSError, match="down"):
        over.get("u")
    over, _ = scripted(Clock(), Answer(200, "Just a moment; var articles = [] lawBookID"))
    assert over.get("u")


def test_pace_is_shared_by_tasks():
    times = []
    for task in range(3):
        clock = Clock()
        delay, wait = share(2.0, 3, task)
        over, asked = scripted(clock, *[Answer(200, "x")] * 4, delay=delay, first_wait=wait)
        for _ in range(4):
            over.get("u")
        times += asked
    assert sorted(times) == [2.0 * k for k in range(12)]


class Site:
    """A catalogue of ids with pages of two, newest first, and a detail page for each."""

    def __init__(self, ids, faults=None):
        self.ids, self.faults, self.log, self.times = ids, faults or {}, [], []
        site = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                site.log.append(self.path)
                site.times.append(time.monotonic())
                status, body = site.answer(self.path)
                self.send_response(status)
                if status == 429:
                    self.send_header("Retry-After", "0")
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_): ...

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.root = f"http://127.0.0.1:{self.server.server_port}"

    def answer(self, path):
        if left := self.faults.get(path):
            return left.pop(0)
        kind, n = path[1:].split("/")
        if kind == "law":
            return 200, f"text of {n}"
        k = int(n)
        return 200, json.dumps({"totalCount": len(self.ids), "items": [{"lawBookID": i, "lawTitle": f"t{i}"} for i in self.ids[2 * k : 2 * k + 2]]})

    def options(self, **more):
        return {"template": self.root + "/list/{page}", "pagesize": 2, "parallel": 2} | more

    def pages(self):
        return Counter(x for x in self.log if x.startswith("/list"))


@pytest.fixture
def site():
    made = []

    def make(*a):
        made.append(Site(*a))
        return made[-1]

    yield make
    for s in made:
        s.server.shutdown()


def test_source_paces_and_retries(spark, site):
    s = site(list(range(10)), {"/list/3": [(503, ""), (429, "")]})
    began = time.monotonic()
    rows = catalogue.source(spark, s.options(delay=0.1, pages=5)).load().collect()
    assert sorted(r.lawBookID for r in rows) == list(range(10)) and s.pages()["/list/3"] == 3 and time.monotonic() - began >= 2
    quick = [b - a for a, b in zip(sorted(s.times), sorted(s.times)[2:], strict=False)]
    assert min(quick) > 0.1  # two tasks, one request each in 0.2 seconds
    hole = site(list(range(10)), {"/list/1": [(404, "")] * 9})
    with pytest.raises(Exception, match="HTTP 404"):
        catalogue.source(spark, hole.options()).load().collect()


def law_url(s):
    return F.concat(F.lit(s.root + "/law/"), F.col("lawBookID").cast("string"))


def test_walk_ends_the_same_when_killed(spark, site, tmp_path):
    ids = [*range(100, 109), 103]
    want = None
    for name, kill in (("whole", None), ("killed", 2)):
        s = site(ids, {"/law/104": [(410, "")] * 2})
        path = str(tmp_path / name)

        def between(n, kill=kill):
            if n == kill:
                raise RuntimeError("killed")

        if kill is not None:
            with pytest.raises(RuntimeError, match="killed"):
                catalogue.walk(spark, s.options(), path, law_url(s), step=1, tasks=2, between=between)
            assert load_state(spark, f"{path}/state")["step"] == 2
        done = catalogue.walk(spark, s.options(), path, law_url(s), known=spark.createDataFrame([(101,)], "lawBookID bigint"), step=1, tasks=2)
        items = sorted((r.lawBookID, r.body) for r in spark.read.parquet(f"{path}/items").collect())
        errors = [(r.lawBookID, r.error) for r in spark.read.parquet(f"{path}/errors").collect()]
        assert done["done"] and errors[0][0] == 104 and "HTTP 410" in errors[0][1] and len(errors) == 1
        if want is None:
            want = items
            assert items == [(i, f"text of {i}") for i in range(100, 109) if i not in (101, 104)]
        else:
            assert set(want) <= set(items) and len(items) == len(want) + 1  # the first run did not know 101
            assert set(s.pages().values()) == {1}
        assert catalogue.walk(spark, s.options(), path, law_url(s))["done"]
    s.faults.clear()
    assert catalogue.retry_errors(spark, path, law_url(s)).count() == 0
    assert sorted(r.lawBookID for r in spark.read.parquet(f"{path}/items").collect()) == list(range(100, 109))
    assert catalogue.retry_errors(spark, path, law_url(s)).count() == 0


def test_walk_stops_at_a_challenge_and_goes_on(spark, site, tmp_path):
    s = site([1, 2, 3, 4], {"/law/3": [(403, "Attention Required! | Cloudflare")]})
    path = str(tmp_path / "w")
    got = catalogue.walk(spark, s.options(), path, law_url(s), step=1, tasks=1)
    assert got["blocked"].startswith("Challenge") and got["step"] == 1
    assert catalogue.walk(spark, s.options(), path, law_url(s), step=1, tasks=1)["done"]
    assert sorted(r.lawBookID for r in spark.read.parquet(f"{path}/items").collect()) == [1, 2, 3, 4] and s.log.count("/law/4") == 1


@pytest.mark.parametrize("kill", [None, 0, 1])
def test_discovery_stops_at_known_ids_and_reads_each_page_once(spark, site, tmp_path, kill):
    ids = [50, 49, 48, 20, 47, 19, 18, 17, 16, 15, 14, 13, 12, 11]
    known = spark.createDataFrame([(i,) for i in range(10, 21)], "lawBookID bigint")
    s, path = site(ids), str(tmp_path / "d")

    def between(n):
        if n == kill:
            raise RuntimeError("killed")

    if kill is not None:
        with pytest.raises(Exception, match="killed"):
            catalogue.discover(spark, s.options(step=2), known, path, least=3, between=between)
    got = catalogue.discover(spark, s.options(step=2), known, path, least=3)
    assert got["stopped"] == "known" and got["found"] == 4
    assert sorted(r.lawBookID for r in spark.read.parquet(f"{path}/found").collect()) == [47, 48, 49, 50]
    assert s.pages() == {f"/list/{k}": 1 for k in range(4)}
    assert catalogue.discover(spark, s.options(step=2), known, path) == got and len(s.log) == 4


def test_discovery_to_the_end_and_to_a_limit(spark, site, tmp_path):
    known = spark.createDataFrame([], "lawBookID bigint")
    s = site([9, 8, 9, 7, 6])
    got = catalogue.discover(spark, s.options(step=2), known, str(tmp_path / "e"), least=5)
    assert got["stopped"] == "end" and sorted(r.lawBookID for r in spark.read.parquet(str(tmp_path / "e/found")).collect()) == [6, 7, 8, 9]
    got = catalogue.discover(spark, s.options(step=1), known, str(tmp_path / "l"), limit=3)
    assert got["stopped"] == "limit" and sorted(r.lawBookID for r in spark.read.parquet(str(tmp_path / "l/found")).collect()) == [7, 8, 9]
