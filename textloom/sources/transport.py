"""HTTP requests of a polite client: pacing, retries, interstitial pages.

A transport belongs to one task. Where several tasks ask one server, each keeps its share of the pace (``share``), so that
together they keep the whole.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from typing import Any

from ..functions.web import CHALLENGE, PAYLOAD

#: Answers that are asked for again.
RETRIED = (429, 500, 502, 503, 504)


class Challenge(Exception):
    """The server wants a person: asking again only makes it worse."""


class Refused(Exception):
    """An answer that is no success, after all tries that it allows."""

    def __init__(self, status: int, url: str):
        super().__init__(f"HTTP {status} for {url}")
        self.status = status


@dataclass
class Answer:
    status: int
    body: str
    headers: dict[str, str] = field(default_factory=dict)


Send = Callable[[str], Answer]


def over_http(timeout: float = 60.0, headers: dict[str, str] | None = None) -> Send:
    def send(url: str) -> Answer:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as got:
                return Answer(got.status, got.read().decode("utf-8", "replace"), {k.lower(): v for k, v in got.headers.items()})
        except urllib.error.HTTPError as e:
            return Answer(e.code, e.read().decode("utf-8", "replace"), {k.lower(): v for k, v in e.headers.items()})

    return send


def from_files() -> Send:
    """Saved pages: addresses are paths on a file system that all machines have mounted."""

    def send(path: str) -> Answer:
        try:
            with open(path.removeprefix("file://"), encoding="utf-8") as f:
                return Answer(200, f.read())
        except FileNotFoundError:
            return Answer(404, "")

    return send


def sender(template: str, timeout: float = 60.0) -> Send:
    return over_http(timeout) if template.startswith(("http://", "https://")) else from_files()


def is_challenge(body: str) -> bool:
    """As ``functions.web.is_challenge``, of one page."""
    return any(m in body for m in CHALLENGE) and not (PAYLOAD[0] in body and PAYLOAD[1] in body.lower())


def wait_of(answer: Answer | None, tried: int, most: float, most_asked: float, now: Callable[[], datetime]) -> float:
    """Seconds before the next try: what the server asks for (a number or a date), else a doubling pause."""
    asked = answer.headers.get("retry-after", "").strip() if answer is not None else ""
    if asked.isdigit():
        return min(most_asked, float(asked))
    if asked:
        try:
            at = parsedate_to_datetime(asked)
            return min(most_asked, max(0.0, ((at if at.tzinfo else at.replace(tzinfo=UTC)) - now()).total_seconds()))
        except ValueError:
            pass
    return min(most, 2.0**tried)


def share(delay: float, tasks: int, task: int) -> tuple[float, float]:
    """(delay, first wait) of one of several tasks that together keep one request in ``delay`` seconds."""
    return delay * tasks, delay * (task % tasks)


class Transport:
    """``get`` gives a page's text. At most ``tries`` requests; network errors and the answers in RETRIED are tried again."""

    def __init__(self, send: Send, tries: int = 4, delay: float = 0.0, first_wait: float = 0.0, most: float = 30.0, most_asked: float = 300.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.send, self.tries, self.delay, self.most, self.most_asked, self.sleep, self.clock, self.now = send, tries, delay, most, most_asked, sleep, clock, now
        self.next_at = clock() + first_wait

    def pace(self) -> None:
        left = self.next_at - self.clock()
        if left > 0:
            self.sleep(left)
        self.next_at = self.clock() + self.delay

    def get(self, url: str) -> str:
        for tried in range(1, self.tries + 1):
            self.pace()
            answer, broken = None, None
            try:
                answer = self.send(url)
            except OSError as e:  # no connection, a time-out
                broken = e
            if answer is not None:
                if is_challenge(answer.body):
                    raise Challenge(f"challenge page (HTTP {answer.status}) for {url}")
                if answer.status < 400:
                    return answer.body
                if answer.status not in RETRIED or tried == self.tries:
                    raise Refused(answer.status, url)
            elif tried == self.tries:
                raise broken
            self.sleep(wait_of(answer, tried, self.most, self.most_asked, self.now))
        raise ValueError("tries must be 1 or more")

    def get_json(self, url: str) -> Any:
        return json.loads(self.get(url))
