"""Landing files over HTTP, on the driver: throttled, retried, never retried for what isn't there."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from barscreen.config import FileSource, Ingest

RETRIED = frozenset({403, 408, 425, 429, 500, 502, 503, 504})


@dataclass(frozen=True)
class Fetched:
    status: str  # ok or not_found
    content: bytes = b""
    sha256: str = ""


class Fetcher:
    """GET with a floor between requests and jittered, growing pauses between attempts."""

    def __init__(self, settings: Ingest, opener: Callable[..., object] = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep):
        self.settings, self.opener, self.sleep, self.last = settings, opener, sleep, 0.0

    def start_session(self) -> None:
        """Visit the page that sets cookies; a failure is left to the requests after it."""
        try:
            self._get(self.settings.session_url)
        except (OSError, ValueError):
            pass

    def _get(self, url: str) -> bytes:
        wait = self.last + self.settings.seconds_between_requests - time.monotonic()
        if wait > 0:
            self.sleep(wait)
        self.last = time.monotonic()
        request = urllib.request.Request(url, headers={"User-Agent": self.settings.user_agent, "Referer": self.settings.session_url})
        with self.opener(request, timeout=self.settings.timeout_seconds) as reply:
            return reply.read()

    def fetch(self, url: str) -> Fetched:
        for attempt in range(self.settings.max_retries + 1):
            try:
                content = self._get(url)
                return Fetched("ok", content, hashlib.sha256(content).hexdigest())
            except urllib.error.HTTPError as error:
                if error.code == 404:
                    return Fetched("not_found")
                if error.code not in RETRIED or attempt == self.settings.max_retries:
                    raise
            except OSError:
                if attempt == self.settings.max_retries:
                    raise
            pause = min(self.settings.backoff_max_seconds, self.settings.backoff_base_seconds * 2**attempt)
            self.sleep(pause * random.uniform(0.5, 1.0))
        raise AssertionError("unreachable")

    def fetch_day(self, day: dt.date) -> tuple[FileSource | None, Fetched]:
        source = self.settings.source_for(day)
        return source, self.fetch(source.url_for(day)) if source else Fetched("not_found")


def chunks(start: dt.date, end: dt.date, days: int = 60) -> Iterator[tuple[dt.date, dt.date]]:
    """Consecutive ranges of so many days at most, from start to end, both included."""
    while start <= end:
        last = min(start + dt.timedelta(days=days - 1), end)
        yield start, last
        start = last + dt.timedelta(days=1)
