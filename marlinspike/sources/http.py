"""HTTP feeds as a Spark data source: one partition per host, polite intervals, retries, robots rules."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, dict[str, str], float], tuple[int, bytes]]


def fetch(url: str, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    """Status and body of one GET."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


class Polite:
    """GETs with at least `interval` seconds between them; timeouts and 5xx are tried again up to `attempts` times in all."""

    def __init__(self, agent: str, interval: float = 1.0, timeout: float = 30.0, attempts: int = 4, get: Fetch = fetch, sleep: Callable[[float], None] = time.sleep):
        self.agent, self.interval, self.timeout, self.attempts, self._get, self._sleep = agent, interval, timeout, attempts, get, sleep
        self._last = 0.0

    def get(self, url: str) -> bytes:
        for attempt in range(1, self.attempts + 1):
            wait = self._last + self.interval - time.monotonic()
            if wait > 0:
                self._sleep(wait)
            self._last = time.monotonic()
            try:
                status, body = self._get(url, {"User-Agent": self.agent}, self.timeout)
            except (TimeoutError, urllib.error.URLError):
                status, body = 599, b""
            if status < 400:
                return body
            if status < 500 or attempt == self.attempts:
                raise OSError(f"{url}: status {status}")
            self._sleep(min(8.0, 2.0 ** (attempt - 1)))
        raise AssertionError

    def allowed(self, url: str) -> bool:
        """Whether robots.txt lets the agent fetch the address; a site without the file allows everything."""
        parts = urlsplit(url)
        status, body = self._get(f"{parts.scheme}://{parts.netloc}/robots.txt", {"User-Agent": self.agent}, self.timeout)
        if status in (404, 410):
            return True
        rules = urllib.robotparser.RobotFileParser()
        rules.parse(body.decode("utf-8", "replace").splitlines())
        return status < 400 and rules.can_fetch(self.agent, url)


class _Host(InputPartition):
    """The feeds of one host: they are read one after another, so that its pauses hold."""

    def __init__(self, feeds: list[tuple[str, str]]):
        self.feeds = feeds


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        by_host: dict[str, list[tuple[str, str]]] = {}
        for source_id, url in json.loads(self.options["feeds"]):
            by_host.setdefault(urlsplit(url).netloc.lower(), []).append((source_id, url))
        return [_Host(feeds) for feeds in by_host.values()]

    def read(self, partition: _Host) -> Iterator[tuple]:
        client = Polite(self.options.get("agent", "marlinspike"), float(self.options.get("interval", "1")), float(self.options.get("timeout", "30")))
        for source_id, url in partition.feeds:
            if not client.allowed(url):
                raise PermissionError(f"robots.txt disallows {url}")
            body = client.get(url).decode("utf-8", "replace")
            yield source_id, url, body, hashlib.sha256(body.encode()).hexdigest()


class HttpFeedSource(DataSource):
    """spark.read.format("http_feed").option("feeds", '[["source", "https://..."]]'): one row per feed document."""

    @classmethod
    def name(cls) -> str:
        return "http_feed"

    def schema(self) -> str:
        return "source_id string, url string, value string, content_hash string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))
