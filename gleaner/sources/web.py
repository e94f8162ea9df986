"""The web as a source: fetching with retries and robots rules, in tasks.

A task fetches the urls of its partition one after the other and keeps the
pause of a host, so partition by host (``fetch_pages`` does).
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import urls

MAX_DELAY = 30.0
AGENT = "gleaner"


@dataclass(frozen=True)
class Fetched:
    body: bytes | None
    status_code: int | None
    content_type: str | None


def open_url(url: str, timeout: float, agent: str = AGENT) -> tuple[int, dict, bytes]:
    request = urllib.request.Request(url, headers={"User-Agent": agent})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


def retry_delay(headers: dict, attempt: int, delay: float) -> float:
    """Retry-After in seconds if it is a number, else a delay that grows with the attempts; never over half a minute."""
    try:
        wait = float(headers.get("retry-after", ""))
    except ValueError:
        wait = (attempt + 1) * delay
    return max(0.0, min(wait, MAX_DELAY))


def fetch(url: str, timeout: float = 10, delay: float = 1, retries: int = 3, get: Callable = open_url, sleep: Callable = time.sleep) -> Fetched:
    """One page; 429 and server errors are tried again, other answers than a good HTML page have no body."""
    status, headers, body = None, {}, b""
    for attempt in range(max(1, retries)):
        status, headers, body = get(url, timeout)
        if status != 429 and status < 500:
            break
        if attempt + 1 < retries:
            sleep(retry_delay(headers, attempt, delay))
    kind = headers.get("content-type")
    good = 200 <= status < 300 and (kind or "").lower().startswith("text/html")
    return Fetched(body if good else None, status, kind)


def robots(url: str, timeout: float = 10, get: Callable = open_url) -> urllib.robotparser.RobotFileParser:
    """The robots rules of a site; all is allowed where there are none."""
    u = urlsplit(url)
    rules = urllib.robotparser.RobotFileParser()
    try:
        status, _, body = get(f"{u.scheme}://{u.netloc}/robots.txt", timeout)
        rules.parse(body.decode("utf-8", "replace").splitlines() if status == 200 else [])
    except (OSError, ValueError):
        rules.parse([])
    return rules


SCHEMA = "url string, status_code int, content_type string, html string, error string"


def fetch_pages(targets: DataFrame, partitions: int, pause: float = 1, get: Callable = open_url, sleep: Callable = time.sleep, **options) -> DataFrame:
    """(url, status_code, content_type, html, error) of ``targets`` (url); a failed fetch has an error and no status."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, last = {}, {}
        for b in batches:
            rows = []
            for url in b["url"]:
                host = urlsplit(url).netloc
                if host not in rules:
                    rules[host] = robots(url, get=get)
                if not rules[host].can_fetch(AGENT, url):
                    rows.append((url, None, None, None, "robots"))
                    continue
                if host in last:
                    sleep(max(0.0, last[host] + pause - time.monotonic()))
                try:
                    f = fetch(url, get=get, sleep=sleep, **options)
                    rows.append((url, f.status_code, f.content_type, None if f.body is None else f.body.decode("utf-8", "replace"), None))
                except (OSError, ValueError) as e:
                    rows.append((url, None, None, None, str(e)))
                last[host] = time.monotonic()
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"status_code": "Int32"})

    by_host = targets.where(F.col("url").isNotNull()).repartition(partitions, urls.host_of(F.col("url")))
    return by_host.select("url").mapInPandas(run, SCHEMA)


def fetcher(partitions: int, pause: float = 1, **options) -> Callable[[DataFrame], DataFrame]:
    """``fetch_pages`` as the web of a crawl."""
    return lambda targets: fetch_pages(targets, partitions, pause, **options)


def search_results(pages: Iterable[list[dict]], query: str) -> list[dict]:
    """Results of a search API, page by page: rank over all pages, the first of a url wins."""
    seen, out = set(), []
    for number, page in enumerate(pages, 1):
        for k, r in enumerate(page, 1):
            key = urls._normalized(r.get("link"))
            if not key or key in seen:
                continue
            seen.add(key)
            out.append({"query": query, "normalized_url": key, "page_number": number, "rank": (number - 1) * 10 + k, "title": r.get("title", ""), "url": r["link"], "snippet": r.get("snippet", "")})
    return out
