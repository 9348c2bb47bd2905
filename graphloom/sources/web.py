"""Crawling connectors: category pages, abstracts and citation counts over HTTP, as Python data sources.

A transport fetches one JSON answer for one request, so the readers work on any
service and are tested without one. A reader has one partition, and with it one rate limit.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

Transport = Callable[[dict], tuple[int, dict]]


@dataclass
class RateLimit:
    """At most ``limit`` requests in any ``period`` seconds; a caller waits its turn."""

    period: float
    limit: int
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    times: deque = field(default_factory=deque)

    def __call__(self) -> None:
        while True:
            now = self.clock()
            while self.times and now - self.times[0] >= self.period:
                self.times.popleft()
            if len(self.times) < self.limit:
                self.times.append(now)
                return
            self.sleep(self.period - (now - self.times[0]))


def request(transport: Transport, parameters: dict, retries: int = 3, limit: RateLimit | None = None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One answer; a busy service (429) and failures are tried again after 1, 2, 4 ... seconds."""
    last: Exception | None = None
    for attempt in range(retries):
        if limit:
            limit()
        try:
            status, answer = transport(parameters)
            if status == 200:
                return answer
            last = RuntimeError(f"status {status}")
            if status != 429:
                raise last
        except (OSError, RuntimeError) as error:
            last = error
        if attempt < retries - 1:
            sleep(2**attempt)
    raise last or RuntimeError("no request was made")


def http_transport(url: str, timeout: float = 30.0) -> Transport:
    def fetch(parameters: dict) -> tuple[int, dict]:
        import json
        from urllib.error import HTTPError
        from urllib.parse import urlencode
        from urllib.request import urlopen

        try:
            with urlopen(f"{url}?{urlencode(parameters)}", timeout=timeout) as answer:  # noqa: S310
                return answer.status, json.load(answer)
        except HTTPError as error:
            return error.code, {}

    return fetch


def _answers(transport: Transport, parameters: dict, most: int, limit: RateLimit | None) -> Iterator[dict]:
    """An answer and its continuations."""
    more: dict = {}
    for _ in range(most):
        answer = request(transport, parameters | more, limit=limit)
        yield answer
        more = answer.get("continue") or {}
        if not more:
            return


def category_record(transport: Transport, category: int, limit: RateLimit | None = None, most_answers: int = 10) -> dict | None:
    """{id, title, pages, sub_categories} of a category; None if it is missing."""
    asked = {"action": "query", "format": "json", "pageids": category, "generator": "categorymembers", "gcmpageid": category, "gcmlimit": 500, "prop": "info"}
    pages, below, title = [], [], None
    for answer in _answers(transport, asked, most_answers, limit):
        title = answer.get("title", title)
        for member in answer.get("query", {}).get("pages", {}).values():
            if "missing" in member:
                continue
            name, space = member.get("title", ""), member.get("ns", 0)
            if space == 14:
                below.append({"id": member["pageid"], "title": name.removeprefix("Category:")})
            elif space == 0:
                pages.append(member["pageid"])
            else:
                raise ValueError(f"unknown kind of member: {member}")
    return None if title is None and not pages and not below else {"id": category, "title": (title or "").removeprefix("Category:"), "pages": pages, "sub_categories": below}


def crawl(transport: Transport, root: int, max_depth: int, known: dict[int, dict] | None = None, limit: RateLimit | None = None) -> Iterator[dict]:
    """Category records breadth first from a root; those in ``known`` are not fetched anew, nor given out."""
    seen, front = {root}, [root]
    known = known or {}
    for depth in range(max_depth + 1):
        after: list[int] = []
        for category in front:
            record = known.get(category)
            if record is None:
                record = category_record(transport, category, limit)
                if record is None:
                    continue
                yield record
            if depth < max_depth:
                for child in record["sub_categories"]:
                    if child["id"] not in seen:
                        seen.add(child["id"])
                        after.append(child["id"])
        front = after


def abstracts(transport: Transport, ids: list[int], size: int = 50, limit: RateLimit | None = None) -> Iterator[dict]:
    """{id, title, abstract} of pages; missing and empty ones are left out."""
    for at in range(0, len(ids), size):
        asked = {"action": "query", "format": "json", "prop": "extracts", "exintro": 1, "explaintext": 1, "pageids": "|".join(map(str, ids[at : at + size]))}
        for answer in _answers(transport, asked, 1000, limit):
            for page in answer.get("query", {}).get("pages", {}).values():
                if "missing" not in page and page.get("extract"):
                    yield {"id": page["pageid"], "title": page["title"], "abstract": page["extract"]}


def citation_counts(transport: Transport, ids: list[str], size: int = 500, limit: RateLimit | None = None) -> Iterator[dict]:
    """{id, citation_count}; answers come in the order of the request, with nulls for unknown papers."""
    for at in range(0, len(ids), size):
        part = ids[at : at + size]
        answer = request(transport, {"ids": part, "fields": "citationCount"}, limit=limit)
        for paper, found in zip(part, answer["data"], strict=True):
            if found is not None:
                yield {"id": paper, "citation_count": found["citationCount"]}


class CategorySource(DataSource):
    """``spark.read.format("category_crawl").option("url", ..).option("root", ..).option("max_depth", ..)``."""

    @classmethod
    def name(cls) -> str:
        return "category_crawl"

    def schema(self) -> str:
        return "id bigint, title string, pages array<bigint>, sub_categories array<struct<id:bigint,title:string>>"

    def reader(self, schema) -> DataSourceReader:
        return CategoryReader(dict(self.options))


class CategoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        transport = http_transport(self.options["url"])
        limit = RateLimit(1.0, int(self.options.get("per_second", 50)))
        for r in crawl(transport, int(self.options["root"]), int(self.options.get("max_depth", 0)), limit=limit):
            yield r["id"], r["title"], r["pages"], [(c["id"], c["title"]) for c in r["sub_categories"]]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CategorySource)
