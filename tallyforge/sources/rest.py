"""A paged REST source as a Python data source, batch and streaming, with retries.

Each (team, season) is a partition, read by start and limit until the announced total; a page that fails for good is
asked for again in half the size.  Filters on team and season leave out partitions before anything is asked for.  As a
stream each micro-batch goes on from the last page that was committed.  Pages landed as JSON files are read with
``files.explode_variant`` instead.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

RETRY = (429, 500, 502, 503, 504)

#: How often a request is tried and how the waits grow.
TRIES, FACTOR = 4, 0.8


def fetch(url: str, tries: int = TRIES, factor: float = FACTOR, open_url: Callable[[str], bytes] | None = None, sleep: Callable[[float], None] = time.sleep) -> dict:
    """JSON by GET, again after 429 and 5xx with growing waits; other errors are raised at once."""
    def plain(address: str) -> bytes:
        with urllib.request.urlopen(address, timeout=30) as answer:
            return answer.read()

    for attempt in range(tries):
        try:
            return json.loads((open_url or plain)(url))
        except urllib.error.HTTPError as error:
            if error.code not in RETRY or attempt + 1 == tries:
                raise
            sleep(factor * 2**attempt)
    raise AssertionError("unreachable")


def pages(ask: Callable[[int, int], dict], limit: int = 100, least: int = 10, start: int = 0) -> Iterator[dict]:
    """Items from start and limit until the total; a page that cannot be had is asked for in half the size."""
    while True:
        try:
            answer = ask(start, limit)
        except urllib.error.HTTPError:
            if limit // 2 < least:
                raise
            limit //= 2
            continue
        items = answer.get("data", [])
        yield from items
        start += len(items)
        if not items or start >= int(answer.get("total", 0)):
            return


def _asker(options: dict[str, str], team: str, season: str) -> Callable[[int, int], dict]:
    """Asks the address, and the fallback where that fails for good."""
    base, fallback, factor = options["url"], options.get("fallback"), float(options.get("factor", FACTOR))

    def ask(start: int, limit: int) -> dict:
        query = urllib.parse.urlencode({"start": start, "limit": limit, "team": team, "season": season})
        try:
            return fetch(f"{base}?{query}", factor=factor)
        except urllib.error.HTTPError:
            if not fallback:
                raise
            return fetch(f"{fallback}?{query}", factor=factor)

    return ask


def _listed(options: dict[str, str], name: str) -> list[str]:
    return [x for x in options.get(name, "").split(",") if x]


class _Part(InputPartition):
    def __init__(self, team: str, season: str):
        super().__init__((team, season))
        self.team, self.season = team, season


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.allowed: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters that name teams or seasons choose partitions; the others go back to Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute not in (("team",), ("season",)):
                yield f
                continue
            name = f.attribute[0]
            self.allowed[name] = self.allowed.get(name, wanted) & wanted

    def partitions(self) -> list[_Part]:
        keep = lambda name: [x for x in _listed(self.options, name + "s") if x in self.allowed.get(name, {x})]
        return [_Part(t, s) for s in keep("season") for t in keep("team")]

    def read(self, partition: _Part) -> Iterator[tuple]:
        ask = _asker(self.options, partition.team, partition.season)
        for item in pages(ask, int(self.options.get("limit", 100)), int(self.options.get("least", 10))):
            yield partition.team, partition.season, json.dumps(item)


class _Stream(SimpleDataSourceStreamReader):
    """Offsets hold how many items of each partition have been read, so that a restart asks for what comes after."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {f"{t}/{s}": 0 for s in _listed(self.options, "seasons") for t in _listed(self.options, "teams")}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for part, at in start.items():
            team, season = part.split("/", 1)
            answer = _asker(self.options, team, season)(at, int(self.options.get("limit", 100)))
            items = answer.get("data", [])
            rows += [(team, season, json.dumps(item)) for item in items]
            end[part] = at + len(items)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for part, at in start.items():
            team, season = part.split("/", 1)
            ask = _asker(self.options, team, season)
            while at < end[part]:
                items = ask(at, min(int(self.options.get("limit", 100)), end[part] - at)).get("data", [])
                if not items:
                    break
                yield from ((team, season, json.dumps(item)) for item in items)
                at += len(items)


class PagedRest(DataSource):
    """``register(spark)``, then ``spark.read.format("paged_rest")`` or ``readStream`` with options url, teams, seasons,
    limit, least, factor and fallback. One row for each item: team, season, item (JSON text). Filters on team and season
    choose partitions. A stream reads one page of each partition a micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "team string, season string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with the setting that hands it filters."""
    spark.dataSource.register(PagedRest)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
