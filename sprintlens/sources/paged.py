"""Paged REST lists as a Spark data source: partitions are pages, a bound on time is pushed to them.

Rows of a list come newest first by a time field, as pull requests do by ``updated_at``.

* Batch: the first answer tells how many pages there are; a filter ``updated_at >= t`` is
  pushed into planning, which finds the last page that can hold such rows by bisection, and
  spans of pages become partitions. So a list of any length is read in parallel, and of an
  old one only its new end. A service that doesn't tell its last page is read in turn by one
  task, which ends at the first row before the bound.
* Stream: the offset is the last update that was read; each trigger reads the rows since.
  Rows of the offset's own moment come again, as others of that moment may have been late:
  sinks go by key.

Spark still applies the filter itself, so nothing depends on what was pushed.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, SimpleDataSourceStreamReader

from .rest import Transport, answer

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Pages of a partition, and lists that are planned at a time.
SPAN, TOGETHER = 10, 8


def moment(text: str | None) -> datetime | None:
    if not text:
        return None
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class _Span(InputPartition):
    """Pages first to last of a list; last 0: as far as they go."""

    def __init__(self, key: str, url: str, params: dict, first: int, last: int, since: datetime | None):
        super().__init__((key, first))
        self.key, self.url, self.params, self.first, self.last, self.since = key, url, params, first, last, since


class _Lists:
    """What the options say: the transport, and the lists as [key, url, params]."""

    def __init__(self, options):
        self.transport: Transport = cloudpickle.loads(base64.b64decode(options["transport"]))
        self.lists, self.time = json.loads(options["lists"]), options.get("time", "updated_at")
        self.per_page, self.span = int(options.get("per_page", 100)), int(options.get("span", SPAN))

    def page(self, url: str, params: dict, k: int) -> tuple[dict, list[dict]]:
        headers, body = answer(self.transport, url, {**params, "per_page": self.per_page, "page": k})
        return headers, body if isinstance(body, list) else []

    def at(self, row: dict) -> datetime | None:
        return moment(row.get(self.time))

    def rows(self, span: _Span) -> Iterator[tuple]:
        k = span.first
        while not span.last or k <= span.last:
            _, body = self.page(span.url, span.params, k)
            if not body:
                return
            for row in body:
                at = self.at(row)
                if span.since and at and at < span.since:
                    return
                yield span.key, k, at, json.dumps(row)
            k += 1

    def spans(self, one: list, since: datetime | None) -> list[_Span]:
        key, url, params = one
        headers, body = self.page(url, params, 1)
        if not body:
            return []
        known = re.search(r'[?&]page=([0-9]+)[^>]*>; *rel="last"', headers.get("link", ""))
        if not known and 'rel="next"' in headers.get("link", ""):
            return [_Span(key, url, params, 1, 0, since)]
        lo, hi = 1, int(known[1]) if known else 1
        if not known and len(body) >= self.per_page:
            return [_Span(key, url, params, 1, 0, since)]
        while since and lo < hi:  # the last page whose first row is not before since
            mid = (lo + hi + 1) // 2
            _, rows = self.page(url, params, mid)
            at = self.at(rows[0]) if rows else None
            if at and at >= since:
                lo = mid
            else:
                hi = mid - 1
        return [_Span(key, url, params, k, min(k + self.span - 1, hi), since) for k in range(1, hi + 1, self.span)]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.lists, self.since = _Lists(options), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and tuple(f.attribute) == ("updated_at",) and isinstance(f.value, datetime):
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                self.since = at if self.since is None else max(self.since, at)
            yield f  # a page may hold older rows: Spark filters, too

    def partitions(self):
        with ThreadPoolExecutor(TOGETHER) as pool:
            return [s for spans in pool.map(lambda x: self.lists.spans(x, self.since), self.lists.lists) for s in spans]

    def read(self, partition):
        return self.lists.rows(partition)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.lists, self.start = _Lists(options), options.get("since", "")

    def initialOffset(self) -> dict:
        return {"since": self.start}

    def _since(self, since: str) -> list[tuple]:
        return [row for key, url, params in self.lists.lists for row in self.lists.rows(_Span(key, url, params, 1, 0, moment(since)))]

    def read(self, start: dict):
        rows = self._since(start["since"])
        last = max((r[2] for r in rows if r[2]), default=None)
        if last is None or start["since"] and last <= moment(start["since"]):
            return iter([]), start  # nothing newer
        return iter(rows), {"since": last.isoformat()}

    def readBetweenOffsets(self, start: dict, end: dict):
        upto = moment(end["since"])
        return iter(r for r in self._since(start["since"]) if upto and r[2] and r[2] <= upto)

    def commit(self, end: dict) -> None:
        pass


class PagedRest(DataSource):
    """key, page, updated_at and body (JSON) of the rows of paged lists."""

    @classmethod
    def name(cls):
        return "paged_rest"

    def schema(self):
        return "key string, page int, updated_at timestamp, body string"

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)


def _options(lists: list[tuple[str, str, dict]], transport: Transport, per_page: int, span: int) -> dict[str, str]:
    return {"transport": base64.b64encode(cloudpickle.dumps(transport)).decode(), "lists": json.dumps(lists), "per_page": str(per_page), "span": str(span)}


def paged(spark: SparkSession, lists: list[tuple[str, str, dict]], transport: Transport, per_page: int = 100, span: int = SPAN) -> DataFrame:
    """Rows of lists (key, url, params) that come newest first; filter by ``updated_at`` to read their new ends only."""
    spark.dataSource.register(PagedRest)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("paged_rest").options(**_options(lists, transport, per_page, span)).load()


def followed(spark: SparkSession, lists: list[tuple[str, str, dict]], transport: Transport, since: str = "", per_page: int = 100) -> DataFrame:
    """The same rows as a stream, from those updated at or after since on."""
    spark.dataSource.register(PagedRest)
    return spark.readStream.format("paged_rest").options(**_options(lists, transport, per_page, SPAN), since=since).load()
