"""Paginated REST resources as rows, with a pluggable transport.

A transport is a picklable callable (url, params) -> (status, headers, body) with body the
decoded JSON; ``http`` is the default and ``Fixtures`` answers from a dictionary.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Transport = Callable[[str, dict], tuple[int, dict, object]]


class ApiError(RuntimeError):
    pass


#: The parameter whose value is posted as JSON.
POST = "__body"


class Http:
    def __init__(self, token: str = "", header: str = "Authorization"):
        self.headers = {header: token} if token else {}

    def __call__(self, url: str, params: dict) -> tuple[int, dict, object]:
        """Reads url with params; a body in params (``POST``) is sent instead."""
        body = json.dumps(params[POST]).encode() if POST in params else None
        full = f"{url}?{urllib.parse.urlencode(params)}" if params and body is None else url
        try:
            with urllib.request.urlopen(urllib.request.Request(full, body, self.headers), timeout=60) as r:
                return r.status, dict(r.headers), json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read().decode(errors="replace")


class Fixtures:
    """Pages by URL: a list of rows is served in pages of per_page."""

    def __init__(self, rows: dict[str, object]):
        self.rows = rows

    def __call__(self, url: str, params: dict) -> tuple[int, dict, object]:
        body = self.rows.get(url)
        if isinstance(body, list) and "page" in params:
            n, k = int(params["per_page"]), int(params["page"])
            last, body = -(-len(body) // n), body[(k - 1) * n : k * n]
            if k < last:
                return 200, {"Link": f'<{url}?per_page={n}&page={k + 1}>; rel="next", <{url}?per_page={n}&page={last}>; rel="last"'}, body
        return (404, {}, "") if body is None else (200, {}, body)


def answer(transport: Transport, url: str, params: dict, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> tuple[dict, object]:
    """Headers (lower-cased names) and body of a good answer; waits out rate limits, raises on other errors."""
    for _ in range(tries):
        status, headers, body = transport(url, params)
        limited = status == 429 or status == 403 and "rate limit" in str(body).lower()
        if not limited:
            break
        low = {k.lower(): v for k, v in headers.items()}
        wait = float(low.get("retry-after") or 0) or float(low.get("x-ratelimit-reset") or 0) - time.time()
        sleep(min(3600.0, max(1.0, wait)))
    if status >= 400:
        raise ApiError(f"{url}: {status}")
    return {k.lower(): v for k, v in headers.items()}, body


def get(transport: Transport, url: str, params: dict, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> object:
    """The body of a good answer."""
    return answer(transport, url, params, tries, sleep)[1]


def paginate(transport: Transport, url: str, params: dict | None = None, per_page: int = 100, max_pages: int = 10_000, stop: Callable[[dict], bool] | None = None) -> Iterator[dict]:
    """Rows of the pages until an empty or a non-list one, or a row that stop holds for.

    Pages beyond those allowed are an error, never left out."""
    for page in range(1, max_pages + 1):
        body = get(transport, url, {**(params or {}), "per_page": per_page, "page": page})
        if not isinstance(body, list) or not body:
            return
        for row in body:
            if stop and stop(row):
                return
            yield row
    raise ApiError(f"{url}: more than {max_pages} pages")


def _moment(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def resources(requests: DataFrame, transport: Transport, per_page: int = 100, max_pages: int = 10_000, newest_first: str = "", since: str = "") -> DataFrame:
    """key and JSON text of every row of each request (key, url, params as a map).

    Where rows come newest first by a time field, reading ends with the first before since."""

    def old(row: dict) -> bool:
        return bool(row.get(newest_first)) and _moment(row[newest_first]) < _moment(since)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, url, params in zip(f["key"], f["url"], f["params"], strict=True):
                rows = [json.dumps(r) for r in paginate(transport, url, dict(params or {}), per_page, max_pages, old if newest_first and since else None)]
                yield pd.DataFrame({"key": [key] * len(rows), "body": rows})

    return requests.select("key", "url", "params").mapInPandas(task, "key string, body string")


def documents(requests: DataFrame, transport: Transport, lenient: bool = False) -> DataFrame:
    """key and JSON text of the one object behind each request (key, url); where lenient, an error gives an empty one."""

    def one(url: str) -> str:
        try:
            return json.dumps(get(transport, url, {}))
        except (ApiError, OSError):
            if lenient:
                return "{}"
            raise

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "body": [one(u) for u in f["url"]]})

    return requests.select("key", "url").mapInPandas(task, "key string, body string")


def pull_list(spark: SparkSession, repos: list[str], transport: Transport, since: str = "", base: str = "") -> DataFrame:
    """repo, number and updated_at of PRs updated at or after since; the list is read newest first and no further."""
    rows = spark.createDataFrame([(r, f"{base}/repos/{r}/pulls", {"state": "all", "sort": "updated", "direction": "desc"}) for r in repos], "key string, url string, params map<string,string>")
    df = resources(rows, transport, newest_first="updated_at", since=since)
    return df.select(F.col("key").alias("repo"), F.from_json("body", "number int, updated_at string").alias("p")).select("repo", "p.*")


def current_milestones(spark: SparkSession, repos: list[str], transport: Transport, prefix: str = "", days: int = 10, base: str = "") -> DataFrame:
    """Each repository's open milestone with the prefix that is due first, its dates and its JSON."""
    rows = spark.createDataFrame([(r, f"{base}/repos/{r}/milestones", {"state": "open", "sort": "due_on", "direction": "asc"}) for r in repos], "key string, url string, params map<string,string>")
    m = resources(rows, transport).select(F.col("key").alias("repo"), "body", F.from_json("body", "number int, title string, due_on string, state string").alias("m")).select("repo", "body", "m.*")
    m = m.filter((F.coalesce("state", F.lit("open")) == "open") & F.startswith(F.coalesce("title", F.lit("")), F.lit(prefix)))
    top = m.groupBy("repo").agg(F.min_by(F.struct("number", "title", "due_on", "body"), F.struct(F.col("due_on").isNull(), "due_on", "number")).alias("m"))
    end = F.coalesce(F.to_date("m.due_on"), F.current_date())
    return top.select(
        "repo", F.concat("repo", F.lit("#milestone-"), "m.number").alias("sprint_id"), F.col("m.number").alias("milestone_id"), F.coalesce("m.title", F.concat(F.lit("Milestone "), "m.number")).alias("title"),
        F.date_sub(end, days).alias("start_date"), end.alias("end_date"), F.lit(days + 1).alias("length_days"), F.col("m.body").alias("raw_json"),
    )


def repo_id(transport: Transport, repo: str, base: str = "") -> int:
    """The numeric id of owner/name."""
    body = get(transport, f"{base}/repos/{repo}", {})
    if not isinstance(body, dict) or "id" not in body:
        raise ApiError(f"{repo}: no id")
    return int(body["id"])


def graphql(transport: Transport, query: str, variables: dict | None = None, base: str = "") -> dict:
    """The data of a GraphQL query; errors in its answer are errors here."""
    body = get(transport, f"{base}/graphql", {POST: {"query": query, "variables": variables or {}}})
    if not isinstance(body, dict) or body.get("errors") or "data" not in body:
        raise ApiError(f"graphql: {body.get('errors') if isinstance(body, dict) else body}")
    return body["data"]


def tracker_resource(transport: Transport, repo_id: int, kind: str, base: str = "") -> object:
    """A repository's board, milestones or epics in the tracker."""
    if kind not in ("board", "milestones", "epics"):
        raise ValueError(f"unknown resource: {kind}")
    return get(transport, f"{base}/p1/repositories/{repo_id}/{kind}", {})


def issue_estimates(issues: DataFrame, estimates: DataFrame) -> DataFrame:
    """issues (repo, issue_number, ..) with estimate_value, null where there is none."""
    best = estimates.groupBy("repo", "issue_number").agg(F.max("estimate_value").alias("estimate_value"))
    return issues.join(best, ["repo", "issue_number"], "left")
