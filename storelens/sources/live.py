"""A Python data source that fetches bodies: requests are dealt over partitions, the pages of one come one after the other.

Options: ``kind`` (page, form, search, app or reviews), ``url`` or ``urls`` (JSON list), ``body``, ``contentType``, ``userAgent``,
``timeout`` (seconds), ``throttleMs`` (least time between two requests), ``lanes`` (with a throttle: over so many partitions
the requests are dealt, 1 if not given; the partitions take turns, so the rate is that of one), ``notBefore`` (seconds since
1970: no request earlier). For apps and reviews: ``appId`` or ``appIds`` (JSON list), ``lang`` and ``country`` or ``locales`` (JSON
list of pairs), ``base`` (the store's address). For reviews: ``sort``, ``count`` (the total), ``pageSize``, ``pages`` (at most so many for each
rating), ``scores`` (such as ``1,2,3,4,5``). ``token`` starts behind a page. For a search: ``moreUrl`` (where further pages are asked
for) and ``count``.

Filters ``= k`` and ``IN (...)`` of ``app_id``, ``lang``, ``country`` and ``score_query`` are pushed down where requests have these
columns: what they rule out is not asked for. Other filters stay with Spark. Only rows that count towards a total are
counted: reviews with an id, results with an app id. Any status but 200 is an error; there is no retry. Errors are
rows: ``status``, ``error``. ``at`` is the time of the request.

The source is also a stream, of reviews: a batch takes the next page of each read, and its offset holds the tokens, so
a query that was stopped goes on behind the last page that it had committed. It asks one request at a time. A request in
error ends the query; started again, it asks for that page again.
"""

from __future__ import annotations

import json
import math
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, SimpleDataSourceStreamReader

from ..functions.payload import BLOCK
from ..functions.text import PREFIXES
from ..operators.tables import SEARCH_BLOCKS, SEARCH_CONTAINERS
from ..schemas import BASE_URL, PAGE_MOST
from . import requests

# What the requests say about the client.
USER_AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
GET_HEADERS = {"Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9"}
POST_HEADERS = {"Accept": "*/*"}
#: Requests without a throttle are dealt over at most so many partitions.
PARTITIONS = 64
FORM, FORM_UTF8 = "application/x-www-form-urlencoded", "application/x-www-form-urlencoded;charset=UTF-8"

SCHEMA = "request string, app_id string, lang string, country string, score_query int, page_no int, status int, error string, body string, at double"


class Asked(NamedTuple):
    """A request, with the values of its columns."""

    url: str
    body: str | None = None
    app_id: str | None = None
    lang: str | None = None
    country: str | None = None
    score_query: int | None = None

    def row(self, page: int, status: int, error: str | None, text: str, at: float) -> tuple:
        return self.url, self.app_id, self.lang, self.country, self.score_query, page, status, error, text, at


class Requests(InputPartition):
    """Requests that are made one after the other, in a lane of several that start at a time."""

    def __init__(self, requests: list[Asked], lane: int = 0, lanes: int = 1, start: float = 0):
        self.requests, self.lane, self.lanes, self.start = requests, lane, lanes, start


class Throttle:
    """At least ``wait`` seconds between two calls, the first not before a given time.

    Of several lanes each has every n-th of the times that are ``wait`` apart; a call takes the next one of its lane that is
    still to come. So no two calls of all lanes together are closer, whenever the lanes begin and however long calls take.
    """

    def __init__(self, wait: float, first: float = 0, lane: int = 0, lanes: int = 1):
        self.wait, self.next, self.first, self.lane, self.lanes = wait, first, first, lane, lanes

    def __call__(self) -> float:
        if self.lanes > 1 and self.wait > 0:
            turn = math.ceil((max(time.time(), self.next) - self.first) / self.wait - self.lane)
            self.next = self.first + (self.lane + self.lanes * max(0, -(-turn // self.lanes))) * self.wait
        if (rest := self.next - time.time()) > 0:
            time.sleep(rest)
        now = time.time()
        self.next = (self.next if self.lanes > 1 else now) + self.wait
        return now


def fetch(url: str, body: str | None, agent: str, timeout: float, content: str) -> tuple[int, str, str | None]:
    """Status, text and error of one request; a body makes it a form."""
    headers = {"User-Agent": agent} | (GET_HEADERS if body is None else POST_HEADERS | {"Content-Type": content})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body.encode() if body is not None else None, headers), timeout=timeout) as answer:
            return answer.status, answer.read().decode(errors="replace"), None if answer.status == 200 else f"unexpected status {answer.status}"
    except urllib.error.HTTPError as e:
        return e.code, "", f"unexpected status {e.code}"
    except OSError as e:
        return 0, "", str(e)


def walk(data, *steps):
    for i in steps:
        data = data[i] if isinstance(data, list) and i < len(data) else data.get(str(i)) if isinstance(data, dict) else None
    return data


def inner(body: str):
    """The inner document of a response; None if there is none."""
    try:
        return json.loads(json.loads(body[body.find("\n") + 1 :])[0][2])
    except (ValueError, TypeError, IndexError, KeyError):
        return None


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _package(row) -> bool:
    """Does a result of a first page keep its app id?"""
    row = row[0] if isinstance(row, list) and len(row) == 1 and isinstance(row[0], list) else row
    for steps in ((0, 0, 0, 0), (0, 0, 0), (0, 0)):
        head, dot, rest = _text(walk(row, *steps)).partition(".")
        if dot and rest and head in PREFIXES:
            return True
    return False


def find_apps(data: object) -> list | None:
    """``first_app_array`` for plain values."""

    def is_app(v: object) -> bool:
        for steps in ((0, 0), (0, 0, 0), (0, 0, 0, 0), (12, 0)):
            head, dot, rest = (text := _text(walk(v, *steps))).partition(".")
            if len(text) > 3 and dot and rest and head in PREFIXES:
                return True
        return False

    work = [data]
    while work:
        v = work.pop()
        if isinstance(v, list):
            if any(isinstance(x, list) and is_app(x) for x in v):
                return v
            work += reversed(v)
    return None


def search_page_info(body: str) -> tuple[int, str]:
    """Number of results and token of a first page of a search, where its blocks and containers may be."""
    blocks = {}
    for key, data in re.findall(BLOCK, body):
        try:
            blocks[key] = json.loads(data.strip())
        except ValueError:
            continue
    data = next((blocks[k] for k in SEARCH_BLOCKS if k in blocks), None)
    rows = next((r for p in SEARCH_CONTAINERS if isinstance(r := walk(data, 0, 1, 0, p, 0), list) and r), None) or find_apps(data) or []
    return sum(map(_package, rows)), _text(walk(data, 0, 1, 0, 0, 3, 0))


def batch_info(body: str) -> tuple[int, str]:
    """The same for a further page of a search."""
    data = inner(body)
    rows = walk(data, 0, 0, 0)
    return sum(walk(r, 12, 0) not in (None, "") for r in rows) if isinstance(rows, list) else 0, _text(walk(data, 0, 0, 7, 1))


def page_info(body: str) -> tuple[int, str]:
    """Number of reviews and token of a review page; a malformed page has neither."""
    data = inner(body)
    rows = walk(data, 0)
    return sum(isinstance(r, list) and bool(_text(walk(r, 0))) for r in rows) if isinstance(rows, list) else 0, _text(walk(data, 1, 1))


class Options:
    """The options of a read, and the requests that they mean."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def get(self, name: str, default=None):
        return self.options.get(name.lower(), default)

    def columns(self) -> set[str]:
        """The columns that every request has a value in."""
        return {"app": {"app_id", "lang", "country"}, "reviews": {"app_id", "lang", "country", "score_query"}}.get(self.get("kind", "page"), set())

    def requests(self) -> list[Asked]:
        get, kind = self.get, self.get("kind", "page")
        if kind not in ("app", "reviews"):
            urls = json.loads(get("urls")) if get("urls") else [get("url")]
            return [Asked(u, get("body") if kind == "form" else None) for u in urls]
        apps = json.loads(get("appIds")) if get("appIds") else [get("appId")]
        if not apps or not all(apps):
            raise ValueError("app id is required")
        locales = json.loads(get("locales")) if get("locales") else [[get("lang", "en"), get("country", "us")]]
        places = [(app, *locale) for app in apps for locale in locales]
        if kind == "app":
            return [Asked(requests.app_url(*x, get("base", BASE_URL)), None, *x) for x in places]
        scores = [int(x) for x in get("scores", "0").split(",")]
        return [Asked(get("url") or requests.rpc_url(*x[1:], get("base", BASE_URL)), None, *x, s) for x in places for s in scores]

    def ask(self, throttle: Throttle, url: str, body: str | None) -> tuple:
        """Time, status, text and error of one request."""
        get = self.get
        return throttle(), *fetch(url, body, get("userAgent", USER_AGENT), float(get("timeout", 30)), get("contentType", FORM))

    def review_page(self, throttle: Throttle, asked: Asked, token: str) -> tuple:
        get = self.get
        return self.ask(throttle, asked.url, requests.reviews_form(asked.app_id, int(get("sort", 2)), int(get("pageSize", PAGE_MOST)), asked.score_query, token))


class Reader(Options, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in self.columns():
                values = {f.value} if isinstance(f, EqualTo) else {x for x in f.value if x is not None}
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Requests]:
        asked = [x for x in self.requests() if all(getattr(x, name) in values for name, values in self.wanted.items())]
        throttled = float(self.get("throttleMs", 0)) > 0
        n = min(len(asked), int(self.get("lanes", 1)) if throttled else PARTITIONS)
        start = max(time.time(), float(self.get("notBefore", 0)))
        return [Requests(asked[k::n], k, n, start) for k in range(n)] or [Requests([])]

    def read(self, part: Requests) -> Iterator[tuple]:
        first = part.start if part.lanes > 1 else float(self.get("notBefore", 0))
        throttle = Throttle(float(self.get("throttleMs", 0)) / 1000, first, part.lane, part.lanes)
        pages = {"search": self.search, "reviews": self.reviews}.get(self.get("kind", "page"), self.single)
        for asked in part.requests:
            yield from pages(throttle, asked)

    def single(self, throttle: Throttle, asked: Asked) -> Iterator[tuple]:
        at, status, text, error = self.ask(throttle, asked.url, asked.body)
        yield asked.row(0, status, error, text, at)

    def search(self, throttle: Throttle, asked: Asked) -> Iterator[tuple]:
        left, page, address, form, before = int(self.get("count", 20)), 0, asked.url, None, None
        while True:
            at, status, text, error = self.ask(throttle, address, form)
            yield asked.row(page, status, error, text, at)
            rows, token = batch_info(text) if page else search_page_info(text)
            left, page, address, form = left - rows, page + 1, self.get("moreUrl"), requests.form(requests.SEARCH_BODY, token=token)
            if error or left <= 0 or not token or (not rows and token == before):  # a page that only repeats its token leads nowhere
                return
            before = token

    def reviews(self, throttle: Throttle, asked: Asked) -> Iterator[tuple]:
        left, token, page, most = int(self.get("count", 500)), self.get("token", "") or "", 0, int(self.get("pages", 1 << 31))
        while left > 0 and page < most:
            at, status, text, error = self.review_page(throttle, asked, token)
            yield asked.row(page, status, error, text, at)
            rows, token = page_info(text)
            left, page = left - rows, page + 1
            if error or not rows or not token:
                return


class TokenStream(Options, SimpleDataSourceStreamReader):
    """Reviews page by page. The offset has ``[token, pages so far, reviews left]`` of each read in turn; without a token and with
    pages, or with nothing left, a read is over."""

    def __init__(self, options: dict):
        super().__init__(options)
        if self.get("kind") != "reviews":
            raise ValueError("only reviews are a stream")
        self.reads = self.requests()
        self.throttle = Throttle(float(self.get("throttleMs", 0)) / 1000)

    def initialOffset(self) -> dict:
        return {"reads": [[self.get("token", "") or "", 0, int(self.get("count", 500))] for _ in self.reads]}

    def page(self, asked: Asked, state: list) -> tuple[tuple, list]:
        """The next page of a read, and its state behind it."""
        token, page, left = state
        at, status, text, error = self.review_page(self.throttle, asked, token)
        if error:
            raise RuntimeError(f"request failed: {error} (app {asked.app_id}, page {page})")
        rows, token = page_info(text)
        return asked.row(page, status, error, text, at), [token if rows else "", page + 1, max(0, left - rows)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], []
        for asked, state in zip(self.reads, start["reads"], strict=True):
            token, page, left = state
            if left > 0 and (token or not page):
                row, state = self.page(asked, state)
                rows.append(row)
            end.append(state)
        return iter(rows), {"reads": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages of a batch that was planned but not committed, asked for again."""
        for asked, state, last in zip(self.reads, start["reads"], end["reads"], strict=True):
            while state[1] < last[1]:
                row, state = self.page(asked, state)
                yield row

    def commit(self, end: dict) -> None:
        pass


class Live(DataSource):
    @classmethod
    def name(cls) -> str:
        return "storelens_live"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def simpleStreamReader(self, schema) -> TokenStream:
        return TokenStream(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Live)
