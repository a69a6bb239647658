"""Documents from HTTP: a Spark data source for lists of URLs, and a function for tables of them.

``spark.read.format("leafmill_pages")`` plans its partitions by host: the URLs of one host stay together up to
``perTask`` of them, small hosts share a partition. :func:`fetch_all` deals the URLs of a table the same way with
an exchange by host. A page that cannot be had is a row with an error, never a failed task; requests
are repeated at most ``retries`` times, and only where a connection broke.
"""

from __future__ import annotations

import errno
import http.client
import json
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls
from ..functions.extract import MAX_BYTES, byte_size
from ..functions.shipping import ship

TYPES = ("", "text/html", "application/xhtml+xml")
FETCH_SECONDS = 15.0
PER_TASK = 200
SCHEMA = "url string, html string, shown_url string, steps array<struct<action:string,outcome:string,status:int,message:string>>, load_error string"


class FetchError(ValueError):
    """What is wrong with a response, with its status."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class _Answered(urllib.request.HTTPErrorProcessor):
    """Responses of any status are responses, not errors; redirects are followed."""

    def http_response(self, request, response):
        return response if response.status < 300 or response.status >= 400 else super().http_response(request, response)

    https_response = http_response


@dataclass(frozen=True)
class Fetch:
    """How pages are fetched. ``trust`` is ``platform`` (the machine's roots) or the path of a PEM file with the roots to trust instead."""

    max_bytes: int = MAX_BYTES
    head_first: bool = True
    timeout: float = FETCH_SECONDS
    retries: int = 0
    trust: str = "platform"

    def opener(self) -> urllib.request.OpenerDirector:
        if self.trust == "platform":
            context = ssl.create_default_context()
        else:
            context = ssl.SSLContext(ssl.PROTOCOL_TLS_CLIENT)
            try:
                context.load_verify_locations(self.trust)
            except ssl.SSLError as e:
                raise FetchError(f"Custom CA bundle {self.trust} does not contain any PEM certificates.") from e
            except OSError as e:
                raise FetchError(f"Could not read custom CA bundle {self.trust}: {e.strerror}") from e
        return urllib.request.build_opener(_Answered, urllib.request.HTTPSHandler(context=context))


def broken(error: BaseException) -> bool:
    """That a connection broke or the other side spoke no proper HTTP: what lets a refused HEAD fall back to GET, or a request be repeated."""
    if isinstance(error, urllib.error.URLError) and not isinstance(error, urllib.error.HTTPError) and isinstance(error.reason, BaseException):
        error = error.reason
    if isinstance(error, (http.client.HTTPException, EOFError, ConnectionResetError, ConnectionAbortedError, BrokenPipeError)):
        return True
    return isinstance(error, ssl.SSLEOFError) or isinstance(error, OSError) and error.errno in (errno.ECONNRESET, errno.ECONNABORTED, errno.EPIPE)


def _valid(response, method: str, shown: str, max_bytes: int) -> None:
    length, kind = response.headers.get("content-length"), response.headers.get("content-type") or ""
    if not 200 <= response.status < 300:
        raise FetchError(f"{method} {shown} returned unexpected status {response.status}.", response.status)
    if length and length.isdigit() and int(length) > max_bytes:
        raise FetchError(f"{method} response exceeds {byte_size(max_bytes)} limit.", response.status)
    if kind.split(";")[0].strip().lower() not in TYPES:
        raise FetchError(f"{method} {shown} reported non-HTML content type {kind}.", response.status)


_ERRORS = (OSError, http.client.HTTPException, EOFError, ValueError)


def fetch(url: str, max_bytes: int = MAX_BYTES, head_first: bool = True, timeout: float = FETCH_SECONDS, how: Fetch | None = None) -> dict:
    """html, the shown URL, the steps taken and an error, if there is one.

    A HEAD request that is answered with success must be acceptable, or the page is refused; any other answer, or a connection that
    breaks, leaves the judgement to GET; all other failures (refused, unknown host, too slow, untrusted) are final.
    """
    how = how or Fetch(max_bytes, head_first, timeout)
    shown = urls.redacted(url)
    out = {"html": None, "shown_url": shown, "steps": [], "load_error": None}
    if shown is None:
        return out | {"load_error": "only http and https URLs without credentials are allowed"}
    step = lambda action, outcome, status=None, message=None: out["steps"].append({"action": action, "outcome": outcome, "status": status, "message": message})
    reason = lambda e: str(getattr(e, "reason", e)) or type(e).__name__
    try:
        opener = how.opener()
    except FetchError as e:
        return out | {"load_error": str(e)}

    def ask(method: str, use: Callable):
        for left in range(how.retries, -1, -1):
            try:
                with opener.open(urllib.request.Request(url, method=method), timeout=how.timeout) as response:
                    return use(response)
            except _ERRORS as e:
                if not left or not broken(e):
                    raise
                step(method.lower(), "retried", None, reason(e))
                time.sleep(min(2.0, 0.1 * 2 ** (how.retries - left)))

    def head(response) -> None:
        if not 200 <= response.status < 300:
            return step("head", "fallback", response.status, f"HEAD returned {response.status}; GET decides.")
        _valid(response, "HEAD", shown, how.max_bytes)
        return step("head", "succeeded", response.status)

    def get(response) -> str:
        _valid(response, "GET", shown, how.max_bytes)
        raw = response.read(how.max_bytes + 1)
        if len(raw) > how.max_bytes:
            raise FetchError(f"{shown} exceeds {byte_size(how.max_bytes)} limit.", response.status)
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError as e:
            raise FetchError(f"{shown} is not valid UTF-8", response.status) from e
        step("get", "succeeded", response.status)
        return text

    if not how.head_first:
        step("head", "skipped")
    else:
        try:
            ask("HEAD", head)
        except _ERRORS as e:
            if isinstance(e, FetchError) or not broken(e):
                step("head", "failed", getattr(e, "status", None), reason(e))
                return out | {"load_error": str(e) if isinstance(e, FetchError) else f"Could not preflight {shown} with HEAD: {reason(e)}"}
            step("head", "fallback", None, reason(e))
    try:
        out["html"] = ask("GET", get)
    except _ERRORS as e:
        step("get", "failed", getattr(e, "status", None), reason(e))
        out["load_error"] = str(e) if isinstance(e, FetchError) else f"Could not fetch {shown}: {reason(e)}"
    return out


_STEP = pa.struct([("action", pa.string()), ("outcome", pa.string()), ("status", pa.int32()), ("message", pa.string())])
_SHAPE = pa.schema([("url", pa.string()), ("html", pa.string()), ("shown_url", pa.string()), ("steps", pa.list_(_STEP)), ("load_error", pa.string())])


def _fetched(some: Iterable[str], how: Fetch) -> Iterator[pa.RecordBatch]:
    """One page a batch, so that a task holds one page at a time."""
    for one in some:
        yield pa.RecordBatch.from_pylist([{"url": one} | fetch(one, how=how)], _SHAPE)


def by_host(some: Iterable[str], per_task: int) -> list[list[str]]:
    """The distinct URLs dealt to tasks: hosts with more than ``per_task`` are cut, small ones share a task."""
    hosts: dict[str, list[str]] = {}
    for url in dict.fromkeys(some):
        hosts.setdefault(urlsplit(url).netloc.lower(), []).append(url)
    out, shared = [], []
    for _, mine in sorted(hosts.items()):
        pieces = [mine[i : i + per_task] for i in range(0, len(mine), per_task)]
        out += [p for p in pieces if len(p) == per_task]
        rest = [p for p in pieces if len(p) < per_task]
        for piece in rest:
            if shared and len(shared) + len(piece) > per_task:
                out.append(shared)
                shared = []
            shared = shared + piece
    return [*out, shared] if shared else out


@dataclass
class Some(InputPartition):
    urls: list[str]


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        value = {k.lower(): v for k, v in options.items()}
        self.urls = json.loads(value.get("urls", "[]"))
        self.per_task = int(value.get("pertask", PER_TASK))
        self.how = Fetch(int(value.get("maxbytes", MAX_BYTES)), value.get("preflight", "head-first") != "get-only", float(value.get("timeoutms", 1000 * FETCH_SECONDS)) / 1000, int(value.get("retries", 0)), value.get("trust", "platform"))

    def partitions(self) -> list[Some]:
        return [Some(p) for p in by_host(self.urls, self.per_task)] or [Some([])]

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        return _fetched(partition.urls, self.how)


class PageSource(DataSource):
    """Options: ``urls`` (a JSON list), ``perTask``, ``maxBytes``, ``preflight`` (head-first or get-only), ``timeoutMs``, ``retries``, ``trust``."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, some: Iterable[str], **options: object) -> DataFrame:
    """url, html, shown_url, steps and load_error of each distinct URL, through the data source."""
    ship(spark).dataSource.register(PageSource)
    return spark.read.format("leafmill_pages").options(urls=json.dumps(list(some)), **{k: str(v) for k, v in options.items()}).load()


def fetch_all(pages: DataFrame, url: str = "url", max_bytes: int = MAX_BYTES, head_first: bool = True, partitions: int | None = None, how: Fetch | None = None, spread: int = 16) -> DataFrame:
    """The same for the distinct URLs of a table, dealt by host; a host's URLs are spread over at most ``spread`` tasks."""
    ship(pages.sparkSession)
    how = how or Fetch(max_bytes, head_first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _fetched(batch.column(0).to_pylist(), how)

    host = F.lower(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1))
    links = pages.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    dealt = [host, F.pmod(F.xxhash64("url"), F.lit(spread))]
    links = links.repartition(partitions, *dealt) if partitions else links.repartition(*dealt)
    return links.mapInArrow(run, SCHEMA)
