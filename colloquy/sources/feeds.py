"""Polled feeds: a fixture generator, an HTTP reader with retries, and data sources over a cursor.

The network part is a function that can be replaced, so tests and examples run on the
generated pages; the cursor, the retry and the stopping rules are the same either way.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

ITEM_SCHEMA = "id string, created_at_ms long, comment_count int, body string"


def stub_feed(spark: SparkSession, sort: str, limit: int, round_index: int) -> DataFrame:
    """A generated feed page: rank 1.. and ids that overlap between rounds."""
    t = spark.range(limit)
    return t.select(
        F.lit(round_index).alias("round"), F.lit(sort).alias("sort"), (F.col("id") + 1).cast("int").alias("rank"), F.concat(F.lit("post_"), (F.col("id") + round_index * 3).cast("string")).alias("post_id"),
        ((F.col("id") * 7 + round_index) % 50).cast("int").alias("comment_count"),
    )


def stub_post(spark: SparkSession, post_id: str) -> DataFrame:
    """A generated post detail."""
    return spark.range(1).select(F.lit(post_id).alias("post_id"), F.concat(F.lit("title of "), F.lit(post_id)).alias("title"), F.lit(3).alias("comment_count"))


def stub_communities(spark: SparkSession, n: int = 3) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("community_"), F.col("id").cast("string")).alias("name"), (F.col("id") * 10).alias("subscriber_count"))


def resolve_mode(mode: str, probe: Callable[[], int]) -> str:
    """``auto`` tries the server once: live if it answers, a stub if it refuses (401, 403) or can't be reached."""
    if mode != "auto":
        return mode
    try:
        return "stub" if probe() in (401, 403) else "live"
    except OSError:
        return "stub"


def stub_thread(spark: SparkSession, post_id: str, width: int = 3) -> DataFrame:
    """A generated two-level comment document as nested JSON."""
    leaf = "concat('{\"id\":\"', post, '_c', i, '_', j, '\",\"author\":\"a', j, '\",\"children\":[]}')"
    node = f"concat('{{\"id\":\"', post, '_c', i, '\",\"author\":{{\"name\":\"a', i, '\"}},\"children\":[', array_join(transform(sequence(0, 1), j -> {leaf}), ','), ']}}')"
    doc = f"concat('{{\"comments\":[', array_join(transform(sequence(0, {width - 1}), i -> {node}), ','), ']}}')"
    return spark.range(1).select(F.lit(post_id).alias("post")).select("post", F.expr(doc).alias("json"))


def comment_rows(doc: str | None) -> Iterator[tuple]:
    """(id, parent_id, depth, author) of a nested comment document, by a stack: no level is the last."""

    def text(value) -> str | None:
        if isinstance(value, bool):
            return "true" if value else "false"
        out = value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        return None if out is None else out.encode("utf-8", "replace").decode()

    try:
        payload = json.loads(doc or "null", parse_int=str, parse_float=str)
    except json.JSONDecodeError:
        return
    below = lambda of, key: [c for c in v if isinstance(c, dict)] if isinstance(of, dict) and isinstance(v := of.get(key), list) else []
    stack = [(c, None, 0) for c in reversed(below(payload, "comments"))]
    while stack:
        node, outer, depth = stack.pop()
        own, author = text(node.get("id")), node.get("author")
        yield own, text(node.get("parent_id")) or outer, depth, text(author.get("name") if isinstance(author, dict) else author)
        stack += [(c, own, depth + 1) for c in reversed(below(node, "children"))]


def flatten_comments(docs: DataFrame) -> DataFrame:
    """(post, id, parent_id, depth, author) of nested comment documents, however deep.

    A node's own parent_id counts if it is not empty, else the node that encloses it.
    Documents that are no JSON have no rows; one nested beyond the JSON parser's own
    limit (thousands of levels) fails, it is not cut.
    """
    from colloquy.sources.scratch import ship

    ship(docs.sparkSession)
    kinds = pa.schema([("post", pa.string()), ("id", pa.string()), ("parent_id", pa.string()), ("depth", pa.int32()), ("author", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc in batch.to_pylist():
                rows = comment_rows(doc["json"])
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([doc["post"]] * len(part), *zip(*part)), kinds.types)], schema=kinds)

    return docs.select(F.col("post").cast("string"), F.col("json").cast("string")).mapInArrow(run, "post string, id string, parent_id string, depth int, author string")


def backoff_seconds(attempt: int, retry_after: str | None, base: float, cap: float = 60.0) -> float:
    """The server's wish if it gives one, else doubling from the base; both capped."""
    try:
        return min(cap, max(0.0, float(retry_after))) if retry_after is not None else min(cap, base * 2**attempt)
    except ValueError:
        return min(cap, base * 2**attempt)


def http_get(url: str, headers: dict[str, str] | None = None, timeout: float = 30, retries: int = 4, base: float = 1.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> tuple[int, str]:
    """(status, body); retries on 429, on 5xx and on network errors."""
    for attempt in range(retries + 1):
        after = None
        try:
            with opener(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or attempt == retries:
                return e.code, ""
            after = e.headers.get("Retry-After") if e.headers else None
        except OSError:
            if attempt == retries:
                raise
        sleep(backoff_seconds(attempt, after, base))
    raise AssertionError


def stub_page(after_ms: int, before_ms: int, size: int) -> list[dict]:
    """What a server would answer: items each 1000 ms, ascending."""
    first = -(-after_ms // 1000) * 1000
    return [{"id": f"i{t // 1000}", "created_at_ms": t, "comment_count": t // 1000 % 40, "body": f"text {t}"} for t in range(first, min(before_ms, first + 1000 * size), 1000)]


class FeedError(RuntimeError):
    """A page that could not be had: what was read so far is not the whole window."""


def http_page(base_url: str, get: Callable = http_get, log: Callable[[dict], None] | None = None) -> Callable[[int, int, int], list[dict]]:
    """Pages of a server; a status other than 200 and a body that holds no list are errors, not ends.

    ``log`` gets an entry of the request log for every call, failed ones too.
    """

    def fetch(after_ms: int, before_ms: int, size: int) -> list[dict]:
        params = {"after": str(after_ms), "before": str(before_ms), "limit": str(size), "sort": "asc"}
        url = f"{base_url}?{urllib.parse.urlencode(params)}"
        began, status, body, error = time.time(), None, "", None
        try:
            status, body = get(url)
        except OSError as e:
            error = f"{type(e).__name__}: {e}"
        if log:
            log({"method": "GET", "endpoint": urllib.parse.urlsplit(base_url).path, "url": url, "params": params, "retrieved_at_utc": began, "http_status": status, "latency_ms": (time.time() - began) * 1000, "bytes": len(body.encode()), "error": error})
        if error or status != 200:
            raise FeedError(f"{url}: {error or f'status {status}'}")
        try:
            payload = json.loads(body)
        except ValueError as e:
            raise FeedError(f"{url}: no JSON") from e
        if isinstance(payload, list):
            return payload
        found = next((v for k in ("data", "items", "results") if isinstance(payload, dict) and isinstance(v := payload.get(k), list)), None)
        if found is None:
            raise FeedError(f"{url}: no list")
        return found

    return fetch


def next_page(fetch: Callable, after_ms: int, before_ms: int, size: int) -> tuple[list[dict], int]:
    """Items from ``after_ms`` on, ascending, and the next cursor; the window is complete where there are none.

    Items that share the last time of a full page may go on beyond it, so they are left to
    the next page, which begins at that time; a page of one time alone is asked again in
    twice the size. ``size`` must not exceed what the server gives at once.
    """
    while True:
        page = fetch(after_ms, before_ms, size)
        if not page:
            return [], after_ms
        last = page[-1]["created_at_ms"]
        if len(page) < size:
            return page, last + 1
        whole = [i for i in page if i["created_at_ms"] < last]
        if whole:
            return whole, last
        more = fetch(after_ms, before_ms, 2 * size)
        if len(more) <= len(page):
            if fetch(last + 1, before_ms, 1):  # the server gives no more at once, though there is more
                raise FeedError(f"more than {len(page)} items may share the time {last}")
            return page, last + 1
        size *= 2


def pages(fetch: Callable, after_ms: int, before_ms: int, size: int, cap: int) -> Iterator[dict]:
    """Items of [after, before), each id once; ends at an empty page, a cursor that stands still, or the cap."""
    seen: set[str] = set()
    while True:
        page, nxt = next_page(fetch, after_ms, before_ms, size)
        if not page:
            return
        for item in page:
            if item["id"] not in seen:
                seen.add(item["id"])
                yield item
                if len(seen) >= cap:
                    return
        if nxt <= after_ms:
            return
        after_ms = nxt


class _Window(InputPartition):
    def __init__(self, after_ms: int, before_ms: int):
        self.after_ms, self.before_ms = after_ms, before_ms


class CursorReader(DataSourceReader):
    """A window cut into partitions, each paged on its own."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        a, b, n = int(self.options["after_ms"]), int(self.options["before_ms"]), int(self.options.get("partitions", 4))
        edges = [a + (b - a) * k // n for k in range(n + 1)]
        return [_Window(x, y) for x, y in zip(edges, edges[1:], strict=False) if x < y]

    def read(self, partition: _Window):
        o = self.options
        fetch = http_page(o["url"]) if "url" in o else stub_page
        for i in pages(fetch, partition.after_ms, partition.before_ms, int(o.get("page_size", 100)), int(o.get("max_items", 1 << 40))):
            yield (i["id"], int(i["created_at_ms"]), int(i.get("comment_count") or 0), i.get("body"))


class CursorStream(SimpleDataSourceStreamReader):
    """One page a micro-batch; the offset is the next cursor, so a restart goes on where it ended."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"after_ms": int(self.options["after_ms"])}

    def _page(self, after_ms: int) -> tuple[list[dict], int]:
        o = self.options
        return next_page(http_page(o["url"]) if "url" in o else stub_page, after_ms, int(o["before_ms"]), int(o.get("page_size", 100)))

    def read(self, start: dict):
        page, nxt = self._page(start["after_ms"])
        rows = [(i["id"], int(i["created_at_ms"]), int(i.get("comment_count") or 0), i.get("body")) for i in page]
        return iter(rows), {"after_ms": nxt}

    def readBetweenOffsets(self, start: dict, end: dict):
        rows, at = [], start["after_ms"]
        while at < end["after_ms"]:
            page, nxt = self._page(at)
            page = [i for i in page if i["created_at_ms"] < end["after_ms"]]
            if not page:
                break
            rows += [(i["id"], int(i["created_at_ms"]), int(i.get("comment_count") or 0), i.get("body")) for i in page]
            at = nxt
        return iter(rows)


class CursorSource(DataSource):
    """spark.read.format("cursor_feed") and readStream: options after_ms, before_ms, page_size, max_items, url."""

    @classmethod
    def name(cls):
        return "cursor_feed"

    def schema(self):
        return ITEM_SCHEMA

    def reader(self, schema):
        return CursorReader(self.options)

    def simpleStreamReader(self, schema):
        return CursorStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known; its classes travel by value, so executors need no installed package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CursorSource)
