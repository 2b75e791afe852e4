"""A paged provider as a Spark data source (SRC1, SRC2, SRC8): pages are partitions, fetched in the tasks.

``spark.dataSource.register(PagedSource)``; ``spark.read.format("paged_records")`` with option ``url`` (with {page} and {size})
asks a service, with the retries of ``fetch``; with option ``root`` it reads pages page-1.json, page-2.json ... of a folder
that all executors share. ``walk`` serves callers with a client of their own, ``lookup`` reads details by id.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SIZE = 100
RETRY_STATUS = {429, 503, 504}


class FetchError(Exception):
    def __init__(self, code: str, terminal: bool = False):
        super().__init__(code)
        self.code, self.terminal = code, terminal


def wait_seconds(attempt: int, retry_after: str | None, base: float = 0.5, rng: Callable[[], float] = random.random) -> float:
    """SRC8. What the server asks for, else doubling with up to half as much again at random."""
    try:
        asked = float(retry_after) if retry_after else 0.0
    except ValueError:
        asked = 0.0
    return asked if asked > 0 else base * 2**attempt * (1 + rng() / 2)


def fetch(get: Callable[[], tuple[int, str, dict]], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """SRC8. The body of ``get`` () -> (status, body, headers); busy answers, empty and HTML bodies are tried again."""
    for attempt in range(retries + 1):
        after, code = None, ""
        try:
            status, body, headers = get()
            after = {k.lower(): v for k, v in headers.items()}.get("retry-after")
            text = body.strip()
            if status in RETRY_STATUS:
                code = f"HTTP_{status}"
            elif status >= 400:
                raise FetchError(f"HTTP_{status}", terminal=True)
            elif not text:
                code = "EMPTY_BODY"
            elif text[:14].lower().startswith("<!doctype html") or text[:5].lower() == "<html":
                code = "HTML_BODY"
            else:
                return body
        except OSError:
            code = "NETWORK"
        if attempt == retries:
            raise FetchError(code)
        sleep(wait_seconds(attempt, after))
    raise AssertionError


def walk(read_page: Callable[[int, int], tuple[list, int]], limit: int, page_size: int = PAGE_SIZE) -> list:
    """SRC1. Records page by page until the provider's total, the caller's limit or an empty page."""
    out: list = []
    size, page = min(page_size, max(1, limit), PAGE_SIZE), 1
    while len(out) < limit:
        rows, total = read_page(page, size)
        out += rows
        if not rows or page * size >= total:
            break
        page += 1
    return out[:limit]


def http_get(url: str, timeout: float = 10.0) -> Callable[[], tuple[int, str, dict]]:
    """A plain client for ``fetch``: answers of every status come back as they are, network faults as OSError."""

    def get() -> tuple[int, str, dict]:
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return r.status, r.read().decode("utf-8", "replace"), dict(r.headers)
        except urllib.error.HTTPError as e:
            return e.code, "", dict(e.headers)

    return get


class _Page(InputPartition):
    def __init__(self, number: int, at: str):
        self.number, self.at = number, at


class _Reader(DataSourceReader):
    """Pages of a service (``url`` with {page} and {size}) or of a shared folder (``root``, any URI pyarrow knows)."""

    def __init__(self, options: dict):
        self.url, self.root = options.get("url"), options.get("root")
        if bool(self.url) == bool(self.root):
            raise ValueError("give url or root")
        self.size = min(PAGE_SIZE, max(1, int(options.get("page_size", PAGE_SIZE))))
        self.limit = int(options.get("limit", 0))
        self.base, self.retries = float(options.get("wait", 0.5)), int(options.get("retries", 3))

    def _body(self, at: str) -> str:
        sleep = lambda s: time.sleep(s * self.base / 0.5)
        if self.url:
            return fetch(http_get(at), self.retries, sleep)

        def get() -> tuple[int, str, dict]:
            fs, path = _files(at)
            with fs.open_input_stream(path) as f:
                return 200, f.read().decode("utf-8"), {}

        return fetch(get, self.retries, sleep)

    def partitions(self) -> list[_Page]:
        if self.root:
            fs, path = _files(self.root)
            names = [i.path.rsplit("/", 1)[1] for i in fs.get_file_info(FileSelector(path)) if i.is_file]
            found = sorted(int(m.group(1)) for m in (re.fullmatch(r"page-(\d+)\.json", n) for n in names) if m)
            return [_Page(n, f"{self.root.rstrip('/')}/page-{n}.json") for n in found]
        # the first page tells how many there are; it is read once more by its task
        first = json.loads(self._body(self.url.format(page=1, size=self.size)))
        total = int((first.get("PrecSearch") or {}).get("totalCnt") or 0)
        total = min(total, self.limit) if self.limit else total
        return [_Page(n, self.url.format(page=n, size=self.size)) for n in range(1, -(-total // self.size) + 1)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        found = (json.loads(self._body(partition.at)).get("PrecSearch") or {}).get("prec") or []
        rows = found if isinstance(found, list) else [found]
        if self.limit and self.url:
            rows = rows[: max(0, self.limit - (partition.number - 1) * self.size)]
        for row in rows:
            yield partition.number, json.dumps(row, ensure_ascii=False)


def _files(uri: str) -> tuple[FileSystem, str]:
    """A folder or file that all executors share: file://, hdfs://, s3:// or gs://; a plain path counts as shared."""
    return FileSystem.from_uri(uri) if "://" in uri else (LocalFileSystem(), uri)


class PagedSource(DataSource):
    """``page INT, payload STRING`` of each listed record; a page that can't be had fails the read with its code."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "page int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def lookup(ids: DataFrame, key: str, get_detail: Callable[[str], str]) -> DataFrame:
    """SRC2. key, payload and error_code of each distinct id: one call of the client in a task, one failure an error on its row."""

    def run(batches):
        for b in batches:
            rows = []
            for i in b[key]:
                try:
                    rows.append((i, get_detail(i), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, None, getattr(e, "code", "FETCH_FAILED")))
            yield pd.DataFrame(rows, columns=[key, "payload", "error_code"])

    return ids.select(key).where(ids[key].isNotNull()).distinct().mapInPandas(run, f"{key} string, payload string, error_code string")
