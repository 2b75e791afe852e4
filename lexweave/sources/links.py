"""Link probes (SRC11): plain connector policy with an injected client, run in tasks over distinct addresses."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

Client = Callable[[str, str, dict], tuple[int, str]]  # (method, url, headers) -> (status, final url)


def allowed(url: str, hosts: set[str]) -> bool:
    try:
        parts = urlsplit(url)
        return parts.scheme == "https" and (parts.hostname or "") in hosts
    except ValueError:
        return False


def link_status(url: str | None, client: Client, hosts: set[str]) -> int:
    """The status of HEAD, or of a GET of one byte where HEAD isn't answered well; 0 for errors and for addresses that
    are, or lead, outside ``hosts``."""
    if not url or not allowed(url, hosts):
        return 0
    for method, headers in (("HEAD", {}), ("GET", {"Range": "bytes=0-0"})):
        try:
            status, final = client(method, url, headers)
        except Exception:  # noqa: BLE001
            return 0
        if not allowed(final or url, hosts):
            return 0
        if 200 <= status <= 399:
            return status
    return status


def probe(df: DataFrame, column: str, client: Client, hosts: set[str]) -> DataFrame:
    """(column, link_status) of each distinct address; join it back to the records."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({column: b[column], "link_status": [link_status(u, client, hosts) for u in b[column]]})

    return df.select(column).where(df[column].isNotNull()).distinct().mapInPandas(run, f"{column} string, link_status int")
