"""Fetching: which handler serves a URL's scheme, and one operator that any handler runs in.

No handler that needs a network or a browser comes with the package; ``fetch`` takes any callable of a request.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote_to_bytes, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import urls as U

#: (url, method, headers, body) to (status, headers, body)
Handler = Callable[[str, str, dict[str, str], bytes], tuple[int, dict[str, str], bytes]]
RESPONSE = "status int, headers map<string,string>, body binary, error string, latency_ms long"


def handler_of(url: Column, handlers: dict[str, str]) -> Column:
    """The name of the handler for the URL's scheme; null where none is."""
    out = F.lit(None).cast("string")
    for scheme, name in handlers.items():
        out = F.when(U.scheme(url) == scheme, F.lit(name)).otherwise(out)
    return out


def data_url(url: str, method: str, headers: dict[str, str], body: bytes) -> tuple[int, dict[str, str], bytes]:
    """Answers a ``data:`` URL with what it holds."""
    import base64

    head, mark, rest = url.removeprefix("data:").partition(",")
    if not mark:
        raise ValueError("no data in URL")
    raw = unquote_to_bytes(rest)
    kind = head.removesuffix(";base64") or "text/plain;charset=US-ASCII"
    return 200, {"Content-Type": kind}, base64.b64decode(raw) if head.endswith(";base64") else raw


def file_url(url: str, method: str, headers: dict[str, str], body: bytes) -> tuple[int, dict[str, str], bytes]:
    """Answers a ``file:`` URL, from a folder that all executors share."""
    with open(unquote_to_bytes(urlsplit(url).path).decode(), "rb") as stream:
        return 200, {}, stream.read()


HANDLERS: dict[str, Handler] = {"data": data_url, "file": file_url}


def fetch(requests: DataFrame, key: str, handlers: dict[str, Handler] | None = None, most_bytes: int | None = None) -> DataFrame:
    """(key, url, status, headers, body, error, latency_ms) of (key, url, method, headers, body), through the handler of each URL's scheme.

    A handler is made for or shared by all rows of a task. An exception, a scheme without a handler ('NotSupported') or a body of more than
    ``most_bytes`` is an error row; it ends that request alone.
    """
    served = HANDLERS if handlers is None else handlers
    kind = dict(requests.dtypes)[key]

    def answer(row: dict[str, Any]) -> tuple:
        import time

        began = time.monotonic()
        try:
            handler = served.get((row["url"] or "").partition(":")[0].lower())
            if handler is None:
                return None, None, None, "NotSupported", 0
            status, headers, body = handler(row["url"], row["method"] or "GET", dict(row["headers"] or ()), row["body"] or b"")
            if most_bytes is not None and len(body) > most_bytes:
                return None, None, None, "TooLarge", int(1000 * (time.monotonic() - began))
            return status, list(headers.items()), body, None, int(1000 * (time.monotonic() - began))
        except Exception as e:
            return None, None, None, type(e).__name__, int(1000 * (time.monotonic() - began))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = [answer(r) for r in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[key, "url", "status", "headers", "body", "error", "latency_ms"])

    rows = requests.select(key, F.col("url").cast("string"), F.col("method").cast("string"), F.col("headers").cast("map<string,string>"), F.col("body").cast("binary"))
    return rows.mapInArrow(run, f"{key} {kind}, url string, {RESPONSE}")
