"""User code in a plan: component order, chains of DataFrame steps, and callbacks from pages to requests and items."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


def load(name: str | Any) -> Any:
    """An object, or what a dotted path names."""
    if not isinstance(name, str):
        return name
    module, _, attribute = name.rpartition(".")
    if not module:
        raise ValueError(f"not a dotted path: {name}")
    return getattr(importlib.import_module(module), attribute)


def ordered(base: dict[Any, int | None], own: dict[Any, int | None] | None = None) -> list[Any]:
    """Components by weight; an own weight replaces the base's, and None switches a component off."""
    merged: dict[Any, int | None] = {}
    for layer in (base, own or {}):
        for name, weight in layer.items():
            merged[load(name)] = weight
    return [c for c, w in sorted(((c, w) for c, w in merged.items() if w is not None), key=lambda x: x[1])]


def through(rows: DataFrame, steps: list[Step], backwards: bool = False) -> DataFrame:
    """Rows through every step; requests go forwards, responses and outputs backwards. A step that returns None changes nothing."""
    for step in reversed(steps) if backwards else steps:
        made = step(rows)
        rows = rows if made is None else made
    return rows


def short_circuit(requests: DataFrame, steps: list[Callable[[DataFrame], tuple[DataFrame, DataFrame | None] | None]]) -> tuple[DataFrame, DataFrame | None]:
    """(requests that go on to the download, answers given on the way).

    A step gets the requests that are left and returns those to pass on, with answers for the others, or None to change nothing. What a
    step answers reaches neither later steps nor the download.
    """
    answers: DataFrame | None = None
    for step in steps:
        made = step(requests)
        if made is None:
            continue
        requests, given = made
        if given is not None:
            answers = given if answers is None else answers.unionByName(given, allowMissingColumns=True)
    return requests, answers


class Pipeline:
    """Item steps with a beginning and an end: ``open`` of each in order, its ``process``, then ``close`` of all, also after an error."""

    def __init__(self, steps: list[Any]):
        self.steps = steps

    def __call__(self, items: DataFrame) -> DataFrame:
        return through(items, [s.process for s in self.steps])

    def __enter__(self) -> Pipeline:
        for s in self.steps:
            getattr(s, "open", lambda: None)()
        return self

    def __exit__(self, *error: Any) -> None:
        for s in reversed(self.steps):
            getattr(s, "close", lambda: None)()


def parse(pages: DataFrame, callback: Callable[[dict], Iterator[tuple[str, dict] | None]], columns: list[str], key: str = "page_id", errback: Callable[[dict, Exception], Iterator[tuple[str, dict] | None]] | None = None) -> DataFrame:
    """(key, kind, payload): what a callback yields for each page: ('request', {...}), ('item', {...}) or None.

    An exception of the callback goes to ``errback``, which may yield the same; without one, or if that raises too, it is a row of kind
    'error' with its class and text. It ends that page alone.
    """
    kind = dict(pages.dtypes)[key]

    def take(rows: list[tuple], k: Any, made: Iterator[tuple[str, dict] | None]) -> None:
        for out in made:
            if out is None:
                continue
            if out[0] not in ("request", "item"):
                raise TypeError(f"neither request nor item: {out[0]}")
            rows.append((k, out[0], json.dumps(out[1], ensure_ascii=False, sort_keys=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page in batch.to_pylist():
                try:
                    try:
                        take(rows, page[key], callback(page))
                    except Exception as e:
                        if errback is None:
                            raise
                        take(rows, page[key], errback(page, e))
                except Exception as e:
                    rows.append((page[key], "error", json.dumps({"class": type(e).__name__, "text": str(e)})))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(key).type, pa.string(), pa.string()))], names=[key, "kind", "payload"])

    return pages.select(key, *columns).mapInArrow(run, f"{key} {kind}, kind string, payload string")
