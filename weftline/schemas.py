"""Spark schemas of the records that flow: request, response, lease, link, item route, statistic."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REQUEST = (
    "url string, method string, headers map<string,string>, body string, cookies map<string,string>, encoding string, priority int, dont_filter boolean, callback string, errback string, flags array<string>, "
    "cb_kwargs map<string,string>, use_proxy boolean, fp string, depth int, retry_times int, max_retry_times int, dont_retry boolean, priority_adjust int, slot string, download_timeout double, download_latency double, proxy string, "
    "handle_httpstatus_all boolean, handle_httpstatus_list array<int>, referrer_policy string, redirect_urls array<string>, dont_redirect boolean, meta map<string,string>"
)
RESPONSE = "url string, status int, headers map<string,string>, cookies map<string,string>, body binary, flags array<string>, kind string"
LEASE = "task_id string, token string, redelivered boolean, score double, deadline timestamp, payload string"
LINK = "url string, text string, fragment string, nofollow boolean"
ROUTE = "sink string, table_name string, mode string, update_fields array<string>, on_conflict string, alias string, filename string"
STAT = "spider string, key string, value double, kind string"


def dumps(record: Column) -> Column:
    """A record as JSON, nulls left out: the queue's payload."""
    return F.to_json(record)


def loads(payload: Column, schema: str = REQUEST) -> Column:
    """A payload as a record; unknown keys are dropped, and what isn't JSON is a record of nulls."""
    return F.from_json(payload, schema)


def requests_from(payload: Column, decode: Callable[[Column], dict[str, Column]] | None = None, schema: str = REQUEST) -> Column:
    """A payload as a request; ``decode`` gets it as it was queued and returns the fields that it reads its own way."""
    record = loads(payload, schema)
    for name, value in (decode(payload) if decode else {}).items():
        record = record.withField(name, value)
    return F.when(payload.isNotNull(), record)


def without_nulls(record: Column) -> Column:
    return F.map_filter(record, lambda k, v: v.isNotNull())


def layered(*maps: Column) -> Column:
    """Settings in layers, the last that has a key winning."""
    def under(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)

    return functools.reduce(under, maps)


def global_name(module: Column, name: Column) -> Column:
    return F.concat_ws(".", module, name)
