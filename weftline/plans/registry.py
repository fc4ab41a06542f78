"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- what several queries' SQL shares ----
def enc(x: str) -> str:
    out = f"url_encode({x})"
    for c, plain in (("%2F", "/"), ("%2C", ","), ("%27", "''"), ("%3A", ":"), ("%40", "@"), ("%3B", ";"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%24", "$"), ("%2A", "*")):
        out = f"replace({out}, '{c}', '{plain}')"
    return out


RESPONSES = "responses as (select page_id, url, html, case page_id % 10 when 7 then 404 when 8 then 503 when 9 then 301 else 200 end as status from pages)"
LINKS = f"""hrefs as (select page_id, url as page_url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 as pos from pages),
links as (select page_id, pos, page_url, href, lower(regexp_extract(page_url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(page_url, '://([^/?#]*)', 1)) || {enc('href')} as url from hrefs),
outlinks as (select *, sha1('{{"body":"","method":"GET","url":"' || replace(url, '/', '\\/') || '"}}') as fp from links)"""
LOG = "log as (select event_id as seq, user_id as slot, epoch_us(ts) as at_us, ts, event_type <> 'error' as ok, case when event_type = 'error' then 'E' || (user_id % 3) end as error_class, value / 100 as latency, event_type as kind, props from events)"
FRONTIER = "frontier as (select o_orderkey as seq, 6 - cast(left(o_orderpriority, 1) as int) as priority, sha1(o_orderkey::varchar) as task_id, o_orderstatus as state, o_orderdate as queued from orders)"
HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
