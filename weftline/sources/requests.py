"""Requests built from forms, JSON, parameters and command lines."""

from __future__ import annotations

import argparse
import base64
import functools
import json
import shlex
from collections import Counter
from urllib.parse import parse_qsl, quote_plus, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import urls as U

CURL = T.StructType([T.StructField("url", T.StringType()), T.StructField("method", T.StringType()), T.StructField("body", T.StringType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("cookies", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])


def body(data: Column, json_body: Column, raw: Column) -> Column:
    """JSON before form data before a raw body, null as empty."""
    return F.coalesce(json_body, data, raw, F.lit(""))


def form_request(url: Column, pairs: Column, method: Column) -> tuple[Column, Column]:
    """(url, body): form data goes into the URL of a GET and into the body of anything else."""
    data = U.urlencode(pairs)
    get = F.upper(method) == "GET"
    mark = F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when(get & (data != ""), F.concat(url, mark, data)).otherwise(url), F.when(get, F.lit("")).otherwise(data)


def with_defaults(headers: Column, defaults: Column) -> Column:
    """Headers with a default for each name that is missing."""
    missing = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(headers), k) & v.isNotNull())
    return F.map_concat(missing, headers)


def json_headers(headers: Column) -> Column:
    return with_defaults(headers, F.create_map(F.lit("Content-Type"), F.lit("application/json"), F.lit("Accept"), F.lit(", ".join(("application/json", "text/javascript", "*/*; q=0.01")))))


def merge_params(url: str, params: dict) -> str:
    """Parameters of ``params`` in place of those of the URL that occur once on both sides, the others appended."""
    parts = urlsplit(url)
    have = parse_qsl(parts.query, keep_blank_values=True)
    new = []
    for k, v in params.items():
        for x in v if isinstance(v, (list, tuple)) else [v]:
            new.append((k, json.dumps(x) if isinstance(x, (bool, dict)) else "" if x is None else str(x)))
    ours, theirs = Counter(k for k, _ in have), Counter(k for k, _ in new)
    once = {k: v for k, v in new if theirs[k] == 1 and ours[k] == 1}
    merged = [(k, once.get(k, v)) for k, v in have] + [(k, v) for k, v in new if k not in once]
    return urlunsplit(parts._replace(query="&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in merged)))


@functools.cache
def _curl_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(add_help=False, exit_on_error=False)
    parser.add_argument("url")
    parser.add_argument("-H", "--header", action="append", default=[])
    parser.add_argument("-X", "--request")
    parser.add_argument("-d", "--data", "--data-raw", "--data-binary", "--data-ascii", action="append", dest="data")
    parser.add_argument("-u", "--user")
    parser.add_argument("-b", "--cookie", default="")
    for flag in ("--compressed", "-k", "--insecure", "-s", "--silent", "-v", "-L", "--location"):
        parser.add_argument(flag, action="store_true", dest="skipped")
    return parser


def parse_curl(command: str, ignore_unknown: bool = True) -> tuple:
    """A curl command line as the fields of ``CURL``; the last says what is wrong with it."""
    try:
        words = shlex.split(command)
        if not words or words[0] != "curl":
            raise ValueError("not a curl command")
        got, unknown = _curl_parser().parse_known_args(words[1:])
        if unknown and not ignore_unknown:
            raise ValueError(f"unknown options {unknown}")
    except (ValueError, argparse.ArgumentError, SystemExit) as e:
        return None, None, None, {}, {}, str(e)
    headers, cookies = {}, {}
    pairs = [h.partition(":")[::2] for h in got.header] + ([("Cookie", got.cookie)] if got.cookie else [])
    for name, value in pairs:
        if name.strip().lower() == "cookie":
            cookies |= {k.strip(): v for k, _, v in (c.partition("=") for c in value.split(";")) if k.strip()}
        else:
            headers["-".join(x.capitalize() for x in name.strip().split("-"))] = value.strip()
    if got.user:
        headers["Authorization"] = "Basic " + base64.b64encode(got.user.encode()).decode()
    url = got.url if "://" in got.url else "http://" + got.url
    data = "&".join(got.data) if got.data else ""
    return url, (got.request or ("POST" if got.data else "GET")).upper(), data, headers, cookies, None


@F.pandas_udf(CURL)
def from_curl(lines: pd.Series) -> pd.DataFrame:
    """Command lines, a batch at a time, with one parser a worker."""
    return pd.DataFrame([parse_curl(x or "") for x in lines], columns=CURL.names)


@F.pandas_udf(T.StringType())
def with_params(urls: pd.Series, params: pd.Series) -> pd.Series:
    """URLs with the parameters of JSON objects merged into their queries."""
    return pd.Series([None if u is None else u if p is None else merge_params(u, json.loads(p)) for u, p in zip(urls, params)], dtype=object)


def json_request(method: Column, data: Column, raw: Column, headers: Column) -> tuple[Column, Column, Column]:
    """(method, body, headers): POST where data is given without a method; a raw body wins over data."""
    made = F.coalesce(F.upper(method), F.when(data.isNotNull() & raw.isNull(), F.lit("POST")).otherwise(F.lit("GET")))
    return made, F.coalesce(raw, data, F.lit("")), json_headers(headers)
