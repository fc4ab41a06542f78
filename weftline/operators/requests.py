"""Filters and rewrites of requests and responses."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import urls as U

RETRY_CODES = (408, 429, 500, 502, 503, 504, 522, 524)


def status_ok(status: Column, meta_all: Column, meta_list: Column, allow_all: bool = False, spider_list: list[int] | None = None, allowed: list[int] | None = None) -> Column:
    """2xx passes; else the request's own rule, then the global one, then the spider's list, then the setting's."""
    own = F.array_contains(meta_list, status)
    rest = F.lit(True) if allow_all else status.isin(*(spider_list if spider_list is not None else allowed or []))
    return status.between(200, 299) | F.coalesce(meta_all, F.lit(False)) | F.when(meta_list.isNotNull(), own).otherwise(rest)


def domains(allowed: list[str | None]) -> list[str]:
    """The usable entries; URLs and entries with a port are ignored with a warning."""
    out = []
    for d in allowed:
        if d is None:
            continue
        if re.match(r"^https?://.*$", d) or re.search(r":\d+$", d):
            warnings.warn(f"not a plain domain, ignored: {d}", stacklevel=2)
            continue
        out.append(d.lower())
    return out


def on_site(host: Column, allowed: list[str], dont_filter: Column | None = None) -> Column:
    """The host is an allowed domain or below one; no domains allow all."""
    names = domains(allowed)
    inside = F.lit(True) if not names else host.rlike("^(.*\\.)?(" + "|".join(re.escape(d) for d in names) + ")$")
    return inside if dont_filter is None else inside | F.coalesce(dont_filter, F.lit(False))


def assign_spider(requests: DataFrame, spiders: DataFrame, host: str = "host") -> DataFrame:
    """Each request with each spider that has a domain which its host lies in: an equality join on the host's suffixes."""
    return requests.withColumn("domain", F.explode(U.suffixes(F.col(host)))).join(spiders, "domain")


def short_enough(url: Column, limit: int = 2083) -> Column:
    return F.length(url) <= limit


def child_depth(parent: Column) -> Column:
    return F.coalesce(parent, F.lit(0)) + 1


def child_priority(priority: Column, depth: Column, factor: int) -> Column:
    """Deeper requests come later by ``factor`` a level."""
    return priority - depth * factor


def default_timeout(own: Column, seconds: float = 180.0) -> Column:
    return F.coalesce(own.cast("double"), F.lit(seconds))


def within_depth(depth: Column, limit: int) -> Column:
    return F.lit(True) if not limit else depth <= limit


def retryable(status: Column, dont_retry: Column, codes: tuple[int, ...] = RETRY_CODES) -> Column:
    return status.isin(*codes) & ~F.coalesce(dont_retry, F.lit(False))


#: Errors of a download that are worth another try, by the class's name.
RETRY_ERRORS = ("TimeoutError", "DNSLookupError", "ConnectionRefusedError", "ConnectionDone", "ConnectError", "ConnectionLost", "TCPTimedOutError", "ResponseFailed", "IOError", "ProxyException")


def retryable_error(error_class: Column, dont_retry: Column, classes: tuple[str, ...] = RETRY_ERRORS) -> Column:
    """The class, or one that it derives from, given as a path ``Base/Derived``, is among those to retry."""
    hit = F.arrays_overlap(F.split(error_class, "/"), F.array(*map(F.lit, classes)))
    return F.coalesce(hit, F.lit(False)) & ~F.coalesce(dont_retry, F.lit(False))


def retry_counts(failed: DataFrame, reason: str, limit: int = 2) -> DataFrame:
    """(key, value): retries, retries by reason, and requests that were given up, from rows with ``retry_times`` so far."""
    again = F.coalesce(F.col("retry_times"), F.lit(0)) + 1 <= F.coalesce(F.col("max_retry_times"), F.lit(limit))
    marked = failed.select(F.col(reason).alias("reason"), again.alias("again"))
    out = marked.where("again").rollup("reason").agg(F.count("*").alias("value"), F.grouping("reason").alias("g"))
    key = F.when(F.col("g") == 1, F.lit("retry/count")).otherwise(F.concat(F.lit("retry/reason_count/"), F.coalesce("reason", F.lit("none"))))
    lost = marked.where("not again").agg(F.lit("retry/max_reached").alias("key"), F.count("*").alias("value"))
    return out.select(key.alias("key"), "value").unionByName(lost).where("value > 0")


def loud_errors(errors: DataFrame, quiet: tuple[str, ...] = ("IgnoreRequest",)) -> DataFrame:
    """Download errors that are logged: all but those by which a request is given up on purpose."""
    return errors.where(~F.col("error_class").isin(*quiet))


def fingerprinted(requests: DataFrame, computed: Column, own: str = "own_fp") -> DataFrame:
    """A request's own fingerprint counts before the computed one."""
    return requests.withColumn("fp", F.coalesce(F.col(own), computed))


def replaced(records: DataFrame, **overrides: Column) -> DataFrame:
    """Clones of requests or responses with some fields set anew; all others stay."""
    unknown = set(overrides) - set(records.columns)
    if unknown:
        raise TypeError(f"no such fields: {sorted(unknown)}")
    return records.withColumns(overrides)


def paired(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each result with the request that it belongs to, as a struct beside it."""
    return results.join(requests.select(key, F.struct(*requests.columns).alias("request")), key)


def wire(method: Column, url: Column, headers: Column, body: Column) -> Column:
    """A request as it goes over the wire; only its size is of use. Headers in the order of their names."""
    target = F.concat(F.when(U.path(url) == "", F.lit("/")).otherwise(U.path(url)), F.when(U.query(url) != "", F.concat(F.lit("?"), U.query(url))).otherwise(F.lit("")))
    names = F.array_sort(F.map_keys(headers))
    lines = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit(": "), F.element_at(headers, k), F.lit("\r\n"))), "")
    return F.concat(F.upper(method), F.lit(" "), target, F.lit(" HTTP/1.1\r\nHost: "), U.host(url), F.lit("\r\n"), F.coalesce(lines, F.lit("")), F.lit("\r\n"), F.coalesce(body, F.lit("")))


def referer_of(headers: Column) -> Column:
    return F.coalesce(F.element_at(headers, "Referer"), F.element_at(headers, "referer"))


def referrer_policy(meta: Column, header: Column, setting: str) -> Column:
    """The policy that counts: the request's own, else the first known one in the response's header, else the setting's.

    An empty header, or one of unknown names only, says nothing.
    """
    known = F.array(*map(F.lit, U.POLICIES))
    named = F.filter(F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: F.array_contains(known, x))
    return F.coalesce(F.when(F.array_contains(known, F.lower(meta)), F.lower(meta)), F.try_element_at(named, F.lit(1)), F.lit(setting))


def retry(requests: DataFrame, limit: int = 2, adjust: int = -1) -> DataFrame:
    """Requests once more: counted, unfiltered, of changed priority; those past the limit go."""
    times = F.coalesce(F.col("retry_times"), F.lit(0)) + 1
    return requests.withColumns({"retry_times": times, "dont_filter": F.lit(True), "priority": F.col("priority") + F.coalesce("priority_adjust", F.lit(adjust))}).where(F.col("retry_times") <= F.coalesce("max_retry_times", F.lit(limit)))


def follow_redirect(dont_redirect: Column, enabled: Column) -> Column:
    return F.coalesce(~dont_redirect, enabled)


def slot(own: Column, proxy: Column, url: Column, per_ip: bool) -> Column:
    """The request's own slot, else its proxy where connections are counted by address, else its host."""
    return F.coalesce(own, F.coalesce(proxy, F.lit("")) if per_ip else U.host(url), F.lit(""))


def rotate_proxies(requests: DataFrame, proxies: list[str], order: str) -> DataFrame:
    """Requests take proxies in turn, in the order of a dense sequence number; those that opt out have none."""
    turn = F.element_at(F.array(*map(F.lit, proxies)), F.pmod(F.col(order) - 1, F.lit(len(proxies))).cast("int") + 1)
    return requests.withColumn("proxy", F.when(F.coalesce("use_proxy", F.lit(True)), turn))


def usable_proxies(pool: DataFrame, results: DataFrame, allow: tuple[int, ...] = (404,)) -> DataFrame:
    """The pool without proxies that any failure or any status from 400 on, but for those allowed, was seen through."""
    bad = results.where(((F.col("status") >= 400) & ~F.col("status").isin(*allow)) | F.col("error").isNotNull()).select("proxy").distinct()
    return pool.join(bad, "proxy", "left_anti")
