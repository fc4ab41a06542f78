"""Small scalar functions on headers, pages and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import urls as U


def head(html: Column, n: int = 4096) -> Column:
    return F.substring(html, 1, n)


def base_url(html: Column, url: Column) -> Column:
    """The page's ``base`` link, joined to its own URL, else that."""
    href = F.regexp_extract(head(html), r"(?i)<base\s[^>]*href\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return F.when(href != "", U.join_absolute(url, href)).otherwise(url)


def meta_refresh(html: Column) -> tuple[Column, Column]:
    """(delay in seconds, URL) of the page's refresh, outside of scripts and noscript; null for none."""
    visible = F.regexp_replace(head(html), r"(?is)<(script|noscript)[^>]*>.*?</\1>", "")
    content = F.regexp_extract(visible, r"(?i)<meta[^>]+http-equiv\s*=\s*[\"']?refresh[\"']?[^>]+content\s*=\s*[\"']([^\"']*)", 1)
    delay = F.regexp_extract(content, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1)
    target = F.regexp_extract(content, r"(?i)url\s*=\s*(\S+)", 1)
    return F.when(delay != "", delay.cast("double")), F.when(target != "", target)


def cookies(header: Column) -> Column:
    """A Cookie header as a map."""
    pairs = F.filter(F.transform(F.split(header, ";"), lambda p: F.trim(p)), lambda p: p.contains("="))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)), F.regexp_replace(p, r"^[^=]*=", ""))))


def set_cookies(header: Column) -> Column:
    """name=value of each cookie of a joined Set-Cookie header, with or without a domain."""
    return F.regexp_extract_all(header, F.lit(r"(?:^|,\s*)([^=;,\s]+=[^;,]*)"), F.lit(1))


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.concat(user, F.lit(":"), password).cast("binary")))


def ciphers(suites: list[str], seed: int | None = None) -> Column:
    """The suites in order, or permuted by a seed."""
    names = F.array(*map(F.lit, suites))
    return F.array_join(names if seed is None else F.shuffle(names, seed), ":")


def camel_case(text: Column) -> Column:
    """Words run together, each capitalised; other characters go."""
    return F.regexp_replace(F.initcap(F.regexp_replace(text, r"[^A-Za-z0-9]+", " ")), " ", "")


def module_name(text: Column) -> Column:
    """A valid lower-case identifier."""
    name = F.regexp_replace(F.lower(text), r"[^a-z0-9_]", "_")
    return F.when(name.rlike("^[a-z]"), name).otherwise(F.concat(F.lit("a"), name))


def arguments(text: Column) -> Column:
    """``a=1,b=2`` as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def last_match(text: Column, pattern: str) -> Column:
    """The last match of a pattern."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))


def decoded(body: Column, charset: str) -> Column:
    return F.decode(body, charset)
