"""URL algebra as Column expressions. All are null-safe and never raise, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}
LOCAL_SCHEMES = ("about", "blob", "data", "filesystem")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-case host without credentials and port; empty where there is none."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":([0-9]+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def extension(url: Column) -> Column:
    """The last suffix of the path with its dot, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(path(url), r"[^./](\.[^./]*)$", 1))


def has_extension(url: Column, suffixes: list[str]) -> Column:
    return extension(url).isin(*[x.lower() for x in suffixes])


def quote(text: Column) -> Column:
    """Percent-encodes as UTF-8 all but unreserved and path characters."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c, plain in (("%2F", "/"), ("%2C", ","), ("%27", "'"), ("%3A", ":"), ("%40", "@"), ("%3B", ";"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%24", "$")):
        out = F.replace(out, F.lit(c), F.lit(plain))
    return out


def _kept(text: Column, condition: Column) -> Column:
    return F.when(condition, text).otherwise(F.lit(""))


def strip(url: Column, credentials: bool = True, default_port: bool = True, origin_only: bool = False, drop_fragment: bool = True) -> Column:
    """Drops credentials, a default port, and either the fragment or all after the origin."""
    whole = authority(url)
    net = F.regexp_replace(whole, r"^.*@", "") if credentials or origin_only else whole
    if default_port:
        number = F.regexp_extract(whole, r":([0-9]+)$", 1)
        usual = F.lit(False)
        for name, value in DEFAULT_PORTS.items():
            usual = usual | ((scheme(url) == name) & (number == value))
        net = F.when(usual, F.regexp_replace(net, r":[0-9]+$", "")).otherwise(net)
    start = F.concat(scheme(url), F.lit("://"), net)
    if origin_only:
        return F.concat(start, F.lit("/"))
    out = F.concat(start, path(url), _kept(F.concat(F.lit("?"), query(url)), query(url) != ""))
    return out if drop_fragment else F.concat(out, _kept(F.concat(F.lit("#"), fragment(url)), fragment(url) != ""))


def origin(url: Column) -> Column:
    return strip(url, origin_only=True)


def add_scheme(url: Column) -> Column:
    """``http`` in front of what has no scheme."""
    return F.when(url.rlike(r"^\w+://"), url).when(url.startswith("//"), F.concat(F.lit("http:"), url)).otherwise(F.concat(F.lit("http://"), url))


POSIX_PATH = r"^(?:/[^/]|~|\.{1,2}(?:/|$))"
WINDOWS_PATH = r"^(?:[A-Za-z]:\\|\\\\)"


def is_file_path(text: Column) -> Column:
    return text.rlike(POSIX_PATH) | text.rlike(WINDOWS_PATH)


def guess_scheme(text: Column) -> Column:
    """``file`` for a path, ``http`` for what has no scheme."""
    return F.when(text.rlike(r"^\w+://"), text).when(is_file_path(text), F.concat(F.lit("file://"), text)).otherwise(add_scheme(text))


def escape_ajax(url: Column) -> Column:
    """A ``#!x`` fragment as the parameter ``_escaped_fragment_``, replacing one that is there."""
    base = F.regexp_replace(url, r"#.*$", "")
    clean = F.regexp_replace(F.regexp_replace(base, r"([?&])_escaped_fragment_=[^&]*&?", "$1"), r"[?&]$", "")
    mark = F.when(clean.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    value = F.url_encode(F.substr(fragment(url), F.lit(2)))
    return F.when(fragment(url).startswith("!"), F.concat(clean, mark, F.lit("_escaped_fragment_="), value)).otherwise(url)


def canonical(url: Column, keep_fragment: bool = False) -> Column:
    """Lower-case scheme and authority, a path of at least ``/``, sorted parameters with blanks kept, no fragment."""
    body = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    sorted_query = F.array_join(F.array_sort(F.filter(F.split(query(url), "&"), lambda x: x != "")), "&")
    out = F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), body, _kept(F.concat(F.lit("?"), sorted_query), sorted_query != ""))
    return F.concat(out, _kept(F.concat(F.lit("#"), fragment(url)), fragment(url) != "")) if keep_fragment else out


def without_dots(path_: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; one that goes above the root stays at it."""
    last = F.element_at(F.split(path_, "/"), -1)
    segments = F.concat(F.split(path_, "/"), F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))

    def step(held: Column, segment: Column) -> Column:
        up = F.when(F.size(held) > 1, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(held)
        return F.when(segment == ".", held).when(segment == "..", up).otherwise(F.concat(held, F.array(segment)))

    made = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.when(path_.rlike(r"(^|/)\.{1,2}(/|$)"), made).otherwise(path_)


def join_absolute(base: Column, href: Column) -> Column:
    """Joins a link that is absolute, scheme-relative or root-relative, else relative to the base's directory; dot segments go."""
    start = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.concat(F.regexp_replace(path(base), r"[^/]*$", ""))
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    way, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_replace(href, r"^[^?#]*", "")
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(start, without_dots(way), rest))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(start, path(base), href))
        .otherwise(F.concat(start, without_dots(F.concat(folder, way)), rest))
    )


def fingerprint(url: Column, method: Column | None = None, body: Column | None = None) -> Column:
    """SHA-1 of a request's JSON form: body, method and canonical URL, with keys in order and slashes escaped."""
    m = F.coalesce(F.upper(method), F.lit("GET")) if method is not None else F.lit("GET")
    b = F.coalesce(body, F.lit("")) if body is not None else F.lit("")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("/"), F.lit("\\/"))
    return F.sha1(F.concat(F.lit('{"body":"'), esc(b), F.lit('","method":"'), m, F.lit('","url":"'), esc(url), F.lit('"}')).cast("binary"))


def in_domain(name: Column, domain: Column) -> Column:
    """The host is the domain or below it, whatever the case."""
    return (F.lower(name) == F.lower(domain)) | F.endswith(F.lower(name), F.concat(F.lit("."), F.lower(domain)))


def suffixes(name: Column) -> Column:
    """Every domain that the host lies in, itself first: an equality key for joins with domains."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def urlencode(pairs: Column) -> Column:
    """A map or array of (key, value) as form data."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")


def header_name(name: Column) -> Column:
    """Each run of letters capitalised: ``user-agent`` as ``User-Agent``."""
    return F.array_join(F.transform(F.split(name, "-"), lambda x: F.initcap(x)), "-")


def bloom_offsets(key: Column, bits: int = 30, k: int = 6, compat: bool = True) -> Column:
    """``k`` offsets in a bitmap of 2^bits. ``compat``: the rolling polynomial; else 64-bit hashes, which spread better."""
    mask = (1 << bits) - 1
    if not compat:
        return F.array(*[F.xxhash64(key, F.lit(s)).bitwiseAND(mask) for s in range(k)])
    letters = F.filter(F.split(key, ""), lambda c: c != "")

    def roll(seed: int):
        return F.aggregate(letters, F.lit(0).cast("long"), lambda h, c: (h * (seed + 1) + F.ascii(c)).bitwiseAND(mask))

    return F.array(*[roll(s) for s in range(k)])


def _tls(url: Column) -> Column:
    return scheme(url).isin("https", "ftps")


POLICIES = ("no-referrer", "no-referrer-when-downgrade", "same-origin", "origin", "strict-origin", "origin-when-cross-origin", "strict-origin-when-cross-origin", "unsafe-url")


def referrer_parts(source: Column, goal: Column) -> dict[str, Column]:
    """What the policies ask of a pair of URLs. Set as columns first, so that each is worked out once for all policies."""
    return {"_whole": strip(source), "_bare": origin(source), "_there": origin(goal), "_from_tls": _tls(source), "_to_tls": _tls(goal), "_local": scheme(source).isin(*LOCAL_SCHEMES)}


def referrer_rules(parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """By policy, the Referer in terms of the columns that ``referrer_parts`` names; null for none."""
    c = F.col if parts is None else parts.__getitem__
    same, whole, bare = c("_bare") == c("_there"), c("_whole"), c("_bare")
    strict = F.when((c("_from_tls") & c("_to_tls")) | ~c("_from_tls"), bare)
    rules = {
        "no-referrer": F.lit(None).cast("string"),
        "no-referrer-when-downgrade": F.when(~c("_from_tls") | c("_to_tls"), whole),
        "same-origin": F.when(same, whole),
        "origin": bare,
        "strict-origin": strict,
        "origin-when-cross-origin": F.when(same, whole).otherwise(bare),
        "strict-origin-when-cross-origin": F.when(same, whole).otherwise(strict),
        "unsafe-url": whole,
    }
    return {name: F.when(~c("_local"), rule) for name, rule in rules.items()}


def referrer(policy: str, source: Column, goal: Column) -> Column:
    """The Referer that one request carries under one policy. For several, ``with_referrers`` works out the parts once."""
    return referrer_rules(referrer_parts(source, goal))[policy or "no-referrer-when-downgrade"]


def with_referrers(pairs: DataFrame, source: str, goal: str, out: dict[str, str | Column]) -> DataFrame:
    """``pairs`` with a column for each name of ``out``: the Referer under a policy, or under the one that a column names."""
    parts, rules = referrer_parts(F.col(source), F.col(goal)), referrer_rules()

    def chosen(policy: str | Column) -> Column:
        if isinstance(policy, str):
            return rules[policy or "no-referrer-when-downgrade"]
        made = F.lit(None).cast("string")
        for name, rule in rules.items():
            made = F.when(policy == name, rule).otherwise(made)
        return made

    return pairs.withColumns(parts).withColumns({name: chosen(policy) for name, policy in out.items()}).drop(*parts)
