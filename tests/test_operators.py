import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import html as X
from weftline.functions import urls as U
from weftline.operators import crawl, dedup, items
from weftline.operators import requests as R
from weftline.operators import schedule as H
from weftline.operators import stats as A
from weftline.sources import requests as Q
from weftline.sources import tables as S
from weftline.streaming import state as T


def value(spark, column, *values):
    rows = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return rows.select(column(*[F.col(c) for c in rows.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "plain", "origin"),
    [
        ("http://u:p@h.com:80/a?b=c#d", "http://h.com/a?b=c", "http://h.com/"), ("https://h.com:443", "https://h.com", "https://h.com/"),
        ("https://h.com:80/x", "https://h.com:80/x", "https://h.com:80/"), ("ftp://h:21/f", "ftp://h/f", "ftp://h/"), ("http://a@b/?", "http://b/", "http://b/"),
    ],
)
def test_strip(spark, url, plain, origin):
    assert value(spark, U.strip, url) == plain and value(spark, U.origin, url) == origin


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("www.e.com/a.html#!key=value", "www.e.com/a.html?_escaped_fragment_=key%3Dvalue"), ("www.e.com/a?k1=v1#!x", "www.e.com/a?k1=v1&_escaped_fragment_=x"),
        ("www.e.com/a?#!x", "www.e.com/a?_escaped_fragment_=x"), ("www.e.com/a#!", "www.e.com/a?_escaped_fragment_="), ("www.e.com/a#k", "www.e.com/a#k"), ("www.e.com/a?_escaped_fragment_=o&z=1#!n", "www.e.com/a?z=1&_escaped_fragment_=n"),
    ],
)
def test_escape_ajax(spark, url, want):
    assert value(spark, U.escape_ajax, url) == want


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [("http://h/a/b", "c", "http://h/a/c"), ("http://h/a/b", "/c", "http://h/c"), ("http://h", "c", "http://h/c"), ("https://h/a", "//g/x", "https://g/x"), ("http://h/a?q", "#f", "http://h/a?q#f"), ("http://h/a?q", "?r", "http://h/a?r"), ("http://h/a", "ftp://x/y", "ftp://x/y")],
)
def test_join(spark, base, href, want):
    assert value(spark, U.join_absolute, base, href) == want


def test_canonical_and_fingerprint(spark):
    assert value(spark, U.canonical, "HTTP://Ex.COM?b=2&a=1&a=&#f") == "http://ex.com/?a=&a=1&b=2"
    a, b = (value(spark, lambda u: U.fingerprint(U.canonical(u)), x) for x in ("http://e.com/?b=1&a=2", "http://E.com/?a=2&b=1#z"))
    assert a == b and len(a) == 40 and a != value(spark, lambda u: U.fingerprint(u, F.lit("post")), "http://e.com/?a=2&b=1")
    assert value(spark, lambda u: U.host(u), None) is None


def test_bloom_polynomial(spark):
    text, mask = "0a9f" * 10, (1 << 30) - 1
    want = []
    for seed in range(6):
        h = 0
        for c in text:
            h = (seed + 1) * h + ord(c)
        want.append(h & mask)
    assert value(spark, U.bloom_offsets, text) == want
    assert len(set(value(spark, lambda k: U.bloom_offsets(k, compat=False), text))) == 6


SECURE, OTHER, PLAIN = "https://u:p@a.com/x?y#z", "https://b.com/", "http://a.com/"


@pytest.mark.parametrize(
    ("policy", "source", "goal", "want"),
    [
        ("no-referrer", SECURE, OTHER, None), ("no-referrer-when-downgrade", SECURE, PLAIN, None), ("no-referrer-when-downgrade", SECURE, OTHER, "https://a.com/x?y"),
        ("same-origin", SECURE, OTHER, None), ("same-origin", SECURE, "https://a.com/q", "https://a.com/x?y"), ("origin", SECURE, PLAIN, "https://a.com/"),
        ("strict-origin", SECURE, PLAIN, None), ("strict-origin", PLAIN, SECURE, "http://a.com/"), ("origin-when-cross-origin", SECURE, OTHER, "https://a.com/"),
        ("strict-origin-when-cross-origin", SECURE, PLAIN, None), ("strict-origin-when-cross-origin", SECURE, OTHER, "https://a.com/"), ("unsafe-url", SECURE, PLAIN, "https://a.com/x?y"),
        ("", SECURE, PLAIN, None), ("unsafe-url", "about:blank", PLAIN, None),
    ],
)
def test_referrer(spark, policy, source, goal, want):
    assert value(spark, lambda s, g: U.referrer(policy, s, g), source, goal) == want


@pytest.mark.parametrize(("own", "enabled", "want"), [(None, True, True), (None, False, False), (True, True, False), (False, False, True)])
def test_redirect(spark, own, enabled, want):
    df = spark.createDataFrame([(own, enabled)], "o boolean, e boolean")
    assert df.select(R.follow_redirect(F.col("o"), F.col("e")).alias("x")).first().x is want


@pytest.mark.parametrize(
    ("status", "meta_all", "meta_list", "spider", "allowed", "want"),
    [(200, None, None, None, [], True), (404, None, None, None, [], False), (404, None, None, None, [404], True), (404, None, None, [500], [404], False), (404, None, [500], [404], [404], False), (404, True, [500], None, [], True), (500, None, [500], None, [], True)],
)
def test_status(spark, status, meta_all, meta_list, spider, allowed, want):
    df = spark.createDataFrame([(status, meta_all, meta_list)], "s int, a boolean, l array<int>")
    assert df.select(R.status_ok(F.col("s"), F.col("a"), F.col("l"), False, spider, allowed).alias("x")).first().x is want


def test_domains_warn():
    with pytest.warns(UserWarning):
        assert R.domains([None, "http://a.com", "b.com:80", "C.com"]) == ["c.com"]


def test_priority_order(spark):
    rows = spark.createDataFrame([("low", -10, 1), ("high", 100, 2), ("default", 0, 3)], "url string, priority int, seq int")
    assert [r.url for r in H.reserve(rows, 3).collect()] == ["high", "default", "low"]


def test_pacing_is_the_fold(spark):
    rng = random.Random(3)
    rows = [(s, i, sorted(rng.randrange(100) for _ in range(40))[i]) for s in "ab" for i in range(40)]
    got = {(r.slot, r.seq): r.start for r in H.paced(spark.createDataFrame(rows, "slot string, seq int, at long"), 7, ["at", "seq"]).collect()}
    last = {}
    for s, i, a in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last[s] = max(a, last[s] + 7) if s in last else a
        assert got[s, i] == last[s]


def test_throttle(spark):
    rows = [("a", 1, 1, 2.0, 200), ("a", 2, 2, 0.5, 500), ("a", 3, 3, 200.0, 200)]
    got = H.throttled(spark.createDataFrame(rows, "slot string, at long, seq int, latency double, status int")).first()
    assert got.delay == 60.0 and got.n == 3


def test_dedup_admission(spark):
    r = spark.createDataFrame([(1, "x", False, False), (2, "x", False, False), (3, "y", False, False), (4, "y", False, True), (5, "y", True, False), (6, "z", None, None)], "seq int, fp string, dont_filter boolean, redelivered boolean")
    seen = spark.createDataFrame([("y",)], "fp string")
    assert sorted(x.seq for x in dedup.admit(r, seen, ["seq"]).collect()) == [1, 4, 5, 6]


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B", 20), (2, "BB", 30), (3, None, 3)], "k int, v string, n int")
    assert sorted(map(tuple, items.update_insert(old, new, ["k"], ["n"], ["v"]).collect())) == [(1, "a", 1), (2, "BB", 2), (3, None, 3)]
    assert sorted(map(tuple, items.ignore_insert(old, new, ["k"], ["n"]).collect())) == [(1, "a", 1), (2, "b", 2), (3, None, 3)]
    assert items.writer("insert")(old, new).count() == 5


def test_write_errors():
    e = RuntimeError("x")
    e.__cause__ = OSError(2003, "gone")
    assert items.connection_error(e) and not items.connection_error(OSError(1062, "duplicate")) and items.connection_error(ConnectionResetError())


def test_write_to_all_retries(spark):
    calls = []

    def flaky(df):
        calls.append(df.count())
        if len(calls) < 2:
            raise ConnectionError

    items.write_to_all(spark.range(3), [flaky, lambda df: calls.append(-df.count())], retry_on=items.connection_error)
    assert calls == [3, 3, -3]
    with pytest.raises(ValueError):
        items.write_to_all(spark.range(3), [lambda df: int("x")])


def test_csv_by_name(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "a int, b string").unionByName(spark.createDataFrame([("y", 2)], "b string, a int"))
    items.write_csv(a, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "out.csv"), header=True).collect())) == [("1", "x"), ("2", "y")]


def test_seen_file(spark, tmp_path):
    path = str(tmp_path / "seen")
    items.append_seen(spark.createDataFrame([("a",), ("b",)], "fp string"), path)
    items.append_seen(spark.createDataFrame([("b",)], "fp string"), path)
    assert sorted(r.fp for r in S.seen_file(spark, path).collect()) == ["a", "b"]


def test_depths(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (0, 2)], "src long, dst long")
    got = {r.node: r.depth for r in crawl.depths(edges, spark.createDataFrame([(0,)], "node long"), 2).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}


def test_stats(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r.key: r.value for r in A.counts(rows, "n", "k").collect()} == {"n": 3, "n/a": 2, "n/none": 1}


def test_seeds_and_proxies(spark):
    with pytest.raises(ValueError):
        S.seeds(spark, [])
    pool = spark.createDataFrame([("a", 100), ("b", 50), ("c", 100), ("d", -1)], "proxy string, score int")
    assert sorted(r.proxy for r in S.proxies(pool, 9).collect()) == ["a", "c"]
    assert sorted(r.proxy for r in S.proxies(pool.where("score < 100"), 9).collect()) == ["b"]


def test_curl():
    got = Q.parse_curl("curl 'h.com/x' -H 'x-id: 7' -H 'Cookie: a=1; b=2' --data-raw 'q=1' -u me:pw --compressed")
    assert got == ("http://h.com/x", "POST", "q=1", {"X-Id": "7", "Authorization": "Basic bWU6cHc="}, {"a": "1", "b": "2"}, None)
    assert Q.parse_curl("wget x")[5] and Q.parse_curl("curl x --odd", ignore_unknown=False)[5]


def test_params():
    assert Q.merge_params("http://h/?a=1&b=2&b=3#f", {"a": 9, "b": [4, 5], "c": True}) == "http://h/?a=9&b=2&b=3&b=4&b=5&c=true#f"


PAGE = "<html><head><base href='/b/'><title>T &copy;</title></head><body><p class='x y' id=i>one<p>two<br>three <b>bold<ul><li><a href='/1'>A</a><li><a href='/2' rel=nofollow>B</a></ul><script>var t='</p>';</script></body></html>"


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("title::text", ["T ©"]), ("p.x::text", ["one"]), ("#i::attr(class)", ["x y"]), ("li > a::attr(href)", ["/1", "/2"]), ("a[rel=nofollow]::text", ["B"]), ("a[href^='/'], title", ["T ©", "A", "B"]),
        ("//a/@href", ["/1", "/2"]), ("//li[2]/a/text()", ["B"]), ("//a[@rel='nofollow']/@href", ["/2"]), ("/html/body/p[1]/text()", ["one"]), ("//nothing", []),
    ],
)
def test_selectors(selector, want):
    root = X.parse(PAGE)
    assert (X.xpath if selector.startswith("/") else X.css)(root, selector) == want


TABLE = "<div id=m><h2>H</h2><p>a</p><p class='k'>b</p><span>c</span><p>d, e</p><ul><li>1<li>2<li>3<li data-x='p,q'>4<li></ul><a href='/x' title='go [on]'>X y</a> <a name=n>Z</a></div>"


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("h2 + p", ["a"]), ("h2 ~ p", ["a", "b", "d, e"]), ("p:not(.k)", ["a", "d, e"]), ("li:nth-child(2)", ["2"]), ("li:nth-child(odd)", ["1", "3", ""]), ("li:nth-child(2n+2)", ["2", "4"]), ("li:nth-last-child(2)", ["4"]), ("p:nth-of-type(3)", ["d, e"]),
        ("li:first-child, li:last-child", ["1", ""]), ("li[data-x='p,q']", ["4"]), ("li:empty", [""]), ("a[title='go [on]']::attr(href)", ["/x"]), ("p:contains('d, e')", ["d, e"]), ("li:nth-child(-n+2)", ["1", "2"]), ("div>p+p", ["b"]), ("h2:only-child", []),
        ("//li[position()<3]", ["1", "2"]), ("//li[last()-0]", None), ("//li[last()]", [""]), ("//p[contains(., 'd') or @class='k']", ["b", "d, e"]), ("//a[not(@href)]", ["Z"]), ("//a[starts-with(@title, 'go [')]/@href", ["/x"]), ("//p[text()='a']", ["a"]),
        ("//li[normalize-space()='3']/text()", ["3"]), ("//span/../h2", ["H"]), ("//div[count(p)=3]/h2", ["H"]), ("//h2 | //span", ["H", "c"]), ("//p[@class!='k']", []), ("//li[string-length(text())=1][2]", ["2"]), ("//p[2]/@class", ["k"]), ("//ul[li='4']/li[1]", ["1"]), ("//a/@*", ["/x", "go [on]", "n"]),
    ],
)
def test_selectors_in_full(selector, want):
    root = X.parse(TABLE)
    if want is None:
        with pytest.raises(ValueError):
            X.xpath(root, selector)
    else:
        assert (X.xpath if selector.startswith("/") else X.css)(root, selector) == want


def test_paths_are_read_once(monkeypatch):
    """How often the text of a path is read doesn't depend on the pages and their elements."""
    reads, split = [], X._split
    monkeypatch.setattr(X, "_split", lambda *given: reads.append(given) or split(*given))
    path = "//*[starts-with(@href, '/') and not(self-marked) and position()<1000]/@href"
    assert X.xpath(X.parse("<a href='/0'></a>"), path) == ["/0"]
    first = len(reads)
    for n in (1, 300):
        page = X.parse("".join(f"<a href='/{k}'></a><a href='{k}'></a><a href='/m'><self-marked></self-marked></a>" for k in range(n)))
        assert X.xpath(page, path) == [f"/{k}" for k in range(n)]
    assert len(reads) - first == 2  # at the bars between paths, once a call
    assert X.css(page, "a:not([href^='/'])::attr(href)") == X.css(page, "a:not([href^='/'])::attr(href)") == [str(k) for k in range(300)]


def test_marks_in_the_left_of_a_comparison():
    root = X.parse("<div><a title='x=y'>1</a><a>2</a></div>")
    assert X.xpath(root, "//a['x=y'=@title]") == ["1"] and X.xpath(root, "//div[count(a[@title='x=y'])=1]/a[2]") == ["2"]


def test_matches_and_follow(spark):
    assert X.matches(["a1 b22", "c3"], r"[a-z](\d+)") == ["1", "22", "3"] and X.matches(["a1 b22"], r"\d+") == ["1", "22"]
    pages = spark.createDataFrame([(1, "http://h/a/b", TABLE), (2, "http://h/", None)], "page_id long, url string, html string")
    assert [(r.page_id, r.pos, r.url) for r in X.follow_all(pages, css="a").collect()] == [(1, 0, "http://h/x")] == [(r.page_id, r.pos, r.url) for r in X.follow_all(pages, xpath="//a").collect()]
    assert sorted(r.url for r in X.follow_all(pages, urls=["c", "/d"]).collect()) == ["http://h/a/c", "http://h/c", "http://h/d", "http://h/d"]
    for wrong in ({}, {"css": "a", "xpath": "//a"}):
        with pytest.raises(ValueError):
            X.follow_all(pages, **wrong)
    assert [r.value for r in X.select(pages, {"n": "li"}, patterns={"n": r"[13]"}).collect()] == ["1", "3"]


def test_text_and_encoding():
    assert X.visible_text(X.parse(PAGE)) == "onetwothree boldAB" and X.visible_text(X.parse(None)) == ""
    assert X.detect_encoding(b"abc") == "ascii" and X.detect_encoding("é".encode()) == "utf-8" and X.detect_encoding(b"\xe9") == "cp1252"
    assert X.detect_encoding(b"<meta charset='latin-1'>\xe9") == "latin-1" and X.detect_encoding(b"x", "text/html; charset=UTF-16") == "utf-16"


def test_lease_machine(spark, tmp_path):
    """Random histories through the stream equal those of a plain model."""
    rng = random.Random(5)
    events, want = [], []
    for task in range(12):
        phase, token, deadline, again, now = "", "", 0, False, 0
        for k in range(15):
            now += rng.randrange(1, 400)
            kind = rng.choice(["push", "reserve", "reserve", "ack", "nack"])
            mine = f"w{k}" if kind == "reserve" else rng.choice([token, "old"])
            events.append((f"t{task}", kind, mine, now))
            result = "stale"
            if kind == "push":
                result = "rejected" if phase else "pushed"
                phase, again = (phase, again) if phase else ("ready", False)
            elif kind == "reserve" and (phase == "ready" or (phase == "leased" and now >= deadline)):
                again, phase, token, deadline, result = again or phase == "leased", "leased", mine, now + 500, "reserved"
            elif kind in ("ack", "nack") and phase == "leased" and mine == token:
                result, phase, again = ("acked", "", False) if kind == "ack" else ("requeued", "ready", True)
            want.append((f"t{task}", mine, result, again))
    folder = str(tmp_path / "in")
    spark.createDataFrame(events, "task_id string, kind string, token string, at_ms long").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("task_id string, kind string, token string, at_ms long").parquet(folder)
    got = T.collect(T.leases(stream, 500), "leases_test", str(tmp_path / "ck"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_idempotent_sink(spark, tmp_path):
    batch = spark.range(5).toDF("x")
    for _ in range(2):
        T.write_idempotent(batch, 0, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).count() == 5


def test_settings(monkeypatch):
    from weftline.config import Settings

    monkeypatch.setenv("WEFTLINE_RETRY_TIMES", "7")
    s = Settings({"DEPTH_LIMIT": "3", "LIST": "a,b", "MAP": '{"x": 1}', "ON": "True"})
    s.set("DEPTH_LIMIT", 9, "spider")
    s.set("DEPTH_LIMIT", 1, "project")
    assert s.getint("DEPTH_LIMIT") == 9 and s.getint("RETRY_TIMES") == 7 and s.getlist("LIST") == ["a", "b"] and s.getdict("MAP") == {"x": 1} and s.getbool("ON")
    assert s["missing"] is None and s.getfloat("missing", 1.5) == 1.5 and s.layer("DEPTH_LIMIT") == 30
    with pytest.raises(TypeError):
        s.freeze().set("x", 1)
    with pytest.raises(ValueError):
        Settings({"ON": "maybe"}).getbool("ON")


def test_chain():
    from weftline.operators import chain

    assert chain.ordered({"os.path.join": 2, len: 1, max: 5}, {max: None, min: 0}) == [min, len, __import__("os").path.join]
    assert chain.through(1, [lambda x: x + 1, lambda x: None, lambda x: x * 10]) == 20
    assert chain.through(1, [lambda x: x + 1, lambda x: x * 10], backwards=True) == 11


def test_signals():
    from types import SimpleNamespace

    from weftline.streaming.listener import Signals

    got = []
    s = Signals({"opened": [got.append], "idle": [lambda e: 1 / 0]})
    s.onQueryStarted("e")
    s.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=3)))
    s.onQueryIdle("e")
    s.onQueryTerminated(SimpleNamespace(exception=None))
    assert got == ["e"] and s.stats["rows"] == 3 and s.stats["signal_errors/ZeroDivisionError"] == 1 and s.stats["finish_reason/finished"] == 1
