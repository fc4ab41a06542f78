import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from weftline import config
from weftline.functions import urls as U
from weftline.operators import chain, crawl, dedup, items
from weftline.operators import requests as R
from weftline.operators import schedule as H
from weftline.operators import stats as A
from weftline.schemas import requests_from
from weftline.sources import fetch as W
from weftline.streaming import state as T


def test_fetch_seam(spark):
    def echo(url, method, headers, body):
        if "fail" in url:
            raise TimeoutError(url)
        return 200, {"X-Method": method, **headers}, body or url.encode()

    rows = [(1, "data:,a%20b", None, None, None), (2, "DATA:text/plain;base64,YWI=", "GET", {"A": "1"}, None), (3, "echo://x", "POST", {"A": "1"}, b"body"), (4, "echo://fail", None, None, None), (5, "ftp://h", None, None, None), (6, None, None, None, None), (7, "data:no", None, None, None), (8, "echo://x", None, None, b"z" * 99)]
    df = spark.createDataFrame(rows, "k long, url string, method string, headers map<string,string>, body binary")
    got = {r.k: r for r in W.fetch(df, "k", {"data": W.data_url, "echo": echo}, most_bytes=50).collect()}
    assert len(got) == 8 and bytes(got[1].body) == b"a b" and bytes(got[2].body) == b"ab" and bytes(got[3].body) == b"body" and got[3].headers == {"X-Method": "POST", "A": "1"}
    assert [got[k].error for k in (4, 5, 6, 7, 8)] == ["TimeoutError", "NotSupported", "NotSupported", "ValueError", "TooLarge"]
    assert W.fetch(df.limit(0), "k").collect() == []


def test_fetch_files(spark, tmp_path):
    (tmp_path / "a b").write_bytes(b"x")
    df = spark.createDataFrame([(1, f"file://{tmp_path}/a%20b")], "k long, url string").selectExpr("*", "'GET' method", "map() headers", "cast(null as binary) body")
    assert bytes(W.fetch(df, "k").first().body) == b"x"


@pytest.mark.parametrize("chunk", [7, 100, 10**9])
def test_ranks_and_paces_by_chunks(spark, chunk):
    r = random.Random(chunk)
    rows = [(k, "ab"[k % 9 == 0], r.randrange(300), r.randrange(1, 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "seq long, slot string, at long, d long")
    want_rank, want_start = {}, {}
    for slot in "ab":
        last = None
        for n, (at, seq, d) in enumerate(sorted((at, seq, d) for seq, s, at, d in rows if s == slot), 1):
            last = at if last is None else max(at, last + d)
            want_rank[seq], want_start[seq] = n, last
    assert {x.seq: x.n for x in H.ranked(df, "slot", ["at", "seq"], "n", chunk=chunk).collect()} == want_rank
    assert {x.seq: x.start for x in H.paced(df, F.col("d"), ["at", "seq"], chunk=chunk).collect()} == want_start


def test_close_reasons(spark):
    df = spark.createDataFrame([(k, k * 10, k % 2 == 0) for k in range(20)], "seq long, at long, item boolean")
    assert H.closed(df, {"items": (F.col("item"), 3)}).first()[:] == ("items", 40, 4)
    assert H.closed(df, {"items": (F.col("item"), 99)}, 35).first()[:] == ("timeout", 35, None)
    assert H.closed(df, {"items": (F.col("item"), 99)}).collect() == []


def test_backpressure_and_pause(spark):
    q = spark.range(40).withColumnRenamed("id", "seq")
    assert H.admissible(q, 10, 0, ["seq"]).count() == 6 and H.admissible(q, 0, 5_000_001, ["seq"]).count() == 0 and H.admissible(q, 20, 0, ["seq"]).count() == 0
    one = spark.range(1)
    until = lambda v: one.select(H.pause_until(F.lit(v).cast("double"), F.lit(100.0)).alias("x")).first().x
    assert until(None) == float("inf") and until(30) == 130 and until(500) == 500


def test_in_flight_limits(spark):
    s = 1_000_000
    events = [("a", "test", 0), ("a", "test", 100 * s), ("b", "test", 270 * s), ("a", "test", 300 * s), ("a", "test", 481 * s), ("a", "request_ok", 482 * s), ("a", "test", 483 * s), ("b", "parse_ok", 484 * s), ("b", "test", 485 * s)]
    df = spark.createDataFrame([(k, i, t, n) for n, (k, i, t) in enumerate(events)], "fp string, kind string, at long, seq long")
    got = {r.seq: r.verdict for r in dedup.outcomes_of_tests(df).collect()}
    assert got == {0: "new", 1: "in flight", 2: "new", 3: "in flight", 4: "new", 6: "new", 8: "seen"}
    known = spark.createDataFrame([("a",)], "fp string")
    assert {r.verdict for r in dedup.outcomes_of_tests(df, known).where("fp = 'a'").collect()} == {"seen"}


@pytest.mark.parametrize(("meta", "header", "want"), [(None, None, "origin"), ("Unsafe-URL", "no-referrer", "unsafe-url"), ("bogus", "x, same-origin, no-referrer", "same-origin"), (None, "", "origin"), (None, "bogus", "origin")])
def test_referrer_policy_order(spark, meta, header, want):
    df = spark.createDataFrame([(meta, header)], "m string, h string")
    assert df.select(R.referrer_policy(F.col("m"), F.col("h"), "origin").alias("x")).first().x == want


@pytest.mark.parametrize(("path", "want"), [("/a/./b", "/a/b"), ("/a/../b", "/b"), ("/../../b", "/b"), ("/a/b/..", "/a/"), ("/a/.", "/a/"), ("/a..b/.c", "/a..b/.c"), ("/", "/"), ("", "")])
def test_dot_segments(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(U.without_dots(F.col("p")).alias("x")).first().x == want


def test_wire_and_pairs(spark):
    df = spark.createDataFrame([("post", "http://u@h:8/p?q#f", {"B": "2", "A": "1"}, "x"), ("get", "http://h", {}, None)], "m string, u string, h map<string,string>, b string")
    got = [r.x for r in df.select(R.wire(F.col("m"), F.col("u"), F.col("h"), F.col("b")).alias("x")).collect()]
    assert got == ["POST /p?q HTTP/1.1\r\nHost: h\r\nA: 1\r\nB: 2\r\n\r\nx", "GET / HTTP/1.1\r\nHost: h\r\n\r\n"]
    with pytest.raises(TypeError):
        R.replaced(df, nothing=F.lit(1))


def test_errors_and_decoders(spark):
    def bad(page):
        raise KeyError(page["k"])
        yield

    pages = spark.createDataFrame([(1, "a")], "k long, url string")
    assert chain.parse(pages, bad, ["url"], "k").first().kind == "error"
    assert chain.parse(pages, bad, ["url"], "k", errback=lambda p, e: iter([("item", {"e": type(e).__name__})])).first().payload == '{"e": "KeyError"}'
    r = spark.createDataFrame([('{"url":"u","p":7}',), (None,), ("junk",)], "x string").select(requests_from(F.col("x"), lambda raw: {"priority": F.get_json_object(raw, "$.p").cast("int")}).alias("r")).collect()
    assert (r[0].r.url, r[0].r.priority) == ("u", 7) and r[1].r is None and r[2].r.url is None


def test_pipeline_opens_and_closes(spark):
    log = []

    class Step:
        def __init__(self, name):
            self.name = name

        def open(self):
            log.append("open " + self.name)

        def process(self, rows):
            log.append(self.name)
            return None if self.name == "b" else rows.where("id > 0")

        def close(self):
            log.append("close " + self.name)

    with pytest.raises(ZeroDivisionError), chain.Pipeline([Step("a"), Step("b")]) as p:
        assert p(spark.range(3)).count() == 2
        1 / 0
    assert log == ["open a", "open b", "a", "b", "close b", "close a"]


def test_statements_reach_a_database(spark, tmp_path):
    path = str(tmp_path / "a.db")
    sqlite3.connect(path).execute('create table "t" ("k" integer primary key, "v" text)').connection.commit()
    connect = lambda: sqlite3.connect(path, timeout=60)
    sql = items.statement("postgres", "update_insert", "t", ["k", "v"], ["k"]).replace("%s", "?")
    for v in ("a", "b"):
        items.write_statements(spark.range(10).select(F.col("id").alias("k"), F.lit(v).alias("v")).coalesce(1), connect, sql, batch=3)
    items.write_statements(spark.range(8, 12).select(F.col("id").alias("k"), F.lit("c").alias("v")).coalesce(1), connect, items.statement("postgres", "ignore_insert", "t", ["k", "v"]).replace("%s", "?"))
    assert sqlite3.connect(path).execute("select v, count(*) from t group by v order by v").fetchall() == [("b", 10), ("c", 2)]
    assert items.statement("mysql", "update_insert", "t", ["k", "v"], ["k"]) == "INSERT INTO `t` (`k`, `v`) VALUES (%s, %s) ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"
    assert items.statement("mysql", "ignore_insert", "t", ["k"]) == "INSERT IGNORE INTO `t` (`k`) VALUES (%s)"
    with pytest.raises(ValueError):
        items.statement("mysql", "other", "t", ["k"])


@pytest.mark.parametrize(("mode", "want"), [("insert", [(1, "a"), (1, "b"), (2, "b")]), ("ignore_insert", [(1, "a"), (2, "b")]), ("update_insert", [(1, "b"), (2, "b")])])
def test_table_sink_modes(spark, tmp_path, mode, want):
    write = items.table_sink(str(tmp_path), mode, ["k"], ["v"])
    batch = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    write(batch((1, "a")), 0)
    for _ in range(2):  # a batch that comes again changes nothing
        write(batch((1, "b"), (2, "b")), 1)
    assert items.versions(spark, str(tmp_path)) == [0, 1]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/version=1").collect())) == want


def test_streams_resume(spark, tmp_path):
    """A stream under a named checkpoint goes on where it stopped, and a batch whose sink failed comes again."""
    source, out, place = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/at"
    fails = [True]

    def sink(batch, batch_id):
        if fails and batch.where("id = 7").count():
            fails.clear()
            raise OSError("gone")
        T.write_idempotent(batch, batch_id, out)

    def run():
        stream = spark.readStream.schema("id long").parquet(source)
        query = T.flush_every(stream, sink, place, None)
        try:
            query.awaitTermination()
        except Exception:
            return False
        return True

    spark.range(3).write.parquet(source)
    assert run()
    spark.range(7, 9).write.mode("append").parquet(source)
    assert not run() and run() and run()
    got = sorted((r.id, r.batch) for r in spark.read.parquet(out).collect())
    assert [i for i, _ in got] == [0, 1, 2, 7, 8] and len({b for _, b in got}) == 2
    assert T.checkpoint(spark, "crawl") == T.checkpoint(spark, "crawl") != T.checkpoint(spark, "other")


def test_children_come_before_acks(spark, tmp_path):
    batch = spark.createDataFrame([("a", "u")], "task_id string, url string")
    order = []

    def children(b):
        assert not os.path.exists(f"{tmp_path}/acks")
        order.append("children")
        return b.select("url")

    T.children_then_ack(batch, 4, children, f"{tmp_path}/frontier", f"{tmp_path}/acks", ["task_id"])
    assert order == ["children"] and spark.read.parquet(f"{tmp_path}/acks").count() == 1 == spark.read.parquet(f"{tmp_path}/frontier").count()


def test_streaming_throttle(spark, tmp_path):
    rows = [(k, "ab"[k % 2], k, 0.5 + k / 10, 200 if k % 3 else 500) for k in range(20)]
    spark.createDataFrame(rows, "seq long, slot string, at long, latency double, status int").write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("seq long, slot string, at long, latency double, status int").parquet(f"{tmp_path}/log")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else batches for time-outs follow without end
    got = {r.slot: (r.delay, r.n) for r in T.collect(T.throttle(stream), "throttle", f"{tmp_path}/at", "update", 100).collect()}
    want = {r.slot: (r.delay, r.n) for r in H.throttled(spark.read.parquet(f"{tmp_path}/log")).collect()}
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got == want


def test_walk_ends(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(6, 0)], "src long, dst long")
    assert {r.node: r.depth for r in crawl.depths(edges, spark.createDataFrame([(2,)], "node long")).collect()} == {2: 0, 3: 1, 4: 2, 5: 3, 6: 4, 0: 5, 1: 6}


def test_stats_are_kept(spark, tmp_path):
    A.persist(spark.createDataFrame([("a/b", 3)], "key string, value long"), f"{tmp_path}/stats")
    assert spark.read.parquet(f"{tmp_path}/stats").first()[:] == ("a/b", 3.0)
    d = A.duplicates(spark.createDataFrame([("x", "m1"), ("x", "m2"), ("y", "m3")], "name string, module string")).collect()
    assert [(r.name, r.n, r.modules) for r in d] == [("x", 2, ["m1", "m2"])]


def test_flush_groups(spark):
    df = spark.createDataFrame([(k, k // 7, "s") for k in range(30)], "seq long, at long, k string").withColumn("at", F.col("at") * 1_000_000)
    got = H.flush_groups(df, 5, 1, "at", ["seq"]).groupBy("flush_at", "flush").count().collect()
    assert sorted((r.flush_at, r.flush, r["count"]) for r in got) == [(0, 0, 5), (0, 1, 2), (1, 0, 5), (1, 1, 2), (2, 0, 5), (2, 1, 2), (3, 0, 5), (3, 1, 2), (4, 0, 2)]
    by = items.flushes(df, 4, ["seq"], ["k"], buckets=3).groupBy("writer", "flush").count().collect()
    assert sum(r["count"] for r in by) == 30 and max(r["count"] for r in by) == 4


def test_project_file(tmp_path, monkeypatch):
    (tmp_path / "weftline.cfg").write_text("[settings]\ndefault = shopcrawl_settings\n")
    (tmp_path / "shopcrawl_settings.py").write_text("DEPTH_LIMIT = 4\nlower = 1\n")
    (tmp_path / "a").mkdir()
    monkeypatch.setattr("sys.path", list(__import__("sys").path))
    assert config.project_settings(str(tmp_path / "a")) == {"DEPTH_LIMIT": 4}
    assert config.Settings(config.project_settings(str(tmp_path / "a"))).getint("DEPTH_LIMIT") == 4
    monkeypatch.setenv("WEFTLINE_SETTINGS", "json")
    assert "JSONDecodeError" not in config.project_settings(str(tmp_path))
