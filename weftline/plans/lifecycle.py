"""Queries of a crawl's life: retries, counters, pauses, limits, leases, fetching and sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import html as P
from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.operators import chain, crawl, dedup
from weftline.operators import items as I
from weftline.operators import requests as R
from weftline.operators import schedule as H
from weftline.operators import stats as A
from weftline.plans import queue as Q
from weftline.plans import records as K
from weftline.plans.registry import FRONTIER, HOST, LINKS, LOG, RESPONSES, query
from weftline.schemas import global_name, requests_from
from weftline.sources import fetch as W
from weftline.sources import requests as B
from weftline.sources import tables as S
from weftline.streaming import state as T

NOW = 1_706_659_200_000_000  # 2024-01-31


def _cases(by: Column, *values: str | None) -> Column:
    """The value at the remainder of ``by``."""
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        out = F.when(by % len(values) == k, F.lit(v)).otherwise(out)
    return out


# ---- retries and errors ----
@query(f"""with {RESPONSES}, f as (select status::varchar as reason, page_id % 4 + 1 <= 2 as again from responses where status >= 400)
select 'retry/count' as key, count(*) as value from f where again having count(*) > 0 union all select 'retry/reason_count/' || reason, count(*) from f where again group by reason union all select 'retry/max_reached', count(*) from f where not again having count(*) > 0""")
def retry_stats(spark: SparkSession, sf: str) -> DataFrame:
    failed = S.responses(spark, sf).where("status >= 400").select(F.col("status").cast("string").alias("reason"), (F.col("page_id") % 4).alias("retry_times"), F.lit(None).cast("int").alias("max_retry_times"))
    return R.retry_counts(failed, "reason")


@query(f"with {LOG} select seq, error_class = 'E0' and seq % 5 <> 0 as again, error_class <> 'E2' as logged from log where not ok")
def retryable_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Failed downloads with their class and those that it derives from; one class stands for requests that were given up."""
    names = F.create_map(F.lit("E0"), F.lit("OSError/TimeoutError"), F.lit("E1"), F.lit("ValueError"), F.lit("E2"), F.lit("IgnoreRequest"))
    errors = S.download_log(spark, sf).where("not ok").select("seq", F.element_at(names, F.col("error_class")).alias("error_class"))
    loud = R.loud_errors(errors).select("seq", F.lit(True).alias("logged"))
    marked = errors.select("seq", R.retryable_error(F.col("error_class"), F.col("seq") % 5 == 0).alias("again"))
    return marked.join(loud, "seq", "left").select("seq", "again", F.coalesce("logged", F.lit(False)).alias("logged"))


def _raise(page: dict) -> Iterator[tuple[str, dict]]:
    if page["page_id"] % 3 == 0:
        raise ValueError(page["url"])
    if page["page_id"] % 3 == 1:
        raise KeyError("title")
    yield "item", {"id": page["page_id"]}


def _recover(page: dict, error: Exception) -> Iterator[tuple[str, dict]]:
    if page["page_id"] % 2:
        raise error
    yield "request", {"url": page["url"]}


@query("""select 'spider_exceptions' as key, count(*) as value from pages where page_id % 3 < 2 union all select 'spider_exceptions/ValueError', count(*) from pages where page_id % 3 = 0 union all select 'spider_exceptions/KeyError', count(*) from pages where page_id % 3 = 1""")
def spider_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    out = chain.parse(S.table(spark, sf, "pages"), _raise, ["url"]).where("kind = 'error'")
    return A.counts(out.select(F.get_json_object("payload", "$.class").alias("class")), "spider_exceptions", "class")


@query("select page_id, case when page_id % 3 = 2 then 'item' when page_id % 2 = 0 then 'request' else 'error' end as kind from pages")
def errback_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return chain.parse(S.table(spark, sf, "pages"), _raise, ["url"], errback=_recover).select("page_id", "kind")


@query("select page_id, page_id % 5 = 0 as answered from pages where page_id % 5 = 0 or page_id % 7 <> 0")
def short_circuited(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of which one step answers some and the next, which does not see these, drops some."""
    cache = lambda r: (r.where("page_id % 5 <> 0"), r.where("page_id % 5 = 0"))
    left, answers = chain.short_circuit(S.table(spark, sf, "pages").select("page_id"), [cache, lambda r: None, lambda r: (r.where("page_id % 7 <> 0"), None)])
    return left.withColumn("answered", F.lit(False)).unionByName(answers.withColumn("answered", F.lit(True)))


# ---- counters ----
@query("""with r as (select c_custkey, case when c_custkey % 2 = 0 then 'GET' else 'POST' end as method, '/p?x=' || c_custkey as target, case when c_custkey % 2 = 0 then '' else 'k=v' end as body from customer)
select 'downloader/request_count' as key, count(*) as value from r union all select 'downloader/request_count/' || method, count(*) from r group by method
union all select 'downloader/request_bytes', sum(length(method || ' ' || target || ' HTTP/1.1__Host: h.example__X-Id: ' || c_custkey || '____' || body))::bigint from r""")
def request_wire_stats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = S.table(spark, sf, "customer").select(F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("http://user@h.example:80/p?x="), k, F.lit("#f")).alias("url"), F.create_map(F.lit("X-Id"), k.cast("string")).alias("headers"), F.when(k % 2 == 1, F.lit("k=v")).alias("body"))
    return A.request_sizes(rows, "method", R.wire(F.col("method"), F.col("url"), F.col("headers"), F.col("body")))


@query(f"with {RESPONSES}, i as (select status from responses where not (status between 200 and 299 or status = 404)) select 'httperror/response_ignored_count' as key, count(*) as value from i union all select 'httperror/response_ignored_count/' || status, count(*) from i group by status")
def http_error_stats(spark: SparkSession, sf: str) -> DataFrame:
    ok = R.status_ok(F.col("status"), F.lit(None).cast("boolean"), F.lit(None).cast("array<int>"), allowed=[404])
    return A.counts(S.responses(spark, sf).where(~ok), "httperror/response_ignored_count", "status")


@query(f"with {LINKS} select 'dupefilter/filtered' as key, count(*) - count(distinct fp) as value from outlinks")
def dedup_filtered(spark: SparkSession, sf: str) -> DataFrame:
    links = S.outlinks(spark, sf).select("page_id", "pos", "fp")
    return dedup.filtered(links, dedup.first_seen(links, ["page_id", "pos"]))


@query(f"""with {FRONTIER}, {Q.LEASES}, acks as (select task_id, 't' || (seq % 7 + case when seq % 3 = 0 then 1 else 0 end) as token from leases where seq % 2 = 0)
select * from (select 'scheduler/enqueued' as key, count(*) as value from frontier where state = 'O' union all select 'scheduler/rejected', count(*) from frontier where state = 'F' union all select 'scheduler/reserved', count(*) from leases
union all select 'scheduler/redelivered', least(100, count(*)) from leases where deadline <= 820454400 and seq % 4 <> 0 union all select 'scheduler/requeued', count(*) from leases where seq % 11 = 0
union all select 'scheduler/' || case when l.token = a.token then 'acked' else 'stale' end, count(*) from acks a join leases l using (task_id) group by 1) where value > 0""")
def scheduler_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """The scheduler's counters, from what push, reserve, recovery and acknowledgement give."""
    all_, leases = S.frontier(spark, sf), Q._leases(spark, sf)
    waiting, new = all_.where("state = 'F'").select("task_id"), all_.where("state <> 'P'").select("task_id")
    pushed = H.push(waiting, new)
    late = F.when(F.col("seq") % 3 == 0, 1).otherwise(0)
    acks = leases.where("seq % 2 = 0").select("task_id", F.concat(F.lit("t"), F.col("seq") % 7 + late).alias("token"))
    recovered = H.recover(leases.select("task_id", "token", "deadline"), leases.where("seq % 4 <> 0").select("task_id"), F.lit(820454400), 100)
    return H.transitions(pushed, new.join(pushed, "task_id", "left_anti"), leases, recovered, H.settled(leases, acks), leases.where("seq % 11 = 0"))


@query(f"with {LOG} select kind, count(*) as n, min(at_us) as oldest from log where ok group by 1")
def live_objects(spark: SparkSession, sf: str) -> DataFrame:
    return A.live(S.download_log(spark, sf), "kind", "at", F.col("ok"))


@query(f"with {K.DELTAS} select '<s> ' || kind || ': ' || delta as line from d where delta <> 0")
def metric_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = K._deltas(spark, sf).withColumnRenamed("kind", "metric")
    return d.select(A.log_lines(d, "s").alias("line"))


@query("""select page_id, 'Crawled (200) <GET ' || url || '> (referer: None)' as crawled, 'Scraped from <200 ' || url || '>' || chr(10) || page_id as scraped, 'Dropped: short' || chr(10) || page_id as dropped, 'Error processing ' || page_id as item_error,
'Spider error processing <GET ' || url || '> (referer: r)' as spider_error, 'Error downloading <GET ' || url || '>: timeout' as download_error from pages""")
def item_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    u, k, none = F.col("url"), F.col("page_id"), F.lit(None).cast("string")
    lines = {
        "crawled": (F.lit(200), F.lit("GET"), u, none), "scraped": (F.lit(200), u, k), "dropped": (F.lit("short"), k), "item_error": (k,),
        "spider_error": (F.lit("GET"), u, F.lit("r")), "download_error": (F.lit("GET"), u, F.lit("timeout")),
    }
    return S.table(spark, sf, "pages").select("page_id", *[I.log_line(kind, *v).alias(kind) for kind, v in lines.items()])


# ---- the frontier, its pace and its end ----
@query(f"with {FRONTIER} select seq from (select seq, seq % 3 = 0 as redelivered from frontier) order by redelivered, seq limit 64")
def frontier_requeued_last(spark: SparkSession, sf: str) -> DataFrame:
    return H.reserve(S.frontier(spark, sf).withColumn("redelivered", F.col("seq") % 3 == 0), 64, "fifo", requeued="back").select("seq")


@query("select false as on_start, count(*) as n from orders union all select true, 0")
def frontier_flush(spark: SparkSession, sf: str) -> DataFrame:
    q = S.frontier(spark, sf)
    one = lambda x: H.flushed(q, x).agg(F.lit(x).alias("on_start"), F.count("*").alias("n"))
    return one(False).unionByName(one(True))


@query(f"with {FRONTIER} select seq from frontier order by priority desc, seq limit 10")
def backpressure(spark: SparkSession, sf: str) -> DataFrame:
    """Six requests run and no response is held, so ten more start; with too many bytes held none would."""
    q, order = S.frontier(spark, sf), [F.desc("priority"), F.asc("seq")]
    return H.admissible(q, 6, 0, order).unionByName(H.admissible(q, 6, 6_000_000, order)).select("seq")


@query(f"with {FRONTIER} select seq from frontier where not (seq % 2 = 0 and 999999900 < case seq % 3 when 1 then 1000000030 when 2 then 2000000000 else 1e300 end)")
def unpaused_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the spiders pause: without end, for 30 s from a moment ago, or until a date."""
    now = F.lit(1_000_000_000).cast("double")
    value = F.when(F.col("seq") % 3 == 1, 30.0).when(F.col("seq") % 3 == 2, 2e9)
    q = S.frontier(spark, sf).withColumn("until", H.pause_until(value, now))
    return H.unpaused(q, F.col("seq") % 2 == 0, F.col("until"), now - 100).select("seq")


@query(f"with {LOG} select slot, max(at_us) as last from log group by 1 having {NOW} - max(at_us) > 43200000000")
def idle_slots(spark: SparkSession, sf: str) -> DataFrame:
    return H.idle_slots(S.download_log(spark, sf), F.lit(NOW), 43_200_000_000)


@query(f"""with {LOG}, i as (select seq, slot, at_us, (14400000000 * (500 + (seq * 7919) % 1001)) // 1000 as d, row_number() over (partition by slot order by at_us, seq) as i from log), s as (select *, sum(d) over (partition by slot order by i) as s from i)
select seq, slot, (s + max(at_us - s) over (partition by slot order by i rows unbounded preceding))::bigint as start from s""")
def slot_pacing_jitter(spark: SparkSession, sf: str) -> DataFrame:
    return H.paced(S.download_log(spark, sf), H.jitter(14_400_000_000, F.col("seq")), ["at", "seq"]).select("seq", "slot", "start")


@query(f"""with {LOG} select reason, at_us as at, seq from ((select 'closespider_itemcount' as reason, at_us, seq from log where kind = 'purchase' order by at_us, seq limit 1 offset 49) union all (select 'closespider_errorcount', at_us, seq from log where not ok order by at_us, seq limit 1 offset 69)
union all (select 'timeout', min(at_us) + 864000000000, null from log having max(at_us) - min(at_us) >= 864000000000)) order by at_us, seq nulls last limit 1""")
def close_spider(spark: SparkSession, sf: str) -> DataFrame:
    limits = {"closespider_itemcount": (F.col("kind") == "purchase", 50), "closespider_errorcount": (~F.col("ok"), 70)}
    return H.closed(S.download_log(spark, sf), limits, 864_000_000_000)


@query(f"with {LOG} select seq, at_us // 86400000000 as flush_at, (row_number() over (partition by at_us // 86400000000 order by at_us, seq) - 1) // 100 as flush from log")
def ack_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Acknowledgements that go together: a hundred, or what a tick has."""
    return H.flush_groups(S.download_log(spark, sf), 100, 86_400, "at", ["at", "seq"]).select("seq", "flush_at", "flush")


@query(f"with recursive {LINKS}, {Q.EDGES}, walk as (select 0::bigint as node, 0 as depth union select e.dst, w.depth + 1 from walk w join edges e on e.src = w.node where w.depth < 30) select node, min(depth)::int as depth from walk group by 1")
def crawl_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """The walk over the link graph until a level is empty."""
    return crawl.depths(Q._edges(spark, sf), spark.createDataFrame([(0,)], "node long"))


@query(f"""with {LOG}, e as (select seq, at_us, (slot % 7)::varchar as fp, case when seq % 8 = 0 and slot % 7 < 3 then 'parse_ok' when seq % 8 = 1 then 'request_ok' when seq % 8 = 2 then 'request_err' else 'test' end as kind from log),
t as (select seq, at_us, case when at_us - lag(at_us) over (order by at_us, seq) > 180000000 then 1 else 0 end as gap from e where kind = 'test'), g as (select seq, sum(gap) over (order by at_us, seq) as epoch from t),
m as (select e.*, epoch, case when kind = 'test' then epoch when kind in ('request_ok', 'request_err') then -1 end as mark from e left join g using (seq)),
x as (select *, last_value(mark ignore nulls) over w as held, max((kind = 'parse_ok')::int) over w as done from m window w as (partition by fp order by at_us, seq rows between unbounded preceding and 1 preceding))
select seq, fp, case when coalesce(done, 0) = 1 then 'seen' when held = epoch then 'in flight' else 'new' end as verdict from x where kind = 'test'""")
def in_flight_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Tests against what is parsed and what is in flight; the latter is forgotten 180 s after the last test."""
    k = F.col("seq") % 8
    kind = F.when((k == 0) & (F.col("slot") % 7 < 3), "parse_ok").when(k == 1, "request_ok").when(k == 2, "request_err").otherwise("test")
    events = S.download_log(spark, sf).select("seq", "at", (F.col("slot") % 7).cast("string").alias("fp"), kind.alias("kind"))
    return dedup.outcomes_of_tests(events).select("seq", "fp", "verdict")


# ---- requests ----
@query("select page_id, case page_id % 3 when 0 then 'web' when 1 then 'inline' end as handler from pages")
def scheme_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.lit("DATA:,x")).otherwise(F.lit("ftp://h/x"))
    return S.table(spark, sf, "pages").select("page_id", W.handler_of(url, {"http": "web", "https": "web", "data": "inline"}).alias("handler"))


@query("select page_id, case when page_id % 10 <> 0 then 200 else 0 end::int as status, case when page_id % 10 <> 0 then sha1(html) end as body_sha1, case when page_id % 10 = 0 then 'NotSupported' end as error from pages")
def fetch_data_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as data URLs, fetched through the handler of their scheme; some have a scheme that no handler serves."""
    url = F.when(F.col("page_id") % 10 == 0, F.lit("gopher://h/x")).otherwise(F.concat(F.lit("data:text/html;base64,"), F.base64(F.encode("html", "UTF-8"))))
    requests = S.table(spark, sf, "pages").select("page_id", url.alias("url"), F.lit("GET").alias("method"), F.create_map().cast("map<string,string>").alias("headers"), F.lit(None).cast("binary").alias("body"))
    return W.fetch(requests, "page_id").select("page_id", F.coalesce("status", F.lit(0)).alias("status"), F.sha1("body").alias("body_sha1"), "error")


@query("""with p as (select page_id, url, case when page_id % 4 = 0 then 'origin' when page_id % 3 = 0 then 'no-referrer' when page_id % 3 = 1 then 'same-origin' else 'unsafe-url' end as policy from pages)
select page_id, policy, case policy when 'origin' then regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/' when 'no-referrer' then null else regexp_replace(url, '#.*$', '') end as referer from p""")
def referrer_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The request's own policy, the response's header, the setting: the first that names a known one counts."""
    own = _cases(F.col("page_id"), "origin", None, "bogus", None)
    header = _cases(F.col("page_id"), "nonsense, No-Referrer, same-origin", "same-origin", "")
    p = S.table(spark, sf, "pages").select("page_id", "url", F.col("url").alias("goal"), R.referrer_policy(own, header, "unsafe-url").alias("policy"))
    return U.with_referrers(p, "url", "goal", {"referer": F.col("policy")}).select("page_id", "policy", "referer")


@query(r"""with p as (select page_id, regexp_extract(url, '^[a-z]+', 0) || '://' || regexp_extract(url, '://([^/?#]*)', 1) as root, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as dir from pages),
d as (select page_id, root, case when dir = '' then '/' else dir end as dir from p)
select page_id, 0 as k, root || dir || 'a' as joined from d union all select page_id, 1, root || case when dir = '/' then '/' else regexp_replace(dir, '[^/]+/$', '') end || 'b' from d
union all select page_id, 2, root || dir || 'c?x=../y' from d union all select page_id, 3, root || '/d/' from d union all select page_id, 4, root || '/g' from d""")
def url_join_dots(spark: SparkSession, sf: str) -> DataFrame:
    links = F.array(*map(F.lit, ["./a", "../b", "c?x=../y", "/d/e/..", "/../../g"]))
    p = S.table(spark, sf, "pages").select("page_id", "url", F.posexplode(links).alias("k", "href"))
    return p.select("page_id", "k", U.join_absolute(F.col("url"), F.col("href")).alias("joined"))


@query(f"with {LINKS} select page_id, pos::int as pos, url from links")
def follow_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every link that a page's elements have, absolute."""
    return P.follow_all(S.table(spark, sf, "pages"), css="[href]:not(.no-such-class)")


@query("select page_id, (generate_subscripts(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1), 1) - 1)::int as pos, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) as value from pages")
def selector_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return P.select(S.table(spark, sf, "pages"), {"way": "//*[starts-with(@href, '/') and not(self-marked)]/@href"}, patterns={"way": "^/(.*)$"}).select("page_id", "pos", "value")


@query("select c_custkey, 'http://h/p?a=' || c_custkey || '&b=2&d=1&d=2&c=x+y&d=3' as url from customer")
def param_merge(spark: SparkSession, sf: str) -> DataFrame:
    params = F.to_json(F.struct(F.col("c_custkey").alias("a"), F.lit("x y").alias("c"), F.lit(3).alias("d")))
    return S.table(spark, sf, "customer").select("c_custkey", B.with_params(F.lit("http://h/p?a=1&b=2&d=1&d=2"), params).alias("url"))


@query(f"with {FRONTIER} select seq, 5 as priority, state from frontier")
def request_replace(spark: SparkSession, sf: str) -> DataFrame:
    return R.replaced(S.frontier(spark, sf), priority=F.lit(5)).select("seq", "priority", "state")


@query("""select c_custkey, case c_custkey % 3 when 2 then 'PUT' when 0 then 'POST' else 'GET' end as method, case c_custkey % 3 when 0 then '{"id":' || c_custkey || '}' when 1 then 'raw' else '' end as body, case when c_custkey % 2 = 0 then 'own' else 'application/json' end as content_type from customer""")
def json_requests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    data, raw = F.when(k % 3 != 2, F.to_json(F.struct(k.alias("id")))), F.when(k % 3 == 1, F.lit("raw"))
    own = F.when(k % 2 == 0, F.create_map(F.lit("Content-Type"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    method, body, headers = B.json_request(F.when(k % 3 == 2, F.lit("put")), data, raw, own)
    return S.table(spark, sf, "customer").select("c_custkey", method.alias("method"), body.alias("body"), headers["Content-Type"].alias("content_type"))


@query(f"with {LINKS} select page_id, pos, case when page_id % 5 = 0 then 'own-' || page_id else fp end as fp from outlinks")
def custom_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    links = S.outlinks(spark, sf).withColumn("own_fp", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("own-"), F.col("page_id"))))
    return R.fingerprinted(links, F.col("fp")).select("page_id", F.col("pos").cast("long"), "fp")


@query("select page_id, url, page_id as priority, 'parse' as callback from pages")
def queued_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of another shape than the queue's own, read by a decoder."""
    payload = F.to_json(F.struct("url", F.col("page_id").alias("p"), F.lit("parse").alias("callback")))
    record = requests_from(payload, lambda raw: {"priority": F.get_json_object(raw, "$.p").cast("int")})
    return S.table(spark, sf, "pages").select("page_id", record.alias("r")).select("page_id", "r.url", "r.priority", "r.callback")


@query(f"with {RESPONSES} select page_id, status, 'http://from/' || page_id as referer, url as request_url from responses where page_id % 2 = 0")
def request_result_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Results beside the request that each came from."""
    requests = S.table(spark, sf, "pages").select("page_id", "url", F.create_map(F.lit("Referer"), F.concat(F.lit("http://from/"), F.col("page_id"))).alias("headers"))
    results = S.responses(spark, sf).where("page_id % 2 = 0").select("page_id", "status")
    return R.paired(requests, results, "page_id").select("page_id", "status", R.referer_of(F.col("request.headers")).alias("referer"), F.col("request.url").alias("request_url"))


@query(f"select page_id, {HOST.format('url')} = 'example.com' or {HOST.format('url')} like '%.example.com' as inside from pages")
def url_in_domain(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "pages").select("page_id", U.in_domain(U.host(F.col("url")), F.lit("EXAMPLE.com")).alias("inside"))


@query("select doc_id, sha1(text) as utf8, 'é' || doc_id as latin, 'spiders.' || lang || '.Spider' as name from documents")
def text_names(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes as text under two charsets, and the dotted names of classes."""
    latin = X.decoded(F.concat(F.unhex(F.lit("E9")), F.col("doc_id").cast("string").cast("binary")), "ISO-8859-1")
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", F.sha1(X.decoded(F.encode("text", "UTF-8"), "UTF-8").cast("binary")).alias("utf8"), latin.alias("latin"), global_name(F.concat(F.lit("spiders."), F.col("lang")), F.lit("Spider")).alias("name"))


# ---- sinks ----
@query("select doc_id, case doc_id % 3 when 0 then 'db://a' when 1 then 'db://b' end as url, case when doc_id % 3 = 2 then 'no sink c' end as error from documents")
def item_sink_config(spark: SparkSession, sf: str) -> DataFrame:
    sinks = spark.createDataFrame([("a", "db://a"), ("b", "db://b")], "alias string, url string")
    items = S.table(spark, sf, "documents").select("doc_id", _cases(F.col("doc_id"), "a", "b", "c").alias("alias"))
    return I.with_sinks(items, sinks).select("doc_id", "url", "error")


@query("select doc_id, (row_number() over (partition by lang order by doc_id) - 1) // 50 as flush from documents")
def item_size_flush(spark: SparkSession, sf: str) -> DataFrame:
    return I.flushes(S.table(spark, sf, "documents").select("doc_id", "lang"), 50, ["doc_id"], ["lang"]).select("doc_id", "flush")


@query("""select distinct 'sadd' as method, 'sources' as key, '{"lang":"' || lang || '","source":"' || source || '"}' as value from documents""")
def item_set_commands(spark: SparkSession, sf: str) -> DataFrame:
    return I.commands(S.table(spark, sf, "documents"), "sadd", "sources", ["lang", "source"])


@query("""select '{"id":' || doc_id || ',"lang":' || case when doc_id % 2 = 0 then '"' || lang || '"' else 'null' end || '}' as document from documents""")
def item_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    return I.documents(d, ["id", "lang"])


@query(f"with {FRONTIER} select task_id as payload, greatest(0, least(255, (priority - 2) * 100))::int as priority, true as persistent from frontier")
def broker_messages(spark: SparkSession, sf: str) -> DataFrame:
    q = S.frontier(spark, sf).withColumn("priority", (F.col("priority") - 2) * 100)
    return I.published(q, F.col("task_id"))


@query("select l_orderkey, l_linenumber, max(l_extendedprice) as l_extendedprice from lineitem group by 1, 2")
def item_stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of items into a table under the mode 'update_insert': of rows of one key in a batch the last by order stays."""
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    lines = S.table(spark, sf, "lineitem")
    stream = spark.readStream.schema(lines.schema).parquet(f"{sf}/lineitem.parquet*").select(*columns)
    folder = T.scratch(spark, "items")
    running = T.flush_every(stream, I.table_sink(folder, "update_insert", columns[:2], columns[2:]), T.scratch(spark, "stream"), None)
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.parquet(f"{folder}/version={I.versions(spark, folder)[-1]}")
