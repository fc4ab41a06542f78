"""URL, request and response queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.operators import requests as R
from weftline.plans.registry import HOST, LINKS, RESPONSES, query
from weftline.sources import requests as Q
from weftline.sources import tables as S


@query(f"with {LINKS} select page_id, pos, href, url, fp from outlinks")
def outlinks_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return S.outlinks(spark, sf).select("page_id", F.col("pos").cast("long"), "href", "url", "fp")


@query(f"with {LINKS} select {HOST.format('url')} as host, count(*) as links, count(distinct fp) as requests from outlinks group by 1")
def outlinks_per_host(spark: SparkSession, sf: str) -> DataFrame:
    return S.outlinks(spark, sf).groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("links"), F.count_distinct("fp").alias("requests"))


@query(r"""select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path,
regexp_extract(url, '\?([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment, lower(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '[^./](\.[^./]*)$', 1)) as extension from pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return S.table(spark, sf, "pages").select("page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"), U.extension(u).alias("extension"))


@query(r"""with u as (select page_id, replace(url, '://', case when page_id % 3 = 0 then '://user:pw@' else '://' end) as v from pages),
p as (select page_id, case when page_id % 2 = 0 then regexp_replace(v, '^(http://[^/]*)/', '\1:80/') else regexp_replace(v, '^(https?://[^/]*)/', '\1:8080/') end as v from u)
select page_id, v as url, regexp_replace(regexp_replace(regexp_replace(v, '#.*$', ''), '://[^/@]*@', '://'), '^(http://[^/:]*):80/', '\1/') as stripped,
regexp_extract(regexp_replace(regexp_replace(v, '://[^/@]*@', '://'), '^(http://[^/:]*):80/', '\1/'), '^[a-z]+://[^/]*/', 0) as origin from p""")
def url_strip(spark: SparkSession, sf: str) -> DataFrame:
    user = F.when(F.col("page_id") % 3 == 0, F.lit("://user:pw@")).otherwise(F.lit("://"))
    p = S.table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("://"), user).alias("v"))
    v = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("v", "^(http://[^/]*)/", "$1:80/")).otherwise(F.regexp_replace("v", "^(https?://[^/]*)/", "$1:8080/"))
    p = p.select("page_id", v.alias("url"))
    return p.select("page_id", "url", U.strip(F.col("url")).alias("stripped"), U.origin(F.col("url")).alias("origin"))


@query(r"""with u as (select page_id, replace(url, '#', '#!a=b') as url from pages)
select page_id, url, case when url like '%#!%' then regexp_replace(url, '#.*$', '') || case when regexp_replace(url, '#.*$', '') like '%?%' then '&' else '?' end || '_escaped_fragment_=' || replace(regexp_extract(url, '#!(.*)$', 1), '=', '%3D') else url end as escaped from u""")
def escape_ajax(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("#"), F.lit("#!a=b")).alias("url"))
    return p.select("page_id", "url", U.escape_ajax(F.col("url")).alias("escaped"))


@query(r"""with u as (select page_id, case page_id % 4 when 0 then url when 1 then regexp_replace(url, '^[a-z]+:', '') when 2 then regexp_replace(url, '^[a-z]+://', '') else regexp_replace(url, '^[a-z]+://[^/]*', '') end as raw from pages)
select page_id, raw, case when regexp_matches(raw, '^\w+://') then raw when raw like '//%' then 'http:' || raw else 'http://' || raw end as with_scheme,
case when regexp_matches(raw, '^\w+://') then raw when regexp_matches(raw, '^/[^/]') then 'file://' || raw when raw like '//%' then 'http:' || raw else 'http://' || raw end as guessed from u""")
def add_scheme(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^[a-z]+:", "")).when(k == 2, F.regexp_replace("url", "^[a-z]+://", "")).otherwise(F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    p = S.table(spark, sf, "pages").select("page_id", raw.alias("raw"))
    return p.select("page_id", "raw", U.add_scheme(F.col("raw")).alias("with_scheme"), U.guess_scheme(F.col("raw")).alias("guessed"))


@query("select page_id, url from pages where regexp_matches(url, '^[a-z]+://[^/?#]*[^?#]*\\.html([?#]|$)')")
def extension_filter(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "pages").where(U.has_extension(F.col("url"), [".html"])).select("page_id", "url")


@query("""with r as (select page_id, 1 as k, url as raw from pages union all select page_id, 2, '/srv/' || page_id from pages union all select page_id, 3, 'C:\\data\\' || page_id from pages union all select page_id, 4, '../up' from pages)
select page_id, k, k in (2, 3, 4) as is_path from r""")
def path_predicates(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "pages")
    raw = F.array(F.col("url"), F.concat(F.lit("/srv/"), F.col("page_id")), F.concat(F.lit("C:\\data\\"), F.col("page_id")), F.lit("../up"))
    return p.select("page_id", F.posexplode(raw).alias("k", "raw")).select("page_id", (F.col("k") + 1).alias("k"), U.is_file_path(F.col("raw")).alias("is_path"))


@query("""with p as (select a.page_id, a.url as src, b.url as dst from pages a join pages b on b.page_id = (a.page_id + 1) % (select count(*) from pages) union all select page_id, url, url from pages),
x as (select *, regexp_replace(src, '#.*$', '') as whole, regexp_extract(src, '^[a-z]+://[^/?#]*', 0) || '/' as bare, src like 'https:%' as ts, dst like 'https:%' as td, regexp_extract(src, '^[a-z]+://[^/?#]*', 0) = regexp_extract(dst, '^[a-z]+://[^/?#]*', 0) as same from p)
select page_id, dst, null::varchar as no_referrer, case when not ts or td then whole end as no_referrer_when_downgrade, case when same then whole end as same_origin, bare as origin, case when (ts and td) or not ts then bare end as strict_origin,
case when same then whole else bare end as origin_when_cross_origin, case when same then whole when (ts and td) or not ts then bare end as strict_origin_when_cross_origin, whole as unsafe_url from x""")
def referrer_policies(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "pages").select("page_id", "url")
    n = p.agg(F.count("*").alias("n"))
    after = p.join(F.broadcast(n)).select(F.pmod(F.col("page_id") - 1, F.col("n")).alias("page_id"), F.col("url").alias("dst"))  # one row
    pairs = p.join(after, "page_id").select("page_id", F.col("url").alias("src"), "dst").unionByName(p.select("page_id", F.col("url").alias("src"), F.col("url").alias("dst")))
    return U.with_referrers(pairs, "src", "dst", {x.replace("-", "_"): x for x in U.POLICIES}).drop("src")


@query("""select c_custkey, 'http://h/' || case when true then '?' else '' end || 'name=' || replace(url_encode(c_name), '%20', '+') || '&seg=' || replace(url_encode(c_mktsegment), '%20', '+') as get_url, '' as get_body,
'http://h/' as post_url, 'name=' || replace(url_encode(c_name), '%20', '+') || '&seg=' || replace(url_encode(c_mktsegment), '%20', '+') as post_body from customer""")
def form_urlencode(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("name").alias("key"), F.col("c_name").alias("value")), F.struct(F.lit("seg").alias("key"), F.col("c_mktsegment").alias("value")))
    c = S.table(spark, sf, "customer").select("c_custkey", pairs.alias("pairs"))
    get, post = Q.form_request(F.lit("http://h/"), F.col("pairs"), F.lit("get")), Q.form_request(F.lit("http://h/"), F.col("pairs"), F.lit("POST"))
    return c.select("c_custkey", get[0].alias("get_url"), get[1].alias("get_body"), post[0].alias("post_url"), post[1].alias("post_body"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'own' else 'weft/1.0' end as user_agent, 'text/html' as accept, case when c_custkey % 3 = 0 then c_custkey::double else 180.0 end as timeout from customer""")
def header_default_merge(spark: SparkSession, sf: str) -> DataFrame:
    own = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("User-Agent"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    c = S.table(spark, sf, "customer").withColumn("headers", F.transform_keys(own, lambda k, v: U.header_name(k)))
    h = Q.with_defaults(F.col("headers"), F.create_map(F.lit("User-Agent"), F.lit("weft/1.0"), F.lit("Accept"), F.lit("text/html")))
    c = c.withColumn("h", h)
    return c.select("c_custkey", F.col("h")["User-Agent"].alias("user_agent"), F.col("h")["Accept"].alias("accept"), R.default_timeout(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey"))).alias("timeout"))


@query(f"with {RESPONSES} select page_id, status from responses where status between 200 and 299 or page_id % 20 = 7 or status = 404")
def http_status_filter(spark: SparkSession, sf: str) -> DataFrame:
    r = S.responses(spark, sf).withColumns({"all": F.col("page_id") % 20 == 7, "list": F.lit(None).cast("array<int>")})
    return r.where(R.status_ok(F.col("status"), F.col("all"), F.col("list"), allowed=[404])).select("page_id", "status")


@query(f"with {RESPONSES} select page_id, status, page_id % 3 + 1 as retry_times, true as dont_filter, -1 as priority from responses where status in (408, 429, 500, 502, 503, 504, 522, 524) and page_id % 4 <> 0 and page_id % 3 + 1 <= 2")
def retry_clone(spark: SparkSession, sf: str) -> DataFrame:
    r = S.responses(spark, sf).where(R.retryable(F.col("status"), F.col("page_id") % 4 == 0))
    r = r.select("page_id", "status", (F.col("page_id") % 3).alias("retry_times"), F.lit(0).alias("priority"), F.lit(None).cast("int").alias("priority_adjust"), F.lit(None).cast("int").alias("max_retry_times"))
    return R.retry(r).select("page_id", "status", "retry_times", "dont_filter", "priority")


@query(f"with {RESPONSES} select page_id, status in (408, 429, 500, 502, 503, 504, 522, 524) as retryable, coalesce(not case when page_id % 5 = 0 then true when page_id % 5 = 1 then false end, true) as redirect from responses")
def retryable_responses(spark: SparkSession, sf: str) -> DataFrame:
    own = F.when(F.col("page_id") % 5 == 0, F.lit(True)).when(F.col("page_id") % 5 == 1, F.lit(False))
    return S.responses(spark, sf).select("page_id", R.retryable(F.col("status"), F.lit(None).cast("boolean")).alias("retryable"), R.follow_redirect(own, F.lit(True)).alias("redirect"))


@query(f"with {LINKS} select page_id, pos, url from outlinks where regexp_matches({HOST.format('url')}, '^(.*\\.)?(example\\.com|example\\.net)$') or page_id % 10 = 0")
def offsite_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.outlinks(spark, sf)
    return rows.where(R.on_site(U.host(F.col("url")), ["example.com", "example.net"], F.col("page_id") % 10 == 0)).select("page_id", F.col("pos").cast("long"), "url")


@query(f"with {LINKS} select count(*) as filtered, count(distinct {HOST.format('url')}) as domains from outlinks where not regexp_matches({HOST.format('url')}, '^(.*\\.)?example\\.com$')")
def offsite_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.outlinks(spark, sf).withColumn("host", U.host(F.col("url")))
    return rows.where(~R.on_site(F.col("host"), ["example.com"])).agg(F.count("*").alias("filtered"), F.count_distinct("host").alias("domains"))


@query(f"with {LINKS} select page_id, pos, length(url)::int as n from outlinks where length(url) <= 45")
def url_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return S.outlinks(spark, sf).where(R.short_enough(F.col("url"), 45)).select("page_id", F.col("pos").cast("long"), F.length("url").alias("n"))


@query(f"with {LINKS}, d as (select page_id, pos, case when page_id % 4 = 0 then 0 else page_id % 4 end + 1 as depth from outlinks) select page_id, pos, depth, 100 - depth * 10 as priority from d where depth <= 3")
def depth_limit(spark: SparkSession, sf: str) -> DataFrame:
    own = F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 4)
    rows = S.outlinks(spark, sf).select("page_id", F.col("pos").cast("long"), R.child_depth(own).alias("depth"))
    return rows.where(R.within_depth(F.col("depth"), 3)).withColumn("priority", R.child_priority(F.lit(100), F.col("depth"), 10))


@query(f"with spiders(name, domain) as (values ('com', 'example.com'), ('net', 'example.net'), ('blog', 'ththan.example.net')) select s.name, p.page_id from pages p join spiders s on {HOST.format('p.url')} = s.domain or {HOST.format('p.url')} like '%.' || s.domain")
def domain_suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    spiders = spark.createDataFrame([("com", "example.com"), ("net", "example.net"), ("blog", "ththan.example.net")], "name string, domain string")
    pages = S.table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    return R.assign_spider(pages, spiders).select("name", "page_id")


@query(f"""with {RESPONSES} select page_id, coalesce(case when page_id % 6 = 0 then 's' || page_id end, {HOST.format('url')}) as by_host, coalesce(case when page_id % 6 = 0 then 's' || page_id end, case when page_id % 2 = 0 then 'p1' end, '') as by_proxy from responses""")
def download_slots(spark: SparkSession, sf: str) -> DataFrame:
    own, proxy = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("s"), F.col("page_id"))), F.when(F.col("page_id") % 2 == 0, F.lit("p1"))
    return S.responses(spark, sf).select("page_id", R.slot(own, proxy, F.col("url"), False).alias("by_host"), R.slot(own, proxy, F.col("url"), True).alias("by_proxy"))


@query("""with p as (select page_id, case when page_id % 7 <> 0 then ['px0', 'px1', 'px2'][1 + (row_number() over (order by page_id) - 1) % 3] end as proxy from pages) select * from p""")
def proxy_rotation(spark: SparkSession, sf: str) -> DataFrame:
    pages = S.table(spark, sf, "pages").select("page_id", (F.col("page_id") + 1).alias("turn"), (F.col("page_id") % 7 != 0).alias("use_proxy"))
    return R.rotate_proxies(pages, ["px0", "px1", "px2"], "turn").select("page_id", "proxy")


@query(f"""with {RESPONSES}, seen as (select 'px' || (page_id % 20) as proxy, status from responses), pool as (select distinct proxy from seen)
select proxy from pool where proxy not in (select proxy from seen where status >= 400 and status <> 404)""")
def proxy_eviction(spark: SparkSession, sf: str) -> DataFrame:
    seen = S.responses(spark, sf).select(F.concat(F.lit("px"), F.col("page_id") % 20).alias("proxy"), "status", F.lit(None).cast("string").alias("error"))
    return R.usable_proxies(seen.select("proxy").distinct(), seen)


@query("select s_suppkey as k from supplier where s_suppkey % 9 = 0")
def proxy_pool(spark: SparkSession, sf: str) -> DataFrame:
    s = S.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("proxy"), F.when(F.col("s_suppkey") % 9 == 0, 100).otherwise(50).alias("score"))
    return S.proxies(s, 1_000_000).select(F.col("proxy").cast("long").alias("k"))


@query(f"with {RESPONSES} select page_id, sum(greatest(octet_length(encode(html)), 1024)) over () as active, octet_length(encode('GET ' || regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?#]*', '') || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: ' || {HOST.format('url')} || chr(13) || chr(10) || chr(13) || chr(10)))::int as wire from responses")
def request_sizes(spark: SparkSession, sf: str) -> DataFrame:
    r = S.responses(spark, sf)
    total = r.agg(F.sum(F.greatest(F.octet_length("html"), F.lit(1024))).alias("active"))
    wire = F.octet_length(R.wire(F.lit("get"), F.col("url"), F.create_map().cast("map<string,string>"), F.lit(None).cast("string")))
    return r.select("page_id", wire.alias("wire")).join(F.broadcast(total)).select("page_id", "active", "wire")  # one row


@query(None)
def curl_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Command lines made from pages, parsed again."""
    line = F.concat(F.lit("curl -X post -H 'X-Id: "), F.col("page_id"), F.lit("' -b 'a=1; b=2' -d 'k=v' '"), F.col("url"), F.lit("'"))
    p = S.table(spark, sf, "pages").select("page_id", Q.from_curl(line).alias("r"))
    return p.select("page_id", "r.url", "r.method", "r.body", F.col("r.headers")["X-Id"].alias("x_id"), F.col("r.cookies")["b"].alias("cookie_b"), "r.error")


@query("select page_id, coalesce(case when page_id % 3 = 0 then '{\"id\":' || page_id || '}' end, case when page_id % 3 = 1 then 'id=' || page_id end, '') as body from pages")
def request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 3
    body = Q.body(F.when(k == 1, F.concat(F.lit("id="), F.col("page_id"))), F.when(k == 0, F.to_json(F.struct(F.col("page_id").alias("id")))), F.lit(None).cast("string"))
    return S.table(spark, sf, "pages").select("page_id", body.alias("body"))
