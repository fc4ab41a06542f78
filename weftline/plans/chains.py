"""Queries through chains and callbacks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import urls as U
from weftline.operators import chain
from weftline.operators import requests as R
from weftline.plans.registry import HOST, LINKS, RESPONSES, query
from weftline.schemas import dumps, layered, loads, without_nulls
from weftline.sources import tables as S


@query(f"""with {LINKS}, d as (select page_id, pos, url, page_url, page_id % 4 + 1 as depth from outlinks),
k as (select * from d where depth <= 3 and length(url) <= 60 and regexp_matches({HOST.format('url')}, '^(.*\\.)?example\\.(com|net)$'))
select (select max(depth) from d where depth <= 3) as depth_max, (select count(*) from d where depth > 3) as too_deep, (select count(*) from d where depth <= 3 and length(url) > 60) as too_long,
(select count(*) from d where depth <= 3 and length(url) <= 60) - (select count(*) from k) as offsite, (select count(*) from k) as kept, (select sum(-10 * depth) from k)::bigint as priority""")
def spider_output_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Requests through depth, length and offsite filters in that order; a reject has the first rule that it breaks."""
    rows = S.outlinks(spark, sf).withColumns({"fate": F.lit(None).cast("string"), "depth": F.col("page_id") % 4, "priority": F.lit(0)})

    def mark(name, broken):
        return lambda df: df.withColumn("fate", F.coalesce("fate", F.when(broken, F.lit(name))))

    def deeper(df):
        df = df.withColumn("depth", R.child_depth(F.col("depth")))
        return mark("too_deep", ~R.within_depth(F.col("depth"), 3))(df.withColumn("priority", F.col("priority") - F.col("depth") * 10))

    steps = {mark("offsite", ~R.on_site(U.host(F.col("url")), ["example.com", "example.net"])): 500, mark("too_long", ~R.short_enough(F.col("url"), 60)): 800, deeper: 900}
    out = chain.through(rows, chain.ordered(steps), backwards=True)
    count = lambda name: F.count_if(F.col("fate") == name).alias(name)
    kept = F.col("fate").isNull()
    return out.agg(F.max(F.when(~F.coalesce(F.col("fate") == "too_deep", F.lit(False)), F.col("depth"))).alias("depth_max"), count("too_deep"), count("too_long"), count("offsite"), F.count_if(kept).alias("kept"), F.sum(F.when(kept, F.col("priority"))).alias("priority"))


def _callback(page: dict):
    for k, href in enumerate(re.findall('href="([^"]*)"', page["html"])):
        yield "request", {"href": href, "pos": k}
    yield None
    yield "item", {"id": page["page_id"]}
    if page["page_id"] % 50 == 0:
        raise ValueError("planted")


@query(f"""with {LINKS} select 'request' as kind, count(*) as n from outlinks union all select 'item', count(*) from pages union all select 'error', count(*) from pages where page_id % 50 = 0""")
def callback_outputs(spark: SparkSession, sf: str) -> DataFrame:
    made = chain.parse(S.table(spark, sf, "pages"), _callback, ["html"])
    return made.groupBy("kind").agg(F.count("*").alias("n"))


@query("""select page_id, case when page_id % 3 = 0 then 7.0::double end as delay, case when page_id % 3 = 0 then '/go' end as target, case when page_id % 2 = 0 then regexp_extract(url, '^[a-z]+://[^/]*', 0) || '/b/' else url end as base from pages""")
def page_directives(spark: SparkSession, sf: str) -> DataFrame:
    """Refresh and base links, planted into the pages' heads."""
    refresh = F.when(F.col("page_id") % 3 == 0, F.lit('<meta http-equiv="refresh" content="7; url=/go">')).otherwise(F.lit("<script>x='<meta http-equiv=\"refresh\" content=\"9\">'</script>"))
    base = F.when(F.col("page_id") % 2 == 0, F.lit('<base href="/b/">')).otherwise(F.lit(""))
    p = S.table(spark, sf, "pages").select("page_id", "url", F.concat(refresh, base, F.col("html")).alias("html"))
    delay, target = X.meta_refresh(F.col("html"))
    return p.select("page_id", delay.alias("delay"), target.alias("target"), X.base_url(F.col("html"), F.col("url")).alias("base"))


@query("""select c_custkey, 'a=' || c_custkey as first_cookie, 2 as n_set, '7' as b, 'Basic ' || base64(encode(c_name || ':pw')) as auth, replace(c_name, '#', '') as camel, lower(replace(c_name, '#', '_')) as module, '9' as last_digit, 'x' as arg from customer""")
def header_values(spark: SparkSession, sf: str) -> DataFrame:
    c = S.table(spark, sf, "customer")
    header = F.concat(F.lit("a="), F.col("c_custkey"), F.lit("; Path=/, b=7; Domain=e.com"))
    return c.select(
        "c_custkey", X.set_cookies(header)[0].alias("first_cookie"), F.size(X.set_cookies(header)).alias("n_set"), X.cookies(F.lit("a=1; b=7"))["b"].alias("b"), X.basic_auth(F.col("c_name"), F.lit("pw")).alias("auth"),
        X.camel_case(F.col("c_name")).alias("camel"), X.module_name(F.col("c_name")).alias("module"), X.last_match(F.concat(F.col("c_name"), F.lit("x9")), "[0-9]").alias("last_digit"), X.arguments(F.lit("k=x,l=y"))["k"].alias("arg"),
    )


@query(f"with {LINKS} select page_id, pos, url, fp, page_id % 4 + 1 as depth, 'GET' as method from outlinks")
def request_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Requests written as queue payloads and read again; an unknown key is dropped."""
    r = S.outlinks(spark, sf).withColumn("depth", R.child_depth((F.col("page_id") % 4).cast("int")))
    payload = dumps(F.struct("url", "fp", "depth", F.lit("GET").alias("method"), F.lit("x").alias("unknown")))
    return r.select("page_id", F.col("pos").cast("long"), loads(payload).alias("q")).select("page_id", "pos", "q.url", "q.fp", "q.depth", "q.method")


@query("select c_custkey, case when c_custkey % 3 = 0 then 's' when c_custkey % 2 = 0 then 'p' else 'd' end as value, case when c_custkey % 2 = 0 then 2 else 1 end as n from customer")
def settings_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Default, project and spider settings, and a map without its nulls."""
    empty = F.create_map().cast("map<string,string>")
    own = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("k"), F.lit("s"))).otherwise(empty)
    project = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("k"), F.lit("p"))).otherwise(empty)
    merged = layered(F.create_map(F.lit("k"), F.lit("d")), project, own)
    sparse = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2")))
    return S.table(spark, sf, "customer").select("c_custkey", merged["k"].alias("value"), F.size(without_nulls(sparse)).alias("n"))


@query(f"with {RESPONSES}, q as (select page_id, url, page_id % 4 as depth from pages) select r.page_id, r.status, q.depth + 1 as child_depth from responses r join q on r.url = q.url")
def request_response_join(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with what their requests carry."""
    sent = S.table(spark, sf, "pages").select("url", (F.col("page_id") % 4).alias("depth"))
    return S.responses(spark, sf).join(sent, "url").select("page_id", "status", R.child_depth(F.col("depth")).alias("child_depth"))
