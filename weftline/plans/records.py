"""Statistics, item and extraction queries, and streams over stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import html as X
from weftline.functions import urls as U
from weftline.operators import items as I
from weftline.operators import stats as A
from weftline.plans.registry import HOST, LINKS, LOG, RESPONSES, query
from weftline.sources import tables as S
from weftline.streaming import state as T


def _counts(table: str, prefix: str, by: str, where: str = "true", cte: str = "") -> str:
    return f"{cte} select '{prefix}' as key, count(*) as value from {table} where {where} union all select '{prefix}/' || coalesce({by}::varchar, 'none'), count(*) from {table} where {where} group by {by}"


@query(_counts("responses", "downloader/response_status_count", "status", cte=f"with {RESPONSES}"))
def stats_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return A.counts(S.responses(spark, sf), "downloader/response_status_count", "status")


@query(_counts("log", "downloader/request_count", "kind", cte=f"with {LOG}"))
def stats_by_method(spark: SparkSession, sf: str) -> DataFrame:
    return A.counts(S.download_log(spark, sf), "downloader/request_count", "kind")


@query(_counts("log", "downloader/exception_count", "error_class", "not ok", f"with {LOG}"))
def stats_by_error(spark: SparkSession, sf: str) -> DataFrame:
    return A.counts(S.download_log(spark, sf).where("not ok"), "downloader/exception_count", "error_class")


@query(_counts("(select *, case when status = 404 then 'not found' when status >= 500 then 'server' end as reason from responses)", "item_dropped", "reason", "status >= 400", f"with {RESPONSES}"))
def stats_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    _, dropped = I.rejects(S.responses(spark, sf), {"not found": F.col("status") == 404, "server": F.col("status") >= 500})
    return A.counts(dropped, "item_dropped", "reason")


@query(_counts("(select case o_orderstatus when 'O' then 'enqueued' when 'F' then 'acked' else 'reserved' end as t from orders)", "scheduler", "t"))
def stats_by_transition(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.col("state") == "O", "enqueued").when(F.col("state") == "F", "acked").otherwise("reserved")
    return A.counts(S.frontier(spark, sf).select(t.alias("t")), "scheduler", "t")


@query(f"with {LOG} select epoch_us(min(ts)) as start, epoch_us(max(ts)) as finish, epoch_us(max(ts)) - epoch_us(min(ts)) as elapsed, 'finished' as finish_reason, count_if(kind = 'purchase') as item_scraped_count, count_if(ok) as response_received_count from log")
def stats_core(spark: SparkSession, sf: str) -> DataFrame:
    log = S.download_log(spark, sf)
    return A.core(log, F.col("kind") == "purchase", F.col("ok"))


@query(f"with {LOG} select kind as key, count(*) as n, min(latency) as least, max(latency) as most, max_by(latency, r) as last from (select *, row_number() over (order by at_us, seq) as r from log) group by 1")
def stats_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return A.gauges(S.download_log(spark, sf), F.col("kind"), F.col("latency"), F.struct("at", "seq"))


@query(f"with {RESPONSES} select status, count(*) as n, sum(octet_length(encode(html)))::bigint as bytes from responses group by 1")
def response_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return S.responses(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))


@query(f"with {LOG}, t as (select epoch_us(date_trunc('hour', ts)) as tick, count(*) as n from log group by 1), c as (select tick, sum(n) over (order by tick) as total from t) select tick, total::bigint as total, ((total - lag(total, 1, 0) over (order by tick)) * 60.0 / 3600)::double as rate from c")
def stats_rates_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    log = S.download_log(spark, sf)
    ticks = log.groupBy((F.col("at") - F.pmod("at", F.lit(3_600_000_000))).alias("tick")).agg(F.count("*").alias("n"))
    running = ticks.select("tick", F.sum("n").over(Window.orderBy("tick")).alias("total"))  # one row a tick
    return A.per_minute(running, "tick", "total", 3600)


DELTAS = f"{LOG}, t as (select kind, epoch_us(date_trunc('day', ts)) as tick, count(*) // 10 as v from log group by 1, 2), d as (select kind, tick, v - lag(v, 1, 0) over (partition by kind order by tick) as delta from t)"


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    log = S.download_log(spark, sf)
    t = log.groupBy("kind", (F.col("at") - F.pmod("at", F.lit(86_400_000_000))).alias("tick")).agg(F.expr("count(*) div 10").alias("v"))
    return A.deltas(t, "kind", "tick", "v")


@query(f"with {DELTAS} select kind, tick, delta from d where delta <> 0")
def metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return _deltas(spark, sf).select("kind", "tick", "delta")


@query(f"with {DELTAS} select 'log-' || kind || ',spider_name=s,location=l value=' || delta || ' ' || (tick * 1000) as line from d where delta <> 0")
def line_protocol(spark: SparkSession, sf: str) -> DataFrame:
    d = _deltas(spark, sf)
    return d.select(A.line_protocol(F.concat(F.lit("log/"), F.col("kind")), F.lit("s"), F.lit("l"), F.col("delta"), F.col("tick") * 1000).alias("line"))


@query(f"with {RESPONSES} select page_id, format('Crawled ({{}}) <GET {{}}> (referer: None)', status, url) as line from responses")
def crawl_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.responses(spark, sf).select("page_id", F.format_string("Crawled (%d) <GET %s> (referer: None)", "status", "url").alias("line"))


@query("with q as (select unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) as p from pages) select split_part(p, '=', 1) as name, count(*) as n from q where p <> '' group by 1")
def param_counts(spark: SparkSession, sf: str) -> DataFrame:
    q = S.table(spark, sf, "pages").select(F.explode(F.split(U.query(F.col("url")), "&")).alias("p")).where("p <> ''")
    return q.groupBy(F.split_part("p", F.lit("="), F.lit(1)).alias("name")).agg(F.count("*").alias("n"))


@query(f"with h as (select distinct {HOST.format('url')} as module from pages) select split_part(module, '.', -1) as name, count(*) as n, array_to_string(list_sort(list(module)), ' ') as modules from h group by 1 having count(*) > 1")
def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    """Spiders, one a host, that are named by their top-level domain."""
    hosts = S.table(spark, sf, "pages").select(U.host(F.col("url")).alias("module")).distinct()
    spiders = hosts.withColumn("name", F.element_at(F.split("module", r"\."), -1))
    return A.duplicates(spiders).select("name", "n", F.array_join("modules", " ").alias("modules"))


ITEMS = "base as (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_extendedprice) as l_extendedprice from lineitem where l_linestatus = 'F' group by 1, 2), batch as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem where l_linestatus = 'O')"


def _items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = S.table(spark, sf, "lineitem")
    rows = lambda status: lines.where(F.col("l_linestatus") == status).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    base = rows("F").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"))
    return base, rows("O")


KEYS, ORDER = ["l_orderkey", "l_linenumber"], ["l_extendedprice", "l_quantity"]


@query(f"with {ITEMS} select * from base union all select * from batch")
def item_append(spark: SparkSession, sf: str) -> DataFrame:
    return I.insert(*_items(spark, sf))


@query(f"with {ITEMS} select * from base union all (select * from batch where (l_orderkey, l_linenumber) not in (select (l_orderkey, l_linenumber) from base) qualify row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice, l_quantity) = 1)")
def item_ignore_insert(spark: SparkSession, sf: str) -> DataFrame:
    return I.ignore_insert(*_items(spark, sf), KEYS, ORDER)


@query(f"""with {ITEMS}, n as (select * from batch qualify row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice desc, l_quantity desc) = 1)
select coalesce(b.l_orderkey, n.l_orderkey) as l_orderkey, coalesce(b.l_linenumber, n.l_linenumber) as l_linenumber, coalesce(b.l_quantity, n.l_quantity) as l_quantity, coalesce(n.l_extendedprice, b.l_extendedprice) as l_extendedprice
from base b full join n on b.l_orderkey = n.l_orderkey and b.l_linenumber = n.l_linenumber""")
def item_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return I.update_insert(*_items(spark, sf), KEYS, ORDER, fields=["l_extendedprice"])


@query("with r as (select doc_id, case doc_id % 4 when 0 then ['a', 'b'] when 1 then ['a'] when 2 then ['b'] end as aliases from documents) select alias, count(*) as n from (select unnest(aliases) as alias from r) group by 1")
def item_route_fanout(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    route = F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("a"))).when(k == 2, F.array(F.lit("b")))
    docs = I.stored(S.table(spark, sf, "documents").select("doc_id", route.alias("route")))
    return I.fan_out(docs, F.col("route")).groupBy("alias").agg(F.count("*").alias("n"))


@query("select doc_id, case when n_chars < 100 then 'short' when lang <> 'en' then 'language' end as reason from documents where n_chars < 100 or lang <> 'en'")
def item_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return I.rejects(S.table(spark, sf, "documents"), {"short": F.col("n_chars") < 100, "language": F.col("lang") != "en"})[1].select("doc_id", "reason")


@query("select case when doc_id % 2 = 0 then ['ab', 'c'] else ['a', 'bc'] end as fields, lang as alias, count(*) as n from documents group by 1, 2")
def item_statement_groups(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("ab"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("bc")))
    d = S.table(spark, sf, "documents").select(fields.alias("fields"), F.array().cast("array<string>").alias("update_fields"), F.col("lang").alias("alias"), F.lit("insert").alias("mode"), F.lit("t").alias("table_name"), F.lit("").alias("on_conflict"))
    return I.statement_groups(d).select("fields", "alias", "n")


@query("select page_id, 0 as pos, unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)) as raw from pages")
def html_title_raw(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<title>([^<]*)</title>"), F.lit(1))).alias("raw"))
    return p.select("page_id", F.lit(0).alias("pos"), "raw")


@query("select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as value, (generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) - 1)::int as pos from pages")
def css_links(spark: SparkSession, sf: str) -> DataFrame:
    return X.select(S.table(spark, sf, "pages"), {"links": "nav ul li > a, a[href]::attr(href)"}).select("page_id", "value", "pos")


@query("select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as value, (generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) - 1)::int as pos from pages")
def xpath_links(spark: SparkSession, sf: str) -> DataFrame:
    return X.select(S.table(spark, sf, "pages"), {"links": "//a/@href"}).select("page_id", "value", "pos")


@query(None)
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return X.texts(S.table(spark, sf, "pages"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select epoch_us(time_bucket(interval '1 hour', ts)) as start, event_type as kind, count(*) as n from events group by 1, 2")
def stream_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling counts of a stream over the stored events, run to its end."""
    events = S.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))
    out = T.rates(stream, width="1 hour", by="kind")
    name = f"rates_{abs(hash(sf)) % 10**8}"
    return T.collect(out, name, T.scratch(spark, "stream"), "complete").select(F.unix_micros("start").alias("start"), "kind", "n")


@query("select event_type as fp from events group by 1")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of a stream over the stored events, each once."""
    events = S.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("fp"))
    return T.collect(T.dedup(stream, keep="60 days"), f"dedup_{abs(hash(sf)) % 10**8}", T.scratch(spark, "stream")).select("fp")
