"""Dedup, frontier and pacing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.operators import crawl, dedup
from weftline.operators import schedule as H
from weftline.plans.registry import FRONTIER, LINKS, LOG, query
from weftline.sources import tables as S

MASK = (1 << 16) - 1
OFFSETS = "list_transform([1, 2, 3, 4, 5, 6], lambda k: list_reduce(list_transform(string_split(fp, ''), lambda c: ascii(c)::bigint), lambda a, b: (k * a + b) & {0}, 0::bigint))"
REQUESTS = "(page_id * 1000 + pos)"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return S.outlinks(spark, sf).select("page_id", F.col("pos").cast("long"), "url", "fp").withColumn("seq", F.col("page_id") * 1000 + F.col("pos"))


@query(f"with {LINKS} select page_id, pos, url, fp from outlinks qualify row_number() over (partition by fp order by page_id, pos) = 1")
def outlinks_dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_seen(_requests(spark, sf), ["page_id", "pos"]).select("page_id", "pos", "url", "fp")


@query(f"with {LINKS} select page_id, pos, url, fp from outlinks where fp not in (select fp from outlinks where page_id % 4 = 0) qualify row_number() over (partition by fp order by page_id, pos) = 1")
def dedup_against_seen(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf)
    return dedup.unseen(r, r.where("page_id % 4 = 0").select("fp").distinct(), ["page_id", "pos"]).select("page_id", "pos", "url", "fp")


@query(f"""with {LINKS}, f as (select *, page_id % 7 = 0 or page_id % 11 = 0 as free from outlinks)
select page_id, pos, fp from f where free union all select page_id, pos, fp from (select * from f where not free and fp not in (select fp from outlinks where page_id % 4 = 0) qualify row_number() over (partition by fp order by page_id, pos) = 1)""")
def dedup_dont_filter_bypass(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf).withColumns({"dont_filter": F.col("page_id") % 7 == 0, "redelivered": F.col("page_id") % 11 == 0})
    return dedup.admit(r, r.where("page_id % 4 = 0").select("fp").distinct(), ["page_id", "pos"]).select("page_id", "pos", "fp")


@query(f"""with {LOG}, last as (select slot, ok from log qualify row_number() over (partition by slot order by at_us desc, seq desc) = 1) select slot from last where ok""")
def dedup_ex_failures(spark: SparkSession, sf: str) -> DataFrame:
    log = S.download_log(spark, sf)
    outcomes = log.select("slot", F.struct("at", "seq").alias("seq"), F.when(F.col("ok"), "parse_ok").otherwise("request_err").alias("outcome"))
    return dedup.after_failures(log.select("slot").distinct(), outcomes, key="slot")


@query(f"with {LINKS}, s as (select fp from outlinks where page_id % 4 = 0), n as (select fp from outlinks where page_id % 4 <> 0) select count(*) as marks from (select fp from s union select fp from n)")
def seen_union(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf)
    return dedup.extend(r.where("page_id % 4 = 0"), r.where("page_id % 4 <> 0")).agg(F.count("*").alias("marks"))


@query(f"with {LINKS}, p as (select page_id, sha1(url) as fp from pages), o as (select page_id, {OFFSETS.format((1 << 30) - 1)} as h from p) select page_id, unnest([0, 1, 2, 3, 4, 5])::int as k, unnest(h) as bit from o")
def bloom_offsets(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "pages").select("page_id", F.sha1(F.col("url").cast("binary")).alias("fp"))
    return p.select("page_id", F.posexplode(U.bloom_offsets(F.col("fp"))).alias("k", "bit"))


@query(f"""with {LINKS}, u as (select distinct fp from outlinks), o as (select fp, {OFFSETS.format(MASK)} as h from u), m as (select distinct unnest(h) as bit from o where fp in (select fp from outlinks where page_id % 4 = 0)),
q as (select fp, unnest(list_distinct(h)) as bit from o) select q.fp, count(m.bit) = count(*) as seen from q left join m using (bit) group by 1""")
def bloom_seen(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf).select("page_id", "fp")
    bits = dedup.bloom_bits(r.where("page_id % 4 = 0"), 16, 6)
    return dedup.bloom_seen(r, bits, 16, 6)


@query(f"with {FRONTIER} select seq, priority from frontier order by priority desc, seq limit 16")
def frontier_priority_topk(spark: SparkSession, sf: str) -> DataFrame:
    return H.reserve(S.frontier(spark, sf).select("seq", "priority"), 16)


@query(f"with {FRONTIER} select seq from frontier order by seq limit 16")
def frontier_fifo(spark: SparkSession, sf: str) -> DataFrame:
    return H.reserve(S.frontier(spark, sf).select("seq"), 16, "fifo")


@query(f"with {FRONTIER} select seq from frontier order by seq desc limit 16")
def frontier_lifo(spark: SparkSession, sf: str) -> DataFrame:
    return H.reserve(S.frontier(spark, sf).select("seq"), 16, "lifo")


@query(f"with {FRONTIER} select seq, priority, seq % 50 = 0 as redelivered from frontier order by seq % 50 = 0 desc, priority desc, seq limit 64")
def frontier_requeued_first(spark: SparkSession, sf: str) -> DataFrame:
    return H.reserve(S.frontier(spark, sf).select("seq", "priority", (F.col("seq") % 50 == 0).alias("redelivered")), 64)


@query(f"with {FRONTIER} select state, count(*) as n from frontier where state in ('O', 'P') group by 1")
def queue_length(spark: SparkSession, sf: str) -> DataFrame:
    return S.frontier(spark, sf).where("state in ('O', 'P')").groupBy("state").agg(F.count("*").alias("n"))


@query(f"with {FRONTIER} select count(*) as pushed from frontier where state <> 'F' and task_id not in (select task_id from frontier where state = 'F' or seq % 3 = 0)")
def idempotent_push(spark: SparkSession, sf: str) -> DataFrame:
    q = S.frontier(spark, sf)
    new = q.where("state <> 'F'").select("seq", "task_id")
    return H.push(q.where("state = 'F' or seq % 3 = 0"), new.union(new)).agg(F.count("*").alias("pushed"))


LEASES = "leases as (select task_id, 't' || (seq % 7) as token, epoch_us(queued) // 1000000 + 600 as deadline, seq from frontier where state = 'P')"


def _leases(spark: SparkSession, sf: str) -> DataFrame:
    q = S.frontier(spark, sf).where("state = 'P'")
    return q.select("task_id", F.concat(F.lit("t"), F.col("seq") % 7).alias("token"), (F.unix_seconds(F.col("queued").cast("timestamp")) + 600).alias("deadline"), "seq")


@query(f"with {FRONTIER}, {LEASES} select task_id, token, deadline, true as redelivered from leases where deadline <= 820454400 and seq % 4 <> 0 order by deadline, task_id limit 100")
def lease_expiry_redelivery(spark: SparkSession, sf: str) -> DataFrame:
    leases = _leases(spark, sf)
    payload = leases.where("seq % 4 <> 0").select("task_id")
    return H.recover(leases.select("task_id", "token", "deadline"), payload, F.lit(820454400), 100)


@query(f"with {FRONTIER}, {LEASES}, acks as (select task_id, 't' || (seq % 7 + case when seq % 3 = 0 then 1 else 0 end) as token from leases where seq % 2 = 0) select l.task_id, l.token from leases l left join acks a on l.task_id = a.task_id and l.token = a.token where a.task_id is null")
def ack_fencing(spark: SparkSession, sf: str) -> DataFrame:
    leases = _leases(spark, sf)
    late = F.when(F.col("seq") % 3 == 0, 1).otherwise(0)
    acks = leases.where("seq % 2 = 0").select("task_id", F.concat(F.lit("t"), F.col("seq") % 7 + late).alias("token"))
    return H.acknowledge(leases, acks)[0].select("task_id", "token")


@query(f"with {FRONTIER}, {LEASES}, p as (select task_id from leases where seq % 4 <> 0) select l.task_id, l.token from leases l join p using (task_id)")
def lease_payload_join(spark: SparkSession, sf: str) -> DataFrame:
    leases = _leases(spark, sf)
    return H.payloads(leases, leases.where("seq % 4 <> 0").select("task_id")).select("task_id", "token")


@query(f"with {LOG} select seq, slot, (row_number() over (partition by slot order by at_us, seq) - 1) // 8 as wave from log")
def slot_concurrency_waves(spark: SparkSession, sf: str) -> DataFrame:
    return H.waves(S.download_log(spark, sf), 8, ["at", "seq"]).select("seq", "slot", "wave")


@query(f"""with {LOG}, i as (select seq, slot, at_us, row_number() over (partition by slot order by at_us, seq) as i from log)
select seq, slot, i * 14400000000 + max(at_us - i * 14400000000) over (partition by slot order by i rows unbounded preceding) as start from i""")
def slot_pacing(spark: SparkSession, sf: str) -> DataFrame:
    return H.paced(S.download_log(spark, sf), 14_400_000_000, ["at", "seq"]).select("seq", "slot", "start")


@query(f"""with recursive {LOG}, r as (select slot, row_number() over (partition by slot order by at_us, seq) as i, latency, case when ok then 200 else 500 end as status from log),
f as (select slot, 0::bigint as i, 5.0::double as delay from (select distinct slot from r)
union all select r.slot, r.i, round(case when r.status <> 200 and least(greatest(greatest(r.latency, (f.delay + r.latency) / 2), 0), 60) <= f.delay then f.delay else least(greatest(greatest(r.latency, (f.delay + r.latency) / 2), 0), 60) end, 6) from f join r on r.slot = f.slot and r.i = f.i + 1)
select slot, max_by(delay, i) as delay, max(i)::int as n from f group by 1""")
def autothrottle_delay(spark: SparkSession, sf: str) -> DataFrame:
    log = S.download_log(spark, sf).withColumn("status", F.when(F.col("ok"), 200).otherwise(500))
    return H.throttled(log)


@query(f"with {LOG} select seq from log order by at_us, seq limit 500")
def close_on_itemcount(spark: SparkSession, sf: str) -> DataFrame:
    return H.until(S.download_log(spark, sf), 500, ["at", "seq"]).select("seq")


@query(f"with {LOG} select seq, slot, row_number() over (partition by slot order by at_us, seq)::int as attempt from log where not ok")
def retry_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return H.attempts(S.download_log(spark, sf).where("not ok"), "slot", ["at", "seq"]).select("seq", "slot", "attempt")


EDGES = f"edges as (select page_id as src, (page_id * 31 + pos * 17 + 1) % (select count(*) from pages) as dst from outlinks)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    n = S.table(spark, sf, "pages").agg(F.count("*").alias("n"))  # one row
    return S.outlinks(spark, sf).join(F.broadcast(n)).select(F.col("page_id").alias("src"), ((F.col("page_id") * 31 + F.col("pos") * 17 + 1) % F.col("n")).alias("dst"))


@query(f"with recursive {LINKS}, {EDGES}, walk as (select 0::bigint as node, 0 as depth union select e.dst, w.depth + 1 from walk w join edges e on e.src = w.node where w.depth < 3) select node, min(depth)::int as depth from walk group by 1")
def depth_crawl(spark: SparkSession, sf: str) -> DataFrame:
    roots = spark.createDataFrame([(0,)], "node long")
    return crawl.depths(_edges(spark, sf), roots, 3)


@query(f"with recursive {LINKS}, {EDGES}, walk as (select 0::bigint as node, 0 as depth union select e.dst, w.depth + 1 from walk w join edges e on e.src = w.node where w.depth < 3), d as (select node, min(depth)::int as depth from walk group by 1) select depth, count(*) as n from d group by 1")
def depth_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return depth_crawl(spark, sf).groupBy("depth").agg(F.count("*").alias("n"))
