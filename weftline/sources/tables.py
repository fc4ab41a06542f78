"""Crawl records drawn from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import urls as U


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seeds(spark: SparkSession, start_urls: list[str]) -> DataFrame:
    """One GET request a start URL."""
    if not start_urls:
        raise ValueError("no start_urls")
    return spark.createDataFrame([(u, "GET", 0, 0, False) for u in start_urls], "url string, method string, priority int, depth int, dont_filter boolean")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pages as responses, with a status that follows from the id."""
    k = F.col("page_id") % 10
    status = F.when(k == 7, 404).when(k == 8, 503).when(k == 9, 301).otherwise(200)
    return table(spark, folder, "pages").withColumn("status", status)


def outlinks(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, pos, page_url, href, url, fp): every link of every page, absolute, with its request's fingerprint."""
    pages = table(spark, folder, "pages")
    links = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    url = U.canonical(U.join_absolute(F.col("page_url"), U.quote(F.col("href"))))
    return links.withColumn("url", url).withColumn("fp", U.fingerprint(F.col("url")))


def download_log(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, slot, at, ok, error_class, latency, kind) from events; ``at`` in microseconds."""
    e = table(spark, folder, "events")
    ok = F.col("event_type") != "error"
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("slot"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("ts"), ok.alias("ok"), F.when(~ok, F.concat(F.lit("E"), F.col("user_id") % 3)).alias("error_class"), (F.col("value") / 100).alias("latency"), F.col("event_type").alias("kind"), "props")


def frontier(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, priority, task_id): orders as queued requests."""
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), (6 - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("priority"), F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("task_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("queued"))


def seen_file(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("fp")).where("fp <> ''").distinct()


def jdbc(spark: SparkSession, url: str, query: str, driver: str | None = None, **options: str) -> DataFrame:
    """A database query's rows."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query).options(**options)
    return (reader.option("driver", driver) if driver else reader).load()


def proxies(pool: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Up to ``k`` proxies of score 100, or, where there are none, of any score; chosen by a seeded hash."""
    best = pool.where("score = 100")
    usable = pool.where("score between 0 and 100").join(best.limit(1).select(F.lit(1).alias("_top")), how="left")
    tier = usable.where("_top is null or score = 100").drop("_top")
    return tier.orderBy(F.xxhash64("proxy", F.lit(seed)), "proxy").limit(k)
