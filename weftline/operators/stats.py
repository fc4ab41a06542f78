"""Crawl statistics as a long table of (key, value), and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts(rows: DataFrame, prefix: str, by: str) -> DataFrame:
    """``prefix`` with the total, and ``prefix/value`` with the count of each value, from one rollup."""
    out = rows.rollup(by).agg(F.count("*").alias("value"), F.grouping(by).alias("g"))
    key = F.when(F.col("g") == 1, F.lit(prefix)).otherwise(F.concat_ws("/", F.lit(prefix), F.coalesce(F.col(by).cast("string"), F.lit("none"))))
    return out.select(key.alias("key"), "value")


def gauges(rows: DataFrame, key: Column, value: Column, order: Column) -> DataFrame:
    """Sum, least, greatest and last value of each key."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, order).alias("last"))


def per_minute(ticks: DataFrame, tick: str, value: str, seconds: int) -> DataFrame:
    """The rate of a running count between ticks."""
    before = F.lag(value, 1, 0).over(Window.orderBy(tick))
    return ticks.withColumn("rate", (F.col(value) - before) * 60.0 / seconds)


def deltas(samples: DataFrame, metric: str, tick: str, value: str) -> DataFrame:
    """Changes since the metric's last sample; those of zero are left out."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(metric).orderBy(tick))
    return samples.withColumn("delta", F.col(value) - before).where("delta <> 0")


def line_protocol(measurement: Column, spider: Column, location: Column, value: Column, nanos: Column) -> Column:
    return F.concat(F.translate(measurement, "/", "-"), F.lit(",spider_name="), spider, F.lit(",location="), location, F.lit(" value="), value.cast("string"), F.lit(" "), nanos.cast("string"))


def request_sizes(requests: DataFrame, method: str, wire: Column) -> DataFrame:
    """(key, value): requests, requests by method, and their bytes."""
    n = counts(requests, "downloader/request_count", method)
    size = requests.agg(F.lit("downloader/request_bytes").alias("key"), F.coalesce(F.sum(F.octet_length(wire)), F.lit(0)).alias("value"))
    return n.unionByName(size)


def core(log: DataFrame, item: Column, response: Column, reason: str = "finished", at: str = "at") -> DataFrame:
    """Start, finish and duration of a run in microseconds, why it ended, and how many items and responses it gave."""
    return log.agg(F.min(at).alias("start"), F.max(at).alias("finish"), (F.max(at) - F.min(at)).alias("elapsed"), F.lit(reason).alias("finish_reason"), F.count_if(item).alias("item_scraped_count"), F.count_if(response).alias("response_received_count"))


def live(records: DataFrame, kind: str, at: str, alive: Column) -> DataFrame:
    """(kind, n, oldest): the objects of each kind that are still held and the age of the oldest."""
    return records.where(alive).groupBy(kind).agg(F.count("*").alias("n"), F.min(at).alias("oldest"))


def duplicates(spiders: DataFrame, name: str = "name", module: str = "module") -> DataFrame:
    """Names that more than one class bears, with the modules that these are in."""
    return spiders.groupBy(name).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(module)).alias("modules")).where("n > 1")


def persist(stats: DataFrame, path: str) -> None:
    """The statistics of a run, as they stand when it closes."""
    stats.select(F.col("key").cast("string"), F.col("value").cast("double")).coalesce(1).write.mode("overwrite").parquet(path)


def log_lines(samples: DataFrame, spider: str) -> Column:
    """One line a change of a metric."""
    return F.format_string(f"<{spider}> %s: %s", "metric", F.col("delta").cast("string"))
