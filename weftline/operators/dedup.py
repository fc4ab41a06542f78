"""Request dedup: exact, against a seen table, with failures taken back, and by a Bloom bitmap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import urls as U


def first_seen(requests: DataFrame, order: list[str], key: str = "fp") -> DataFrame:
    """The first request of each fingerprint. An aggregate, combined before the shuffle, so a hot fingerprint is one row a task."""
    columns = requests.columns
    first = requests.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"))
    return first.select("r.*")


def unseen(requests: DataFrame, seen: DataFrame, order: list[str], key: str = "fp") -> DataFrame:
    """First requests of fingerprints that the seen table lacks."""
    return first_seen(requests, order, key).join(seen.select(key), key, "left_anti")


def admit(requests: DataFrame, seen: DataFrame, order: list[str], key: str = "fp") -> DataFrame:
    """``unseen``, past which unfiltered and redelivered requests go."""
    free = F.coalesce("dont_filter", F.lit(False)) | F.coalesce("redelivered", F.lit(False))
    return unseen(requests.where(~free), seen, order, key).unionByName(requests.where(free))


def after_failures(marked: DataFrame, outcomes: DataFrame, key: str = "fp") -> DataFrame:
    """Marks without those whose last outcome is a failure of the request or of the parse, so these may come again."""
    last = outcomes.groupBy(key).agg(F.max_by("outcome", "seq").alias("outcome"))
    return marked.join(last.where("outcome in ('request_err', 'parse_err')"), key, "left_anti")


def extend(seen: DataFrame, new: DataFrame, key: str = "fp") -> DataFrame:
    return seen.select(key).union(new.select(key)).distinct()


def bloom_bits(keys: DataFrame, bits: int, k: int, compat: bool = True, key: str = "fp") -> DataFrame:
    """The set bits of a Bloom filter over the keys, as a table."""
    return keys.select(F.explode(U.bloom_offsets(F.col(key), bits, k, compat)).alias("bit")).distinct()


def bloom_seen(requests: DataFrame, set_bits: DataFrame, bits: int, k: int, compat: bool = True, key: str = "fp") -> DataFrame:
    """(key, seen): whether all of a key's bits are set. Bits are joined, not broadcast, so the bitmap may be of any size."""
    asked = requests.select(key).distinct().select(key, F.explode(F.array_distinct(U.bloom_offsets(F.col(key), bits, k, compat))).alias("bit"))
    hits = asked.join(set_bits.withColumn("hit", F.lit(1)), "bit", "left")
    return hits.groupBy(key).agg((F.count("hit") == F.count("*")).alias("seen"))


def outcomes_of_tests(events: DataFrame, committed: DataFrame | None = None, ttl: int = 180_000_000, key: str = "fp", at: str = "at", seq: str = "seq") -> DataFrame:
    """Each test of (key, kind, at, seq) with ``verdict``: 'seen' for what is committed, 'in flight' for what an earlier test holds, else 'new'.

    Kinds: test, request_ok, request_err, parse_ok. A test puts its key among those in flight; an ok or an error of the request takes it out,
    and parse_ok commits it. The keys in flight go together once no test has come for ``ttl`` microseconds, as one limit holds for all of them and each
    test renews it. ``committed``: keys of earlier runs.
    """
    ticks = events.where("kind = 'test'").select(F.floor(F.col(at) / 1_000_000).alias("s"), at).groupBy("s").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    by_time = Window.partitionBy(F.lit(0)).orderBy("s")  # one row a second that has tests
    ticks = ticks.withColumn("gap", (F.col("first") - F.lag("last").over(by_time) > ttl).cast("int"))
    spans = ticks.withColumn("epoch", F.coalesce(F.sum("gap").over(by_time), F.lit(0))).select(F.col("s").alias("_s"), F.col("epoch").alias("_epoch"))
    rows = events.withColumn("_s", F.floor(F.col(at) / 1_000_000)).join(spans, "_s", "left")
    before = Window.partitionBy(key).orderBy(at, seq).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("kind") == "test", F.col("_epoch")).when(F.col("kind").isin("request_ok", "request_err"), F.lit(-1))
    rows = rows.withColumns({"_held": F.last(mark, True).over(before), "_done": F.max(F.col("kind") == "parse_ok").over(before)})
    if committed is not None:
        rows = rows.join(committed.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    known = F.coalesce("_done", F.lit(False)) | (F.coalesce("_known", F.lit(False)) if committed is not None else F.lit(False))
    verdict = F.when(known, "seen").when(F.col("_held") == F.col("_epoch"), "in flight").otherwise("new")
    return rows.where("kind = 'test'").select(*events.columns, verdict.alias("verdict"))


def filtered(requests: DataFrame, kept: DataFrame) -> DataFrame:
    """(key, value): how many requests the filter took out."""
    n = requests.agg(F.count("*").alias("a")).join(kept.agg(F.count("*").alias("b")))  # one row each
    return n.select(F.lit("dupefilter/filtered").alias("key"), (F.col("a") - F.col("b")).alias("value"))
