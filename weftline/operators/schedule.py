"""The frontier: order, leases, and the pace at which slots are served.

Ranks and running values of a slot are taken within chunks of its time and joined with those of the chunks before, so that a slot which
holds most requests is never one task's.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reserve(queue: DataFrame, k: int, policy: str = "priority", requeued: str = "front") -> DataFrame:
    """The next ``k`` entries: of highest priority and then oldest, oldest, or newest. Redelivered ones come first, or last where
    ``requeued`` is 'back', as in a queue that holds its entries in memory."""
    by = {"priority": [F.desc("priority"), F.asc("seq")], "fifo": [F.asc("seq")], "lifo": [F.desc("seq")]}[policy]
    front = [] if "redelivered" not in queue.columns else [F.desc("redelivered") if requeued == "front" else F.asc("redelivered")]
    return queue.orderBy(*front, *by).limit(k)


def push(queue: DataFrame, new: DataFrame, key: str = "task_id") -> DataFrame:
    """Entries of ``new`` whose task is not queued yet, each task once."""
    return new.dropDuplicates([key]).join(queue.select(key), key, "left_anti")


def recover(leases: DataFrame, payload: DataFrame, now: Column, limit: int) -> DataFrame:
    """Expired leases that still have a payload, oldest deadline first, marked as redelivered."""
    expired = leases.where(F.col("deadline") <= now).join(payload.select("task_id"), "task_id", "left_semi")
    return expired.orderBy("deadline", "task_id").limit(limit).withColumn("redelivered", F.lit(True))


def acknowledge(leases: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leases left, acks that count): an ack counts if its token is the lease's, so a late one removes nothing."""
    pairs = acks.select("task_id", "token").distinct()
    return leases.join(pairs, ["task_id", "token"], "left_anti"), pairs.join(leases.select("task_id", "token"), ["task_id", "token"], "left_semi")


def payloads(leases: DataFrame, payload: DataFrame) -> DataFrame:
    """Leases with what they are for; those whose payload is gone fall out."""
    return leases.join(payload, "task_id")


def settled(leases: DataFrame, acks: DataFrame) -> DataFrame:
    """(transition, n): acks that count and those that come too late, each ack counted."""
    held = leases.select("task_id", "token", F.lit(True).alias("held"))
    marked = acks.select("task_id", "token").join(held, ["task_id", "token"], "left")
    return marked.groupBy(F.when(F.col("held"), "acked").otherwise("stale").alias("transition")).agg(F.count("*").alias("n"))


def flush_groups(rows: DataFrame, size: int, seconds: int, at: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows with ``flush_at`` and ``flush``: within each tick of ``seconds`` of each key, every ``size`` rows are one batch. ``at``: microseconds."""
    tick = F.floor(F.col(at) / (seconds * 1_000_000)).cast("long")
    ticked = rows.withColumn("flush_at", tick)
    rank = F.row_number().over(Window.partitionBy(*(keys or []), "flush_at").orderBy(*order))
    return ticked.withColumn("flush", F.floor((rank - 1) / size).cast("long"))


def transitions(pushed: DataFrame, rejected: DataFrame, reserved: DataFrame, recovered: DataFrame, settled_acks: DataFrame, requeued: DataFrame) -> DataFrame:
    """(key, value): the scheduler's counters from the outcomes of its operations."""
    named = {"enqueued": pushed, "rejected": rejected, "reserved": reserved, "redelivered": recovered, "requeued": requeued}
    parts = [df.agg(F.lit(f"scheduler/{name}").alias("key"), F.count("*").alias("value")) for name, df in named.items()]
    acks = settled_acks.select(F.concat(F.lit("scheduler/"), F.col("transition")).alias("key"), F.col("n").alias("value"))
    return functools.reduce(DataFrame.unionByName, [*parts, acks]).where("value > 0")


def flushed(queue: DataFrame, on_start: bool) -> DataFrame:
    """The queue that a start finds: empty if it is to be flushed."""
    return queue.limit(0) if on_start else queue


HOUR = 3_600_000_000


def ranked(rows: DataFrame, key: str, order: list[str], name: str, at: str = "at", chunk: int = HOUR) -> DataFrame:
    """Rows with their rank, from 1, within ``key`` by ``order``, of which ``at`` is the first column."""
    cut = rows.withColumn("_chunk", F.floor(F.col(at) / chunk).cast("long"))
    sizes = cut.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    sizes = sizes.select(key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order))
    return cut.withColumn("_r", local).join(sizes, [key, "_chunk"]).withColumn(name, F.col("_base") + F.col("_r")).drop("_chunk", "_r", "_base")


def waves(requests: DataFrame, per_slot: int, order: list[str], slot: str = "slot") -> DataFrame:
    """The wave in which each request goes, ``per_slot`` of a slot at a time."""
    return ranked(requests, slot, order, "_rank", order[0]).withColumn("wave", F.floor((F.col("_rank") - 1) / per_slot).cast("long")).drop("_rank")


def jitter(delay: int, seed: Column) -> Column:
    """A delay between a half and one and a half times ``delay``, the same for the same whole number ``seed``."""
    return F.floor((F.lit(delay) * (F.lit(500) + F.pmod(seed * 7919, F.lit(1001)))) / 1000).cast("long")


def paced(requests: DataFrame, delay: int | Column, order: list[str], slot: str = "slot", arrival: str = "at", chunk: int = HOUR) -> DataFrame:
    """Start times ``s[i] = max(a[i], s[i-1] + d[i])`` of each slot, in closed form ``D[i] + max over j<=i of (a[j] - D[j])``, where ``D`` sums
    the delays. Sum and maximum are taken within chunks, and those of the chunks before are joined in."""
    own = delay if isinstance(delay, Column) else F.lit(delay)
    cut = requests.withColumns({"_d": own, "_chunk": F.floor(F.col(arrival) / chunk).cast("long")})
    inside = Window.partitionBy(slot, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_sum", F.sum("_d").over(inside)).withColumn("_ahead", F.max(F.col(arrival) - F.col("_sum")).over(inside))
    parts = local.groupBy(slot, "_chunk").agg(F.max("_sum").alias("_all"), F.max("_ahead").alias("_most"))
    before = Window.partitionBy(slot).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    parts = parts.withColumn("_base", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    parts = parts.withColumn("_past", F.max(F.col("_most") - F.col("_base")).over(before)).select(slot, "_chunk", "_base", "_past")
    out = local.join(parts, [slot, "_chunk"])
    start = F.col("_base") + F.col("_sum") + F.greatest(F.col("_past"), F.col("_ahead") - F.col("_base"))
    return out.withColumn("start", start).drop("_d", "_chunk", "_sum", "_ahead", "_base", "_past")


def next_delay(delay: float, latency: float, status: int, least: float = 0.0, most: float = 60.0, target: float = 1.0) -> float:
    """The mean of the old delay and latency over target, at least the latter, clamped; a response other than 200 can't lower it."""
    aim = latency / target
    new = min(max(aim, (delay + aim) / 2, least), most)
    return math.floor((delay if status != 200 and new <= delay else new) * 1e6 + 0.5) / 1e6


def throttled(log: DataFrame, start: float = 5.0, least: float = 0.0, most: float = 60.0, target: float = 1.0, slot: str = "slot") -> DataFrame:
    """Each slot's delay after its responses in order. The fold is bound to the order, so a slot's log streams through one task, sorted on
    disk if need be, and only the delay is held."""
    kind = dict(log.dtypes)[slot]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, delay, n, none = None, start, 0, True
        for batch in batches:
            done = []
            for key, latency, status in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if none or key != held:
                    if not none:
                        done.append((held, delay, n))
                    held, delay, n, none = key, start, 0, False
                delay, n = next_delay(delay, latency, status, least, most, target), n + 1
            if done:
                yield out(done, batch.schema)
            schema = batch.schema
        if not none:
            yield out([(held, delay, n)], schema)

    def out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (schema.field(0).type, pa.float64(), pa.int32()))], names=[slot, "delay", "n"])

    rows = log.select(slot, F.col("latency").cast("double"), F.col("status").cast("int"), "at", "seq")
    return rows.repartition(slot).sortWithinPartitions(slot, "at", "seq").mapInArrow(run, f"{slot} {kind}, delay double, n int")


def until(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Rows up to the one at which a count reaches ``n``: a top-n by order."""
    return rows.orderBy(*order).limit(n)


def closed(log: DataFrame, limits: dict[str, tuple[Column, int]], timeout: int | None = None, at: str = "at", seq: str = "seq") -> DataFrame:
    """(reason, at, seq): the first limit that is reached, of counts of rows that meet a condition and, in microseconds, of time. Empty if none is.

    Each limit looks for its n-th row by a top-n, so no running count over the whole log is needed.
    """
    ends = []
    for reason, (condition, n) in limits.items():
        nth = log.where(condition).orderBy(at, seq).limit(n).agg(F.count("*").alias("n"), F.max(F.struct(at, seq)).alias("m"))
        ends.append(nth.where(F.col("n") == n).select(F.lit(reason).alias("reason"), F.col(f"m.{at}").alias("at"), F.col(f"m.{seq}").alias("seq")))
    if timeout is not None:
        over = log.agg(F.min(at).alias("a"), F.max(at).alias("z")).where(F.col("z") - F.col("a") >= timeout)
        ends.append(over.select(F.lit("timeout").alias("reason"), (F.col("a") + timeout).alias("at"), F.lit(None).cast("long").alias("seq")))
    return functools.reduce(DataFrame.unionByName, ends).orderBy("at", F.col("seq").asc_nulls_last()).limit(1)


def attempts(errors: DataFrame, key: str, order: list[str]) -> DataFrame:
    return ranked(errors, key, order, "attempt", order[0]).withColumn("attempt", F.col("attempt").cast("int"))


def admissible(requests: DataFrame, active: int, active_bytes: int, order: list[str], limit: int = 16, most_bytes: int = 5_000_000) -> DataFrame:
    """What may start now: none while responses of too many bytes are held, else as many as there are free places."""
    free = 0 if active_bytes > most_bytes else max(0, limit - active)
    return requests.orderBy(*order).limit(free)


def pause_until(value: Column, now: Column) -> Column:
    """The time until which a pause lasts: for ever without a value; a value below the present time counts from it."""
    return F.when(value.isNull(), F.lit(float("inf"))).when(value < now, now + value).otherwise(value).cast("double")


def unpaused(queue: DataFrame, paused: Column, until_: Column, now: Column) -> DataFrame:
    """The entries of spiders that aren't paused, or whose pause is over."""
    return queue.where(~F.coalesce(paused, F.lit(False)) | (now >= until_))


def idle_slots(log: DataFrame, now: Column, idle: int = 60_000_000, slot: str = "slot", at: str = "at") -> DataFrame:
    """(slot, last): slots not used for ``idle`` microseconds, whose state may go."""
    return log.groupBy(slot).agg(F.max(at).alias("last")).where(now - F.col("last") > idle)
