"""Streaming forms: dedup with time-limited state, tumbling rates, leases."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.schedule import next_delay


def dedup(requests: DataFrame, key: str = "fp", time: str = "at", keep: str = "1 hour") -> DataFrame:
    """The first request of each key; a key is forgotten once the watermark is ``keep`` past it."""
    return requests.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def rates(log: DataFrame, time: str = "at", width: str = "60 seconds", late: str = "5 minutes", by: str | None = None) -> DataFrame:
    """Counts of each tumbling window."""
    keys = [F.window(time, width), *([by] if by else [])]
    out = log.withWatermark(time, late).groupBy(*keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *([by] if by else []), "n")


LEASE = "task_id string, token string, kind string, redelivered boolean"


def leases(events: DataFrame, visible_ms: int = 600_000) -> DataFrame:
    """Transitions of each task from (task_id, kind, token, at_ms): push, reserve, ack, nack.

    State is the task's present one: absent, ready, or leased under a token until a deadline in event time. A lease that has expired is recovered by the next reserve, marked
    as redelivered; an ack or nack counts only with the present token, so one that comes late is written as stale.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, token, deadline, again = state.get if state.exists else ("", "", 0, False)
        out = []
        for e in pd.concat(list(batches)).sort_values("at_ms", kind="stable").itertuples():
            kind = "stale"
            if e.kind == "push":
                kind = "rejected" if phase else "pushed"
                if not phase:
                    phase, again = "ready", False
            elif e.kind == "reserve" and (phase == "ready" or phase == "leased" and e.at_ms >= deadline):
                again = again or phase == "leased"
                kind, phase, token, deadline = "reserved", "leased", e.token, int(e.at_ms) + visible_ms
            elif e.kind in ("ack", "nack") and phase == "leased" and e.token == token:
                kind, phase, again = ("acked", "", False) if e.kind == "ack" else ("requeued", "ready", True)
            out.append((key[0], e.token, kind, again))
        if phase:
            state.update((phase, token, deadline, again))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["task_id", "token", "kind", "redelivered"])

    return events.groupBy("task_id").applyInPandasWithState(step, LEASE, "phase string, token string, deadline long, again boolean", "append", GroupStateTimeout.NoTimeout)


def throttle(log: DataFrame, start: float = 5.0, slot: str = "slot", idle_ms: int = 60_000) -> DataFrame:
    """(slot, delay, n): each slot's delay after every batch of its responses, from (slot, at, latency, status).

    State is the delay; a slot for which nothing came in ``idle_ms`` of processing time is forgotten and begins anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        delay, n = state.get if state.exists else (start, 0)
        for part in batches:
            for e in part.sort_values("at", kind="stable").itertuples():
                delay, n = next_delay(delay, e.latency, e.status), n + 1
        state.update((delay, n))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], delay, n)], columns=[slot, "delay", "n"])

    kind = dict(log.dtypes)[slot]
    return log.groupBy(slot).applyInPandasWithState(step, f"{slot} {kind}, delay double, n long", "delay double, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


_base: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without it, a temporary folder that goes with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _base:
        _base["dir"] = tempfile.mkdtemp(prefix="weftline-stream-")
        atexit.register(shutil.rmtree, _base["dir"], ignore_errors=True)
    return "file://" + _base["dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for a stream that is run once."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(spark: SparkSession, name: str) -> str:
    """The folder of a named stream: the same in every run, so that the next run goes on where the last one stopped."""
    return f"{base(spark)}/streams/{name}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder and read back, with its lineage cut."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", seconds: float | None = None) -> DataFrame:
    """All that is there now, run to its end into a table in memory: for tests and small results only. A run that takes longer than
    ``seconds`` is an error, not a partial result."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if seconds is None:
            query.awaitTermination()
        elif not query.awaitTermination(seconds):
            raise TimeoutError(f"{name} has not ended")
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def write_idempotent(batch: DataFrame, batch_id: int, folder: str) -> None:
    """A ``foreachBatch`` sink that a repeated batch overwrites rather than doubles."""
    batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def flush_every(stream: DataFrame, sink: Callable[[DataFrame, int], None], location: str, seconds: float | None = 10):
    """Starts the stream into ``sink(batch, batch_id)``: every ``seconds``, or with None all that is there now and no more.

    A batch counts as done once the sink has returned; one that failed comes again under its number, also after a restart at the
    same ``location``.
    """
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", location)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def children_then_ack(batch: DataFrame, batch_id: int, children: Callable[[DataFrame], DataFrame], frontier: str, acks: str, keys: list[str]) -> None:
    """A ``foreachBatch`` sink: what the batch leads to is in the frontier before the batch itself is acknowledged."""
    write_idempotent(children(batch), batch_id, frontier)
    write_idempotent(batch.select(*keys), batch_id, acks)
