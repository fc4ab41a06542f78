"""Best-fit packing by exact-complement hashing.

Only lengths decide which pieces share a sequence, and there are at most ``limit`` of them, so the plan is made on
the driver from a table of counts by length, of fixed size for any corpus. For each length, longest first, hash indexes of the
single, pair and triple length sums are asked for what exactly fills its gap, and combinations are consumed as often as the
counts allow; what is left is packed best-fit. The plan is a list of recipes, each a combination of lengths and how often
it is used. Pieces then get ranks within their length, and a rank and a length name a recipe's copy and a place in it.

Edge cases: a null or empty text is one piece of the end id alone; rows that repeat an id are packed each by itself, equal ones in any
order; a null id is passed through; a very long text is encoded whole and cut into as many pieces as it needs; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import store, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, limit: int, tokenizer: str, end_id: int = 0, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids with the end id; one longer than ``limit`` is cut so that its first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        end = np.array([end_id], "<u4")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            out = []
            for d, t in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate((coder.encode(t.as_py()), end)).astype("<u4")
                at = 0
                stop = len(ids) % limit or limit
                for k in range(-(-len(ids) // limit)):
                    out.append((d.as_py(), k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
                    at, stop = stop, stop + limit
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Recipes, (lengths, times), that use every piece of ``counts`` once and have sums of at most ``limit``.

    Exact fills of up to three pieces are best where short pieces abound, but may use up short pieces that long ones
    need; so plans with sums of fewer pieces are made too, down to best-fit alone, and the shortest is taken. One that
    is as short as the sum of lengths allows ends the search.
    """
    bound = -(-sum(length * n for length, n in counts.items()) // limit)
    best: list[tuple[tuple[int, ...], int]] | None = None
    for most in (3, 2, 1, 0):
        made = _plan(counts, limit, most)
        if best is None or _sequences(made) < _sequences(best):
            best = made
        if _sequences(best) == bound:
            break
    return best or []


def _sequences(recipes: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(n for _, n in recipes)


def _plan(counts: dict[int, int], limit: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """``most``: pieces that an exact fill of a gap may have."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    recipes: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> int:
        """Consumes the combination as often as counts allow."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                left[x] -= n * times
            recipes.append((lengths, times))
        return times

    use((limit,))
    for longest in range(limit - 1, 0, -1) if most else ():
        gap = limit - longest
        if left[longest] and gap >= 1:
            use((longest, gap))
        if not left[longest] or most < 2:
            continue
        a = np.arange(1, gap // 2 + 1)
        pairs = a[(left[a] > 0) & (left[gap - a] > 0)]
        for x in pairs[np.argsort(-np.minimum(left[pairs], left[gap - pairs]), kind="stable")]:
            if not left[longest]:
                break
            use((longest, int(gap - x), int(x)))
        if not left[longest] or gap < 3 or most < 3:
            continue
        for x in range(gap - 2, 0, -1):
            if not left[longest]:
                break
            if not left[x] or x > longest:
                continue
            rest = gap - x
            b = np.arange(max(1, rest - x), rest // 2 + 1)
            b = b[(left[b] > 0) & (left[rest - b] > 0)]
            for y in b:
                if not (left[longest] and left[x]):
                    break
                use((longest, x, int(rest - y), int(y)))
    while left.any():
        live = np.flatnonzero(left)
        taken: dict[int, int] = {}
        lengths, gap = [], limit
        while gap:
            k = np.searchsorted(live, gap, side="right") - 1
            while k >= 0 and left[live[k]] - taken.get(int(live[k]), 0) <= 0:
                k -= 1
            if k < 0:
                break
            x = int(live[k])
            lengths.append(x)
            taken[x] = taken.get(x, 0) + 1
            gap -= x
        use(tuple(lengths))
    return recipes


def places(recipes: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of every slot of every recipe."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in recipes:
        offset = 0
        for x in lengths:
            first = ranks.get(x, 0)
            ranks[x] = first + times
            out.append((x, first, first + times, sequence, offset))
            offset += x
        sequence += times
    return out


def pack(cut: DataFrame, limit: int, rows_per_bucket: int = 32_768) -> DataFrame:
    """``cut``, a table of pieces, with ``sequence_id`` and ``offset``.

    Ranks are counted within hash buckets of each length plus the pieces in the buckets before, so that a length
    that a third of all pieces have is no single task's; there are as many buckets as the commonest length needs. The slot table has at most a few rows for each of the ``limit``
    lengths and recipes, whatever the corpus, so it is broadcast.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``limit`` rows
    slots = places(plan(counts, limit))
    buckets = max(1, -(-max(counts.values(), default=0) // rows_per_bucket))
    spark = cut.sparkSession
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length long, first long, upto long, sequence long, offset long")
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    parts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("r", F.row_number().over(inside) - 1).join(parts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("base"))
    joined = ranked.join(F.broadcast(table), "length").where("rank >= first and rank < upto")
    return joined.select(*cut.columns, (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def best_fit(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(store.write_once(pieces(docs, limit, tokenizer or tokens.default_path(), end_id), "pieces"), limit)
