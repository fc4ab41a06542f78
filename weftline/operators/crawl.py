"""Walks over the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.streaming import state as streams


def depths(edges: DataFrame, roots: DataFrame, limit: int | None = None, written=None) -> DataFrame:
    """(node, depth): the least number of steps from a root, up to ``limit``, or until a level is empty. (src, dst) edges, (node) roots.

    A level is the last one's links without what is already reached. Each level is written by ``written``, in the shared folder by
    default, and read back, so the plan of a level does not hold those before it.
    """
    keep = written or streams.written
    edges = keep(edges.distinct())
    reached = level = keep(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while limit is None or depth < limit:
        depth += 1
        found = edges.join(level.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        level = keep(found.join(reached, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached
