"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arkose.storage import forget, settled


#: Edges that a task writes, about.
PER_TASK = 1 << 16


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, but for a chance of about 2^-64."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def stars(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs: (u, v) for each node u that is not the least of its
    component, v being that least node. No edges give no rows; repeated edges and loops
    change nothing.

    Each round is written to the shared folder. In its large step a node of any degree is
    met by a plain join of two tables that were written (nodes' least neighbours are sums
    with a partial step), so Spark can split a hub's rows over tasks; they are never
    gathered. In the small step a node has its lesser neighbours only. Few edges are
    handled by few tasks."""
    now = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        tasks = -(-mark[0] // PER_TASK)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks))
        large = settled(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks))
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lesser, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, settled(small.union(lesser.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        forget(before, least, large)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now
