"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of each u.  Staged, so that joins with it are of plain
    exchanges, which Spark splits where a node has many neighbours."""
    return staged(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node is tied to the node's least neighbour; and what to release after."""
    both = edges.union(edges.select("v", "u"))
    least = _least(both)
    found = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("m"))
    return found.select("u", F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node and its smaller neighbours are tied to the least of them; and what to release after."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = _least(down)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """Staged (node, root): for each node of an edge (u, v: long) the least node it reaches.

    Loops and repeated edges do no harm.  Each round is staged in the shared
    folder, and the edges never leave the executors: only their number and a
    checksum say when nothing changes any more.
    """
    now = staged(edges.select("u", "v").where("u != v").distinct(), "edges")
    seen = None
    while True:
        before = now
        large, one = _large_star(now)
        small, two = _small_star(large)
        now = staged(small, "edges")
        release(before, one, two)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if state == seen:
            break
        seen = state
    out = staged(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct()), "roots")
    release(now)
    return out
