"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, tasks_for, written


def large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's least neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    smaller = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return smaller.union(least.select("u", "m")).filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """The least node that each node of ``edges`` (a, b) can reach: node, component.

    Edges with a null end, loops and repeated edges change nothing; an empty table gives no rows. Each
    step is written to the shared folder, so a lost executor costs one step at most, and replaces the
    one before it. Steps go on until nothing changes, which these two always reach. The steps of a
    small table run in few tasks, by its count of edges.
    """
    state, before = None, None
    edges = written(edges.select("a", "b").filter("a <> b").distinct())
    tasks = tasks_for(edges.count())
    while True:
        large = written(large_star(edges).coalesce(tasks))
        new = written(small_star(large).coalesce(tasks).distinct().coalesce(tasks))
        discard(edges, large)
        edges = new
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, tasks = state, tasks_for(state[0])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
