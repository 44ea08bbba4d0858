"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_stage, stage, stage_distinct


def _stars_only(e: DataFrame) -> bool:
    """Whether every u has one v, which is no u: then v is the smallest of its component, and a round would change nothing."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").limit(1).count()


def _star(e: DataFrame) -> DataFrame:
    """``e`` has rows (u, v).  Link every v of a u to the smallest of u's neighbours and u itself."""
    low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.join(low, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of ``edges``: the smallest node reachable.

    Rounds go on until only stars are left; edges that are stars already take none.  Each round writes its edges to the
    shared folder; the number of edges never grows.  The smallest neighbour comes from a combined aggregate and is joined
    back, so a hub is no group in one task.
    """
    n = edges.count()
    cur = stage_distinct(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v"), "star", n)
    while not _stars_only(cur):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage_distinct(_star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large", n)
        s = _star(large)
        small = s.select(F.col("v").alias("x"), "m").unionByName(s.select(F.col("u").alias("x"), "m"))
        new = stage_distinct(small.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")), "star", n)
        drop_stage(large, cur)
        cur = new
    tops = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops).distinct()
