"""Connected components by alternating large-star and small-star steps, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Written


def _mins(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def large_star(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the least of its neighbourhood."""
    both = e.union(e.select("v", "u"))
    return both.join(_mins(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the least of these."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _mins(down)
    moved = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, root (the least node reachable) for every node of the edges (u, v) that isn't a root itself.

    Links hang in stars at the end, so that each node has one row. The rounds are few: their number
    grows with the logarithm of a component's size.
    """
    held = Written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        e = held.read()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select("u", F.col("v").alias("root"))
        seen = now
        after = Written(small_star(large_star(e)), "edges")
        held.drop()
        held = after
