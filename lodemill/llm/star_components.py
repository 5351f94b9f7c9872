"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm.common import Scratch


def _least_neighbour(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, m): written, so that the join with it can deal a hot node's edges to many tasks."""
    return scratch.save(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node of ``edges(a, b)`` that has a neighbour; the component is its smallest id.

    Loops and repeated edges don't matter; rows with nulls are left out.  Every round is written to the shared folder;
    rounds go on until one changes nothing, about the squared logarithm of the nodes at most.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = scratch.save(edges.where("a is not null and b is not null and a <> b").select(high, low).distinct(), "edges")
    state = None
    while True:
        # Large-star: every node ties its larger neighbours to the smallest node it knows.
        both = now.selectExpr("a u", "b v").unionAll(now.selectExpr("b u", "a v"))
        least = _least_neighbour(both, scratch)
        large = scratch.save(both.where("v > u").join(least, "u").selectExpr("v a", "m b").where("a <> b").distinct(), "large")
        # Small-star: every node ties its smaller neighbours, and itself, to the smallest of them.
        down = large.selectExpr("a u", "b v")
        least2 = _least_neighbour(down, scratch)
        small = down.join(least2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = scratch.save(small.where("a <> b").distinct(), "edges")
        scratch.drop(now, least, large, least2)
        now = after
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            roots = now.select("b").distinct()
            return now.selectExpr("a id", "b component").unionAll(roots.selectExpr("b id", "b component"))
        state = seen
