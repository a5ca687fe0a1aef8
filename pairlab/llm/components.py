"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.storage import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v) with u > v: every node hands its least
    neighbour (itself included) to its larger neighbours (large star) or to
    its smaller ones and itself (small star)."""
    both = links.union(links.select("v", "u")).toDF("u", "v") if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.where("u != v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b), but for the least node
    of each component; component is the least node reachable. Each round is written to shared storage; rounds go on
    until nothing changes (a few more than the logarithm of the longest path).
    Pre-aggregated least neighbours keep hot nodes out of single tasks; the
    join with them has one row a node and is split where it is skewed. An
    empty link table gives no rows."""
    state = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "links")
    mark = None
    while True:
        state = stored(_star(_star(state, True), False), "stars")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
