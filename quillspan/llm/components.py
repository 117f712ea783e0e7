"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch, split_join


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node with an edge; root is the smallest node of its component.

    Edges are rows of two longs in any direction, repeats and loops allowed; rows with a null are no
    edges.  Each step is two aggregations, made map-side first, and two joins, in which hubs are looked up
    where their rows lie.  Each step's edges are a table of ``scratch``, as is the result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = scratch.write(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u > v").distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")))
        large = split_join(both, low, ["u"], 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.distinct())
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        size = least.agg(F.sum("n")).first()[0] or 0
        linked = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = split_join(large, least, ["u"], size).select(F.explode(linked).alias("e"))
        after = scratch.write(small.select("e.u", "e.v").filter("u > v").distinct())
        for table in (now, low, large, least):
            scratch.drop(table)
        now = after
    named = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return scratch.write(named.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


def named_by_least(nodes: DataFrame, roots: DataFrame, node: str, scratch: Scratch) -> DataFrame:
    """nodes (node, least, n) with component_id, the smallest ``least`` of their component; a node without a root is its own."""
    rooted = scratch.write(nodes.join(roots, nodes[node] == roots["node"], "left").select(nodes[node], "least", "n", F.coalesce("root", nodes[node]).alias("root")))
    groups = scratch.write(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    size = groups.agg(F.sum("members")).first()[0] or 0
    return scratch.write(split_join(rooted, groups, ["root"], size, "members").select(node, "component_id", "n"))
