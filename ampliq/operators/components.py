"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.plans.scratch import table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are linked to the least of them. edges run from u to a larger v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    met = edges.join(least, "v")
    lower = met.select(F.col("m").alias("u"), F.col("u").alias("v"))
    return lower.unionByName(least.select(F.col("m").alias("u"), "v")).filter("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node it is connected to.

    Takes O(log**2 nodes) rounds whatever the diameter; each is written to the shared folder. A node of many edges
    is a hot key of two joins whose other side has one row a node, which adaptive execution can split. Edges with a
    null end are ignored, loops and repeated edges change nothing; a node with loops only is its own component.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    work = table(ends.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    nodes = ends.filter("u = v").select(F.col("u").alias("node")).distinct()
    last = None
    while True:
        work = table(_small_star(_large_star(work)), "edges")
        # count and sums of both ends are a certificate of a fixed point: each contraction lowers some end or the count
        now = work.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    found = work.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = work.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    alone = nodes.join(found.unionByName(roots).select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(roots).unionByName(alone)
