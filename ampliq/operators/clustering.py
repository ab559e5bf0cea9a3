"""Clusters as a fixpoint over directed links.

The seed of an amplicon is the least ord that reaches it; its generation the length of the shortest path from there.
That is what visiting amplicons in order and claiming all that is reachable gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.plans.scratch import drop_scratch, kept

#: Tables of changes after which they are merged into one.
MERGE = 6


def _union(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df for df, _ in parts])


def reached(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """((ord, root, generation) of every amplicon that one before it reaches, folders to drop once it is read).

    A round offers the changes of the last one along the links and writes what gets better; nothing else is written
    or read to the end of it: an amplicon never reached is its own root and stands nowhere. Every MERGE rounds the
    changes are merged and the merged tables dropped, so disk does not grow with the rounds. Rounds: the longest chain.
    """
    pairs = links.select("src", "dst")
    least = lambda: F.min(F.struct("root", "generation")).alias("best")
    first = pairs.filter("src < dst").groupBy(F.col("dst").alias("ord")).agg(F.min("src").alias("root")).select("ord", "root", F.lit(1).alias("generation"))
    parts = [kept(first, "reached")]
    while not parts[-1][0].isEmpty():
        told = parts[-1][0].join(pairs, F.col("ord") == F.col("src")).select(F.col("dst").alias("ord"), "root", (F.col("generation") + 1).alias("generation"))
        offers = told.groupBy("ord").agg(F.min(F.struct("root", "generation")).alias("offer"))
        mine = _union(parts).join(offers.select("ord"), "ord", "left_semi").groupBy("ord").agg(least())
        own = F.coalesce("best", F.struct(F.col("ord").alias("root"), F.lit(0).alias("generation")))
        better = offers.join(mine, "ord", "left").filter(F.col("offer") < own).select("ord", "offer.root", "offer.generation")
        if len(parts) > MERGE:
            merged = kept(_union(parts).groupBy("ord").agg(least()).select("ord", "best.root", "best.generation"), "reached")
            changed = kept(better, "reached")
            for _, path in parts:
                drop_scratch(links.sparkSession, path)
            parts = [merged, changed]
        else:
            parts.append(kept(better, "reached"))
    return _union(parts).groupBy("ord").agg(least()).select("ord", "best.root", "best.generation"), [path for _, path in parts]


def _radii(tree: DataFrame) -> DataFrame:
    """(ord, radius): steps added up along the parents of tree (ord, parent, step); each round doubles the way covered."""
    spark = tree.sparkSession
    ways, path = kept(tree.select("ord", F.col("parent").alias("top"), F.coalesce("step", F.lit(0)).alias("radius")), "ways")
    while not ways.filter("top is not null").isEmpty():
        on = ways.filter("top is not null")
        up = ways.select(F.col("ord").alias("top"), F.col("top").alias("next"), F.col("radius").alias("more"))
        longer = on.join(up, "top").select("ord", F.col("next").alias("top"), (F.col("radius") + F.col("more")).alias("radius"))
        following, next_path = kept(ways.filter("top is null").unionByName(longer), "ways")
        drop_scratch(spark, path)
        ways, path = following, next_path
    return ways.select("ord", F.col("radius").cast("int").alias("radius"))


def membership(amps: DataFrame, links: DataFrame, distances: bool = False) -> DataFrame:
    """(ord, root, generation, parent, radius) of every amplicon; root is the seed's ord, a seed has no parent.

    parent is the least member of the generation before that links to it. radius adds up differences along parents
    (distances), else it is the generation. links: a written table, which every round reads.
    """
    found, paths = reached(links)
    own = amps.select("ord").join(found.withColumnsRenamed({"root": "r", "generation": "g"}), "ord", "left")
    state, _ = kept(own.select("ord", F.coalesce("r", "ord").alias("root"), F.coalesce("g", F.lit(0)).alias("generation")), "state")
    for path in paths:
        drop_scratch(amps.sparkSession, path)
    up = state.select(F.col("ord").alias("src"), F.col("root").alias("ps"), F.col("generation").alias("pg"))
    claimed = (
        links.join(up, "src").join(state, F.col("dst") == F.col("ord"))
        .filter((F.col("ps") == F.col("root")) & (F.col("pg") == F.col("generation") - 1))
        .groupBy("ord").agg(F.min(F.struct("src", "diff")).alias("p"))
        .select("ord", F.col("p.src").alias("parent"), F.col("p.diff").alias("step"))
    )
    tree = state.join(claimed, "ord", "left")
    if not distances:
        return tree.select("ord", "root", "generation", "parent", F.col("generation").alias("radius"))
    tree, _ = kept(tree, "tree")
    return tree.join(_radii(tree), "ord").select("ord", "root", "generation", "parent", "radius")


def clusters(amps: DataFrame, members: DataFrame) -> DataFrame:
    """(root, size, mass, sumlen, singletons, maxgen, maxradius): one row a cluster, by its seed's ord."""
    return (
        members.join(amps.select("ord", "abundance", "seqlen"), "ord").groupBy("root")
        .agg(
            F.count(F.lit(1)).alias("size"), F.sum("abundance").alias("mass"), F.sum("seqlen").alias("sumlen"),
            F.sum(F.when(F.col("abundance") == 1, 1).otherwise(0)).alias("singletons"), F.max("generation").alias("maxgen"), F.max("radius").alias("maxradius"),
        )
    )


def weights(found: DataFrame, limit: int) -> DataFrame:
    """One row of counters: heavy and light clusters, their amplicons, and the nucleotides of light ones."""
    light = F.col("mass") < limit
    count = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("bigint")
    return found.agg(
        count(~light, F.lit(1)).alias("heavy_clusters"), count(~light, F.col("size")).alias("heavy_amplicons"),
        count(light, F.lit(1)).alias("light_clusters"), count(light, F.col("size")).alias("light_amplicons"), count(light, F.col("sumlen")).alias("light_nucleotides"),
    )


def totals(found: DataFrame) -> DataFrame:
    """One row: clusters, largest size, heaviest mass, most generations."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.agg(F.count(F.lit(1)).alias("clusters"), zero(F.max("size")).alias("largest"), zero(F.max("mass")).alias("heaviest"), zero(F.max("maxgen")).alias("generations"))
