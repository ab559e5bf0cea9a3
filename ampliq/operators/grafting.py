"""The second pass: light clusters attached to heavy ones two edits away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.operators.neighbours import pairs_between


def graft_candidates(amps: DataFrame, members: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """(child, parent): for each amplicon of a light cluster the least amplicon of a heavy one at most two edits away.

    Two sequences share a sequence one edit from either exactly when they are at most two edits apart, so this is one
    join by pieces; abundances play no part.
    """
    heavy = F.col("mass") >= limit
    side = lambda c: members.join(found.filter(c).select("root"), "root").select("ord").join(amps.select("ord", "sequence"), "ord")
    near = pairs_between(side(heavy), side(~heavy), 2)
    return near.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent"))


def grafts(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """(light, heavy, child, parent): of each light cluster the candidate that is first by parent, then child."""
    of = members.select("ord", "root")
    first = (
        candidates.join(of.select(F.col("ord").alias("child"), F.col("root").alias("light")), "child")
        .groupBy("light").agg(F.min(F.struct("parent", "child")).alias("g"))
        .select("light", F.col("g.parent").alias("parent"), F.col("g.child").alias("child"))
    )
    return first.join(of.select(F.col("ord").alias("parent"), F.col("root").alias("heavy")), "parent").select("light", "heavy", "child", "parent")


def attach(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """members with root moved to the heavy cluster, and own (the cluster before), graft_parent (of the child that
    attached) and graft_key: where a light cluster comes in its heavy one's list, null for the heavy one's own."""
    moved = members.withColumn("own", F.col("root")).join(chosen.select(F.col("light").alias("own"), "heavy", "child", F.col("parent").alias("by")), "own", "left")
    return moved.select(
        "ord", F.coalesce("heavy", "root").alias("root"), "generation", "parent", "radius", "own",
        F.when(F.col("ord") == F.col("child"), F.col("by")).alias("graft_parent"),
        F.when(F.col("heavy").isNotNull(), F.struct(F.col("by").alias("parent"), F.col("child").alias("child"))).alias("graft_key"),
    )


def merged_clusters(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Clusters after attaching: sizes, masses and singletons add up, generations stay those of the heavy one."""
    add = chosen.join(found.withColumnRenamed("root", "light"), "light").groupBy(F.col("heavy").alias("root")).agg(*[F.sum(c).alias(f"more_{c}") for c in ("size", "mass", "sumlen", "singletons")])
    kept = found.join(chosen.select(F.col("light").alias("root")), "root", "left_anti").join(add, "root", "left")
    more = {c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("size", "mass", "sumlen", "singletons")}
    return kept.select("root", *more.values(), "maxgen", "maxradius")
