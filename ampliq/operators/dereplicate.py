"""d = 0: entries with the same sequence merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dereplicate(amps: DataFrame) -> DataFrame:
    """(sequence, root, size, mass, sumlen, singletons, maxgen, maxradius): root is the least ord of the sequence.

    Merging is one aggregation that combines before it shuffles; members are found by join, never collected.
    """
    return amps.groupBy("sequence").agg(
        F.min("ord").alias("root"), F.count(F.lit(1)).alias("size"), F.sum("abundance").alias("mass"), F.sum("seqlen").alias("sumlen"),
        F.sum(F.when(F.col("abundance") == 1, 1).otherwise(0)).alias("singletons"), F.lit(0).alias("maxgen"), F.lit(0).alias("maxradius"),
    )


def dereplicated_members(amps: DataFrame, found: DataFrame) -> DataFrame:
    """(ord, root, generation, parent, radius) in the shape of a clustering: every member has the seed as its parent."""
    return amps.select("ord", "sequence").join(found.select("sequence", "root"), "sequence").select(
        "ord", "root", F.lit(0).alias("generation"), F.when(F.col("ord") != F.col("root"), F.col("root")).alias("parent"), F.lit(0).alias("radius")
    )
