"""Directed links: src may claim dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.functions.alignment import affine_diff
from ampliq.operators.neighbours import pairs_of
from ampliq.plans.options import Options


def directed(pairs: DataFrame, breaking: bool) -> DataFrame:
    """(src, dst, from_sequence, to_sequence) both ways of (a, b, sa, sb, abundance_a, abundance_b) with a < b.

    ord ascends as abundance descends: with breaking the way back is open only between equal abundances.
    """
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.col(f"s{x}").alias("from_sequence"), F.col(f"s{y}").alias("to_sequence"))
    there, both = F.array(way("a", "b")), F.array(way("a", "b"), way("b", "a"))
    ways = F.when(F.col("abundance_a") == F.col("abundance_b"), both).otherwise(there) if breaking else both
    return pairs.select(F.explode(ways).alias("w")).select("w.*")


def edges(amps: DataFrame, options: Options = Options()) -> DataFrame:
    """(src, dst, diff) of all amplicons at most d differences apart.

    d = 1: one substitution, deletion or insertion. d > 1: the non-matching columns of the optimal affine alignment of
    src (query) and dst (hit), which are never fewer than the edits that candidates are made by.
    """
    if options.d == 0:
        return amps.sparkSession.createDataFrame([], "src bigint, dst bigint, diff int")
    found = directed(pairs_of(amps, options.d, extra=("abundance",)), options.breaking)
    if options.d == 1:
        return found.select("src", "dst", F.lit(1).alias("diff"))
    return found.withColumn("diff", affine_diff(options.penalties)("from_sequence", "to_sequence")).filter(F.col("diff") <= options.d).select("src", "dst", "diff")


def network(amps: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, source, target) with the headers as printed, for the network output; order by src, dst."""
    shown = amps.select("ord", "shown")
    return (
        links.join(shown.select(F.col("ord").alias("src"), F.col("shown").alias("source")), "src")
        .join(shown.select(F.col("ord").alias("dst"), F.col("shown").alias("target")), "dst")
        .select("src", "dst", "source", "target")
    )
