"""Dense positions in a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.plans.scratch import table

_LOW = 33  # bits of monotonically_increasing_id that number the rows of a partition


def dense_order(df: DataFrame, *by: Column, name: str = "ord") -> DataFrame:
    """df with name = 0, 1, 2 ... along the order. Range-sorts once, writes it, then adds each partition's offset.

    Ties keep some order. The offsets are one number a partition.
    """
    ranged = table(df.orderBy(*by).withColumn("_m", F.monotonically_increasing_id()), "order")
    part = F.shiftrightunsigned("_m", _LOW)
    counts = sorted((r["p"], r["count"]) for r in ranged.groupBy(part.alias("p")).count().collect())
    start, at = {}, 0
    for p, n in counts:
        start[p], at = at, at + n
    offsets = df.sparkSession.createDataFrame(list(start.items()) or [(0, 0)], "_p bigint, _start bigint")
    inside = F.col("_m") - F.shiftleft(part, _LOW)
    return ranged.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_start") + inside).drop("_p", "_m", "_start")
