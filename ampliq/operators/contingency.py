"""Amplicons by samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.operators.order import dense_order
from ampliq.plans.options import AmpliconError
from ampliq.plans.scratch import table

_HEADER = r"^([^;]*(?:;(?!size=)[^;]*)*);size=([0-9]+);*\z"

#: Cells of the wide table in one task.
CELLS = 100_000_000


def observations(rows: DataFrame) -> DataFrame:
    """(amplicon, sample, abundance) of FASTA rows (header, sample); headers must be name;size=number."""
    bad = rows.filter(~F.col("header").rlike(_HEADER)).select("header").limit(1).collect()
    if bad:
        raise AmpliconError(f"no ;size= annotation in {bad[0]['header'][:80]}")
    return rows.select(F.regexp_extract("header", _HEADER, 1).alias("amplicon"), "sample", F.regexp_extract("header", _HEADER, 2).cast("bigint").alias("abundance"))


def long_table(obs: DataFrame) -> DataFrame:
    """(amplicon, sample, abundance) summed: the table in long form, for any number of samples. Null keys are left out."""
    return obs.filter("amplicon is not null and sample is not null").groupBy("amplicon", "sample").agg(F.coalesce(F.sum("abundance"), F.lit(0)).alias("abundance"))


def sparse_contingency(obs: DataFrame, samples: list[str] | None = None, limit: int = 10_000) -> tuple[DataFrame, list[str]]:
    """(ord, amplicon, total, cells: sorted array of (place of the sample, abundance)), a row an amplicon, and the samples.

    As large as the observations, whatever the number of columns. Ranges of ord, as many as the wide table's cells need.
    """
    summed = table(long_table(obs), "observed")
    if samples is None:
        samples = sorted(r["sample"] for r in summed.select("sample").distinct().limit(limit + 1).collect())
        if len(samples) > limit:
            raise AmpliconError(f"more than {limit} samples: use the long table")
    places = obs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(samples)], "sample string, place int")
    placed = summed.join(F.broadcast(places), "sample", "left")
    cell = F.when(F.col("place").isNotNull(), F.struct("place", "abundance"))
    rows = dense_order(placed.groupBy("amplicon").agg(F.sum("abundance").alias("total"), F.array_sort(F.collect_list(cell)).alias("cells")), F.col("total").desc(), F.col("amplicon").desc())
    parts = -(-rows.count() * (len(samples) + 1) // CELLS)
    return rows.repartitionByRange(max(parts, obs.sparkSession.sparkContext.defaultParallelism), "ord").sortWithinPartitions("ord"), samples


def _spread(n: int, zeros: Callable[[Column], Column], one: Callable[[Column], Column]) -> Column:
    """The cells of a row as n neighbours: an array of what stands for a run of samples that are missing, or for one."""
    c = F.col("cells")
    before = lambda i: F.when(i > 0, F.get(c, i - 1)["place"]).otherwise(F.lit(-1))
    pieces = F.transform(c, lambda x, i: F.concat(zeros(x["place"] - before(i) - 1), one(x["abundance"])))
    last = F.coalesce(F.get(c, F.size(c) - 1)["place"], F.lit(-1))
    return F.concat(pieces, F.array(zeros(F.lit(n - 1) - last)))


def contingency(obs: DataFrame, samples: list[str] | None = None, limit: int = 10_000) -> DataFrame:
    """ord, amplicon, a column a sample (0 where there is none), total; by total, then name, both descending.

    samples: the columns; found in one pass if not given, limit of them at most. Rows are ordered before they are wide.
    """
    rows, samples = sparse_contingency(obs, samples, limit)
    zero = F.lit(0).cast("bigint")
    wide = F.flatten(_spread(len(samples), lambda n: F.array_repeat(zero, n), F.array))
    return rows.select("ord", "amplicon", "total", wide.alias("row")).select("ord", "amplicon", *[F.coalesce(F.get("row", F.lit(i)), zero).alias(s) for i, s in enumerate(samples)], "total")


def contingency_lines(obs: DataFrame, samples: list[str] | None = None, limit: int = 10_000) -> tuple[DataFrame, list[str]]:
    """(ord, value) of the contingency table as tab-separated lines, in order, and the names of their fields.

    A line is put together from its few counts and runs of zeros; the wide table is not made. Names that hold a tab stand
    between zero characters, which is how Spark reads and writes CSV without a quote.
    """
    rows, samples = sparse_contingency(obs, samples, limit)
    cells = F.array_join(_spread(len(samples), lambda n: F.repeat(F.lit("\t0"), n), lambda a: F.concat(F.lit("\t"), a.cast("string"))), "")
    return rows.select("ord", F.concat(F.when(F.col("amplicon").contains("\t"), F.concat(F.lit("\0"), "amplicon", F.lit("\0"))).otherwise(F.col("amplicon")), cells, F.lit("\t"), F.col("total").cast("string")).alias("value")), ["amplicon", *samples, "total"]


def repeated_samples(files: DataFrame) -> DataFrame:
    """(sample, files) of samples that more than one file has. files: one row a file."""
    return files.filter("sample is not null").groupBy("sample").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")
