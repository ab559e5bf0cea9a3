"""Entries checked and put in the order that every later tie follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.functions.headers import annotate, printed
from ampliq.operators.order import dense_order
from ampliq.plans.options import AmpliconError, Options

MAX_HEADER = 16_777_215
MAX_SEQUENCE = 67_108_861


def parse_entries(entries: DataFrame, options: Options) -> DataFrame:
    """(header, sequence) rows with abundance, label, id, before, after, appended, seqlen and fault (null if sound)."""
    parsed = annotate(entries.select(F.coalesce("header", F.lit("")).alias("header"), F.coalesce("sequence", F.lit("")).alias("sequence")), options.usearch)
    sequence = F.replace(F.upper("sequence"), F.lit("U"), F.lit("T"))
    given = F.col("number").try_cast("bigint")
    return parsed.select(
        "header", sequence.alias("sequence"), "label", "id", "before", "after",
        F.when(F.col("found"), given).otherwise(F.lit(options.default_abundance).cast("bigint")).alias("abundance"),
        (~F.col("found")).alias("appended"),
        F.length("sequence").alias("seqlen"),
        F.length("before").alias("abundance_start"),
        (F.length("header") - F.length("after")).alias("abundance_end"),
        F.when(F.length("header") > MAX_HEADER, "header too long")
        .when(F.col("sequence") == "", "empty sequence")
        .when(~sequence.rlike(r"^[ACGT]+\z"), "illegal character in sequence")
        .when(F.length("sequence") > MAX_SEQUENCE, "sequence too long")
        .when(F.col("found") & (F.coalesce(given, F.lit(0)) <= 0), "illegal abundance value")
        .when(F.col("id") == "", "empty sequence identifier")
        .alias("fault"),
    )


def repeats(parsed: DataFrame, column: str) -> DataFrame:
    """(column, entries): the ids (or sequences) that more than one entry has."""
    return parsed.groupBy(column).agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1")


def missing(parsed: DataFrame) -> DataFrame:
    """One row: entries without an abundance, and the first of their headers."""
    none = F.col("abundance").isNull() & F.col("fault").isNull()
    return parsed.agg(F.count(F.when(none, 1)).alias("entries"), F.min(F.when(none, F.col("header"))).alias("first"))


def variants(sequence: Column) -> Column:
    """How many sequences are one edit away: 3 a letter to replace, 3 a letter and 4 to add, one a run of letters to drop."""
    return 6 * F.length(sequence) + 4 + F.length(F.regexp_replace(sequence, r"(.)\1*", "x"))


def check(parsed: DataFrame, options: Options) -> None:
    """AmpliconError if an entry is unsound, or a label, a sequence (d > 0) repeats, or an abundance is missing."""
    missing = F.col("abundance").isNull() & F.col("fault").isNull()
    seen = parsed.agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("fault", "header"))).alias("bad"), F.count(F.when(missing, 1)).alias("n"), F.min(F.when(missing, F.col("header"))).alias("first")).first()
    if seen["bad"]:
        raise AmpliconError(f"{seen['bad']['fault']}: {seen['bad']['header'][:80]}", seen["bad"]["header"])
    keys = [F.struct(F.lit(0).alias("kind"), F.col("id").alias("key"))] + ([F.struct(F.lit(1).alias("kind"), F.md5("sequence").alias("key"))] if options.d > 0 else [])
    twice = parsed.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.kind", "k.key").count().filter("count > 1").agg(F.min(F.struct("kind", "key")).alias("k")).first()["k"]
    if twice and twice["kind"] == 0:
        raise AmpliconError(f"duplicated sequence identifier: {twice['key'][:80]}")
    if twice:
        raise AmpliconError("some sequences are not unique: dereplicate the input first, with d = 0")
    if options.default_abundance is None and seen["n"]:
        raise AmpliconError(f"abundance annotations not found for {seen['n']} sequences, among them {seen['first'][:80]}", seen["first"])


def amplicons(entries: DataFrame, options: Options = Options(), validate: bool = True) -> DataFrame:
    """The amplicon table: ord (0 for the most abundant; ties by header bytes), header, shown, label, abundance, sequence ..."""
    out = dense_order(parse_entries(entries, options), F.col("abundance").desc(), F.col("header").asc())
    if validate:
        check(out, options)
    out = out.drop("fault")
    return out.withColumn("shown", printed(options.usearch, F.col("appended"), F.col("header"), F.col("abundance")))


def summary(amps: DataFrame) -> DataFrame:
    """One row: nucleotides, sequences, longest."""
    return amps.agg(F.coalesce(F.sum("seqlen"), F.lit(0)).cast("bigint").alias("nucleotides"), F.count(F.lit(1)).alias("sequences"), F.coalesce(F.max("seqlen"), F.lit(0)).alias("longest"))
