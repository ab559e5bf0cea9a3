"""Problem 8: documents of several sources combined so that each source has its target share of the tokens.

Method: hash-threshold histograms. Tokens are summed by source and by the leading bits of the document's hash. The
budget of a source is some whole passes over it and a rest; the rest takes the documents whose hash lies under a
threshold. The histogram tells in which bucket the threshold falls, only that bucket is split further, and the
selection is a filter: nothing is sorted. Thresholds are nested: a larger budget keeps what a smaller one took.

The largest total that no source's cap forbids is used unless a budget is given. Listed sources without tokens cannot
have a share; theirs is spread over the others in proportion. Sources that are not listed, or null, take no part, nor
do documents without tokens. Documents of one id hash alike and go in or out together, so the last bucket may miss
the budget by that group, as by part of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliq.llm.tokens import VOCABULARY, token_sizes
from ampliq.plans.scratch import table

BITS = 12
WIDTH = 60
MAX_SOURCES = 10_000


def _boundaries(rows: DataFrame, left: dict[str, int], at: dict[str, int], level: int) -> dict[str, tuple[int, int, int, int]]:
    """By source the bucket in which its tokens pass what is left: (bucket, tokens before it, its tokens, its documents).

    The histogram, of 2**BITS buckets a source, stays on the executors; one row a source comes to the driver. A source
    that never passes is not there. Below the top level only the last boundary bucket of a source is looked into.
    """
    low = WIDTH - BITS * (level + 1)
    facts = rows.sparkSession.createDataFrame([(s, n, at[s]) for s, n in left.items()], "source string, left bigint, inside bigint")
    own = rows.join(F.broadcast(facts), "source")  # MAX_SOURCES rows at most
    if level:
        own = own.filter(F.shiftright("h", low + BITS) == F.col("inside"))
    bars = own.groupBy("source", "left", F.shiftright("h", low).alias("b")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("b")) - F.col("n")
    passing = bars.withColumn("before", before).filter(F.col("before") + F.col("n") > F.col("left"))
    got = passing.groupBy("source").agg(F.min(F.struct("b", "before", "n", "docs")).alias("x")).select("source", "x.*").collect()
    return {r["source"]: (r["b"], r["before"], r["n"], r["docs"]) for r in got}


def _thresholds(rows: DataFrame, rest: dict[str, int]) -> dict[str, int]:
    """For each source the hash under which documents add up to its rest, as near as whole documents allow."""
    found = {s: 0 for s, n in rest.items() if n <= 0}
    left = {s: n for s, n in rest.items() if n > 0}
    at = dict.fromkeys(left, 0)
    for level in range(WIDTH // BITS):
        if not left:
            break
        low = WIDTH - BITS * (level + 1)
        passed = _boundaries(rows, left, at, level)
        for s in list(left):
            if s not in passed:  # all of it is taken
                found[s] = (at[s] + 1) << (low + BITS)
                del left[s]
                continue
            b, before, n, docs = passed[s]
            left[s] -= before
            last = docs == 1 or not low
            found[s] = (b + (last and 2 * left[s] >= n)) << low
            at[s] = b
            if last or not left[s]:
                del left[s]
    return found


def sized(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, tokens, h): h is 60 bits of the id's hash. Written once, for every pass reads it."""
    counted = token_sizes(documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), ["doc_id", "source"], "text", vocabulary)
    return table(counted.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 4)), "sizes")


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, **columns) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: doc_id, source, tokens, copies (1 to max_repeats) of every document taken.
    report: source, target_share, max_repeats, available_tokens, selected_tokens, actual_share, one row a listed source.
    targets: source, target_share, max_repeats; it is read to the driver, MAX_SOURCES rows at most.
    """
    spark = documents.sparkSession
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect() if r["source"] is not None}
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    rows = sized(documents, **columns)
    names = spark.createDataFrame([(s,) for s in goal], "source string")
    listed = rows.filter(F.col("tokens") > 0).join(F.broadcast(names), "source", "left_semi")  # MAX_SOURCES rows at most
    have = {r["source"]: r["n"] for r in listed.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    live = {s: g for s, g in goal.items() if have.get(s, 0) > 0 and g[0] > 0 and g[1] > 0}
    weight = sum(g[0] for g in live.values())
    total = min((have[s] * g[1] * weight / g[0] for s, g in live.items()), default=0.0)
    if budget is not None:
        total = min(total, budget)
    wanted = {s: min(have[s] * g[1], round(total * g[0] / weight)) for s, g in live.items()}
    passes = {s: w // have[s] for s, w in wanted.items()}
    under = _thresholds(listed, {s: wanted[s] - passes[s] * have[s] for s in live}) if live else {}
    cuts = spark.createDataFrame([(s, int(passes[s]), int(under[s])) for s in live], "source string, whole int, level bigint")
    copies = F.col("whole") + (F.col("h") < F.col("level")).cast("int")
    selection = listed.join(F.broadcast(cuts), "source").withColumn("copies", copies.cast("int")).filter("copies > 0").select("doc_id", "source", "tokens", "copies")
    taken = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"))
    facts = spark.createDataFrame([(s, g[0], g[1], int(have.get(s, 0))) for s, g in goal.items()], "source string, target_share double, max_repeats int, available_tokens bigint")
    every = F.broadcast(taken.agg(F.sum("selected_tokens").alias("all_tokens")).withColumn("one", F.lit(1)))
    report = (
        facts.join(F.broadcast(taken), "source", "left").withColumn("one", F.lit(1)).join(every, "one")
        .select("source", "target_share", "max_repeats", "available_tokens", F.coalesce("selected_tokens", F.lit(0)).cast("bigint").alias("selected_tokens"),
                F.coalesce(F.col("selected_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))
    )
    return selection, report
