"""Pairs of sequences that differ by a few edits, as equi-joins without all-pairs groups."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.plans.scratch import drop_scratch, kept, stage_partitions, table

#: Rows of one key beyond which the key is refined before its rows are paired.
HOT = 512


def microvariants(df: DataFrame, key: str = "ord", sequence: str = "sequence") -> DataFrame:
    """(key, variant, kind): every distinct sequence exactly one substitution, deletion or insertion away.

    Deletions and insertions inside a run of one letter are made once, at the run's start. An output of its own: links
    are found by shared pieces, with a hundredth of the rows.
    """
    s = F.col("s")
    at = F.col("i")
    letter = F.substring(s, at, F.lit(1))
    left, right = F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s))
    base = df.select(F.col(key).alias("key"), F.col(sequence).alias("s"))
    sites = base.select("key", "s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("i"))
    letters = F.explode(F.array(*map(F.lit, "ACGT"))).alias("b")
    swaps = sites.select("key", "s", "i", letters).filter(F.col("b") != letter).select("key", F.concat(left, F.col("b"), right).alias("variant"), F.lit("substitution").alias("kind"))
    drops = sites.filter((at == 1) | (letter != F.substring(s, at - 1, F.lit(1)))).select("key", F.concat(left, right).alias("variant"), F.lit("deletion").alias("kind"))
    gaps = base.select("key", "s", F.explode(F.sequence(F.lit(0), F.length("s"))).alias("i")).select("key", "s", "i", letters)
    new = (F.col("i") == 0) | (F.col("b") != letter)  # a letter after itself makes what it makes before the run
    adds = gaps.filter(new).select("key", F.concat(F.substring(s, F.lit(1), at), F.col("b"), F.substring(s, at + 1, F.length(s))).alias("variant"), F.lit("insertion").alias("kind"))
    return swaps.unionByName(drops).unionByName(adds).withColumnRenamed("key", key)


def variant_counts(sequence: Column) -> dict[str, Column]:
    """How many rows of each kind `microvariants` has for a sequence, and in all; none of them is made.

    Three other letters a place, a deletion a run of one letter, and four letters before the sequence and three after
    each letter. All differ: inside a kind each is made once, and the kinds differ in length.
    """
    n = F.length(sequence).cast("bigint")
    runs = F.length(F.regexp_replace(sequence, r"(.)\1*", "x")).cast("bigint")
    return {"substitution": 3 * n, "deletion": runs, "insertion": 3 * n + 4, "variants": 6 * n + 4 + runs}


def parity_sign(sequence: Column, q: int = 5) -> Column:
    """64 bits: the parities of the q-letter words, folded by hash. One edit changes 2 q words, hence 2 q bits, at most."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.substring(sequence, i, F.lit(q))), F.lit(64)).cast("int"))
    words = F.transform(F.sequence(F.lit(1), F.length(sequence) - (q - 1)), bit)
    return F.when(F.length(sequence) >= q, F.aggregate(words, F.lit(0).cast("bigint"), lambda t, x: t.bitwiseXOR(x))).otherwise(F.lit(0).cast("bigint"))


def _near_signs(a: str, b: str, d: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 10 * d


def _keys(rows: DataFrame, d: int, low: int, high: int) -> DataFrame:
    """rows (side, id, g, s, sign, delta) with key, start and size: the pieces under which a pair can meet inside of g.

    Of d edits between a (side 0) and b (side 1), walk over a's d + 1 pieces and keep the edits so far less the pieces
    so far: it starts at 0, ends below it and falls by one at most, so some piece i has no edits, i - 1 before and d + 1
    - i after it at most. b has that piece, moved by i - 1 at most from either end's view; a's length and i are in the key.
    """
    c = F.col
    cut = lambda n, i: F.floor(n * i / F.lit(d + 1)).cast("int")
    one = rows.filter("side = 0").withColumn("n", F.length("s")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(d + 1)))).withColumn("start", cut(c("n"), c("i") - 1))
    two = rows.filter("side = 1").withColumn("delta", F.explode(F.when(c("delta").isNull(), F.sequence(F.lit(low), F.lit(high))).otherwise(F.array("delta"))))
    two = two.withColumn("n", F.length("s") - c("delta")).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(d + 1))))
    before, after = c("i") - 1, F.lit(d + 1) - c("i")
    least, most = F.greatest(-before, c("delta") - after), F.least(before, c("delta") + after)
    two = two.filter(least <= most).withColumn("move", F.explode(F.sequence(least, most))).withColumn("start", cut(c("n"), c("i") - 1) + c("move")).drop("move")
    both = one.unionByName(two).withColumn("size", cut(c("n"), c("i")) - cut(c("n"), c("i") - 1))
    return both.filter((c("start") >= 0) & (c("start") + c("size") <= F.length("s"))).withColumn("key", F.xxhash64("g", "n", "i", F.substring("s", c("start") + 1, c("size")))).drop("n", "i")


_MET = "a bigint, b bigint, key bigint, side int, delta int, start int, size int"
_MET_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), *[(n, t) for n, t in (("key", pa.int64()), ("side", pa.int32()), ("delta", pa.int32()), ("start", pa.int32()), ("size", pa.int32()))]])


def _meet(bits: int, hot: int):
    """Rows sorted by key and side: pairs of every key with hot rows at most; a longer key's rows as (id, null, ...)."""

    def pairs(key, id_, side, sign, rest):
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(key)))
        left = np.add.reduceat((side == 0).astype(np.int64), start) if len(start) else length
        group = np.repeat(np.arange(len(start)), length)
        row_hot = (length > hot)[group]
        probe = np.flatnonzero((side == 1) & ~row_hot)
        many = left[group[probe]]
        b = np.repeat(probe, many)
        a = start[group[b]] + np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many)
        ok = (id_[a] != id_[b]) & (np.bitwise_count((sign[a] ^ sign[b]).view(np.uint64)) <= bits)
        a, b = id_[a[ok]], id_[b[ok]]
        return made(a, b, key[row_hot], id_[row_hot], side[row_hot], [r[row_hot] for r in rest])

    def made(a, b, key, id_, side, rest):
        n, m = len(a), len(id_)
        void = lambda x, t: pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((a, id_)), pa.int64()), pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(m, pa.int64())]), void(key, pa.int64()), void(side, pa.int32()), *[void(r, pa.int32()) for r in rest]], schema=_MET_ARROW
        )

    none = np.zeros(0, np.int64)

    def run(batches):
        held: list[np.ndarray] = []
        open_key = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            if not batch.num_rows:
                continue
            if open_key is not None:  # the key that ran on from the batch before is a hot one
                n = int(np.searchsorted(cols[0], open_key, "right"))
                yield made(none, none, *[x[:n] for x in cols[:3]], [x[:n] for x in cols[4:]])
                cols = [x[n:] for x in cols]
                if not len(cols[0]):
                    continue
                open_key = None
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if len(cols[0]) - cut > hot:
                open_key, cut = cols[0][-1], len(cols[0])
            yield pairs(*[x[:cut] for x in cols[:4]], [x[:cut] for x in cols[4:]])
            held = [x[cut:] for x in cols]
        if held and len(held[0]):
            yield pairs(*held[:4], held[4:])

    return run


def _join_sides(rows: DataFrame, on: str, d: int) -> DataFrame:
    """(a, b) of the rows of both sides that share on and have near signs."""
    left = rows.filter("side = 0").select(F.col("id").alias("a"), on, F.col("sign").alias("x"))
    right = rows.filter("side = 1").select(F.col("id").alias("b"), on, F.col("sign").alias("y"))
    return left.join(right, on).filter(_near_signs("x", "y", d) & (F.col("a") != F.col("b"))).select("a", "b")


def _deletion_keys(s: Column) -> Column:
    """Hashes of the sequence and of its distinct one-letter deletions."""
    cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.xxhash64(F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))
    return F.when(F.length(s) > 0, F.array_distinct(F.concat(F.array(F.xxhash64(s)), cut))).otherwise(F.array(F.xxhash64(s)))


def _dense(work: DataFrame, d: int) -> DataFrame:
    """(a, b) of groups whose rows are alike nearly everywhere, where most pairs are links.

    d = 1: rows meet under their one-letter deletions; a deletion has few rows, so pairs are hardly more than links.
    """
    if d > 1:
        return _join_sides(work, "g", d)
    return _join_sides(work.withColumn("k", F.explode(_deletion_keys(F.col("s")))).withColumn("g", F.xxhash64("g", "k")), "g", d)


def candidates(rows: DataFrame, d: int, low: int, high: int, hot: int = HOT) -> DataFrame:
    """(a, b): every a of side 0 and b of side 1 at most d edits apart, and few others; pairs may repeat.

    rows: side, id, s. low and high bound length(b) - length(a). A key with more than hot rows (a conserved end, say)
    is refined: what is left of its rows without the shared piece is at most d edits apart too, so the same step is
    taken on it inside the key, as long as that halves the pairs. Where it does not, the rows are alike nearly
    everywhere; they are paired by one join on the key, which adaptive execution can split.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("sign", parity_sign(F.col("s")))
    first = _keys(rows.withColumns({"g": F.lit(0).cast("bigint"), "delta": F.lit(None).cast("int")}), d, low, high)
    met = table(
        first.select("key", "id", F.col("side").cast("int").alias("side"), "sign", F.coalesce("delta", F.lit(0)).alias("delta"), "start", "size")
        .repartition(stage_partitions(spark), "key").sortWithinPartitions("key", "side").mapInArrow(_meet(10 * d, hot), _MET), "met",
    )
    parts = [met.filter("b is not null").select("a", "b")]
    rest = F.concat(F.substring("s", F.lit(1), F.col("start")), F.substring("s", F.col("start") + F.col("size") + 1, F.length("s"))).alias("s")
    warm = met.filter("b is null").select("side", F.col("a").alias("id"), F.col("key").alias("g"), "delta", "start", "size")
    if warm.isEmpty():
        return parts[0]
    work, path = kept(warm.join(rows, ["side", "id"]).select("side", "id", "g", "delta", "sign", rest), "warm")
    two = lambda: [F.sum(F.when(F.col("side") == k, 1).otherwise(0)).alias(n) for k, n in ((0, "l"), (1, "r"))]
    while True:
        keys = _keys(work, d, low, high)
        sizes = work.groupBy("g").agg(*two(), F.max(F.length("s")).alias("longest")).filter("l > 0 and r > 0")
        counts = table(keys.groupBy("g", "key").agg(*two()).filter("l > 0 and r > 0"), "counts")
        then = counts.groupBy("g").agg(F.sum(F.col("l") * F.col("r")).alias("then"))
        # groups without a shared piece have no pairs and fall out here
        judged = table(sizes.join(then, "g").select("g", ((F.col("then") * 2 > F.col("l") * F.col("r")) | (F.col("longest") < 2 * d + 2)).alias("dense")), "judged")
        parts.append(table(_dense(work.join(judged.filter("dense").select("g"), "g", "left_semi"), d), "pairs"))
        refined = counts.join(judged.filter("not dense").select("g"), "g", "left_semi").select("g", "key", (F.col("l") + F.col("r") > hot).alias("hot"))
        apart = keys.join(refined, ["g", "key"])
        parts.append(table(_join_sides(apart.filter("not hot"), "key", d), "pairs"))
        following, next_path = kept(apart.filter("hot").select("side", "id", F.col("key").alias("g"), "delta", "sign", rest), "warm")
        drop_scratch(spark, path)
        if following.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        work, path = following, next_path


def _both(pairs: DataFrame, left: DataFrame, right: DataFrame, d: int, key: str, sequence: str, extra: tuple[str, ...]) -> DataFrame:
    one = lambda df, x: df.select(F.col(key).alias(x), F.col(sequence).alias(f"s{x}"), *[F.col(c).alias(f"{c}_{x}") for c in extra])
    return pairs.join(one(left, "a"), "a").join(one(right, "b"), "b").filter(F.levenshtein("sa", "sb", d) >= 0)


def pairs_of(amps: DataFrame, d: int, key: str = "ord", sequence: str = "sequence", extra: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, sa, sb), a < b, once each: sequences at most d edits apart (Levenshtein). extra: columns that come as x_a, x_b."""
    base = amps.select(F.col(key).alias("id"), F.col(sequence).alias("s"))
    rows = base.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    met = candidates(rows, d, 0, d).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _both(met, amps, amps, d, key, sequence, extra)


def pairs_between(left: DataFrame, right: DataFrame, d: int, key: str = "ord", sequence: str = "sequence") -> DataFrame:
    """(a of left, b of right, sa, sb), once each: sequences at most d edits apart (Levenshtein); left and right share no key."""
    side = lambda df, k: df.select(F.lit(k).alias("side"), F.col(key).alias("id"), F.col(sequence).alias("s"))
    met = candidates(table(side(left, 0).unionByName(side(right, 1)), "sides"), d, -d, d).distinct()
    return _both(met, left, right, d, key, sequence, ())


def qgrams(sequence: Column, q: int = 5) -> Column:
    """Parities of the 4**q words of q letters, as 4**q / 64 longs; a lower bound of edits is qgram_bound of two.

    Candidates are filtered by parity_sign, which folds these bits into one long.
    """
    code = lambda w: F.conv(F.translate(w, "ACGT", "0123"), 4, 10).cast("int")
    words = F.when(F.length(sequence) >= q, F.transform(F.sequence(F.lit(1), F.length(sequence) - (q - 1)), lambda i: code(F.substring(sequence, i, F.lit(q))))).otherwise(F.array().cast("array<int>"))
    zero = F.array_repeat(F.lit(0).cast("bigint"), 4**q // 64)

    def flip(bits, w):
        slot = F.shiftright(w, 6)
        return F.transform(bits, lambda x, i: F.when(i == slot, x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), w.bitwiseAND(F.lit(63))))).otherwise(x))

    return F.aggregate(words, zero, flip)


def qgram_bound(a: Column, b: Column, q: int = 5) -> Column:
    """No fewer edits than this: one edit changes the parity of 2 q words at most."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return F.ceil(differ / F.lit(2.0 * q)).cast("int")
