"""Problem 3: has this key been seen before, in order of arrival, without keeping the earlier keys.

Method: scalable Bloom chains. Keys are split by hash over shards; each shard reads its keys in order of arrival
and keeps a chain of Bloom layers. A layer that reaches its fill threshold (half of its bits expected set, which is
its capacity) is followed by one twice as large with half the error rate, so the chance of a wrong "seen" stays under
twice the first layer's rate however long the history grows. "Not seen" is never wrong.

Within an Arrow batch only the earliest row of a key asks; the later ones are answered by an exact comparison and
travel spread over all shards, so a key holding a third of all rows asks once per batch.

Rows without nucleotides (null, empty, no letters) are neither asked nor remembered. A null time is before all
others; rows alike in time and id count one after another, in any order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.functions.bytescan import mix64
from ampliq.llm.nucleotides import Folded
from ampliq.plans.scratch import stage_partitions

_SHIPPED = "entry_id bigint, h1 bigint, h2 bigint, rank int, ts bigint, ask boolean, spread bigint"
_ARROW = pa.schema([("entry_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("rank", pa.int32()), ("ts", pa.int64()), ("ask", pa.bool_()), ("spread", pa.int64())])


class BloomChain:
    """Bloom layers of growing size; error bounds the chance of a wrong "seen" over the whole chain."""

    def __init__(self, error: float = 1e-6, capacity: int = 4096, growth: int = 2, tighten: float = 0.5):
        self.error, self.growth, self.tighten = error, growth, tighten
        self.layers: list[dict] = []
        self._add(capacity, error * (1 - tighten))

    def _add(self, capacity: int, error: float) -> None:
        bits = 1 << max(10, math.ceil(math.log2(capacity * math.log(1 / error) / math.log(2) ** 2)))
        k = max(1, math.ceil(math.log2(1 / error)))
        room = max(1, int(bits / k * math.log(2)))  # half full
        self.layers.append({"bits": np.zeros(bits // 8, np.uint8), "mask": np.uint64(bits - 1), "k": k, "room": room, "held": 0, "error": error})

    @property
    def bound(self) -> float:
        """Upper bound of the chance that an answer "seen" to a new key is wrong."""
        return sum(x["error"] for x in self.layers)

    @staticmethod
    def _slot(layer: dict, a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
        return (a + np.uint64(i) * b + np.uint64(i * (i + 1) // 2 * i)) & layer["mask"]

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Answers for the keys of hashes (a, b)."""
        a, b = mix64(a.view(np.uint64)), b.view(np.uint64) | np.uint64(1)
        seen = np.zeros(len(a), bool)
        for layer in self.layers:
            live = np.flatnonzero(~seen)
            for i in range(layer["k"]):
                if not len(live):
                    break
                s = self._slot(layer, a[live], b[live], i)
                live = live[(layer["bits"][s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            seen[live] = True
        return seen

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Remember keys that are not in the chain."""
        a, b = mix64(a.view(np.uint64)), b.view(np.uint64) | np.uint64(1)
        at = 0
        while at < len(a):
            layer = self.layers[-1]
            n = min(layer["room"] - layer["held"], len(a) - at)
            if n <= 0:
                self._add(layer["room"] * self.growth, layer["error"] * self.tighten)
                continue
            for i in range(layer["k"]):
                s = self._slot(layer, a[at : at + n], b[at : at + n], i)
                np.bitwise_or.at(layer["bits"], s >> np.uint64(3), np.uint8(1) << (s & np.uint64(7)).astype(np.uint8))
            layer["held"] += n
            at += n


def _ask(batches):
    for batch in batches:
        f = Folded(batch.column(1))
        rows = np.flatnonzero(f.lengths > 0)
        if not len(rows):
            continue
        h1, h2 = f.hashes()
        ids = batch.column(0).fill_null(-(2**63)).to_numpy()
        ts = batch.column(2).fill_null(-(2**63)).to_numpy()
        order = np.lexsort((ids[rows], ts[rows], h2[rows], h1[rows]))
        r = rows[order]
        new = np.ones(len(r), bool)
        new[1:] = (h1[r][1:] != h1[r][:-1]) | (h2[r][1:] != h2[r][:-1])
        lead = r[np.flatnonzero(new)][np.cumsum(new) - 1]
        ask = (lead == r) | ~f.same(r, lead)
        spread = np.where(ask, h1[r], h1[r] ^ (np.arange(len(r)) * 0x9E3779B1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(r)), pa.array(h1[r]), pa.array(h2[r]), batch.column(3).take(pa.array(r)), pa.array(ts[r]), pa.array(ask), pa.array(spread)],
            schema=_ARROW,
        )


def _answer(error: float, capacity: int):
    def run(batches):
        chain = BloomChain(error, capacity)
        for batch in batches:
            ask = batch.column(5).to_numpy(zero_copy_only=False)
            h1, h2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            seen = ~ask
            rows = np.flatnonzero(ask)
            if len(rows):
                a, b = h1[rows], h2[rows]
                hit = chain.contains(a, b)
                order = np.lexsort((np.arange(len(rows)), b, a))
                again = np.zeros(len(rows), bool)
                again[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
                chain.add(a[~hit & ~again], b[~hit & ~again])
                seen[rows] = hit | again
            seen &= batch.column(3).to_numpy() > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(seen))], names=["entry_id"])

    return run


def seen_before(df: DataFrame, known: DataFrame, key: str = "entry_id", text: str = "sequence", time: str = "loaded_at", error: float = 1e-6, capacity: int = 4096) -> DataFrame:
    """(entry_id) of every row whose nucleotides are in known[text] or in a row before it.

    error bounds the chance that a new key is called seen; capacity is that of each shard's first layer.
    """
    cols = lambda i, s, t, rank: [i.alias("entry_id"), s.cast("string").alias("sequence"), t.alias("ts"), F.lit(rank).alias("rank")]
    arrivals = df.select(*cols(F.col(key).cast("bigint"), F.col(text), F.unix_micros(F.col(time).cast("timestamp")), 1))
    earlier = known.select(*cols(F.lit(0).cast("bigint"), F.col(text), F.lit(0).cast("bigint"), 0))
    asked = arrivals.unionByName(earlier).mapInArrow(_ask, _SHIPPED)
    n = stage_partitions(df.sparkSession)
    return asked.repartition(n, "spread").sortWithinPartitions("rank", "ts", "entry_id").mapInArrow(_answer(error, capacity), "entry_id bigint")


def wrong_answers(df: DataFrame, known: DataFrame, **options) -> DataFrame:
    """One row: entries with nucleotides, those answered seen, those truly seen, wrong, rate among new keys, bound."""
    clean = lambda d: d.select(F.replace(F.regexp_replace(F.upper("sequence"), "[^A-Z]+", ""), F.lit("U"), F.lit("T")).alias("n")).filter("n <> ''")
    said = seen_before(df, known, **options).agg(F.count(F.lit(1)).alias("answered_seen"))
    marked = clean(df).groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.lit(0).alias("known")).unionByName(
        clean(known).groupBy("n").agg(F.lit(0).cast("bigint").alias("c"), F.lit(1).alias("known"))
    )
    true = (
        marked.groupBy("n").agg(F.sum("c").alias("c"), F.max("known").alias("known"))
        .agg(F.coalesce(F.sum("c"), F.lit(0)).alias("entries"), F.coalesce(F.sum(F.when((F.col("known") == 0) & (F.col("c") > 0), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("new_keys"))
    )
    both = said.withColumn("one", F.lit(1)).join(true.withColumn("one", F.lit(1)), "one")
    seen = F.col("entries") - F.col("new_keys")
    wrong = F.col("answered_seen") - seen
    return both.select("entries", "new_keys", "answered_seen", seen.alias("truly_seen"), wrong.alias("wrong"), (wrong / F.greatest(F.col("new_keys"), F.lit(1))).alias("wrong_rate"), F.lit(float(options.get("error", 1e-6))).alias("rate_bound"))
