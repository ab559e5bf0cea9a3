"""Problem 5: the most frequent values of a column, in bounded memory.

Method: external sort and run-length counting. Every partition's values are sorted (Spark's external sort) and counted
as runs, one run a distinct value; the runs are written and range-partitioned by value, so that a value that holds a
third of all rows is one run a partition; each range's runs are sorted and merged with their counts, and a bounded heap
keeps the range's best. At most 1 / share values can hold more than that share of the rows, and no value outside its
range's first k can be among the first k of all, so heaps of that size lose none: the counts that come out are exact.

Nulls are not counted, the empty text is a value like others. Ties are broken by the value; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliq.plans.scratch import stage_partitions, table

_RUN = "field string, item string, n bigint"


def _starts(field, item) -> np.ndarray:
    """Where runs of one value begin; there are no nulls."""
    new = np.ones(len(field), bool)
    if len(field) > 1:
        same = pc.and_(pc.equal(field.slice(1), field.slice(0, len(field) - 1)), pc.equal(item.slice(1), item.slice(0, len(item) - 1)))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _runs(batches):
    """Sorted values to runs; the last run of a batch waits for the next one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        field, item = batch.column(0), batch.column(1)
        start = _starts(field, item)
        n = np.diff(np.append(start, batch.num_rows))
        fields, items = field.take(pa.array(start)), item.take(pa.array(start))
        if held is not None:
            if fields[0].as_py() == held[0] and items[0].as_py() == held[1]:
                n[0] += held[2]
            else:
                yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.string()), pa.array([held[2]])], names=["field", "item", "n"])
        held = (fields[-1].as_py(), items[-1].as_py(), int(n[-1]))
        yield pa.RecordBatch.from_arrays([fields.slice(0, len(n) - 1), items.slice(0, len(n) - 1), pa.array(n[:-1])], names=["field", "item", "n"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.string()), pa.array([held[2]])], names=["field", "item", "n"])


def _best(room: int):
    """Per field of one range: the room most frequent values, and the number of rows under a null item."""

    def run(batches):
        heaps: dict[str, list] = {}
        total: dict[str, int] = {}
        held = None

        def close(run):
            f, item, n = run
            heap = heaps.setdefault(f, [])
            entry = (n, item)
            if len(heap) < room:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

        for batch in batches:
            if not batch.num_rows:
                continue
            field, item, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            start = _starts(field, item)
            counts = np.add.reduceat(n, start)
            fields = field.take(pa.array(start)).to_pylist()
            firsts = {f: None for f in fields}
            for f in firsts:
                total[f] = total.get(f, 0) + int(counts[[x == f for x in fields]].sum())
            # only runs that could enter a heap are turned into Python values
            keep = np.zeros(len(start), bool)
            keep[[0, -1]] = True
            names = np.array(fields, object)
            for f in firsts:
                own = np.flatnonzero(names == f)
                floor = heaps[f][0][0] if len(heaps.get(f, ())) == room else 0
                able = own[counts[own] >= floor]
                if len(able) > room:
                    cut = np.partition(counts[able], len(able) - room)[len(able) - room]
                    able = able[counts[able] >= cut]
                keep[able] = True
            kept = np.flatnonzero(keep)
            texts = item.take(pa.array(start[kept])).to_pylist()
            for k, text in zip(kept.tolist(), texts):
                run_ = (fields[k], text, int(counts[k]))
                if held is not None:
                    if held[0] == run_[0] and held[1] == run_[1]:
                        run_ = (run_[0], run_[1], run_[2] + held[2])
                    else:
                        close(held)
                    held = None
                if k == len(start) - 1:
                    held = run_
                else:
                    close(run_)
        if held is not None:
            close(held)
        out = [(f, item, n) for f, heap in heaps.items() for n, item in heap] + [(f, None, n) for f, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], names=["field", "item", "n"])

    return run


def _ranges(columns: dict[str, tuple[DataFrame, str]], room: int) -> DataFrame:
    """(field, item, n, rows): the room most frequent values of each range, and the rows of the whole field."""
    every = None
    for name, (df, column) in columns.items():
        one = df.select(F.lit(name).alias("field"), F.col(column).cast("string").alias("item")).filter("item is not null")
        every = one if every is None else every.unionByName(one)
    # written, as the range partitioner looks at its input before it reads it
    runs = table(every.sortWithinPartitions("field", "item").mapInArrow(_runs, _RUN), "runs")
    ranged = runs.repartitionByRange(stage_partitions(every.sparkSession), "field", "item").sortWithinPartitions("field", "item")
    best = ranged.mapInArrow(_best(room), _RUN)
    whole = Window.partitionBy("field")  # room + 1 rows of a field from each range at most
    return best.withColumn("rows", F.sum(F.when(F.col("item").isNull(), F.col("n"))).over(whole)).filter("item is not null")


def frequent_items(columns: dict[str, tuple[DataFrame, str]], share: float = 0.01) -> DataFrame:
    """(field, item, n, rows): each value in more than share of its column's non-null rows. columns: name -> (frame, column)."""
    return _ranges(columns, math.ceil(1 / share)).filter(F.col("n") > F.col("rows") * F.lit(share))


def top_items(columns: dict[str, tuple[DataFrame, str]], k: int = 10) -> DataFrame:
    """(field, item, n, place): the k most frequent values of each column, ties the greater value first."""
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("item").desc()))
    return _ranges(columns, k).withColumn("place", place).filter(F.col("place") <= k).select("field", "item", "n", "place")
