"""Problem 2: entries with the same nucleotides written differently are collapsed and counted.

Method: bytes run through a skip-and-fold table into two polynomial hashes; no canonical string is made. Each Arrow
batch is pre-aggregated: of the rows that share both hashes and that a two-pointer comparison of the raw bytes finds
equal, the one of the smallest id stands for the others. Only those representatives meet their hash's reducer, with
their raw text, for the comparison there; the other rows travel spread over all reducers, so that a key holding a
third of all rows is one row per batch and key. The MD5 of the output is fed from the raw bytes in chunks.

Nulls, empty sequences and sequences without letters are never a copy of anything. Repeated rows (an id given twice)
stay separate rows, each counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.llm.nucleotides import Folded, first_of_key, same_letters
from ampliq.plans.scratch import stage_partitions

_SHIPPED = "entry_id bigint, h1 bigint, h2 bigint, copies bigint, spread bigint, sequence string, digest binary"
_ARROW = pa.schema(
    [("entry_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("copies", pa.int64()), ("spread", pa.int64()), ("sequence", pa.string()), ("digest", pa.binary())]
)
_OUT = "digest binary, entry_id bigint, copies bigint"
_OUT_ARROW = pa.schema([("digest", pa.binary()), ("entry_id", pa.int64()), ("copies", pa.int64())])


def _map(records: bool):
    """Rows to ship: representatives with their text and local count; unless for records, other rows with the digest only."""

    def run(batches):
        for batch in batches:
            f = Folded(batch.column(1))
            ids = batch.column(0)
            rows = np.flatnonzero(f.lengths > 0)
            if not len(rows):
                continue
            rows = rows[np.argsort(ids.fill_null(2**63 - 1).to_numpy()[rows], kind="stable")]
            h1, h2 = f.hashes()
            first = rows[first_of_key(h1[rows], h2[rows], np.arange(len(rows)))]
            first = np.where(f.same(rows, first), first, rows)  # a hash that deceives: the row stands for itself
            lead, group, count = np.unique(first, return_inverse=True, return_counts=True)
            other = np.flatnonzero((first != rows) & (not records))
            digest = {g: f.digest(int(lead[g])) for g in np.unique(group[other]).tolist()}
            n, m = len(lead), len(other)
            order = np.concatenate((lead, rows[other]))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(order)).cast(pa.int64()),
                    pa.array(h1[order]),
                    pa.array(h2[order]),
                    pa.array(np.concatenate((count, np.zeros(m, np.int64)))),
                    pa.array(np.concatenate((h1[lead], h1[rows[other]] ^ (np.arange(m) * 0x9E3779B1)))),
                    pa.concat_arrays([batch.column(1).cast(pa.string()).take(pa.array(lead)), pa.nulls(m, pa.string())]),
                    pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([digest[g] for g in group[other].tolist()], pa.binary())]),
                ],
                schema=_ARROW,
            )

    return run


class _Runs:
    """Walks representatives in the order of their hashes.

    A hash whose rows lie inside one batch and are all equal is settled there. The hash at a batch's either end may go
    on, and a hash may deceive: these keep one raw text a class until the hash ends.
    """

    def __init__(self, records: bool):
        self.records = records
        self.key: tuple[int, int] | None = None
        self.classes: list[dict] = []
        self.out: tuple[list, list, list] = ([], [], [])

    def write(self, digest: bytes, entry: int | None, copies: int | None) -> None:
        for column, x in zip(self.out, (digest, entry, copies)):
            column.append(x)

    def close(self) -> None:
        for c in self.classes:
            if self.records:
                self.write(c["digest"], c["id"], c["copies"])
        self.classes = []

    def add(self, f: Folded, row: int, key: tuple[int, int], entry: int | None, copies: int, known: dict | None) -> dict:
        """Puts a row into its class, which is known if the row equals one just added."""
        if key != self.key:
            self.close()
            self.key = key
        c = known
        if c is None:
            text = f.text(row)
            c = next((c for c in self.classes if same_letters(c["text"], text)), None)
            if c is None:
                c = {"text": text, "digest": f.digest(row), "id": entry, "copies": 0, "waiting": []}
                self.classes.append(c)
        c["copies"] += copies
        c["id"] = entry if c["id"] is None else c["id"] if entry is None else min(c["id"], entry)
        if not self.records:
            c["waiting"].append(entry)
            if c["copies"] > 1:
                for x in c["waiting"]:
                    self.write(c["digest"], x, None)
                c["waiting"] = []
        return c

    def reduce(self, batch) -> pa.RecordBatch:
        copies = batch.column(3).to_numpy()
        shipped = pa.array(np.flatnonzero(copies == 0))
        ready = pa.RecordBatch.from_arrays([batch.column(6).take(shipped), batch.column(0).take(shipped), pa.nulls(len(shipped), pa.int64())], schema=_OUT_ARROW)
        rows = np.flatnonzero(copies > 0)
        if len(rows):
            f = Folded(batch.column(5))
            h1, h2, copies = batch.column(1).to_numpy()[rows], batch.column(2).to_numpy()[rows], copies[rows]
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            start = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            ends = np.append(start[1:], len(rows))
            same = f.same(rows, np.repeat(rows[start], ends - start))
            total = np.add.reduceat(copies, start)
            whole = np.logical_and.reduceat(same, start)
            whole[[0, -1]] = False
            if not self.records:  # a single row in its hash is no copy
                settled = np.flatnonzero(whole & (total > 1))
            else:
                settled = np.flatnonzero(whole)
            for k in settled.tolist():
                a, b = int(start[k]), int(ends[k])
                digest = f.digest(int(rows[a]))
                if self.records:
                    known = [i for i in ids[a:b] if i is not None]
                    self.write(digest, min(known) if known else None, int(total[k]))
                else:
                    for i in ids[a:b]:
                        self.write(digest, i, None)
            for k in np.flatnonzero(~whole).tolist():
                mine = None
                for j in range(int(start[k]), int(ends[k])):
                    c = self.add(f, int(rows[j]), (int(h1[j]), int(h2[j])), ids[j], int(copies[j]), mine if mine is not None and same[j] else None)
                    mine = mine or c
        return pa.concat_batches([ready, self.flush()])

    def flush(self) -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.out, (pa.binary(), pa.int64(), pa.int64()))], schema=_OUT_ARROW)
        self.out = ([], [], [])
        return got


def _reduce(records: bool):
    def run(batches):
        runs = _Runs(records)
        for batch in batches:
            yield runs.reduce(batch)
        runs.close()
        yield runs.flush()

    return run


def _met(df: DataFrame, key: str, text: str, records: bool) -> DataFrame:
    shipped = df.select(F.col(key).cast("bigint").alias("entry_id"), F.col(text).cast("string").alias("sequence")).mapInArrow(_map(records), _SHIPPED)
    met = shipped.repartition(stage_partitions(df.sparkSession), F.col("spread")).sortWithinPartitions("h1", "h2").mapInArrow(_reduce(records), _OUT)
    return met.select(F.lower(F.hex("digest")).alias("sequence_md5"), "entry_id", "copies")


def duplicate_entries(df: DataFrame, key: str = "entry_id", text: str = "sequence") -> DataFrame:
    """(sequence_md5, entry_id) of every row whose nucleotides stand in at least two rows."""
    return _met(df, key, text, False).select("sequence_md5", "entry_id")


def collapse(df: DataFrame, key: str = "entry_id", text: str = "sequence") -> DataFrame:
    """One record per nucleotide string, those that stand in one row too: sequence_md5, entry_id (the smallest), copies."""
    return _met(df, key, text, True)


def true_flags(df: DataFrame, key: str = "entry_id", text: str = "sequence") -> DataFrame:
    """(entry_id, has_duplicates) of every row of df: whether another row has the same nucleotides. Ids are unique."""
    found = duplicate_entries(df, key, text).select("entry_id", F.lit(True).alias("found")).dropDuplicates(["entry_id"])
    return df.select(F.col(key).alias("entry_id")).join(found, "entry_id", "left").select("entry_id", F.coalesce("found", F.lit(False)).alias("has_duplicates"))
