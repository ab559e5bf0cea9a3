"""Problem 6: how often every distinct value occurs, under how many records, and which are too rare or too common.

Method: heavy-light aggregation. Values that hold a large part of a bounded hashed sample of the rows are the heavy
ones (at most 1 / HEAVY of a column); they are broadcast and counted in exact local arrays, of which a partition sends
one row a value. Of the other values every row is shuffled, as (value, record id, rows), combined by batch before. The
sample decides where a value is counted, never how.

A record may have several rows, so every record id is shuffled once, with the numbers of its heavy values and not with
the values: under an id of more than one row a value counts once, and what the arrays counted beyond that is taken
off. A record id that is null is not shuffled: it counts as rows, not as a record. Ids and values meet in one shuffle,
each spread by its own hash, so that neither a hot value nor null ids make a hot reducer. Null values are not counted;
the empty text is a value. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.functions.bytescan import flat, mix64, row_sums
from ampliq.plans.scratch import stage_partitions, table

HEAVY = 0.004
SAMPLE = 200_000


#: kind 0: a record id with the numbers of its heavy values; 1: a value that is not heavy; 2: a count of a heavy value.
_SHIPPED = "kind int, field int, item string, _id string, codes binary, n bigint, with_id bigint, spread bigint"
_ARROW = pa.schema([("kind", pa.int32()), ("field", pa.int32()), ("item", pa.string()), ("_id", pa.string()), ("codes", pa.binary()), ("n", pa.int64()), ("with_id", pa.int64()), ("spread", pa.int64())])
_COUNTED = "field int, item string, code int, rows bigint, records bigint"
_COUNTED_ARROW = pa.schema([("field", pa.int32()), ("item", pa.string()), ("code", pa.int32()), ("rows", pa.int64()), ("records", pa.int64())])


def _hash(column: pa.Array) -> np.ndarray:
    """64 bits of every text by its bytes."""
    data, offsets, _ = flat(column)
    power = np.multiply.accumulate(np.full(max(1, int(np.diff(offsets).max(initial=1))), 0x9E3779B97F4A7C15, np.uint64))
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return mix64(row_sums((data.astype(np.uint64) + np.uint64(1)) * power[at], offsets)).view(np.int64)


def _batch(kind: int, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()) if f.name == "kind" else columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _ARROW], schema=_ARROW)


def _ship(fields: int, heavy: list[list[str]]):
    def run(batches):
        sets = [pa.array(h, pa.string()) for h in heavy]
        rows, with_id = ([np.zeros(len(h), np.int64) for h in heavy] for _ in range(2))
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            codes = np.full((batch.num_rows, fields), -1, np.int16)
            for f in range(fields):
                item = batch.column(f + 1)
                if len(sets[f]):
                    at = pc.fill_null(pc.index_in(item, value_set=sets[f], skip_nulls=True), -1).to_numpy(zero_copy_only=False)
                    codes[:, f] = at
                    rows[f] += np.bincount(at[at >= 0], minlength=len(sets[f]))
                    with_id[f] += np.bincount(at[(at >= 0) & known], minlength=len(sets[f]))
                light = pa.array((codes[:, f] < 0)) if item.null_count == 0 else pc.and_(pa.array(codes[:, f] < 0), item.is_valid())
                got = pa.table({"item": item, "_id": ids}).filter(light).group_by(["item", "_id"]).aggregate([([], "count_all")]).combine_chunks()
                if len(got):
                    values = got.column("item").combine_chunks()
                    yield _batch(1, len(got), field=pa.array([f] * len(got), pa.int32()), item=values, _id=got.column("_id").combine_chunks(), n=got.column("count_all").combine_chunks(), spread=pa.array(_hash(values)))
            binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * fields), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            got = pa.table({"_id": ids, "codes": binary}).filter(pa.array(known)).group_by(["_id", "codes"]).aggregate([([], "count_all")]).combine_chunks()
            if len(got):
                names = got.column("_id").combine_chunks()
                yield _batch(0, len(got), _id=names, codes=got.column("codes").combine_chunks(), n=got.column("count_all").combine_chunks(), spread=pa.array(_hash(names)))
        for f in range(fields):
            some = np.flatnonzero(rows[f])
            yield _batch(2, len(some), field=pa.array([f] * len(some), pa.int32()), _id=pa.array(some.astype(str), pa.string()), n=pa.array(rows[f][some]), with_id=pa.array(with_id[f][some]), spread=pa.array(some * 0x9E3779B1))

    return run


def _counted(field, item, code, rows, records) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(field, pa.int32()), pa.nulls(n, pa.string()) if item is None else item, pa.nulls(n, pa.int32()) if code is None else pa.array(code, pa.int32()), pa.array(rows, pa.int64()), pa.array(records, pa.int64())], schema=_COUNTED_ARROW)


def _changes(*columns) -> np.ndarray:
    """Where a row differs from the one before; nulls are alike."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def _count(fields: int):
    """Rows sorted by kind, field, item and id to counts: of values in full, of heavy ones and records in part.

    Field -1 counts the records. A run that goes on into the next batch is held back, as its sums and not as its rows.
    """

    def run(batches):
        records = 0
        excess: dict[tuple[int, int], int] = {}
        same_id: tuple[str, dict] | None = None  # the id at hand and the rows of each of its heavy values
        value = None  # the value at hand: field, text, rows, ids, its last id

        def close_id():
            nonlocal records
            if same_id is not None:
                records += 1
                for k, n in same_id[1].items():
                    if n > 1:
                        excess[k] = excess.get(k, 0) + n - 1

        for batch in batches:
            kind = batch.column(0).to_numpy()
            ids = batch.slice(0, int(np.searchsorted(kind, 0, "right")))
            if ids.num_rows:
                names, codes, n = ids.column(3), np.frombuffer(b"".join(ids.column(4).to_pylist()), np.int16).reshape(-1, fields), ids.column(5).to_numpy()
                start = np.flatnonzero(_changes(names))
                rows = np.add.reduceat(n, start)
                size = np.diff(np.append(start, len(n)))
                alone = (size == 1) & (rows == 1)
                alone[[0, -1]] = False  # may go on
                records += int(alone.sum())
                for k in np.flatnonzero(~alone).tolist():
                    name = names[int(start[k])].as_py()
                    if same_id is None or same_id[0] != name:
                        close_id()
                        same_id = (name, {})
                    for r in range(start[k], start[k] + size[k]):
                        for f in range(fields):
                            if codes[r, f] >= 0:
                                key = (f, int(codes[r, f]))
                                same_id[1][key] = same_id[1].get(key, 0) + int(n[r])
            a, b = (int(np.searchsorted(kind, k, "right")) for k in (0, 1))
            light = batch.slice(a, b - a)
            if light.num_rows:
                field, item, name, n = light.column(1), light.column(2), light.column(3), light.column(5).to_numpy()
                new = _changes(field, item)
                fresh = (new | _changes(name)) & name.is_valid().to_numpy(zero_copy_only=False)
                start = np.flatnonzero(new)
                rows, held = np.add.reduceat(n, start), np.add.reduceat(fresh.astype(np.int64), start)
                end = np.append(start[1:], len(n)) - 1
                top = (field[0].as_py(), item[0].as_py())
                if value is not None and value[:2] == top:
                    rows[0] += value[2]
                    held[0] += value[3] - (name[0].is_valid and name[0].as_py() == value[4])
                elif value is not None:
                    yield _counted([value[0]], pa.array([value[1]], pa.string()), None, [value[2]], [value[3]])
                last = int(end[-1])
                value = (field[last].as_py(), item[last].as_py(), int(rows[-1]), int(held[-1]), name[last].as_py())
                yield _counted(field.take(pa.array(start[:-1])), item.take(pa.array(start[:-1])), None, rows[:-1], held[:-1])
            own = batch.slice(b)
            if own.num_rows:
                yield _counted(own.column(1), None, pc.cast(own.column(3), pa.int32()), own.column(5), own.column(6))
        close_id()
        if value is not None:
            yield _counted([value[0]], pa.array([value[1]], pa.string()), None, [value[2]], [value[3]])
        keys = sorted(excess)
        yield _counted([k[0] for k in keys], None, [k[1] for k in keys], [0] * len(keys), [-excess[k] for k in keys])
        yield _counted([-1], None, [0], [0], [records])

    return run


def heavy_values(df: DataFrame, names: list[str], share: float = HEAVY, sample: int = SAMPLE) -> dict[str, list[str]]:
    """Values in at least share of about sample rows, which their ids' hashes choose; at most 1 / share a column."""
    n = df.count()
    step = max(1, n // sample)
    some = df.filter(F.pmod(F.xxhash64("_id"), F.lit(step)) == 0) if step > 1 else df
    long = some.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in names])).alias("x")).select("x.*").filter("item is not null")
    rows = long.groupBy("field", "item").count().filter(F.col("count") >= max(2, share * min(n, n // step))).collect()
    out: dict[str, list[str]] = {f: [] for f in names}
    for r in rows:
        out[r["field"]].append(r["item"])
    return out


def term_counts(df: DataFrame, columns: list[str], record: str = "row_id", common: float = 0.05) -> DataFrame:
    """(field, item, rows, records, mark): every distinct non-null value of the columns, as text.

    mark is rare under exactly one record id, common under more than that part of all record ids, else null.
    """
    spark = df.sparkSession
    names = [f"c{k}" for k in range(len(columns))]
    rows = df.select(F.col(record).cast("string").alias("_id"), *[F.col(c).cast("string").alias(n) for c, n in zip(columns, names)])
    found = heavy_values(rows, names)
    heavy = [found[n] for n in names]
    shipped = rows.mapInArrow(_ship(len(columns), heavy), _SHIPPED)
    met = shipped.repartition(stage_partitions(spark), "spread").sortWithinPartitions("kind", "field", "item", "_id")
    counted = table(met.mapInArrow(_count(len(columns)), _COUNTED), "terms")
    # heavy values and the total: one row a value and partition here, 1 / HEAVY rows a column on the driver
    parts = counted.filter("code is not null").groupBy("field", "code").agg(F.sum("rows").alias("rows"), F.sum("records").alias("records")).collect()
    total = sum(r["records"] for r in parts if r["field"] < 0)
    big = [(r["field"], heavy[r["field"]][r["code"]], r["rows"], r["records"]) for r in parts if r["field"] >= 0 and r["rows"] > 0]
    every = counted.filter("code is null").select("field", "item", "rows", "records").unionByName(spark.createDataFrame(big, "field int, item string, rows bigint, records bigint"))
    return every.select(
        F.element_at(F.array(*map(F.lit, columns)), F.col("field") + 1).alias("field"),
        "item",
        "rows",
        "records",
        F.when(F.col("records") == 1, "rare").when(F.col("records") > F.lit(common) * F.lit(total), "common").alias("mark"),
    )
