"""Problem 4: rows that fail to parse are separated, with the reason, from the typed rows.

Method: structural indexing. A batch of lines is one byte array; quote masks and the prefix parity of the quotes
before each byte tell which commas delimit. Quoting is sound exactly when the quotes of the line are even in number
and each field between delimiters has none, or opens and closes with one and holds others only as adjacent pairs.
Counts and types are then checked on the columns, in the JVM. Each line is one record and may hold line breaks
inside quotes; the lines' own order of checks gives the one reason reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.functions.bytescan import binary_column, flat, row_sums, rows_of

FIELDS = ("lineno", "header", "missingabundance", "sequence", "sample")


def index_lines(column, width: int) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """(quoting is sound, number of fields, the first width fields without their quotes) of each line.

    Fields are null in lines that are unsound or of another width.
    """
    data, offsets, _ = flat(column)
    n = len(offsets) - 1
    begin, end = offsets[:-1].copy(), offsets[1:].copy()
    some = np.flatnonzero(end > begin)
    end[some[data[end[some] - 1] == 13]] -= 1  # one carriage return at the end
    row = rows_of(offsets)
    quote = data == 34
    total = np.concatenate(([0], np.cumsum(quote)))  # quotes before each byte
    parity = (total[:-1] - total[begin][row]) & 1
    comma = np.flatnonzero((data == 44) & (parity == 0))
    fields = np.bincount(row[comma], minlength=n) + 1
    # limits of all fields, in order
    owner = np.concatenate((np.arange(n), row[comma]))
    starts = np.concatenate((begin, comma + 1))
    starts = starts[np.lexsort((starts, owner))]
    stops = np.concatenate((comma, end))
    stops = stops[np.lexsort((stops, np.concatenate((row[comma], np.arange(n)))))]
    limits = np.concatenate(([0], np.cumsum(fields)))
    # quotes by field: none, or one at either end and pairs between them
    held = total[stops] - total[starts]
    opened = held > 0
    edge = lambda at: np.where(opened, data[np.clip(at, 0, max(0, len(data) - 1))] == 34, True) if len(data) else np.ones(len(starts), bool)
    sound = edge(starts) & edge(stops - 1) & (held % 2 == 0)
    at = np.flatnonzero(quote)
    field_of = np.searchsorted(starts, at, "right") - 1
    place = np.arange(len(at)) - total[starts[field_of]] if len(at) else at
    apart = np.append(True, at[1:] - at[:-1] != 1)[: len(at)]
    sound[field_of[(place % 2 == 0) & (place > 0) & apart]] = False
    good = row_sums((~sound).astype(np.int64), limits) == 0
    # of a sound field's quotes the second of each pair stays
    kept = np.ones(len(data), bool)
    kept[at[(place % 2 == 1) | (place == 0)]] = False
    whole = np.flatnonzero(good & (fields == width))
    to = np.full(n, -1, np.int64)
    to[whole] = np.arange(len(whole))
    to = pa.array(to, mask=to < 0)
    out = []
    for k in range(width):
        f = limits[whole] + k
        size = stops[f] - starts[f]
        ends = np.concatenate(([0], np.cumsum(size)))
        byte = np.repeat(starts[f] - ends[:-1], size) + np.arange(ends[-1])
        stay = kept[byte]
        cut = np.concatenate(([0], np.cumsum(stay)))[ends]
        out.append(binary_column(data[byte[stay]], cut).cast(pa.string()).take(to))
    return good, fields, out


def _index(width: int):
    def run(batches):
        for batch in batches:
            good, fields, out = index_lines(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good), pa.array(fields.astype(np.int32)), *out], names=[*batch.schema.names, "_sound", "_fields", *[f"_{k}" for k in range(width)]])

    return run


def read_entries(df: DataFrame, line: str = "line", key: str = "line_id") -> DataFrame:
    """Every line once: key, reason (null for a valid line), lineno, header, label, abundance, missingabundance, sequence, sample.

    Typed columns are null in faulty lines. A null line counts as an empty one, which has one field: reason columns.
    Repeated lines stay separate. The sequence comes out in upper case, U as T, without line breaks.
    """
    source = df.select(F.coalesce(F.col(line).cast("string"), F.lit("")).alias("_line"), F.col(key).alias(key))
    kind = dict(source.dtypes)[key]
    names = ", ".join(f"_{k} string" for k in range(5))
    cut = source.mapInArrow(_index(5), f"_line string, `{key}` {kind}, _sound boolean, _fields int, {names}")
    c = F.col
    head = F.substring_index(c("_1"), " ", 1)
    # 18 digits at most keep every number inside a bigint
    digits18 = r"^[0-9]{1,18}\z"
    cut = cut.withColumn("_head", head).withColumn("_parts", F.split("_head", ";"))
    cut = cut.withColumn("_size", F.array_position(F.transform("_parts", lambda p: p.rlike(r"^size=[0-9]+\z")), F.lit(True)))
    other = F.array_join(F.filter("_parts", lambda p, i: i != F.col("_size").cast("int") - 1), ";")
    tail = c("_head").rlike(r"(?s)_[0-9]*\z")
    cut = cut.withColumn(
        "_note",
        F.when(c("_size") > 0, F.substring(F.get("_parts", c("_size").cast("int") - 1), 6, 2**31 - 1)).when(tail, F.substring_index("_head", "_", -1)),
    ).withColumn(
        "_label",
        F.when(c("_size") > 0, F.regexp_replace(other, r"^;+|;+\z", "")).when(tail, F.regexp_replace("_head", r"_[0-9]*\z", "")).otherwise(c("_head")),
    )
    zero = lambda x: x.rlike(r"^0+\z")
    bare = F.regexp_replace("_3", "[\r\n]", "")
    annotated = c("_note").isNotNull()
    cut = cut.withColumn(
        "reason",
        F.when(~c("_sound"), "quoting")
        .when(c("_fields") != 5, "columns")
        .when(~c("_0").rlike(digits18) | zero(c("_0")), "lineno")
        .when((c("_label") == "") | (annotated & (~c("_note").rlike(digits18) | zero(c("_note")))), "header")
        .when(~c("_2").isin("0", "1") | ((c("_2") == "1") == annotated), "missingabundance")
        .when(~bare.rlike(r"^[ACGTUacgtu]+\z"), "sequence"),
    )
    ok = c("reason").isNull()
    return cut.select(
        c(key),
        "reason",
        F.when(ok, c("_0").try_cast("bigint")).alias("lineno"),
        F.when(ok, c("_1")).alias("header"),
        F.when(ok, c("_label")).alias("label"),
        F.when(ok, c("_note").try_cast("bigint")).alias("abundance"),
        F.when(ok, c("_2").try_cast("int")).alias("missingabundance"),
        F.when(ok, F.replace(F.upper(bare), F.lit("U"), F.lit("T"))).alias("sequence"),
        F.when(ok, c("_4")).alias("sample"),
    )


def rejects(df: DataFrame, line: str = "line", key: str = "line_id") -> DataFrame:
    """(key, reason) of the faulty lines."""
    return read_entries(df, line, key).filter("reason is not null").select(key, "reason")


def valid_entries(df: DataFrame, line: str = "line", key: str = "line_id") -> DataFrame:
    """The typed rows of the valid lines."""
    return read_entries(df, line, key).filter("reason is null").drop("reason")
