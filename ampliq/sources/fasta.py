"""FASTA files as rows (header, sequence)."""

from __future__ import annotations

import re
import sys
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.plans.options import AmpliconError


def _first_bytes(spark: SparkSession, paths: list[str]) -> None:
    """Every file that is not empty begins with '>'. One byte of each file is read, many files at a time."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def files(name: str) -> list:
        at = jvm.org.apache.hadoop.fs.Path(name)
        fs = at.getFileSystem(conf)
        found = []
        for status in fs.globStatus(at) or []:
            if status.isFile():
                found.append(status.getPath())
            else:
                inner = fs.listFiles(status.getPath(), True)
                while inner.hasNext():
                    path = inner.next().getPath()
                    if not path.getName().startswith(("_", ".")):
                        found.append(path)
        return found

    def first(path) -> tuple[str, int]:
        stream = path.getFileSystem(conf).open(path)
        codec = codecs.getCodec(path)
        byte = (codec.createInputStream(stream) if codec else stream).read()
        stream.close()
        return path.getName(), byte

    with ThreadPoolExecutor(32) as pool:
        for name, byte in pool.map(first, [f for found in pool.map(files, paths) for f in found]):
            if byte not in (-1, ord(">")):
                raise AmpliconError(f"Illegal header line in {name}, line 1: it must start with >")


def _without_mark(batches):
    """The > at the very start of a file taken off; other records have lost theirs to the separator, and what they
    start with belongs to the header."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start, name, value = batch.columns
        new = np.ones(batch.num_rows, bool)
        same = pc.and_(pc.equal(path.slice(1), path.slice(0, len(path) - 1)), pc.equal(start.slice(1), start.slice(0, len(start) - 1)))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
        new[0] = (path[0].as_py(), start[0].as_py()) != last
        last = (path[-1].as_py(), start[-1].as_py())
        at = np.flatnonzero(new & (start.to_numpy() == 0))
        if len(at):
            mask = np.zeros(batch.num_rows, bool)
            mask[at] = True
            value = pc.replace_with_mask(value, pa.array(mask), pa.array([x.removeprefix(">") for x in value.take(pa.array(at)).to_pylist()], value.type))
        yield pa.RecordBatch.from_arrays([path, name, value], names=["file_path", "file_name", "value"])


def split_records(records: DataFrame, value: str = "value") -> DataFrame:
    """header and sequence of records that run from one header to the next, without the > that begins them.

    The header ends at the first space, carriage return or line feed; a tab belongs to it. The sequence is in upper
    case with U as T; a NUL ends its line. Other characters stay, for the check.
    """
    text = F.col(value)
    body = F.regexp_replace(F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(""), "\u0000[^\n]*", "")
    rest = [c for c in records.columns if c != value]
    return records.select(
        *rest,
        F.regexp_extract(text, r"^([^ \r\n]*)", 1).alias("header"),
        F.replace(F.upper(F.regexp_replace(body, "[\r\n]", "")), F.lit("U"), F.lit("T")).alias("sequence"),
    )


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_path, file_name, header, sequence) of plain or compressed files; "-" is standard input. Empty files give no rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if paths == ["-"]:
        text = sys.stdin.read()
        if text and not text.startswith(">"):
            raise AmpliconError("Illegal header line: it must start with >")
        records = spark.createDataFrame([("-", "-", r) for r in text[1:].split("\n>")] if text else [], "file_path string, file_name string, value string")
        return split_records(records)
    _first_bytes(spark, paths)
    lines = spark.read.option("lineSep", "\n>").text(paths).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("start"), "_metadata.file_name", "value")
    return split_records(lines.mapInArrow(_without_mark, "file_path string, file_name string, value string")).select("file_path", "file_name", "header", "sequence")


def line_of(spark: SparkSession, paths: str | list[str], header: str) -> tuple[str, int] | None:
    """(file, line number from 1) of the first entry of that header, for a message; two jobs over the files."""
    rows = spark.read.text(paths).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"), "value")
    place = F.struct("file_path", "start", "m")
    hit = rows.filter((F.substring("value", 1, 1) == ">") & (F.regexp_extract("value", r"^>([^ \r\n]*)", 1) == header)).agg(F.min(place).alias("at")).first()["at"]
    if hit is None:
        return None
    before = rows.filter((F.col("file_path") == hit["file_path"]) & (F.struct("start", "m") < F.struct(F.lit(hit["start"]).alias("start"), F.lit(hit["m"]).alias("m")))).count()
    return hit["file_path"], before + 1


def read_samples(spark: SparkSession, paths: list[str], pattern: str = r"([^/]+?)(?:\.[^./]*)?$") -> tuple[DataFrame, list[str]]:
    """(rows with a sample column, samples named by more than one of paths).

    pattern: its first group finds a sample in the path of a file; a file's name without extension if not given.
    """
    names = [m.group(1) for m in (re.search(pattern, p) for p in paths) if m]
    twice = sorted({n for n in names if names.count(n) > 1})
    return read_fasta(spark, paths).withColumn("sample", F.regexp_extract("file_path", pattern, 1)), twice
