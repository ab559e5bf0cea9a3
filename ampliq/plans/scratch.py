"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a local session gets a folder of our own; a cluster, whose
    executors could not read each other's temporary folders, a RuntimeError."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="ampliq-shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def _clean() -> None:
    for spark, path in _written:
        drop_scratch(spark, path)


atexit.register(_clean)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, removed when the session ends."""
    path = f"{shared_dir(spark)}/ampliq-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(df written once as zstd parquet and read again, its folder, for drop_scratch once it is superseded)."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, name: str) -> DataFrame:
    """df written once as zstd parquet and read again: cuts the lineage and outlives lost executors."""
    return kept(df, name)[0]


def stage_partitions(spark: SparkSession, factor: int = 1) -> int:
    """Reducers of an explicit repartition: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * factor)
