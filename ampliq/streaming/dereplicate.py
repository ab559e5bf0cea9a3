"""Dereplication that keeps up with arriving entries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.plans.scratch import new_path


def running_dereplication(stream: DataFrame, sequence: str = "sequence", abundance: str = "abundance") -> DataFrame:
    """(sequence, size, mass) so far, of a streaming or batch frame; its state grows with the distinct sequences.

    Null and empty sequences are left out; a null abundance counts as 1.
    """
    return stream.filter(F.col(sequence) != "").groupBy(F.col(sequence).alias("sequence")).agg(F.count(F.lit(1)).alias("size"), F.sum(F.coalesce(F.col(abundance), F.lit(1))).alias("mass"))


def dereplicate_folder(spark: SparkSession, path: str, schema: str, prepare, files_per_batch: int = 8, home: str | None = None) -> DataFrame:
    """Runs the stream over the parquet files in path that are new since the last call with the same home; returns the whole table.

    prepare maps the stream to sequence and abundance. home, a shared folder, holds the stream's state and its results:
    a batch writes only the sequences it changed, under its number, so that a batch done again after a failure replaces
    itself; the last number of a sequence holds. Without home all files are read, into a scratch folder.
    """
    home = home or new_path(spark, "stream")
    schema_out = "sequence string, size bigint, mass bigint, batch bigint"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{home}/changes/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    running = running_dereplication(prepare(source)).writeStream.outputMode("update").option("checkpointLocation", f"{home}/state")
    running.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    try:
        changes = spark.read.schema(schema_out).parquet(f"{home}/changes")
    except AnalysisException:  # no file has come yet
        changes = spark.createDataFrame([], schema_out)
    return changes.groupBy("sequence").agg(F.max_by(F.struct("size", "mass"), "batch").alias("x")).select("sequence", "x.size", "x.mass")
