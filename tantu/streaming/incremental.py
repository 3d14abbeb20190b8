"""Incremental processing: what is new is processed once and upserted, then the stream ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tantu.operators.registry import latest


def process_new(
    spark: SparkSession,
    source: str,
    schema: str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    *,
    format: str = "parquet",
    files_at_once: int = 1000,
) -> None:
    """Transform the files of source that no earlier call has seen and append the rows with the number of their batch.

    The checkpoint, in a folder all executors share, holds what was seen; a batch that is run again after a
    failure overwrites its own folder, so that rows are never doubled.
    """
    stream = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_at_once).load(source)

    def sink(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, key: str | list[str]) -> DataFrame:
    """The rows of the latest batch of every key: an upsert read."""
    return latest(spark.read.parquet(target), key, "batch").drop("batch")


def running_counts(spark: SparkSession, source: str, schema: str, term: str, target: str, checkpoint: str) -> None:
    """Term counts of new files, as increments by batch; their sum is the count over everything seen."""
    process_new(spark, source, schema, lambda b: b.groupBy(term).agg(F.count("*").alias("n")), target, checkpoint)
