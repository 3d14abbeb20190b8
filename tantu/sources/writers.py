"""Sinks: JSON lines, tables by shard, vocabulary files, matrices, reports, append-only manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tantu.operators.registry import latest


#: Names of codecs that Spark's JSON writer knows by class only; the cluster's Hadoop needs its native library for them.
CODECS = {"zstd": "org.apache.hadoop.io.compress.ZStandardCodec"}


def write_json_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """compression none, gzip, bzip2 or zstd; readers tell it from the suffix."""
    compression = CODECS.get(compression, compression)
    df.write.mode("overwrite").option("compression", compression).json(path)


def write_sharded(df: DataFrame, path: str, key: str = "id") -> None:
    """Parquet in folders by the first two characters of the key."""
    df.withColumn("shard", F.lpad(F.substring(key, 1, 2), 2, "0")).write.mode("overwrite").partitionBy("shard").parquet(path)


def write_vocabulary(df: DataFrame, path: str) -> None:
    df.select("idx", "lemma", "tf", "df").write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_matrix(entries: DataFrame, rows: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    rows.write.mode("overwrite").parquet(f"{path}/rows")


def write_svd(svd, path: str, stats: dict | None = None) -> None:
    """u, sigma and v, and, if there are any, stats as JSON beside them."""
    for name in ("u", "sigma", "v"):
        getattr(svd, name).write.mode("overwrite").parquet(f"{path}/{name}")
    if stats is not None:
        write_report(svd.sigma.sparkSession, stats, f"{path}/stats")


def write_embeddings(vectors: DataFrame, path: str, meta: dict | None = None) -> None:
    """(idx, vec) as a table, and meta as JSON beside it."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    write_report(vectors.sparkSession, meta or {}, f"{path}/meta")


def report_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(report, default=str, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_manifest(records: DataFrame, path: str) -> None:
    """Records appended as JSON lines with the time they were marked; earlier lines stay."""
    records.withColumn("marked_at", F.current_timestamp()).write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """The last record of every key."""
    return latest(spark.read.schema(f"{schema}, marked_at timestamp").json(path), key, "marked_at").drop("marked_at")
