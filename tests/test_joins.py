"""Numbering, ranks and spread joins against brute force, with ties, nulls, hot keys and empty tables."""

import random

from pyspark.sql import functions as F

from tantu.operators import joins
from tantu.session import materialise, release, shared_dir


def test_numbered(spark):
    rows = [(random.Random(i).randint(0, 3), f"w{i:04}", i) for i in range(500)] + [(None, "n", 500)]
    df = spark.createDataFrame(rows, "tf int, word string, idx int").withColumnRenamed("idx", "__x")
    got = [r["word"] for r in joins.numbered(df, F.desc("tf"), F.col("word")).orderBy("idx").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (-(-1 if r[0] is None else r[0]), r[1]))]
    assert [r["idx"] for r in joins.numbered(df, F.desc("tf"), F.col("word")).orderBy("idx").collect()] == list(range(501))
    assert joins.numbered(df.limit(0), F.col("word")).count() == 0


def test_average_rank(spark):
    values = [1.0] * 400 + [2.0, 2.0, 5.0] + [float(i) for i in range(10, 60)]
    got = {r["x"]: r["rank"] for r in joins.average_rank(spark.createDataFrame([(v,) for v in values], "x double"), "x", "rank").collect()}
    assert got == {v: sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in set(values)}


def test_spread_join(spark, monkeypatch):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [("b", 1), (None, 2)], "key string, n int")
    small = spark.createDataFrame([("hot", 9), ("b", 8), ("c", 7)], "key string, v int")
    want = sorted(map(tuple, big.join(small, "key").collect()))
    monkeypatch.setattr(joins, "KEY_ROWS", 40)
    out = joins.spread_join(big, small, "key", 300)
    assert sorted(map(tuple, out.collect())) == want and out.columns == ["key", "n", "v"]


def test_release_deletes_what_was_written(spark):
    release()
    df = materialise(spark.range(3), "some")
    assert df.count() == 3 and release() == 1 and release() == 0
    assert not spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + "/some").getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + "/some-*"))
