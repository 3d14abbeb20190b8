"""Numbering and joins that no hot key and no large table turns into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tantu.session import materialise, shuffle_partitions

#: Rows of one key that lie in one task at most.
KEY_ROWS = 1_000_000
#: The bits of a monotonically increasing id that count within its partition.
WITHIN = 33


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of the order, written, with __part, the range, and __at, the place in it from 0. Equal rows may lie in two ranges."""
    n = shuffle_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = materialise(placed, "ranged")
    return placed.withColumn("__part", F.shiftright("__id", WITHIN)).withColumn("__at", F.col("__id").bitwiseAND(2**WITHIN - 1)).drop("__id")


def _before(placed: DataFrame, size: Column) -> DataFrame:
    """(__part, __before): what the ranges ahead add up to. As many rows as there are shuffle partitions, one window and a broadcast hold them."""
    sizes = placed.groupBy("__part").agg(size.alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sizes.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before")))


def numbered(df: DataFrame, *order: Column, out: str = "idx") -> DataFrame:
    """df with ``out``, the number from 0 of each row in the order given, which should leave no ties.

    The rows are cut into ranges, numbered within each, and the ranges' sizes added: no task has more than a range.
    """
    placed = _ranged(df, list(order))
    return placed.join(_before(placed, F.count("*")), "__part").withColumn(out, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def spread_join(big: DataFrame, small: DataFrame, key: str, most_of_a_key: int) -> DataFrame:
    """big joined with small, which has one row for each key, on ``key``.

    most_of_a_key is how many rows of big one key may have. The rows of a key are spread over so many tasks that none has more than
    KEY_ROWS of them, and small is repeated as often.
    """
    salts = 1 + most_of_a_key // KEY_ROWS
    if salts == 1:
        return big.join(small, key)
    spread = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return spread.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "__salt"]).drop("__salt")


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the rank from 1 of the column, equal values at their mean rank. Values are counted first, then ranked in ranges."""
    values = _ranged(df.groupBy(column).agg(F.count("*").alias("__rows")), [F.col(column)])
    upto = F.sum("__rows").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    ranks = values.withColumn("__upto", F.coalesce(upto, F.lit(0))).join(_before(values, F.sum("__rows")), "__part")
    ranks = ranks.select(column, (F.col("__before") + F.col("__upto") + (F.col("__rows") + 1) / 2).alias(out))
    most = values.agg(F.coalesce(F.max("__rows"), F.lit(0))).first()[0]
    return spread_join(df, ranks, column, most)
