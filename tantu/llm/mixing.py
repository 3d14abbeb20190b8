"""Problem 9: a mixture of sources with target shares of all tokens and capped repetition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tantu.session import shuffle_partitions

#: Tokens of a block, slots of an output shard, shards summed together on the way to a source's slot numbers.
BLOCK, SHARD_SLOTS, SHARD_GROUP = 4096, 4096, 1024
ROUNDS = 4
#: Sources a mixture may have: their shares go to every task that draws.
MOST_SOURCES = 100_000


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for every key: Feistel rounds on the next even number of bits, walked until below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right, h, m, k = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo], key[todo]
            for r in range(ROUNDS):
                f = (right + k + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f >> np.uint64(32)) & m)
            x[todo] = (left << h) | right
            todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def token_blocks(docs: DataFrame, *, block: int = BLOCK, text: str = "text") -> DataFrame:
    """(source, block_no, doc_id, start, n): the texts of each source laid end to end and cut into blocks of ``block`` tokens.

    A token is one UTF-8 byte. start and n are the bytes of the text that lie in the block. The order is
    that of (bucket, doc_id); the offsets of a source are summed in two levels, within buckets and over
    them, so that a source with a third of all rows is still many groups. Rows of null source and empty
    or null texts are in no block.
    """
    buckets = shuffle_partitions(docs.sparkSession)
    sized = docs.select("source", "doc_id", F.octet_length(F.col(text)).cast("long").alias("n")).filter("n > 0 AND source IS NOT NULL")
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("n").over(within))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("source", "bucket").agg(F.sum("n").alias("sum_n")).select(
        "source",
        "bucket",
        F.coalesce(F.sum("sum_n").over(before), F.lit(0)).alias("offset"),
    )
    placed = placed.join(offsets, ["source", "bucket"]).withColumn("first", F.col("offset") + F.col("upto") - F.col("n"))
    last = F.col("first") + F.col("n")
    spread = placed.withColumn("stop", last).withColumn("block_no", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + n - 1) div {block}"))))
    start = F.greatest(F.col("first"), F.col("block_no") * block)
    return spread.select(
        "source",
        "block_no",
        "doc_id",
        (start - F.col("first")).alias("start"),
        (F.least(F.col("stop"), (F.col("block_no") + 1) * block) - start).alias("n"),
    )


def source_plan(docs: DataFrame, targets: DataFrame, *, block: int = BLOCK, text: str = "text") -> DataFrame:
    """(source, target_share, max_repeat, n_tokens, total_tokens, n_blocks, short): the sources of targets; total_tokens counts every row of docs, null source included.

    short: even max_repeat times all its tokens stay below its share. A target without documents has 0 tokens.
    """
    size = F.octet_length(F.col(text)).cast("long")
    by_source = docs.groupBy("source").agg(F.coalesce(F.sum(size), F.lit(0)).alias("n_tokens"))
    total = by_source.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"))
    plan = targets.select("source", "target_share", "max_repeat").join(by_source, "source", "left").crossJoin(F.broadcast(total)).fillna(0, ["n_tokens"])
    short = F.col("max_repeat") * F.col("n_tokens") < F.col("target_share") * F.col("total_tokens")
    return plan.withColumn("n_blocks", F.ceil(F.col("n_tokens") / block).cast("long")).withColumn("short", F.coalesce(short, F.lit(False)))


def mixture_slots(plan: DataFrame, *, block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(source, shard, slot, block_no, pass_no), which block of which source fills each slot of each output shard, and (source, slots_drawn).

    Every shard draws its counts from one multinomial of the target shares. A source's slots are numbered
    through all shards; slot s takes block permutation(s mod blocks) of pass s div blocks, and slots beyond
    max_repeat passes stay empty. Collected are only the rows of the target table, a configuration; more than
    MOST_SOURCES are a ValueError.
    """
    spark = plan.sparkSession
    rows = plan.orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    shares = np.array([max(r["target_share"] or 0.0, 0.0) for r in rows])
    total = rows[0]["total_tokens"] if rows else 0
    slots = -(-total // block)
    shards = -(-slots // SHARD_SLOTS)
    if not len(rows) or not slots or shares.sum() <= 0:
        return spark.createDataFrame([], "source string, shard long, slot long, block_no long, pass_no int"), spark.createDataFrame([], "source string, slots_drawn long")
    rest = max(0.0, 1.0 - shares.sum())
    p = np.append(shares, rest) / (shares.sum() + rest)
    sources, blocks, repeats = [r["source"] for r in rows], [r["n_blocks"] for r in rows], [r["max_repeat"] or 0 for r in rows]

    def draw(batches):
        for batch in batches:
            for shard in batch["id"]:
                k = min(SHARD_SLOTS, slots - shard * SHARD_SLOTS)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(k, p)[: len(sources)]
                yield pd.DataFrame({"source": sources, "n_blocks": blocks, "max_repeat": repeats, "shard": shard, "k": counts})

    counts = spark.range(0, shards, 1, min(shards, 4 * shuffle_partitions(spark))).mapInPandas(draw, "source string, n_blocks long, max_repeat int, shard long, k long")
    counts = counts.withColumn("grp", F.expr(f"shard div {SHARD_GROUP}"))
    in_group = Window.partitionBy("source", "grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over_groups = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("source", "grp").agg(F.sum("k").alias("g")).select("source", "grp", F.coalesce(F.sum("g").over(over_groups), F.lit(0)).alias("before"))
    based = counts.withColumn("base", F.coalesce(F.sum("k").over(in_group), F.lit(0))).join(groups, ["source", "grp"]).filter("k > 0")
    each = based.withColumn(
        "slot",
        F.explode(F.sequence(F.col("before") + F.col("base"), F.col("before") + F.col("base") + F.col("k") - 1)),
    ).filter("slot < n_blocks * max_repeat")
    each = each.withColumn("pass_no", F.expr("cast(slot div n_blocks as int)"))

    @F.pandas_udf("long")
    def block_of(slot: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(slot.to_numpy() % n.to_numpy(), n.to_numpy(), key.to_numpy().view(np.uint64)))

    each = each.withColumn("block_no", block_of("slot", "n_blocks", F.xxhash64("source", "pass_no", F.lit(seed))))
    drawn = counts.groupBy("source").agg(F.sum("k").alias("slots_drawn"))
    return each.select("source", "shard", "slot", "block_no", "pass_no"), drawn


def mixture(docs: DataFrame, targets: DataFrame, *, block: int = BLOCK, seed: int = 0, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(shard, slot, source, pass_no, doc_id, start, n), the slices of texts that make up the mixture, and the plan it follows, with slots_drawn.

    The texts themselves join by doc_id when the mixture is written. A text is used once a pass, so at
    most max_repeat times. Sources without a target, null source and empty texts contribute nothing.
    """
    plan = source_plan(docs, targets, block=block, text=text)
    slots, drawn = mixture_slots(plan, block=block, seed=seed)
    mixed = slots.join(token_blocks(docs, block=block, text=text), ["source", "block_no"])
    return mixed.select("shard", "slot", "source", "pass_no", "doc_id", "start", "n"), plan.join(drawn, "source", "left").fillna(0, ["slots_drawn"])


def mixture_report(docs: DataFrame, targets: DataFrame, *, block: int = BLOCK, seed: int = 0, text: str = "text") -> DataFrame:
    """One row for every source of targets: what was asked for, and what the mixture holds.

    actual_share is of the tokens of all documents, the size the mixture aims at; mixture_share of those the mixture reached.
    slack is how many tokens the draw may miss its target by chance (six deviations) and by whole blocks. exhausted: within it, the
    mixture used every pass of the source. short: even all passes stay below the share, by exact totals; every short source is exhausted.
    """
    mixed, plan = mixture(docs, targets, block=block, seed=seed, text=text)
    got = mixed.groupBy("source").agg(F.sum("n").alias("mixed_tokens"), (F.max("pass_no") + 1).alias("passes"))
    out = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "passes"])
    # the rows of the report are at most MOST_SOURCES
    out = out.withColumn("mixture_tokens", F.sum("mixed_tokens").over(Window.partitionBy())).withColumn(
        "slack",
        F.ceil((6 * F.sqrt("slots_drawn") + F.col("max_repeat") + 2) * block).cast("long"),
    )
    exhausted = F.coalesce(F.col("mixed_tokens") + F.col("slack") >= F.col("max_repeat") * F.col("n_tokens"), F.lit(True))
    share = lambda whole: F.coalesce(F.try_divide("mixed_tokens", whole), F.lit(0.0))
    return out.select(
        "source", "target_share", "max_repeat", "n_tokens", "total_tokens", "short", exhausted.alias("exhausted"), "slots_drawn", "slack",
        "mixed_tokens", "passes", share("total_tokens").alias("actual_share"), share("mixture_tokens").alias("mixture_share"),
    )
