"""Problem 5: how often every distinct term occurs and in how many records, by merged record bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tantu.llm.tokens import block_counts, counted_rows, distinct_records
from tantu.session import shuffle_partitions

#: Records are numbered bucket by bucket; a bucket has room for so many.
BUCKET_ROOM = 2**32
#: Builds whose verdicts can be asked for at once.
MOST_RUNS = 10_000


def _numbered(blocks: DataFrame, partitions: int) -> DataFrame:
    """(rec, block, number): record numbers, dense within a bucket, for every block of a record.

    The bucket is the shuffle partition in which the record's first block lies, so that the records
    sharing a 64-bit word of a bitmap lie in one task and their word is complete before it is shuffled.
    """
    bucket = F.pmod(F.hash("rec", F.lit(0).cast("long")), F.lit(partitions))
    ids = blocks.select("rec", "block").distinct()
    rank = F.dense_rank().over(Window.partitionBy(bucket).orderBy("rec"))
    return ids.select("rec", "block", (bucket.cast("long") * BUCKET_ROOM + rank - 1).alias("number"))


def term_bitmaps(rows: DataFrame, *, without_oov: bool = False) -> tuple[DataFrame, int]:
    """Vertical layout: (lemma, word_no, bits, tf[, bits_known, tf_known]) and the number of records.

    A term's posting bitmap is kept compressed, as only its non-zero 64-bit words; beside each word runs
    the counter of the occurrences in those records. Bitmaps merge by union (bit_or), so a record whose
    blocks lie in several tasks still counts once; counters merge by sum. Null and empty lemmas do not
    count, an empty table gives no rows.
    """
    _, seed, n = distinct_records(rows)
    blocks = block_counts(counted_rows(rows, seed), without_oov=without_oov)
    ids = _numbered(counted_rows(rows, seed), shuffle_partitions(rows.sparkSession))
    bit = F.expr("shiftleft(1L, cast(number & 63 as int))")
    merged = [F.bit_or("bit").alias("bits"), F.sum("tf").alias("tf")]
    if without_oov:
        merged += [F.bit_or(F.when(F.col("tf_known") > 0, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("bits_known"), F.sum("tf_known").alias("tf_known")]
    placed = blocks.join(ids, ["rec", "block"]).withColumn("bit", bit).withColumn("word_no", F.shiftright("number", 6))
    return placed.groupBy("lemma", "word_no").agg(*merged), n


def term_frequencies(rows: DataFrame) -> tuple[DataFrame, int]:
    """(lemma, tf, df, tf_known, df_known) over all counted rows and over those not marked is_oov, and the number of records N.

    df is the cardinality of the union of a term's bitmaps.
    """
    words, n = term_bitmaps(rows, without_oov=True)
    count = lambda c: F.sum(F.bit_count(c)).cast("long")
    return words.groupBy("lemma").agg(F.sum("tf").alias("tf"), count("bits").alias("df"), F.sum("tf_known").alias("tf_known"), count("bits_known").alias("df_known")), n


def resolved_limits(builds: DataFrame, n: int) -> DataFrame:
    """(run_id, ignore_oov, min_tf, low, high) of the builds of status ok: limits below 1 as shares of n, rounded down; null where none applies.

    low is at least 1 if it came from a share; high is at least low.
    """
    share = lambda c: F.floor(F.col(c) * F.lit(float(n))).cast("double")
    p = builds.filter(F.col("status") == "ok").select("run_id", "params.*")
    low = F.when(F.col("min_df") < 1, F.greatest(F.lit(1.0), share("min_df"))).otherwise(F.col("min_df"))
    high = F.when(F.col("max_df") < 1, share("max_df")).otherwise(F.col("max_df"))
    p = p.withColumn("low", low)
    return p.select(
        "run_id",
        F.coalesce("ignore_oov", F.lit(False)).alias("ignore_oov"),
        "min_tf",
        "low",
        F.when(high.isNotNull(), F.greatest(high, F.col("low"))).alias("high"),
    )


def verdicts(rows: DataFrame, builds: DataFrame) -> DataFrame:
    """(run_id, lemma, tf, df, verdict): every term of every usable build; verdict rare, common or keep.

    The builds are a configuration table: one row a run. The result has a row for each term and run, so the runs are
    sent to all tasks, and more than MOST_RUNS are a ValueError.
    """
    terms, n = term_frequencies(rows)
    runs = resolved_limits(builds, n)
    if runs.limit(MOST_RUNS + 1).count() > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs")
    runs = F.broadcast(runs)
    tf, df = (F.when(F.col("ignore_oov"), F.col(f"{c}_known")).otherwise(F.col(c)) for c in ("tf", "df"))
    each = terms.join(runs, F.lit(True)).withColumns({"n_tf": tf, "n_df": df}).filter("n_tf > 0")
    rare = F.coalesce(F.col("n_df") < F.col("low"), F.lit(False)) | F.coalesce(F.col("n_tf") < F.col("min_tf"), F.lit(False))
    verdict = F.when(rare, "rare").when(F.col("n_df") > F.col("high"), "common").otherwise("keep")
    return each.select("run_id", "lemma", F.col("n_tf").alias("tf"), F.col("n_df").alias("df"), verdict.alias("verdict"))
