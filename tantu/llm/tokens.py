"""The counted rows of a lemma table, and how often each lemma occurs in each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tantu.session import materialise

#: A record is split into blocks of 2 to the power of so many sentences and token positions before it is
#: shuffled, so that one huge record never lands in one task; every ordinary record is one block.
SENTENCE_BITS, TOKEN_BITS = 10, 14
#: Stands for a null position.
NO_POSITION = -(2**31)
#: The block of a record whose sentences and tokens have few numbers: the only one, unless there are others.
NO_BLOCK = 0


def record_key(seed: int, doc: Column) -> Column:
    return F.xxhash64(doc, F.lit(seed))


def distinct_records(rows: DataFrame, *, keep: bool = False) -> tuple[DataFrame, int, int]:
    """(rec BIGINT, doc_id) of every record, the seed that gives distinct keys, and the number of records.

    Shuffling an 8-byte key in place of a 64-character id is exact, because the seed is only taken if
    no two ids share a key (one aggregate over the distinct ids proves it). A null doc_id is no record. keep writes the
    ids, for use again.
    """
    docs = rows.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    if keep:
        docs = materialise(docs, "records")
    n = None
    for seed in range(4):
        found = docs.agg(F.count("*").alias("n"), F.count_distinct(record_key(seed, F.col("doc_id"))).alias("keys")).first()
        n = found["n"]
        if found["keys"] == n:
            return docs.withColumn("rec", record_key(seed, F.col("doc_id"))), seed, n
    raise ValueError("no seed gives every record a key of its own")


def counted_rows(rows: DataFrame, seed: int) -> DataFrame:
    """(rec, block, lemma, is_oov): for each (doc_id, sent_no, tok_no) the row updated last, if its lemma is neither null nor empty.

    One shuffle, by (record, block): equal positions meet, a record stays together unless it is huge.
    Among rows with the same updated_at the larger (is_oov, lemma) counts; a null updated_at is the
    oldest, a null is_oov is false, a null position is a position of its own.
    """
    # every key is of an expression that cannot be null, so that joins add no filter and the shuffle is reused
    sent, tok = (F.coalesce(F.col(c), F.lit(NO_POSITION)).cast("long") for c in ("sent_no", "tok_no"))
    slim = rows.filter(F.col("doc_id").isNotNull()).select(
        record_key(seed, F.col("doc_id")).alias("rec"),
        F.shiftleft(F.shiftright(sent, SENTENCE_BITS), 32).bitwiseOR(F.shiftright(tok, TOKEN_BITS).bitwiseAND(0xFFFFFFFF)).alias("block"),
        F.shiftleft(sent, 32).bitwiseOR(tok.bitwiseAND(0xFFFFFFFF)).alias("at"),
        (F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**60))) * 2 + F.coalesce(F.col("is_oov").cast("long"), F.lit(0))).alias("version"),
        "lemma",
    )
    last = slim.repartition("rec", "block").groupBy("rec", "block", "at").agg(F.max(F.struct("version", "lemma")).alias("last"))
    return last.select("rec", "block", F.col("last.lemma").alias("lemma"), (F.col("last.version") % 2 != 0).alias("is_oov")).filter(F.col("lemma") != "")


def block_counts(counted: DataFrame, *, without_oov: bool = False) -> DataFrame:
    """(rec, block, lemma, tf, tf_known): occurrences in each block of a record; no further shuffle. tf_known leaves out is_oov rows."""
    known = [F.sum((~F.col("is_oov")).cast("long")).alias("tf_known")] if without_oov else []
    return counted.groupBy("rec", "block", "lemma").agg(F.count("*").alias("tf"), *known)
