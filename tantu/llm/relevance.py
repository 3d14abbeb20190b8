"""Problem 1: how characteristic each term of a record is, against the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tantu.llm.tokens import NO_BLOCK, block_counts, counted_rows, distinct_records
from tantu.session import materialise

#: Rows of one term that lie in one task at most, by the number of records.
TERM_ROWS = 1_000_000
#: Up to so many records of more than one block are sent to all tasks (8 bytes each); beyond that they are shuffled.
MOST_SENT = 1_000_000
#: Saturation of the term frequency, and how far the record's length counts.
K1, B = 1.2, 0.75


def _by_record(counts: DataFrame) -> DataFrame:
    """(rec, doc_len, lemma, tf) of (rec, block, block_len, lemma, tf), one row for each term of a record.

    A record of one block, as all but huge ones are, already has these rows; only the others are summed over their blocks.
    """
    plain = counts.select("rec", F.col("block_len").alias("doc_len"), "lemma", "tf")
    huge = counts.filter(F.col("block") != NO_BLOCK).select("rec").distinct()
    n = huge.count()
    if not n:
        return plain
    if n <= MOST_SENT:
        huge = F.broadcast(huge)
    parts = counts.join(huge, "rec", "left_semi")
    lengths = parts.groupBy("rec", "block").agg(F.max("block_len").alias("n")).groupBy("rec").agg(F.sum("n").alias("doc_len"))
    whole = parts.groupBy("rec", "lemma").agg(F.sum("tf").alias("tf")).join(lengths, "rec").select("rec", "doc_len", "lemma", "tf")
    return plain.join(huge, "rec", "left_anti").unionByName(whole)


def term_weights(rows: DataFrame, *, k1: float = K1, b: float = B, term_rows: int = TERM_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rec, doc_len, lemma, tf, df, relevance, tf_idf, log_entropy) for every term of every record, and the records (rec, doc_id).

    relevance is the probabilistic weight ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b len / avg len));
    the two other weightings come from the same pass: tf_idf = ln(1 + tf) ln(N / df), log_entropy = ln(1 + tf) (1 - H / ln N)
    with H the entropy of the term over its records (null if N = 1). N counts the distinct doc_id, also
    those without a counted row; the average length is over records with counted rows.

    The tokens are shuffled once, by (record, block), and their counts written. The statistics of a term are
    summed before they are shuffled and joined back on (term, salt), with as many salts as keep ``term_rows`` rows of a
    term in a task, so a term found in every record never lies in one.
    """
    docs, seed, n = distinct_records(rows, keep=True)
    blocks = block_counts(counted_rows(rows, seed))
    lengths = F.sum("tf").over(Window.partitionBy("rec", "block"))
    counts = materialise(blocks.withColumn("block_len", lengths), "term-counts")
    whole = counts.agg(F.sum("tf").alias("occurrences"), F.count_distinct("rec").alias("records")).first()
    tf = _by_record(counts)
    stats = tf.groupBy("lemma").agg(F.count("*").alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.ln("tf")).alias("tlt"))
    salts = 1 + n // term_rows
    if salts > 1:
        tf = tf.withColumn("salt", F.pmod(F.xxhash64("rec"), F.lit(salts)).cast("int"))
        stats = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scored = tf.join(stats, ["lemma", "salt"] if salts > 1 else ["lemma"])
    sat, big_n = F.col("tf").cast("double"), float(n)
    avg = (whole["occurrences"] or 0) / max(whole["records"], 1) or 1.0
    relevance = F.log1p((big_n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * sat * (k1 + 1) / (sat + k1 * (1 - b + b * F.col("doc_len") / avg))
    entropy = F.ln("gf") - F.col("tlt") / F.col("gf")
    ln_n = F.nullif(F.ln(F.lit(max(big_n, 1.0))), F.lit(0.0))
    weights = scored.select(
        "rec", "doc_len", "lemma", "tf", "df", relevance.alias("relevance"),
        (F.log1p(sat) * F.ln(big_n / F.col("df"))).alias("tf_idf"),
        (F.log1p(sat) * (1 - F.try_divide(entropy, ln_n))).alias("log_entropy"),
    )
    return weights, docs


def most_typical(rows: DataFrame, *, by: str = "relevance", least: int = 0) -> DataFrame:
    """(doc_id, lemma, tf, df, relevance, tf_idf): the term of highest weight of each record of at least ``least`` counted rows.

    Of equal weights the term that comes first in code-point order. min over a struct combines before
    it is shuffled, so a record of any size is no single group.
    """
    weights, docs = term_weights(rows)
    scored = weights.filter(F.col("doc_len") >= least)
    best = scored.groupBy("rec").agg(F.min(F.struct((-F.col(by)).alias("w"), "lemma", "tf", "df", "relevance", "tf_idf")).alias("top"))
    return best.join(docs, "rec").select("doc_id", "top.lemma", "top.tf", "top.df", "top.relevance", "top.tf_idf")


def most_relevant(rows: DataFrame, k: int) -> DataFrame:
    """(doc_id, rank, lemma, tf, df, relevance): the k terms of highest relevance of each record; equal ones in code-point order.

    Each task keeps k terms of a record before they are shuffled.
    """
    weights, docs = term_weights(rows)
    w = Window.partitionBy("rec").orderBy(F.desc("relevance"), "lemma")
    top = weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(docs, "rec").select("doc_id", "rank", "lemma", "tf", "df", "relevance")
