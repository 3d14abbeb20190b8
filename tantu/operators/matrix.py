"""Sparse term matrices as (row, col, value) tables: counting, weighting, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tantu.operators.joins import spread_join
from tantu.session import materialise


def counts(fragments: DataFrame) -> DataFrame:
    """(row, col, tf) of fragments with token_ids and, once numbered, row; else the id is the row."""
    row = F.col("row") if "row" in fragments.columns else F.col("id").alias("row")
    return fragments.select(row, F.explode("token_ids").alias("col")).groupBy("row", "col").agg(F.count("*").alias("tf"))


def _of_columns(tf: DataFrame, *sums: Column) -> tuple[DataFrame, int]:
    """(col, df, n, ...) with n the number of rows with an entry, and the largest df."""
    g = materialise(tf.groupBy("col").agg(F.count("*").alias("df"), *sums), "matrix-columns")
    n = F.broadcast(tf.agg(F.count_distinct("row").alias("n")))
    return g.crossJoin(n), g.agg(F.coalesce(F.max("df"), F.lit(0))).first()[0]


def tf_idf(tf: DataFrame) -> DataFrame:
    """(row, col, value) with ln(1 + tf) ln(N / df); N counts the rows with an entry. Columns of every row get 0."""
    g, most = _of_columns(tf)
    return spread_join(tf, g, "col", most).select("row", "col", (F.log1p("tf") * F.ln(F.col("n") / F.col("df"))).alias("value"))


def log_entropy(tf: DataFrame) -> DataFrame:
    """(row, col, value) with ln(1 + tf) (1 - H / ln N), H the entropy of the column over its rows; null if there is one row only."""
    g, most = _of_columns(tf, F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.ln("tf")).alias("tlt"))
    entropy = F.ln("gf") - F.col("tlt") / F.col("gf")
    weight = 1 - F.try_divide(entropy, F.nullif(F.ln("n"), F.lit(0.0)))
    return spread_join(tf, g, "col", most).select("row", "col", (F.log1p("tf") * weight).alias("value"))


#: Weightings by name; more can be put in.
WEIGHTINGS: dict[str, Callable[[DataFrame], DataFrame]] = {"tf-idf": tf_idf, "log-entropy": log_entropy}


def weighted(tf: DataFrame, weighting: str) -> DataFrame:
    """The counts, written once, under the weighting of that name."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"no such weighting: {weighting}")
    return WEIGHTINGS[weighting](materialise(tf, "matrix-counts"))


def stats(tf: DataFrame) -> DataFrame:
    """One row: rows, columns up to the last used, entries, density."""
    rows, cols, nnz = F.count_distinct("row"), F.max("col") + 1, F.count("*")
    return tf.agg(rows.alias("n_rows"), cols.cast("long").alias("n_cols"), nnz.alias("nnz"), F.try_divide(nnz.cast("double"), rows * cols).alias("density"))


def frobenius(matrix: DataFrame) -> DataFrame:
    """One row: the sum of the squared values."""
    return matrix.agg(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)).alias("frobenius"))


def symmetric(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(i, j, value): co-occurrences of (w1, w2, n) with both words in the vocabulary (idx, word); each pair counts in both directions, repeated ones add up."""
    ids = vocabulary.select("word", "idx")
    one = pairs.join(
        ids.withColumnsRenamed({"word": "w1", "idx": "i"}),
        "w1",
    ).join(ids.withColumnsRenamed({"word": "w2", "idx": "j"}), "w2").select("i", "j", F.col("n").alias("value"))
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    return both.groupBy("i", "j").agg(F.sum("value").alias("value"))


def neighbour_pairs(tokens: DataFrame) -> DataFrame:
    """(w1, w2, n): words that follow each other in a sentence, with how often."""
    from pyspark.sql import Window

    behind = F.lead("lemma").over(Window.partitionBy("doc_id", "sent_no").orderBy("tok_no", "lemma"))
    near = tokens.select("doc_id", "sent_no", "tok_no", F.col("lemma").alias("w1"), behind.alias("w2")).filter("w1 IS NOT NULL AND w2 IS NOT NULL")
    return near.groupBy("w1", "w2").agg(F.count("*").alias("n"))
