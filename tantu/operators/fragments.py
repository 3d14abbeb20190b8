"""Fragments: documents cut into chunks of a fixed number of sentences, as lists of vocabulary numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tantu.functions.text import fragment_id
from tantu.operators import joins
from tantu.operators.joins import spread_join


def chunks(sentences: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk, n_sent, dropped): chunks of ``size`` sentences; the last of several is dropped if it has fewer than size div 2.

    sentences has a row for every (doc_id, sent_no), also of those without a token left. The last chunk is
    found with one aggregate a document over its chunks.
    """
    each = sentences.select("doc_id", "sent_no").distinct().groupBy("doc_id", F.expr(f"sent_no div {size}").alias("chunk")).agg(F.count("*").alias("n_sent"))
    last = F.max("chunk").over(Window.partitionBy("doc_id"))
    tail = (F.col("chunk") == F.col("last")) & (F.col("last") > 0) & (F.col("n_sent") < size // 2)
    return each.withColumn("last", last).select("doc_id", "chunk", "n_sent", tail.alias("dropped"))


def _known(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The tokens of the vocabulary, with idx. A lemma has at most as many rows as its tf says; without tf, as the table has."""
    most = vocabulary.agg(F.max("tf")).first()[0] if "tf" in vocabulary.columns else tokens.count()
    return spread_join(tokens, vocabulary.select("lemma", "idx"), "lemma", most or 0)


def fragments(tokens: DataFrame, sentences: DataFrame, vocabulary: DataFrame, *, size: int, build_id: int) -> DataFrame:
    """(id, source_doc_id, position, token_ids, vocab_id).

    Tokens outside the vocabulary are dropped, chunks without any left too; position counts the kept chunks of a
    document from 0. A chunk is bounded by its size, so its list is too. The vocabulary (lemma, idx, tf) joins by
    lemma, frequent lemmas spread over several tasks.
    """
    ids = _known(tokens, vocabulary).select("doc_id", "sent_no", "tok_no", "idx", F.expr(f"sent_no div {size}").alias("chunk"))
    kept = chunks(sentences, size).filter(~F.col("dropped")).select("doc_id", "chunk")
    lists = ids.join(kept, ["doc_id", "chunk"]).groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("sent_no", "tok_no", "idx"))).alias("found"))
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk")) - 1
    out = lists.select("doc_id", position.alias("position"), F.transform("found", lambda x: x["idx"]).alias("token_ids"))
    return out.select(
        fragment_id(F.lit(build_id), F.col("doc_id"), F.col("position"), F.col("token_ids")).alias("id"),
        F.col("doc_id").alias("source_doc_id"),
        "position",
        "token_ids",
        F.lit(build_id).alias("vocab_id"),
    )


def counters(tokens: DataFrame, sentences: DataFrame, vocabulary: DataFrame, *, size: int) -> DataFrame:
    """One row: documents, fragments, tokens in them, dropped tails, chunks left empty."""
    ids = _known(tokens, vocabulary).groupBy("doc_id", F.expr(f"sent_no div {size}").alias("chunk")).agg(F.count("*").alias("n"))
    all_ = chunks(sentences, size).join(ids, ["doc_id", "chunk"], "left").fillna(0, ["n"])
    kept = ~F.col("dropped") & (F.col("n") > 0)
    return all_.agg(
        F.count_distinct("doc_id").alias("documents"), F.count_if(kept).alias("fragments"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("tokens"),
        F.count_if("dropped").alias("skipped_tail"), F.count_if(~F.col("dropped") & (F.col("n") == 0)).alias("empty"),
    )


def numbered(fragments: DataFrame) -> DataFrame:
    """(row, id, source_doc_id, position, token_ids): fragments with their row of the matrix, from 0 by document and position."""
    return joins.numbered(fragments.select("id", "source_doc_id", "position", "token_ids"), F.col("source_doc_id"), F.col("position"), out="row")
