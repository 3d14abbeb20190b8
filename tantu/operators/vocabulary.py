"""Vocabularies: frequencies, limits, numbering, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tantu.operators import joins


def frequencies(tokens: DataFrame, *, term: str = "lemma", doc: str = "doc_id") -> DataFrame:
    """(term, tf, df): occurrences and records. Counted by (term, record) first, so that a frequent term is no single group of tokens."""
    each = tokens.filter(F.col(term).isNotNull()).groupBy(term, doc).agg(F.count("*").alias("n"))
    return each.groupBy(term).agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def limits(n_docs: Column, min_df: float, max_df: float, policy: str = "build") -> tuple[Column, Column]:
    """Absolute limits on df. build: a minimum below 1 and a maximum up to 1 are shares; report: a minimum up to 1 is, the maximum
    always. Shares are rounded down, to at least 1 at the lower limit; the upper limit is at least the lower."""
    share = lambda p: F.floor(F.lit(float(p)) * n_docs).cast("long")
    is_share = 0 <= min_df < 1 if policy == "build" else isinstance(min_df, float) and 0 <= min_df <= 1
    low = F.greatest(F.lit(1).cast("long"), share(min_df)) if is_share else F.lit(int(min_df)).cast("long")
    high = share(max_df) if policy == "report" or 0 < max_df <= 1 else F.lit(int(max_df)).cast("long")
    return low, F.greatest(low, high)


def with_limits(terms: DataFrame, docs: DataFrame, min_df: float, max_df: float, *, policy: str = "build", doc: str = "doc_id") -> DataFrame:
    """terms with low and high; docs holds a row or more for every record that could be read, also those without a term. One row is sent to all tasks."""
    whole = docs.agg(F.count_distinct(doc).alias("n_docs"))
    low, high = limits(F.col("n_docs"), min_df, max_df, policy)
    return terms.crossJoin(F.broadcast(whole.select("n_docs", low.alias("low"), high.alias("high"))))


def filtered(terms: DataFrame, docs: DataFrame, *, min_df: float = 2, max_df: float = 0.9, min_tf: int = 1, policy: str = "build", doc: str = "doc_id") -> DataFrame:
    """The terms within the limits, both inclusive."""
    kept = with_limits(terms, docs, min_df, max_df, policy=policy, doc=doc).filter(
        (F.col("df") >= F.col("low")) & (F.col("df") <= F.col("high")) & (F.col("tf") >= min_tf)
    )
    return kept.drop("n_docs", "low", "high")


def numbered(terms: DataFrame, *, term: str = "lemma") -> DataFrame:
    """(idx, term, tf, df): numbers from 0 by falling tf, then term; written."""
    return joins.numbered(terms.select(term, "tf", "df"), F.desc("tf"), F.col(term)).select(F.col("idx").cast("int").alias("idx"), term, "tf", "df")


def build(tokens: DataFrame, docs: DataFrame, *, min_df: float = 2, max_df: float = 0.9, min_tf: int = 1) -> DataFrame:
    """(idx, lemma, tf, df): the vocabulary of preprocessed tokens; docs are all documents that were read."""
    return numbered(filtered(frequencies(tokens), docs, min_df=min_df, max_df=max_df, min_tf=min_tf))


def most_frequent(terms: DataFrame, n: int, *, term: str = "lemma") -> DataFrame:
    return terms.orderBy(F.desc("tf"), term).limit(n)


def rarest(terms: DataFrame, docs: DataFrame, min_df: float, *, among: int = 30, term: str = "lemma") -> DataFrame:
    """Of the ``among`` terms in the fewest records those below the limit."""
    low = with_limits(terms.orderBy("df", term).limit(among), docs, min_df, 1.0, policy="report")
    return low.filter("df < low").select(term, "tf", "df")


def commonest(terms: DataFrame, docs: DataFrame, max_df: float, *, among: int = 20, n: int = 5, term: str = "lemma") -> DataFrame:
    """Of the ``among`` terms in the most records the first n above the limit."""
    high = with_limits(terms.orderBy(F.desc("df"), term).limit(among), docs, 1, max_df, policy="report")
    return high.filter("df > high").orderBy(F.desc("df"), term).limit(n).select(term, "tf", "df")


def report(tokens: DataFrame, *, min_df: float = 2, max_df: float = 0.9) -> DataFrame:
    """One row: documents, tokens, terms, type-token ratio before and after the limits, coverage, terms below and above them (below is tested first)."""
    terms = with_limits(frequencies(tokens), tokens, min_df, max_df, policy="report")
    below, above = F.col("df") < F.col("low"), F.col("df") > F.col("high")
    kept = ~below & ~above
    n, kept_n, kept_tf, tf = F.count("*"), F.count_if(kept), F.sum(F.when(kept, F.col("tf")).otherwise(0)), F.sum("tf")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return terms.agg(
        F.max("n_docs").alias("n_docs"), tf.alias("n_tokens"), n.alias("n_terms"), kept_n.alias("n_kept"), F.count_if(below).alias(
            "filtered_by_min_df"
        ), F.count_if(~below & above).alias("filtered_by_max_df"),
        ratio(n, tf).alias("ttr_raw"), ratio(kept_n, kept_tf).alias("ttr_kept"), ratio(kept_tf, tf).alias("coverage"),
    )


def content_hash(vocabulary: DataFrame) -> DataFrame:
    """(part, sha) of the vocabulary in parts of 4096 numbers, a hash each of its lines, so that no row holds the whole."""
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in ("idx", "lemma", "tf", "df")])
    parts = vocabulary.groupBy(F.expr("idx div 4096").alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("lines"))
    return parts.select("part", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("sha"))
