"""Token tables: from nested documents, preprocessing of lemmas, quality reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tantu.functions.script import DEVANAGARI, Profile, classify, is_weird
from tantu.functions.text import normalize_devanagari


@dataclass(frozen=True)
class Options:
    """What is done to lemmas, in this order: leave out unknown tokens, put the class in place of names, normalise or reject."""

    replace_ner: bool = False
    normalize: bool = False
    ignore_oov: bool = False
    script: Profile = DEVANAGARI


def exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, tok_no, token) of documents with ``sentences`` ARRAY<ARRAY<STRING>>; null and empty ones give no row."""
    sents = docs.select(F.col("id").alias("doc_id"), F.posexplode("sentences").alias("sent_no", "tokens"))
    return sents.select("doc_id", "sent_no", F.posexplode("tokens").alias("tok_no", "token"))


def named_or_lemma(*, is_ne: str = "is_ne", label: str = "ner_result", lemma: str = "lemma") -> Column:
    """<LABEL> for a name, <NONE> for one without label, else the lemma."""
    return F.when(F.coalesce(F.col(is_ne), F.lit(False)), F.concat(F.lit("<"), F.upper(F.coalesce(F.col(label), F.lit("None"))), F.lit(">"))).otherwise(F.col(lemma))


def is_special(lemma: Column) -> Column:
    return lemma.startswith("<") & lemma.endswith(">") & (F.length(lemma) > 1)


def normal_or_null(lemma: Column, script: Profile = DEVANAGARI) -> Column:
    """Special tokens as they are; other lemmas normalised, null if they are no word of the script."""
    plain = normalize_devanagari(lemma, any_text=False)
    return F.when(is_special(lemma), lemma).when(classify(plain, script) == "ok", plain)


def preprocess(tokens: DataFrame, options: Options = Options()) -> DataFrame:
    """tokens with the lemma the options make of it; rows left without one are dropped, null lemmas too. A null is_oov is false."""
    if options.ignore_oov:
        tokens = tokens.filter(~F.coalesce(F.col("is_oov"), F.lit(False)))
    if options.replace_ner:
        tokens = tokens.withColumn("lemma", named_or_lemma())
    if options.normalize:
        tokens = tokens.withColumn("lemma", normal_or_null(F.col("lemma"), options.script))
    return tokens.filter(F.col("lemma").isNotNull())


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def lemma_quality(tokens: DataFrame) -> DataFrame:
    """One row: tokens, unknown and ambiguous ones and their shares, mean number of analyses; a token without analyses counts as one."""
    n = F.count("*")
    oov, amb = (F.count_if(F.coalesce(F.col(c), F.lit(False))) for c in ("is_oov", "is_ambiguous"))
    analyses = F.sum(F.greatest(F.coalesce(F.size("analyses"), F.lit(0)), F.lit(1)))
    return tokens.agg(
        n.alias("n_tokens"), F.count_distinct("doc_id").alias("n_docs"), oov.alias("n_oov"), amb.alias("n_ambiguous"),
        _share(oov, n).alias("oov_rate"), _share(amb, n).alias("ambiguity_rate"), _share(analyses, n).alias("analyses_per_token"),
    )


def pos_histogram(tokens: DataFrame) -> DataFrame:
    """(pos, n_tokens), the most frequent first; null and empty parts of speech are "null"."""
    pos = F.coalesce(F.nullif("pos", F.lit("")), F.lit("null")).alias("pos")
    return tokens.groupBy(pos).agg(F.count("*").alias("n_tokens")).orderBy(F.desc("n_tokens"), "pos")


def ner_histogram(tokens: DataFrame) -> DataFrame:
    """(ner_result, n_tokens) of the names, before any other preprocessing."""
    return tokens.filter("is_ne").groupBy(F.coalesce("ner_result", F.lit("None")).alias("ner_result")).agg(F.count("*").alias("n_tokens"))


def ner_summary(tokens: DataFrame, most: int = 1000) -> DataFrame:
    """One row: summary, a map of ner_ratio, the names' share of all tokens, and of the count of each of the ``most`` commonest labels."""
    ratio = tokens.agg(_share(F.count_if(F.coalesce(F.col("is_ne"), F.lit(False))), F.count("*")).alias("ratio"))
    labels = ner_histogram(tokens).orderBy(F.desc("n_tokens"), "ner_result").limit(most)
    pairs = labels.agg(F.map_from_entries(F.collect_list(F.struct("ner_result", F.col("n_tokens").cast("double").alias("n")))).alias("labels"))
    return ratio.crossJoin(F.broadcast(pairs)).select(F.map_concat(F.create_map(F.lit("ner_ratio"), "ratio"), "labels").alias("summary"))


def normalization_account(tokens: DataFrame, script: Profile = DEVANAGARI) -> DataFrame:
    """One row: lemmas before, changed by normalising, rejected by class, accepted; distinct lemmas that fall together."""
    plain = normalize_devanagari(F.col("lemma"), any_text=False)
    kind = classify(F.col("plain"), script)
    rows = tokens.filter("lemma IS NOT NULL").select("lemma", plain.alias("plain")).withColumn("kind", F.when(is_special(F.col("lemma")), "ok").otherwise(kind))
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return rows.agg(
        F.count("*").alias("before"), F.count_if(
            F.col("plain") != F.col("lemma")
        ).alias("changed"), count(f"non_{script.name}"), count(f"invalid_{script.name[:4]}"), count("ocr_garbage"),
        F.count_if(F.col("kind") == "ok").alias("accepted"), (F.count_distinct("lemma") - F.count_distinct("plain")).alias("collapsed"),
    )


def lemmas_per_doc(tokens: DataFrame) -> DataFrame:
    """One row: mean, least and most distinct lemmas of a document."""
    each = tokens.filter("lemma IS NOT NULL").select("doc_id", "lemma").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    return each.agg(F.avg("n").alias("mean_lemmas"), F.min("n").alias("min_lemmas"), F.max("n").alias("max_lemmas"))


def doc_token_stats(docs: DataFrame) -> DataFrame:
    """(id, num_sentences, num_tokens) of documents with sentences; null sentences count 0."""
    sizes = F.aggregate("sentences", F.lit(0), lambda s, x: s + F.coalesce(F.size(x), F.lit(0)))
    return docs.select("id", F.coalesce(F.size("sentences"), F.lit(0)).alias("num_sentences"), F.coalesce(sizes, F.lit(0)).alias("num_tokens"))


def doc_lemma_stats(tokens: DataFrame, script: Profile = DEVANAGARI) -> DataFrame:
    """(doc_id, n_tokens, n_oov, n_ambiguous, n_weird) by document."""
    flag = lambda c, n: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(n)
    return tokens.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        flag("is_oov", "n_oov"),
        flag("is_ambiguous", "n_ambiguous"),
        F.count_if(is_weird(F.coalesce("token", F.lit("")), script)).alias("n_weird"),
    )
