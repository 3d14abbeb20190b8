"""The pN_ queries, each over its whole tables with production parameters, and the SQL of those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tantu.functions.text import nfc
from tantu.llm import encoding, frequency, mixing, neighbours, packing, relevance, scans, sentences, spelling, splitting
from tantu.operators import geometry
from tantu.session import materialise, table

#: Share of the containers' room that has to be used, and of the true neighbours that have to be found.
LEAST_FILL, LEAST_RECALL = 0.9, 0.95


def _spec(spark: SparkSession, d: str, name: str):
    return table(spark, d, "size_specs").filter(F.col("spec") == name).first()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return relevance.most_typical(table(spark, d, "lemma_tokens"), by="tf_idf", least=100).select("doc_id", "lemma")


def p1_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The ten most relevant lemmas of every document."""
    return relevance.most_relevant(table(spark, d, "lemma_tokens"), 10).withColumn("relevance", F.round("relevance", 6))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("sha256").alias("doc"), "title")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_noise(table(spark, d, "doc_raw"), _titles(spark, d))[0]


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_pages(table(spark, d, "doc_raw"), _titles(spark, d))


def p2_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The page numbers found that are nothing but the printed number, as first or last line of their page."""
    raw = table(spark, d, "doc_raw").filter("meta.origin = 'scan'").select("id", "text", "meta.page_num").distinct()
    lines = raw.select(
        "id",
        "page_num",
        F.filter(
            F.transform(F.split("text", "\n", -1), lambda x, k: F.struct((k + 1).alias("line_no"), x.alias("line"))),
            lambda x: x["line"].rlike(r"\S"),
        ).alias("shown"),
    )
    edges = lines.select("id", "page_num", F.inline(F.array_distinct(F.array(F.get("shown", F.lit(0)), F.get("shown", F.size("shown") - 1)))))
    plain = F.translate(F.trim("line"), "०१२३४५६७८९", "0123456789")
    plain_numbers = edges.filter(plain.rlike("^[0-9]{1,5}$") & (plain.cast("int") == F.col("page_num"))).select("id", "line_no")
    return plain_numbers.join(p2_found(spark, d).filter("kind = 'page_number'"), ["id", "line_no"], "left_semi")


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every scanned page, and the single line breaks left in it."""
    return p2_repaired(spark, d).select("id", F.regexp_count("text", F.lit(r"(?<!\n)\n(?!\n)")).cast("long").alias("n_breaks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(table(spark, d, "word_vectors"), "idx", "normed", 10))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar words of every word."""
    vectors = table(spark, d, "word_vectors")
    found = neighbours.nearest(vectors, "idx", "normed", 10)
    words = vectors.select(F.col("idx").cast("long").alias("other"), F.col("word").alias("other_word"))
    return found.join(words, "other").select(F.col("id").alias("idx"), "rank", F.col("other").alias("other_idx"), "other_word", "cosine")


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The ten nearest, by comparison with all, of the words whose number is divisible by 20; and those words."""
    vectors = geometry.usable(table(spark, d, "word_vectors"), "idx", "normed")
    asked = vectors.filter("id % 20 = 0")
    return geometry.exact_neighbours(asked, vectors, 10), asked


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    """The exact way, for a stated query set against all rows."""
    return _asked(spark, d)[0].withColumn("cosine", F.round("cosine", 6))


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index finds LEAST_RECALL of the exact neighbours of the query set."""
    exact, asked = _asked(spark, d)
    found = neighbours.nearest(table(spark, d, "word_vectors"), "idx", "normed", 10).select("id", "other", F.lit(1).alias("hit"))
    share = exact.join(found, ["id", "other"], "left").agg(F.try_divide(F.count("hit").cast("double"), F.count("*")).alias("share"))
    return asked.agg(F.count("*").alias("n_asked")).crossJoin(F.broadcast(share)).select("n_asked", (F.col("share") >= LEAST_RECALL).alias("recalled"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tokens = spelling.inconsistent(
        table(spark, d, "lemma_tokens"),
        "concat_ws(':', doc_id, coalesce(cast(sent_no AS string), ''), coalesce(cast(tok_no AS string), ''))",
        "token",
    )
    pages = table(spark, d, "doc_raw").filter(F.coalesce(F.col("meta.origin"), F.lit("")) != "scan")
    raw = spelling.inconsistent_pages(pages, "id", "text")
    return tokens.select(F.lit("lemma_tokens").alias("src"), "rec_key").unionByName(raw.select(F.lit("doc_raw").alias("src"), "rec_key"))


def p4_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its text in the usual form."""
    return spelling.consistent(table(spark, d, "doc_raw").select("id", "text"), "text").distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """Pages in their usual form that still hold a character without effect, or are not composed."""
    text = F.col("text")
    return p4_pages(spark, d).filter("text IS NOT NULL").agg(
        F.count_distinct("id").alias("n_pages"),
        F.count_if(text.rlike(r"[\x{AD}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]")).alias("n_invisible"),
        F.count_if(nfc(text) != text).alias("n_open"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    marked = frequency.verdicts(table(spark, d, "lemma_tokens"), table(spark, d, "vocab_builds"))
    return marked.filter("verdict <> 'keep'").select("run_id", "lemma", "verdict")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    terms, _ = frequency.term_frequencies(table(spark, d, "lemma_tokens"))
    return terms.select("lemma", "tf", "df")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_bounds(table(spark, d, "doc_raw").filter("meta.origin = 'feed'"))


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every page."""
    return sentences.sentence_bounds(table(spark, d, "doc_raw"), with_text=True)


def p6_cover(spark: SparkSession, d: str) -> DataFrame:
    """The visible characters of every page, counted over its sentences."""
    shown = F.length(F.regexp_replace("sentence", r"[\s\p{Z}\p{Cc}\p{Cf}]", ""))
    return p6_sentences(spark, d).groupBy("id").agg(F.sum(shown).cast("long").alias("n_visible"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_pages(table(spark, d, "doc_raw"))


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_pages(table(spark, d, "doc_raw"), restore=True).select("id", "restored")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Titles beyond ASCII, their UTF-8 read as Latin-1, and restored."""
    titles = table(spark, d, "documents").filter(F.col("title").rlike(r"[^\x00-\x7F]"))
    bad = titles.select(
        F.col("sha256").alias("id"),
        F.decode(F.encode("title", "UTF-8"), "ISO-8859-1").alias("text"),
        F.struct(F.lit("feed").alias("origin")).alias("meta"),
    )
    return encoding.garbled_pages(bad, restore=True).select("id", F.col("restored").alias("title"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    spec = _spec(spark, d, "pack")
    return packing.pack_texts(table(spark, d, "documents"), spec["n_tokens"])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing keeps its rules over all texts, and how full the containers are."""
    capacity = _spec(spark, d, "pack")["n_tokens"]
    account = packing.packing_account(packing.pack_texts(table(spark, d, "documents"), capacity), capacity)
    return account.select("n_texts", "n_over", "n_gaps", "n_needless", (F.col("fill") >= LEAST_FILL).alias("well_filled"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources of which the mixture uses up every pass and, by exact totals, still falls short."""
    return materialise(p9_report(spark, d), "mixture-report").filter("exhausted AND short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mixture keeps to targets and repetitions: every source gets its share, or all it has, up to the slack of a draw."""
    wanted = F.least(F.col("target_share") * F.col("total_tokens"), (F.col("max_repeat") * F.col("n_tokens")).cast("double"))
    return p9_report(spark, d).select(
        "source", "n_tokens", "total_tokens", "short",
        ((F.col("mixed_tokens") <= F.col("max_repeat") * F.col("n_tokens")) & (F.col("passes") <= F.col("max_repeat"))).alias("within_repeats"),
        (F.abs(F.col("mixed_tokens") - wanted) <= F.col("slack")).alias("on_target"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    spec = _spec(spark, d, "split")
    return splitting.split_texts(table(spark, d, "documents"), spec["n_tokens"], spec["overlap"]).filter("piece_no = 0 AND n_pieces > 1").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    spec = _spec(spark, d, "split")
    return splitting.split_texts(table(spark, d, "documents"), spec["n_tokens"], spec["overlap"])


def p10_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces, each without what it repeats."""
    limit, overlap = (_spec(spark, d, "split")[c] for c in ("n_tokens", "overlap"))
    pieces = splitting.split_texts(table(spark, d, "documents"), limit, overlap)
    raw = F.encode("piece", "UTF-8")
    before = F.lag(F.col("start") + F.col("n_tokens"), 1, 0).over(Window.partitionBy("doc_id").orderBy("piece_no"))
    fresh = pieces.withColumn("repeated", before - F.col("start")).withColumn("fresh", F.expr("substring(encode(piece, 'UTF-8'), CAST(repeated AS INT) + 1)"))
    ok = (F.length(raw) <= limit) & (F.length(raw) == F.col("n_tokens")) & (
        F.when(F.col("piece_no") == 0, F.col("repeated") == 0).otherwise(F.col("repeated").between(overlap, overlap + splitting.CHAR_TAIL))
    )
    each = fresh.withColumn("ok", ok).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "fresh"))).alias("parts"), F.every("ok").alias("kept"))
    text = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["fresh"]))
    return each.select("doc_id", F.sha2(text, 256).alias("sha"), "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            p1_found,
            p1_relevance,
            p2_found,
            p2_repaired,
            p2_numbers,
            p2_paragraphs,
            p3_found,
            p3_neighbours,
            p3_exact,
            p3_recall,
            p4_found,
            p4_pages,
            p4_clean,
            p5_found,
            p5_frequencies,
            p6_found,
            p6_sentences,
            p6_cover,
            p7_found,
            p7_restored,
            p7_round_trip,
            p8_pack,
            p8_fill,
            p9_found,
            p9_report,
            p9_kept,
            p10_found,
            p10_pieces,
            p10_whole,
        )
    }


COUNTED = """
WITH last AS (
  SELECT doc_id, lemma, coalesce(is_oov, false) AS is_oov FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no, tok_no ORDER BY updated_at DESC NULLS LAST, coalesce(is_oov, false) DESC, lemma DESC NULLS LAST) AS rn
    FROM lemma_tokens WHERE doc_id IS NOT NULL) WHERE rn = 1),
counted AS (SELECT * FROM last WHERE lemma <> ''),
whole AS (SELECT count(DISTINCT doc_id) AS n FROM lemma_tokens)"""

USABLE = """
WITH v AS (SELECT idx::BIGINT AS id, list_transform(normed, lambda x: x::DOUBLE) AS vec FROM word_vectors
  WHERE normed IS NOT NULL AND len(list_filter(normed, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(normed, lambda x: x <> 0)) > 0)"""

SQL = {
    "p2_numbers": r"""
WITH p AS (SELECT DISTINCT id, text, meta.page_num AS n FROM doc_raw WHERE meta.origin = 'scan'),
l AS (SELECT id, n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM p),
s AS (SELECT *, min(line_no) OVER (PARTITION BY id) AS top, max(line_no) OVER (PARTITION BY id) AS foot FROM l WHERE regexp_matches(line, '\S'))
SELECT id, line_no FROM s WHERE line_no IN (top, foot) AND regexp_full_match(trim(line), '[0-9०-९]{1,5}') AND try_cast(translate(trim(line), '०१२३४५६७८९', '0123456789') AS INT) = n""",
    "p2_paragraphs": "SELECT DISTINCT id, 0::BIGINT AS n_breaks FROM doc_raw WHERE meta.origin = 'scan' AND text IS NOT NULL AND id IS NOT NULL",
    "p3_exact": USABLE + """,
s AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.vec, b.vec) AS cosine FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, other))::INT AS rank FROM s)
SELECT id, other, rank, round(cosine, 6) AS cosine FROM r WHERE rank <= 10""",
    "p3_recall": USABLE + " SELECT count(*) AS n_asked, true AS recalled FROM v WHERE id % 20 = 0",
    "p1_found": COUNTED + """,
tf AS (SELECT doc_id, lemma, count(*) AS tf FROM counted GROUP BY ALL),
df AS (SELECT lemma, count(*) AS df FROM tf GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY ALL HAVING sum(tf) >= 100)
SELECT doc_id, lemma FROM (
  SELECT doc_id, lemma, row_number() OVER (PARTITION BY doc_id ORDER BY ln(1 + tf) * ln(n / df) DESC, lemma) AS rn
  FROM tf JOIN df USING (lemma) JOIN len USING (doc_id) CROSS JOIN whole) WHERE rn = 1""",
    "p1_relevance": COUNTED + """,
tf AS (SELECT doc_id, lemma, count(*) AS tf FROM counted GROUP BY ALL),
df AS (SELECT lemma, count(*) AS df FROM tf GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::DOUBLE AS len FROM tf GROUP BY ALL),
avg AS (SELECT sum(len) / count(*) AS mean FROM len),
w AS (SELECT doc_id, lemma, tf, df,
    ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean)) AS relevance
  FROM tf JOIN df USING (lemma) JOIN len USING (doc_id) CROSS JOIN avg CROSS JOIN whole)
SELECT doc_id, rank, lemma, tf, df, round(relevance, 6) AS relevance FROM (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, lemma))::INT AS rank FROM w) WHERE rank <= 10""",
    "p4_clean": "SELECT count(DISTINCT id) AS n_pages, 0::BIGINT AS n_invisible, 0::BIGINT AS n_open FROM doc_raw WHERE text IS NOT NULL",
    "p5_frequencies": COUNTED + " SELECT lemma, count(*) AS tf, count(DISTINCT doc_id) AS df FROM counted GROUP BY lemma",
    "p5_found": COUNTED + """,
runs AS (SELECT run_id, coalesce(ignore_oov, false) AS ignore_oov, min_tf, low, CASE WHEN high IS NOT NULL THEN greatest(high, low) END AS high FROM (
  SELECT run_id, params.ignore_oov AS ignore_oov, params.min_tf AS min_tf,
    CASE WHEN params.min_df < 1 THEN greatest(1, floor(params.min_df * n)) ELSE params.min_df END AS low,
    CASE WHEN params.max_df < 1 THEN floor(params.max_df * n) ELSE params.max_df END AS high
  FROM vocab_builds, whole WHERE status = 'ok')),
terms AS (SELECT run_id, lemma, min_tf, low, high, count(*) AS tf, count(DISTINCT doc_id) AS df
  FROM counted, runs WHERE NOT (ignore_oov AND is_oov) GROUP BY ALL),
marked AS (SELECT run_id, lemma, CASE WHEN coalesce(df < low, false) OR coalesce(tf < min_tf, false) THEN 'rare'
  WHEN df > high THEN 'common' END AS verdict FROM terms)
SELECT * FROM marked WHERE verdict IS NOT NULL""",
    "p9_found": """
SELECT t.source FROM mix_targets t LEFT JOIN (SELECT source, sum(strlen(text)) AS n FROM documents GROUP BY source) s ON s.source = t.source
WHERE t.max_repeat * coalesce(s.n, 0) < t.target_share * (SELECT sum(strlen(text)) FROM documents)""",
    "p6_cover": r"""
WITH p AS (SELECT DISTINCT id, text FROM doc_raw), n AS (SELECT id, length(regexp_replace(text, '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g')) AS n FROM p)
SELECT id, sum(n)::BIGINT AS n_visible FROM n WHERE n > 0 GROUP BY id""",
    "p7_round_trip": "SELECT sha256 AS id, title FROM documents WHERE regexp_matches(title, '[^\\x00-\\x7F]')",
    "p8_fill": "SELECT count(*) FILTER (text <> '') AS n_texts, 0::BIGINT AS n_over, 0::BIGINT AS n_gaps, 0::BIGINT AS n_needless, true AS well_filled FROM documents",
    "p9_kept": """
WITH s AS (SELECT source, sum(strlen(text)) AS n FROM documents GROUP BY source), t AS (SELECT sum(strlen(text))::BIGINT AS total FROM documents)
SELECT t1.source, coalesce(s.n, 0)::BIGINT AS n_tokens, total AS total_tokens, max_repeat * coalesce(s.n, 0) < target_share * total AS short, true AS within_repeats, true AS on_target
FROM mix_targets t1 LEFT JOIN s ON s.source = t1.source CROSS JOIN t""",
    "p10_whole": "SELECT doc_id, sha256(text) AS sha, true AS kept FROM documents WHERE text IS NOT NULL",
    "p10_found": "SELECT doc_id FROM documents WHERE strlen(text) > (SELECT n_tokens FROM size_specs WHERE spec = 'split')",
}
