"""Queries of sources, sinks, state and smaller operators, most of them a way there and back: what is written is read again. They join those of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tantu.functions import text
from tantu.operators import geometry, lemmatize, registry, svd, tokens as tok, vocabulary as voc
from tantu.plans.catalogue import STAGE, TF, TOKENS, _documents, _embeddings, _stage, query
from tantu.session import shared_dir, table
from tantu.sources import readers, writers
from tantu.streaming import incremental


def _at(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- there and back


@query("SELECT sha256 AS id, sha256(text) AS text_sha, lang FROM documents")
def json_lines_round_trip(spark, d):
    """Documents written as compressed JSON lines and read again."""
    path = _at(spark, "documents")
    writers.write_json_lines(table(spark, d, "documents").select(F.col("sha256").alias("id"), "text", "lang"), path, "gzip")
    return readers.json_lines(spark, path, "id string, text string, lang string").select("id", F.sha2("text", 256).alias("text_sha"), "lang")


@query("SELECT id, count(*) AS n, max(length(text))::INT AS n_chars, max(meta.page_num) AS page_num FROM doc_raw WHERE id IS NOT NULL GROUP BY id")
def page_scan(spark, d):
    """Pages written as JSON lines and scanned with their schema."""
    path = _at(spark, "pages")
    writers.write_json_lines(table(spark, d, "doc_raw"), path)
    return readers.json_lines(spark, path, readers.PAGE).groupBy("id").agg(
        F.count("*").alias("n"),
        F.max(F.length("text")).alias("n_chars"),
        F.max("meta.page_num").alias("page_num"),
    )


@query("SELECT id, lang, coalesce(len(sentences), 0)::INT AS n_sentences FROM doc_tok WHERE sentences IS NOT NULL")
def tokenized_scan(spark, d):
    """A file of both kinds of documents; those with sentences are the tokenized ones."""
    path = _at(spark, "mixed")
    both = table(spark, d, "doc_tok").select("id", "lang", F.lit(None).cast("string").alias("text"), "sentences", "meta")
    raw = table(spark, d, "doc_raw").select(
        "id",
        F.lit(None).cast("string").alias("lang"),
        "text",
        F.lit(None).cast("array<array<string>>").alias("sentences"),
        F.lit(None).cast("map<string,string>").alias("meta"),
    )
    writers.write_json_lines(both.unionByName(raw), path)
    return readers.documents(spark, path)[1].select("id", "lang", F.size("sentences").alias("n_sentences"))


@query("SELECT doc_id AS id, count(*) AS n_tokens, count(*) FILTER (is_ne) AS n_names, count(lemma) AS n_lemmas FROM lemma_tokens GROUP BY doc_id")
def lemmatized_scan(spark, d):
    """Lemmatized documents as nested JSON, one record each, read and counted."""
    path = _at(spark, "lemmas")
    row = F.struct("token", "lemma", "pos", "is_ne", "ner_result", "analyses", "is_oov", "is_ambiguous")
    docs = table(spark, d, TOKENS).groupBy(F.col("doc_id").alias("id"), "sent_no").agg(F.collect_list(row).alias("words")).groupBy("id").agg(
        F.collect_list("words").alias("sentences")
    )
    writers.write_json_lines(docs.withColumn("lang", F.lit("mr")), path)
    words = readers.json_lines(spark, path, readers.LEMMATIZED).select("id", F.explode(F.flatten("sentences")).alias("w"))
    return words.groupBy("id").agg(F.count("*").alias("n_tokens"), F.count_if("w.is_ne").alias("n_names"), F.count("w.lemma").alias("n_lemmas"))


@query("SELECT 'mr-' || (row_number() OVER (ORDER BY n_nationkey) - 1) AS id, n_name AS text FROM nation")
def raw_lines(spark, d):
    """Lines numbered in the order of the file, blank ones left out."""
    path = _at(spark, "lines")
    names = table(spark, d, "nation").select("n_nationkey", F.explode(F.array("n_name", F.lit("  "))).alias("value"))
    names.repartition(1).sortWithinPartitions("n_nationkey", F.desc("value")).select("value").write.text(path)
    return readers.raw_lines(spark, path, "mr")


@query(f"WITH {TF} SELECT (row_number() OVER (ORDER BY tf DESC, lemma) - 1)::INT AS idx, lemma, tf, df FROM tf WHERE tf > 3 AND lemma <> ''")
def vocabulary_file(spark, d):
    """The vocabulary as a tab-separated file, read again."""
    path = _at(spark, "vocabulary")
    writers.write_vocabulary(voc.numbered(voc.frequencies(table(spark, d, TOKENS)).filter("tf > 3 AND lemma <> ''")), path)
    return readers.vocabulary(spark, path)


@query("SELECT idx::BIGINT + 101 AS id, word, tf AS freq FROM word_vectors WHERE regexp_full_match(word, '\\S+') AND tf IS NOT NULL AND idx < 400")
def frequency_list(spark, d):
    """A word list of three fields a line, from the hundred and first number on."""
    path = _at(spark, "words")
    words = table(spark, d, "word_vectors").filter("idx < 400")
    line = F.concat_ws(" ", (F.col("idx") + 101).cast("string"), "word", F.col("tf").cast("string"))
    words.select(F.explode(F.array(line, F.concat_ws(" ", F.lit("5"), "word", F.lit("1")))).alias("value")).write.text(path)
    return readers.frequency_list(spark, path)


@query("SELECT l_partkey AS w1, l_suppkey AS w2, l_orderkey AS n, l_quantity AS sig FROM lineitem WHERE l_linenumber = 1")
def cooccurrence_list(spark, d):
    path = _at(spark, "pairs")
    rows = table(spark, d, "lineitem").filter("l_linenumber = 1")
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")]).alias("value")).write.text(path)
    return readers.cooccurrence_list(spark, path)


@query("""WITH e AS (SELECT vec_id AS idx, embedding AS vec, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings), m AS (SELECT avg(vec[1]::DOUBLE) AS m FROM e)
SELECT idx, 'w' || idx AS lemma, round(vec[1]::DOUBLE / n, 6) AS normed, round(vec[1]::DOUBLE - m, 6) AS centered FROM e, m""")
def embeddings_with_vocabulary(spark, d):
    """Vectors joined with their words, the first value in unit length and centred."""
    vectors = _embeddings(spark, d).withColumnRenamed("id", "idx")
    words = vectors.select("idx", F.concat(F.lit("w"), F.col("idx").cast("string")).alias("lemma"))
    one = lambda c: F.round(F.get(c, F.lit(0)), 6).alias(c)
    return readers.embeddings_with_vocabulary(vectors, words).select("idx", "lemma", one("normed"), one("centered"))


@query("SELECT url, sha256 AS source, ts AS added_at FROM fetch_items WHERE url IS NOT NULL")
def fetch_tasks(spark, d):
    """Links written as JSON lines and read as tasks."""
    path = _at(spark, "links")
    items = table(spark, d, "fetch_items").select("url", F.lit("mr").alias("lang"), F.col("sha256").alias("source"), F.col("ts").cast("timestamp").alias("added_at"))
    writers.write_json_lines(items, path)
    return readers.fetch_tasks(spark, path).select("url", "source", F.col("added_at").cast("timestamp_ntz").alias("added_at"))


@query("SELECT pdf_sha AS id, max(struct_pack(ts := ts, status := status)).status AS status FROM tokenize_manifest WHERE status <> 'error' GROUP BY 1")
def manifest_round_trip(spark, d):
    """The log appended to a manifest in two goes; the last line of each id counts."""
    path = _at(spark, "manifest")
    log = registry.latest(
        table(spark, d, "tokenize_manifest").filter("status <> 'error'").select(F.col("pdf_sha").alias("id"), "ts", "status"),
        "id",
        "ts",
    ).select("id", "status")
    writers.append_manifest(log.withColumn("status", F.lit("running")), path)
    writers.append_manifest(log, path)
    return writers.read_manifest(spark, path, "id string, status string")


@query("SELECT id, url, sha256 FROM fetch_items")
def registry_append(spark, d):
    """The fetch registry, grown by appends."""
    path = _at(spark, "registry")
    items = table(spark, d, "fetch_items").select("id", "url", "sha256")
    registry.append(items.filter("sha256 IS NOT NULL"), path)
    registry.append(items.filter("sha256 IS NULL"), path)
    return spark.read.parquet(path)


@query("SELECT sha256 AS id, lpad(left(sha256, 2), 2, '0') AS shard FROM documents")
def sharded_sink(spark, d):
    path = _at(spark, "sharded")
    writers.write_sharded(table(spark, d, "documents").select(F.col("sha256").alias("id")), path)
    return spark.read.schema("id string, shard string").parquet(path)


@query("SELECT count(*) AS n_docs, count(DISTINCT lang) AS n_langs FROM documents")
def report_round_trip(spark, d):
    path = _at(spark, "report")
    writers.write_report(spark, table(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.count_distinct("lang").alias("n_langs")).first().asDict(), path)
    got = readers.report(spark, path)
    return spark.createDataFrame([(got["n_docs"], got["n_langs"])], "n_docs long, n_langs long")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def incremental_counts(spark, d):
    """Counts of a stream of two files, of which the second comes after the first was processed: the same as of one batch."""
    source, target, seen = (_at(spark, n) for n in ("stream", "counts", "seen"))
    events = table(spark, d, "events").select("event_id", "event_type")
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        incremental.running_counts(spark, source, "event_id long, event_type string", "event_type", target, seen)
    return spark.read.parquet(target).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT i::INT AS page, 'https://x.in/list?page=' || i AS url FROM range(1, 90) r(i)")
def crawl_pages(spark, d):
    return readers.crawl_pages(spark, "https://x.in/list?page={page}", 1, 89)


# ---------------------------------------------------------------- state


@query(
    "SELECT sha256(text) AS artefact, min(id) AS id FROM doc_raw WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL) GROUP BY 1"
)
def text_artefacts(spark, d):
    """Page texts by the hash of their content, each once, those known left out."""
    known = table(spark, d, "documents").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("artefact"))
    return registry.new_texts(table(spark, d, "doc_raw"), known).select("artefact", "id")


def _lemma_results(spark, d) -> DataFrame:
    docs = table(spark, d, TOKENS).select("doc_id").distinct()
    status = F.when(F.substring("doc_id", 1, 1) < "8", "ok").otherwise("error")
    return docs.select("doc_id", F.lit("apertium").alias("method"), status.alias("status"))


@query(f"WITH {STAGE} SELECT sha256 AS doc_id FROM documents WHERE sha256 IN (SELECT doc_id FROM stage WHERE status = 'ok')")
def lemma_all(spark, d):
    """Without a status all tokenized documents are asked for."""
    return registry.tasks(_documents(spark, d), [_stage(spark, d)], _lemma_results(spark, d), None, method="apertium", none_is_all=True)


@query(
    f"WITH {STAGE} SELECT sha256 AS doc_id FROM documents WHERE sha256 IN (SELECT doc_id FROM stage WHERE status = 'ok') AND sha256 IN (SELECT doc_id FROM lemma_tokens WHERE left(doc_id, 1) >= '8')"
)
def lemma_by_status(spark, d):
    return registry.tasks(_documents(spark, d), [_stage(spark, d)], _lemma_results(spark, d), "error", method="apertium")


@query(f"WITH {STAGE} SELECT sha256 AS doc_id FROM documents WHERE sha256 NOT IN (SELECT doc_id FROM stage WHERE doc_id IS NOT NULL) ORDER BY 1 LIMIT 25")
def pending_limited(spark, d):
    return registry.tasks(_documents(spark, d), [], _stage(spark, d), limit=25)


@query(
    "WITH l AS (SELECT DISTINCT doc_id FROM lemma_tokens WHERE doc_id IS NOT NULL) SELECT doc_id, 'apertium' AS method, CASE WHEN left(doc_id, 1) < '8' THEN 'ok' ELSE 'again' END AS status FROM l UNION ALL SELECT doc_id, 'stanza', 'ok' FROM l WHERE left(doc_id, 1) >= '8'"
)
def upsert_by_two_keys(spark, d):
    """Results under (doc_id, method): the same method is replaced, another added."""
    old = _lemma_results(spark, d).filter("doc_id IS NOT NULL")
    failed = old.filter("status = 'error'")
    new = failed.withColumn("status", F.lit("again")).unionByName(failed.withColumns({"method": F.lit("stanza"), "status": F.lit("ok")}))
    return registry.upsert(old, new, ["doc_id", "method"])


@query("SELECT run_id, params.min_df AS min_df, params.replace_ner AS replace_ner FROM vocab_builds WHERE status = 'ok'")
def build_params(spark, d):
    """Parameters kept as JSON, read again."""
    builds = registry.with_json(table(spark, d, "vocab_builds"), params=F.col("params"))
    parsed = F.from_json("params", "min_df double, replace_ner boolean")
    return registry.of(builds, status="ok").select("run_id", parsed["min_df"].alias("min_df"), parsed["replace_ner"].alias("replace_ner"))


@query("SELECT run_id, status FROM tdm_builds ORDER BY run_id")
def builds_listed(spark, d):
    return registry.list_builds(table(spark, d, "tdm_builds")).select("run_id", "status")


@query("SELECT id, url FROM fetch_items WHERE sha256 IN (SELECT sha256 FROM documents WHERE lang = 'mr')")
def fetched_lookup(spark, d):
    """Fetched items of the contents asked for."""
    return table(spark, d, "fetch_items").join(table(spark, d, "documents").filter("lang = 'mr'").select("sha256"), "sha256", "left_semi").select("id", "url")


# ---------------------------------------------------------------- words


@query("""WITH s AS (SELECT id, unnest(sentences) AS tokens, generate_subscripts(sentences, 1)::INT - 1 AS sent_no FROM (SELECT id, any_value(sentences) AS sentences FROM doc_tok WHERE sentences IS NOT NULL GROUP BY id HAVING count(*) = 1)),
k AS (SELECT id, sent_no, coalesce(len(list_filter(tokens, lambda t: regexp_full_match(t, '[\\x{0966}-\\x{096F}0-9]+') OR regexp_full_match(t, '[\\x{0900}-\\x{097F}]+'))), 0)::INT AS n_kept FROM s) SELECT * FROM k""")
def lemmatized_documents(spark, d):
    """Documents lemmatized as such: how many tokens each sentence keeps, emptied sentences with 0."""
    docs = table(spark, d, "doc_tok").filter("sentences IS NOT NULL")
    once = docs.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1")
    out = lemmatize.lemmatize_documents(docs.join(once, "id", "left_semi"), lemmatize.SuffixLemmatizer(lemmatize.MARATHI_SUFFIXES))
    return out.select("id", F.posexplode("sentences").alias("sent_no", "s")).select("id", "sent_no", F.size("s").alias("n_kept"))


@query("""WITH RECURSIVE s AS (SELECT id, unnest(sentences) AS tokens, generate_subscripts(sentences, 1)::INT - 1 AS sent_no FROM (SELECT id, any_value(sentences) AS sentences FROM doc_tok WHERE sentences IS NOT NULL GROUP BY id HAVING count(*) = 1)),
n AS (SELECT id, sent_no, coalesce(len(tokens), 0) AS n FROM s),
c AS (SELECT id, sent_no, n AS total, 0 AS chunk FROM n WHERE sent_no = 0
  UNION ALL SELECT n.id, n.sent_no, CASE WHEN c.total + n.n > 80 THEN n.n ELSE c.total + n.n END, CASE WHEN c.total + n.n > 80 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN n ON n.id = c.id AND n.sent_no = c.sent_no + 1)
SELECT id, sent_no, chunk FROM c""")
def sentence_chunks(spark, d):
    """Sentences in chunks of at most 80 tokens."""
    docs = table(spark, d, "doc_tok").filter("sentences IS NOT NULL")
    once = docs.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1")
    return lemmatize.chunks(docs.join(once, "id", "left_semi"))


@query("""SELECT doc_id, sent_no, tok_no, CASE WHEN bool_or(is_ne) THEN coalesce(max(ner_result), 'Other') ELSE 'Other' END AS ner_result FROM (SELECT doc_id, sent_no, tok_no, is_ne, CASE WHEN is_ne THEN ner_result END AS ner_result FROM lemma_tokens WHERE doc_id IS NOT NULL AND sent_no IS NOT NULL AND tok_no IS NOT NULL) GROUP BY ALL""")
def labelled_names(spark, d):
    """Labels with position prefixes, of the first parts of words, put to the words of the same place; the others are no names."""
    rows = table(spark, d, TOKENS).filter("doc_id IS NOT NULL AND sent_no IS NOT NULL AND tok_no IS NOT NULL")
    words = rows.select("doc_id", "sent_no", "tok_no").distinct()
    named = rows.filter("is_ne AND ner_result IS NOT NULL").groupBy("doc_id", "sent_no", "tok_no").agg(F.max("ner_result").alias("label"))
    parts = named.select("doc_id", "sent_no", "tok_no", F.posexplode(F.array(F.concat(F.lit("B-"), F.col("label")), F.lit("I-Part"))).alias("part_no", "label"))
    return lemmatize.label_names(words, lemmatize.first_labels(parts)).select("doc_id", "sent_no", "tok_no", "ner_result")


@query(
    "SELECT 'ner_ratio' AS key, round(count(*) FILTER (is_ne) / count(*)::DOUBLE, 6) AS value FROM lemma_tokens UNION ALL SELECT coalesce(ner_result, 'None'), count(*)::DOUBLE FROM lemma_tokens WHERE is_ne GROUP BY 1"
)
def ner_summary(spark, d):
    return tok.ner_summary(table(spark, d, TOKENS)).select(F.explode("summary").alias("key", "value")).withColumn("value", F.round("value", 6))


@query("""SELECT DISTINCT analyses, list_filter(a, lambda x, i: list_position(a, x) = i) AS lemmas FROM (SELECT analyses, list_transform(list_concat(analyses, list_transform(analyses, lambda x: '*' || x)), lambda x: regexp_replace(x, '^[*@#]+', '')) AS a FROM lemma_tokens WHERE analyses IS NOT NULL AND len(analyses) > 0)""")
def stripped_analyses(spark, d):
    """Analyses without markers of unknown words, each once in order."""
    rows = table(spark, d, TOKENS).filter("size(analyses) > 0").select("analyses").distinct()
    marked = F.concat("analyses", F.transform("analyses", lambda x: F.concat(F.lit("*"), x)))
    return rows.select("analyses", text.stripped_distinct(marked).alias("lemmas"))


@query("SELECT DISTINCT coalesce(lemma, '') || '<' || coalesce(pos, 'x') || '><sg>+x<y>' AS reading FROM lemma_tokens")
def analyser_readings(spark, d):
    """Readings as an analyser writes them, from lemmas and tags."""
    rows = table(spark, d, TOKENS).select(F.coalesce("lemma", F.lit("")).alias("lemma"), F.coalesce("pos", F.lit("x")).alias("pos")).distinct()
    return rows.select(text.reading(F.array("lemma", F.lit("x")), F.array(F.array("pos", F.lit("sg")), F.array(F.lit("y")))).alias("reading")).distinct()


@query(
    "SELECT id, regexp_replace(replace('/' || local_path, '/', chr(92)), '^x', '') IS NOT NULL AS has_path, regexp_replace(local_path, '^/+', '') AS path FROM fetch_items WHERE NOT contains(coalesce(local_path, ''), '..')"
)
def relative_paths(spark, d):
    """Paths with backslashes and a leading one, made relative."""
    rows = table(spark, d, "fetch_items").filter("NOT contains(coalesce(local_path, ''), '..')")
    odd = F.translate(F.concat(F.lit("/"), F.col("local_path")), "/", "\\")
    return rows.select("id", odd.isNotNull().alias("has_path"), text.relative_path(odd).alias("path"))


@query("SELECT split_part(id, '#', 1) || '#' || coalesce(meta.page_num, 0) AS page FROM doc_raw WHERE id IS NOT NULL")
def page_ids(spark, d):
    return table(spark, d, "doc_raw").filter("id IS NOT NULL").select(text.page_id(F.split("id", "#")[0], F.coalesce("meta.page_num", F.lit(0))).alias("page"))


@query("SELECT doc_id, count(DISTINCT token) AS n_types FROM lemma_tokens WHERE token IS NOT NULL GROUP BY doc_id")
def distinct_tokens(spark, d):
    return table(spark, d, TOKENS).filter("token IS NOT NULL").groupBy("doc_id").agg(F.size(F.collect_set("token")).cast("long").alias("n_types"))


# ---------------------------------------------------------------- vectors


@query("SELECT 'GOOD' AS quality, 2::BIGINT AS n UNION ALL SELECT 'POOR', 1 UNION ALL SELECT 'N/A', 1")
def quality_histogram(spark, d):
    """Labels of reports, of which one has none."""
    report = lambda x: _embeddings(spark, d).agg(geometry.label(F.lit(x).cast("double") + F.count("*") * 0, (0.2, "GOOD"), (0.4, "OK")).alias("quality"))
    return geometry.quality_counts(report(0.1), report(0.15), report(0.9), report(None))


@query("""WITH s AS (SELECT i AS component, (8 - i)::DOUBLE AS sigma FROM range(8) r(i)), c AS (SELECT *, sum(sigma * sigma) OVER (ORDER BY component) / (SELECT sum(sigma * sigma) FROM s) AS upto FROM s)
SELECT min(component + 1) FILTER (upto >= 0.9) AS effective_rank_90, min(component + 1) FILTER (upto >= 0.95) AS effective_rank_95, max(sigma) AS sigma_max, min(sigma) AS sigma_min, median(sigma) AS sigma_median, avg(sigma) AS sigma_mean FROM c""")
def spectrum_of_known_sigma(spark, d):
    """The summary of the spectrum 8, 7, ... 1."""
    sigma = spark.range(8).select(F.col("id").cast("int").alias("component"), (8.0 - F.col("id")).alias("sigma"))
    whole = sigma.agg(F.sum(F.col("sigma") * F.col("sigma")).alias("frobenius"))
    return svd.spectrum_summary(svd.spectrum(sigma, whole))
