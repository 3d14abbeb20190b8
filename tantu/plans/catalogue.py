"""The queries of the core operators by name, each over whole tables, and the SQL that says the same.

Queries without SQL: those whose result depends on a numeric method (SVD, eigenvalues) or on a stream; tests hold them to
brute force instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tantu.functions import script, text
from tantu.operators import fragments as frag, geometry, lemmatize, matrix, registry, svd, tokens as tok, vocabulary as voc
from tantu.session import materialise, table
from tantu.sources import readers

#: More queries and SQL are added by the module exchanges.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- text

SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORDS = rf"list_filter(list_transform(string_split(regexp_replace(s, '{SPACE}+', ' ', 'g'), ' '), lambda t: regexp_replace(regexp_replace(t, '^[^\p{{L}}\p{{N}}_]+', ''), '[^\p{{L}}\p{{N}}_]+$', '')), lambda t: t <> '')"
DOC_SENTENCES = rf"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
t AS (SELECT doc_id, {WORDS} AS tokens FROM s)"""


@query(DOC_SENTENCES + """ SELECT doc_id, count(*) FILTER (len(tokens) > 0) AS num_sentences, coalesce(sum(len(tokens)), 0)::BIGINT AS num_tokens FROM t GROUP BY doc_id""")
def tokenize_simple(spark, d):
    """Sentences and tokens of every document by the simple tokenizer."""
    t = table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("s")).filter("s IS NOT NULL")
    return t.select("doc_id", F.size("s").cast("long").alias("num_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("num_tokens"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS clean FROM documents")
def normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text"), compatibility=False).alias("clean"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(
  translate(nfc_normalize(text), chr(160) || chr(10), '  '), 'https?://\S+|www\.\S+', ' ', 'g'), '०१२३४५६७८९', '0123456789'),
  '[^\x{{0900}}-\x{{097F}}0-9!"#$%&''()*+,\-./:;<=>?@\[\\\]\^_`{{|}}~\x{{0964}}\x{{2013}}\x{{2014}}\x{{2026}}\x{{AB}}\x{{BB}}\x{{09}}-\x{{0D}} ]', ' ', 'g'),
  '([?!.,।]){{2,}}', '\1', 'g'), '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS clean FROM documents""")
def devanagari_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_devanagari(F.col("text")).alias("clean"))


CLASS = r"""CASE WHEN {c} IS NULL OR NOT regexp_full_match({c}, '[\x{{0900}}-\x{{097F}}\x{{A8E0}}-\x{{A8FF}}]+') THEN 'non_devanagari'
  WHEN regexp_matches({c}, '^[\p{{Mn}}\p{{Mc}}]') THEN 'invalid_deva'
  WHEN length({c}) > 30 OR regexp_matches({c}, '्[अआइईउऊऋऌएऐओऔॠॡ]') OR contains({c}, '््') OR (length({c}) > 3 AND (length({c}) - length(replace({c}, '्', '')))::DOUBLE / length({c}) > 0.35)
    OR list_bool_or(list_transform(range(1, length({c}) + 1), lambda i: list_bool_or(list_transform([2, 3, 4], lambda n: length(substring({c}, i, 3 * n)) = 3 * n
      AND substring({c}, i, n) = substring({c}, i + n, n) AND substring({c}, i, n) = substring({c}, i + 2 * n, n))))) THEN 'ocr_garbage' ELSE 'ok' END"""


@query(f"SELECT token, {CLASS.format(c='token')} AS class, count(*) AS n FROM lemma_tokens GROUP BY ALL")
def devanagari_classify(spark, d):
    """Class of every distinct token, with how often it occurs."""
    t = table(spark, d, "lemma_tokens").groupBy("token").agg(F.count("*").alias("n"))
    return t.select("token", script.classify(F.col("token")).alias("class"), "n")


@query(r"""SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (is_oov) AS n_oov, count(*) FILTER (is_ambiguous) AS n_ambiguous,
count(*) FILTER (NOT regexp_full_match(coalesce(token, ''), '[\x{0966}-\x{096F}0-9]+') AND NOT regexp_full_match(coalesce(token, ''), '[\x{0900}-\x{097F}]+')) AS n_weird FROM lemma_tokens GROUP BY doc_id""")
def doc_lemma_stats(spark, d):
    return tok.doc_lemma_stats(table(spark, d, "lemma_tokens"))


@query(
    "SELECT id, coalesce(len(sentences), 0)::INT AS num_sentences, coalesce(list_sum(list_transform(sentences, lambda s: coalesce(len(s), 0))), 0)::INT AS num_tokens FROM doc_tok"
)
def doc_token_stats(spark, d):
    return tok.doc_token_stats(table(spark, d, "doc_tok"))


@query("""WITH s AS (SELECT id, unnest(sentences) AS tokens, generate_subscripts(sentences, 1) - 1 AS sent_no FROM doc_tok),
t AS (SELECT id, sent_no, unnest(tokens) AS token FROM s) SELECT id AS doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_types, max(sent_no)::INT AS last_sentence FROM t GROUP BY id""")
def exploded_documents(spark, d):
    t = tok.exploded(table(spark, d, "doc_tok"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("token").alias("n_types"), F.max("sent_no").alias("last_sentence"))


@query("""WITH p AS (SELECT DISTINCT split_part(id, '#', 1) AS doc_id, coalesce(try_cast(split_part(id, '#', 2) AS BIGINT), 0) AS n, text FROM doc_raw WHERE text IS NOT NULL)
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY n, text) AS text, count(*) AS n_pages FROM p GROUP BY doc_id""")
def page_concat(spark, d):
    """Books: the pages of each document joined."""
    return readers.books(table(spark, d, "doc_raw"))


@query("SELECT sha256, lpad(substring(sha256, 1, 2), 2, '0') || '/' || sha256 || '.json' AS path, sha256(text) AS content_sha FROM documents")
def shard_path(spark, d):
    return table(spark, d, "documents").select("sha256", text.shard(F.col("sha256"), ".json").alias("path"), F.sha2("text", 256).alias("content_sha"))


@query("SELECT token, translate(token, '०१२३४५६७८९', '0123456789') AS ascii, count(*) AS n FROM lemma_tokens WHERE regexp_matches(token, '[०-९]') GROUP BY ALL")
def digit_map(spark, d):
    t = table(spark, d, "lemma_tokens").filter(F.col("token").rlike("[०-९]"))
    return t.groupBy("token").agg(F.count("*").alias("n")).select("token", F.translate("token", text.DEVANAGARI_DIGITS, text.ASCII_DIGITS).alias("ascii"), "n")


# ---------------------------------------------------------------- lemmas and vocabulary

TOKENS = "lemma_tokens"
TF = "tf AS (SELECT lemma, count(*) AS tf, count(DISTINCT doc_id) AS df FROM lemma_tokens WHERE lemma IS NOT NULL GROUP BY lemma), n AS (SELECT count(DISTINCT doc_id) AS n FROM lemma_tokens)"
BUILT = f"{TF}, kept AS (SELECT lemma, tf, df FROM tf, n WHERE df >= 2 AND df <= greatest(2, floor(0.9::DOUBLE * n)) AND tf >= 1)"
NUMBERED = f"{BUILT}, vocab AS (SELECT (row_number() OVER (ORDER BY tf DESC, lemma) - 1)::INT AS idx, lemma, tf, df FROM kept)"


@query(f"WITH {TF} SELECT lemma, tf FROM tf")
def term_frequency(spark, d):
    return voc.frequencies(table(spark, d, TOKENS)).select("lemma", "tf")


@query(f"WITH {TF} SELECT lemma, df FROM tf")
def document_frequency(spark, d):
    return voc.frequencies(table(spark, d, TOKENS)).select("lemma", "df")


@query(f"WITH {NUMBERED} SELECT * FROM vocab")
def vocab_filtered(spark, d):
    t = table(spark, d, TOKENS)
    return voc.build(t, t)


@query(f"WITH {NUMBERED} SELECT * FROM vocab ORDER BY idx LIMIT 20")
def vocab_topk(spark, d):
    t = table(spark, d, TOKENS)
    return voc.build(t, t).orderBy("idx").limit(20)


@query(f"WITH {TF}, r AS (SELECT lemma, tf, df, n FROM tf, n ORDER BY df, lemma LIMIT 30) SELECT lemma, tf, df FROM r WHERE df < 3")
def vocab_rare(spark, d):
    t = table(spark, d, TOKENS)
    return voc.rarest(voc.frequencies(t), t, 3)


@query(
    f"WITH {TF}, r AS (SELECT lemma, tf, df, n FROM tf, n ORDER BY df DESC, lemma LIMIT 20) SELECT lemma, tf, df FROM r WHERE df > greatest(1, floor(0.3::DOUBLE * n)) ORDER BY df DESC, lemma LIMIT 5"
)
def vocab_frequent(spark, d):
    t = table(spark, d, TOKENS)
    return voc.commonest(voc.frequencies(t), t, 0.3)


@query(f"""WITH {TF}, k AS (SELECT *, df < 2 AS below, df > greatest(2, floor(0.9::DOUBLE * n)) AS above FROM tf, n)
SELECT max(n) AS n_docs, sum(tf)::BIGINT AS n_tokens, count(*) AS n_terms, count(*) FILTER (NOT below AND NOT above) AS n_kept, count(*) FILTER (below) AS filtered_by_min_df, count(*) FILTER (NOT below AND above) AS filtered_by_max_df,
round(count(*) / sum(tf)::DOUBLE, 6) AS ttr_raw, round(count(*) FILTER (NOT below AND NOT above) / (sum(tf) FILTER (NOT below AND NOT above))::DOUBLE, 6) AS ttr_kept, round((sum(tf) FILTER (NOT below AND NOT above)) / sum(tf)::DOUBLE, 6) AS coverage FROM k""")
def vocab_report(spark, d):
    return _r(voc.report(table(spark, d, TOKENS)), "ttr_raw", "ttr_kept", "coverage")


@query(
    f"WITH {NUMBERED} SELECT (idx // 4096)::INT AS part, sha256(string_agg(idx || chr(9) || lemma || chr(9) || tf || chr(9) || df, chr(10) ORDER BY idx)) AS sha FROM vocab GROUP BY 1"
)
def vocab_hash(spark, d):
    t = table(spark, d, TOKENS)
    return voc.content_hash(voc.build(t, t))


@query("""WITH t AS (SELECT CASE WHEN coalesce(is_ne, false) THEN '<' || upper(coalesce(ner_result, 'None')) || '>' ELSE lemma END AS lemma FROM lemma_tokens WHERE NOT coalesce(is_oov, false))
SELECT lemma, count(*) AS tf FROM t WHERE lemma IS NOT NULL GROUP BY lemma""")
def ner_replaced_tf(spark, d):
    t = tok.preprocess(table(spark, d, TOKENS), tok.Options(replace_ner=True, ignore_oov=True))
    return t.groupBy("lemma").agg(F.count("*").alias("tf"))


def _plain_sql(c: str) -> str:
    return rf"regexp_replace(nfc_normalize({c}), '[\x{{200B}}-\x{{200F}}\x{{AD}}\x{{FEFF}}]', '', 'g')"


PLAIN = f"SELECT lemma, {_plain_sql('lemma')} AS plain FROM lemma_tokens WHERE lemma IS NOT NULL"


@query(f"""WITH p AS (SELECT lemma, plain, count(*) AS n FROM ({PLAIN}) GROUP BY ALL), k AS (SELECT *, CASE WHEN lemma LIKE '<%' AND lemma LIKE '%>' AND length(lemma) > 1 THEN lemma WHEN {CLASS.format(c='plain')} = 'ok' THEN plain END AS kept FROM p)
SELECT kept AS lemma, sum(n)::BIGINT AS tf FROM k WHERE kept IS NOT NULL GROUP BY kept""")
def normalized_tf(spark, d):
    t = tok.preprocess(table(spark, d, TOKENS), tok.Options(normalize=True))
    return t.groupBy("lemma").agg(F.count("*").alias("tf"))


@query(f"""WITH k AS (SELECT lemma, plain, CASE WHEN lemma LIKE '<%' AND lemma LIKE '%>' AND length(lemma) > 1 THEN 'ok' ELSE {CLASS.format(c='plain')} END AS kind, count(*) AS n FROM ({PLAIN}) GROUP BY ALL)
SELECT sum(n)::BIGINT AS before, sum(CASE WHEN plain <> lemma THEN n ELSE 0 END)::BIGINT AS changed, sum(CASE WHEN kind = 'non_devanagari' THEN n ELSE 0 END)::BIGINT AS non_devanagari, sum(CASE WHEN kind = 'invalid_deva' THEN n ELSE 0 END)::BIGINT AS invalid_deva,
sum(CASE WHEN kind = 'ocr_garbage' THEN n ELSE 0 END)::BIGINT AS ocr_garbage, sum(CASE WHEN kind = 'ok' THEN n ELSE 0 END)::BIGINT AS accepted, count(DISTINCT lemma) - count(DISTINCT plain) AS collapsed FROM k""")
def normalization_accounting(spark, d):
    return tok.normalization_account(table(spark, d, TOKENS))


@query("""SELECT count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (is_oov) AS n_oov, count(*) FILTER (is_ambiguous) AS n_ambiguous, round(count(*) FILTER (is_oov) / count(*)::DOUBLE, 6) AS oov_rate,
round(count(*) FILTER (is_ambiguous) / count(*)::DOUBLE, 6) AS ambiguity_rate, round(sum(greatest(coalesce(len(analyses), 0), 1)) / count(*)::DOUBLE, 6) AS analyses_per_token FROM lemma_tokens""")
def lemma_quality(spark, d):
    return _r(tok.lemma_quality(table(spark, d, TOKENS)), "oov_rate", "ambiguity_rate", "analyses_per_token")


@query("SELECT coalesce(nullif(pos, ''), 'null') AS pos, count(*) AS n_tokens FROM lemma_tokens GROUP BY 1")
def pos_histogram(spark, d):
    return tok.pos_histogram(table(spark, d, TOKENS))


@query("SELECT coalesce(ner_result, 'None') AS ner_result, count(*) AS n_tokens FROM lemma_tokens WHERE is_ne GROUP BY 1")
def ner_histogram(spark, d):
    return tok.ner_histogram(table(spark, d, TOKENS))


@query(
    "SELECT round(avg(n), 6) AS mean_lemmas, min(n) AS min_lemmas, max(n) AS max_lemmas FROM (SELECT doc_id, count(DISTINCT lemma) AS n FROM lemma_tokens WHERE lemma IS NOT NULL GROUP BY doc_id)"
)
def unique_lemmas_per_doc(spark, d):
    return _r(tok.lemmas_per_doc(table(spark, d, TOKENS)), "mean_lemmas")


SUFFIXES = sorted(lemmatize.MARATHI_SUFFIXES, key=len, reverse=True)
STRIPPED = "CASE " + " ".join(f"WHEN token LIKE '%{x}' AND length(token) - {len(x)} >= 2 THEN left(token, length(token) - {len(x)})" for x in SUFFIXES) + " END"


@query(rf"""WITH s AS (SELECT unnest(sentences) AS tokens FROM doc_tok), t AS (SELECT unnest(tokens) AS token FROM s),
l AS (SELECT token, {STRIPPED} AS stem FROM t WHERE regexp_full_match(token, '[\x{{0966}}-\x{{096F}}0-9]+') OR regexp_full_match(token, '[\x{{0900}}-\x{{097F}}]+'))
SELECT coalesce(stem, token) AS lemma, count(*) AS tf, count(*) FILTER (stem IS NULL) AS n_oov FROM l GROUP BY 1""")
def lemmatize_plugin(spark, d):
    """Every distinct token of the tokenized documents through the suffix lemmatizer, joined back and counted."""
    t = lemmatize.lemmatize(tok.exploded(table(spark, d, "doc_tok")), lemmatize.SuffixLemmatizer(lemmatize.MARATHI_SUFFIXES))
    return t.groupBy("lemma").agg(F.count("*").alias("tf"), F.count_if("is_oov").alias("n_oov"))


# ---------------------------------------------------------------- fragments and matrices

SIZE = 4
LATEST = """last AS (SELECT doc_id, sent_no, tok_no, lemma FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no, tok_no ORDER BY updated_at DESC NULLS LAST, lemma DESC NULLS LAST) AS rn FROM lemma_tokens) WHERE rn = 1)"""
FRAGMENTS = f"""{LATEST}, {NUMBERED},
chunks AS (SELECT doc_id, chunk, n_sent, chunk = max(chunk) OVER (PARTITION BY doc_id) AND max(chunk) OVER (PARTITION BY doc_id) > 0 AND n_sent < {SIZE // 2} AS dropped
  FROM (SELECT doc_id, sent_no // {SIZE} AS chunk, count(DISTINCT sent_no) AS n_sent FROM last GROUP BY ALL)),
lists AS (SELECT l.doc_id, sent_no // {SIZE} AS chunk, list(idx ORDER BY sent_no, tok_no) AS token_ids FROM last l JOIN vocab USING (lemma) GROUP BY ALL),
frag AS (SELECT lists.doc_id AS source_doc_id, (row_number() OVER (PARTITION BY lists.doc_id ORDER BY lists.chunk) - 1)::INT AS position, token_ids FROM lists JOIN chunks ON lists.doc_id = chunks.doc_id AND lists.chunk = chunks.chunk WHERE NOT dropped),
fragments AS (SELECT sha256('7:' || source_doc_id || ':' || position || ':[' || array_to_string(token_ids, ', ') || ']') AS id, source_doc_id, position, token_ids, 7 AS vocab_id FROM frag)"""


def _parts(spark, d):
    t = table(spark, d, TOKENS)
    vocab = voc.build(t, t)
    last = registry.latest(t.select("doc_id", "sent_no", "tok_no", "updated_at", "lemma"), ["doc_id", "sent_no", "tok_no"], "updated_at")
    return last, vocab


def _fragments(spark, d):
    last, vocab = _parts(spark, d)
    return frag.fragments(last, last, vocab, size=SIZE, build_id=7)


@query(f"WITH {FRAGMENTS} SELECT * FROM fragments")
def fragments(spark, d):
    return _fragments(spark, d)


@query(f"""WITH {FRAGMENTS}, n AS (SELECT c.doc_id, c.chunk, dropped, coalesce(len(token_ids), 0) AS n FROM chunks c LEFT JOIN lists l ON c.doc_id = l.doc_id AND c.chunk = l.chunk)
SELECT count(DISTINCT doc_id) AS documents, count(*) FILTER (NOT dropped AND n > 0) AS fragments, coalesce(sum(n) FILTER (NOT dropped AND n > 0), 0)::BIGINT AS tokens, count(*) FILTER (dropped) AS skipped_tail, count(*) FILTER (NOT dropped AND n = 0) AS empty FROM n""".replace("n AS (SELECT count(DISTINCT doc_id) AS n FROM lemma_tokens)", "nn AS (SELECT count(DISTINCT doc_id) AS n FROM lemma_tokens)").replace("FROM tf, n WHERE", "FROM tf, nn WHERE"))
def fragment_counters(spark, d):
    last, vocab = _parts(spark, d)
    return frag.counters(last, last, vocab, size=SIZE)


ROWS = f"{FRAGMENTS}, numbered AS (SELECT row_number() OVER (ORDER BY source_doc_id, position) - 1 AS row, * FROM fragments)"
TDM = f"{ROWS}, m AS (SELECT row, col, count(*) AS tf FROM (SELECT row, unnest(token_ids) AS col FROM numbered) GROUP BY ALL), rows AS (SELECT count(DISTINCT row) AS n FROM m)"


def _rows(spark, d):
    return frag.numbered(_fragments(spark, d))


def _counts(spark, d):
    return matrix.counts(_rows(spark, d))


@query(f"WITH {ROWS} SELECT row, id, source_doc_id, position FROM numbered")
def matrix_rows(spark, d):
    """Which fragment each row of the matrix is."""
    return _rows(spark, d).select("row", "id", "source_doc_id", "position")


@query(f"WITH {TDM} SELECT * FROM m")
def tdm_tf(spark, d):
    return _counts(spark, d)


@query(
    f"WITH {TDM}, g AS (SELECT col, count(*) AS df FROM m GROUP BY col) SELECT row, col, round(ln(1 + tf) * ln(rows.n / df), 6) AS value FROM m JOIN g USING (col), rows"
)
def tdm_tfidf(spark, d):
    return _r(matrix.weighted(_counts(spark, d), "tf-idf"), "value")


ENTROPY = f"{TDM}, g AS (SELECT col, sum(tf) AS gf, sum(tf * ln(tf)) AS tlt FROM m GROUP BY col), w AS (SELECT row, col, ln(1 + tf) * (1 - (ln(gf) - tlt / gf) / ln(rows.n)) AS value FROM m JOIN g USING (col), rows)"


@query(f"WITH {ENTROPY} SELECT row, col, round(value, 6) AS value FROM w")
def tdm_log_entropy(spark, d):
    return _r(matrix.weighted(_counts(spark, d), "log-entropy"), "value")


@query(
    f"WITH {TDM} SELECT count(DISTINCT row) AS n_rows, (max(col) + 1)::BIGINT AS n_cols, count(*) AS nnz, round(count(*) / (count(DISTINCT row) * (max(col) + 1))::DOUBLE, 9) AS density FROM m"
)
def tdm_stats(spark, d):
    return _r(matrix.stats(_counts(spark, d)), "density", digits=9)


@query(f"WITH {ENTROPY} SELECT round(sum(value * value), 3) AS frobenius FROM w")
def tdm_frobenius(spark, d):
    return _r(matrix.frobenius(matrix.weighted(_counts(spark, d), "log-entropy")), "frobenius", digits=3)


@query(f"""WITH {LATEST}, p AS (SELECT lemma AS w1, lead(lemma) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no, lemma) AS w2 FROM last),
c AS (SELECT w1, w2, count(*) AS n FROM p WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY ALL), {NUMBERED.replace(" n AS (SELECT count", " nd AS (SELECT count").replace("FROM tf, n WHERE", "FROM tf, nd WHERE")},
e AS (SELECT a.idx AS i, b.idx AS j, c.n FROM c JOIN vocab a ON c.w1 = a.lemma JOIN vocab b ON c.w2 = b.lemma)
SELECT i, j, sum(n)::BIGINT AS value FROM (SELECT i, j, n FROM e UNION ALL SELECT j, i, n FROM e) GROUP BY ALL""")
def cooccurrence_symmetric(spark, d):
    last, vocab = _parts(spark, d)
    return matrix.symmetric(matrix.neighbour_pairs(last), vocab.select("idx", F.col("lemma").alias("word")))


def _svd(spark, d, k=8):
    m = materialise(matrix.weighted(_counts(spark, d), "log-entropy"), "tdm")
    return m, svd.truncated(m, k)


@query()
def svd_sigma(spark, d):
    return _svd(spark, d)[1].sigma


@query("SELECT (i - 1)::INT AS component, true AS unit_u, true AS unit_v, true AS consistent FROM range(1, 9) r(i)")
def svd_identities(spark, d):
    """Whether A'u = sigma v with vectors of length 1, for each component."""
    m, s = _svd(spark, d)
    unit = lambda c: F.abs(F.col(c) - 1) < 1e-6
    return svd.identities(m, s).select("component", unit("length_u").alias("unit_u"), unit("length_v").alias("unit_v"), (F.col("residual") < 1e-6).alias("consistent"))


@query(f"WITH {ENTROPY}, v AS (SELECT row, sum(value * value) AS n FROM w GROUP BY row) SELECT count(*) AS n_rows, true AS within FROM v WHERE n > 0")
def svd_rows(spark, d):
    """Rows on the components (U times sigma): none longer than the row of the matrix."""
    m, s = _svd(spark, d)
    own = m.groupBy("row").agg(F.sum(F.col("value") * F.col("value")).alias("n"))
    at = svd.transformed(s).select("row", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("p"))
    return own.filter("n > 0").join(at, "row", "left").agg(F.count("*").alias("n_rows"), F.every(F.col("p") <= F.col("n") * (1 + 1e-6) + 1e-9).alias("within"))


@query()
def svd_spectrum(spark, d):
    m, s = _svd(spark, d)
    return svd.spectrum_summary(svd.spectrum(s.sigma, matrix.frobenius(m)))


@query()
def word_vectors_from_svd(spark, d):
    return svd.norm_stats(svd.word_vectors(_svd(spark, d)[1], power=0.5))


# ---------------------------------------------------------------- vectors

EMB = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings)"


def _embeddings(spark, d):
    return geometry.usable(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("""WITH n AS (SELECT sqrt(list_sum(list_transform(normed, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM word_vectors WHERE normed IS NOT NULL AND len(list_filter(normed, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, count(*) FILTER (n = 0) AS n_zero FROM n""")
def embedding_norm_stats(spark, d):
    v = table(spark, d, "word_vectors").filter(F.forall("normed", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return _r(svd.norm_stats(v, "normed"), "mean_norm", "std_norm", "min_norm", "max_norm")


@query(f"WITH {EMB} SELECT id, list_transform(range(1, 9), lambda i: round(vec[i] * sqrt(i::DOUBLE), 6)) AS vec FROM e")
def sigma_power_scale(spark, d):
    """The first eight values scaled by the square roots of 1, 2, ..."""
    from tantu.functions.vectors import scaled

    sigma = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x.cast("double"))
    return _embeddings(spark, d).select("id", F.transform(scaled(F.col("vec"), sigma, 0.5, 8), lambda x: F.round(x, 6)).alias("vec"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
COSINE = f"{DOT.format(a='a.vec', b='b.vec')} / (sqrt({DOT.format(a='a.vec', b='a.vec')}) * sqrt({DOT.format(a='b.vec', b='b.vec')}))"


@query(f"""WITH {EMB}, n AS (SELECT count(*) AS n FROM e), p AS (SELECT (k * 7919 + 42) % n AS i, (k * 104729 + k * k % 1000003 + 42) % n AS j FROM range(100000) r(k), n),
c AS (SELECT {COSINE} AS c FROM p JOIN e a ON a.id = p.i JOIN e b ON b.id = p.j WHERE i <> j)
SELECT count(c) AS n_pairs, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(median(c), 6) AS median, round(quantile_cont(c, 0.05), 6) AS p5, round(quantile_cont(c, 0.95), 6) AS p95,
CASE WHEN abs(avg(c)) < 0.05 THEN 'GOOD' WHEN abs(avg(c)) < 0.15 THEN 'OK' WHEN abs(avg(c)) < 0.3 THEN 'MODERATE' ELSE 'POOR' END AS quality FROM c""")
def cosine_pair_stats(spark, d):
    return _r(geometry.cosine_distribution(_embeddings(spark, d)), "mean", "std", "median", "p5", "p95")


@query(f"""WITH {EMB}, l AS (SELECT vec, unnest(range(1, 65)) AS a FROM e), m AS (SELECT a, b, covar_samp(vec[a], vec[b]) AS c FROM (SELECT vec, a, unnest(range(1, 65)) AS b FROM l) GROUP BY a, b)
SELECT round(pow(sum(c) FILTER (a = b), 2) / sum(c * c), 6) AS participation_ratio FROM m""")
def participation_ratio(spark, d):
    out = geometry.participation_ratio(_embeddings(spark, d), 64)
    return spark.createDataFrame([(round(out["participation_ratio"], 6),)], "participation_ratio double")


NEAR = f"""{EMB}, s AS (SELECT a.id, b.id AS other, {COSINE} AS cosine FROM e a, e b WHERE a.id <> b.id{{q}}),
knn AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, other))::INT AS rank FROM s) WHERE rank <= {{k}})"""


@query(f"WITH {NEAR.format(q=' AND a.id % 20 = 0', k=10)} SELECT id, other, rank, round(cosine, 6) AS cosine FROM knn")
def knn_topk(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 20, against all."""
    v = _embeddings(spark, d)
    return _r(geometry.exact_neighbours(v.filter("id % 20 = 0"), v, 10), "cosine")


def _knn(spark, d, k=10):
    v = _embeddings(spark, d)
    return v, geometry.exact_neighbours(v, v, k)


@query(f"""WITH {NEAR.format(q='', k=10)}, n AS (SELECT e.id, count(k.other)::DOUBLE AS n FROM e LEFT JOIN knn k ON k.other = e.id GROUP BY e.id), m AS (SELECT avg(n) AS m, stddev_pop(n) AS s FROM n)
SELECT round((avg(n * n * n) - 3 * avg(n) * avg(n * n) + 2 * pow(avg(n), 3)) / pow(stddev_pop(n), 3), 6) AS skewness, count(*) FILTER (n > m + 2 * s) AS hubs, count(*) FILTER (n = 0) AS antihubs, max(n)::BIGINT AS max_n,
CASE WHEN (avg(n * n * n) - 3 * avg(n) * avg(n * n) + 2 * pow(avg(n), 3)) / pow(stddev_pop(n), 3) < 1 THEN 'GOOD' WHEN (avg(n * n * n) - 3 * avg(n) * avg(n * n) + 2 * pow(avg(n), 3)) / pow(stddev_pop(n), 3) < 1.5 THEN 'OK'
  WHEN (avg(n * n * n) - 3 * avg(n) * avg(n * n) + 2 * pow(avg(n), 3)) / pow(stddev_pop(n), 3) < 2.5 THEN 'MODERATE' ELSE 'POOR' END AS quality FROM n, m""")
def hubness(spark, d):
    v, found = _knn(spark, d)
    return _r(geometry.hubness(found, v), "skewness")


@query(f"""WITH {NEAR.format(q='', k=10)}, s2 AS (SELECT count(*) AS n_pairs, count(b.id) AS n_mutual FROM knn a LEFT JOIN knn b ON a.id = b.other AND a.other = b.id)
SELECT n_pairs, n_mutual, round(n_mutual / n_pairs::DOUBLE, 6) AS symmetry, CASE WHEN n_mutual / n_pairs::DOUBLE > 0.5 THEN 'GOOD' WHEN n_mutual / n_pairs::DOUBLE > 0.35 THEN 'OK' WHEN n_mutual / n_pairs::DOUBLE > 0.2 THEN 'MODERATE' ELSE 'POOR' END AS quality FROM s2""")
def knn_symmetry(spark, d):
    return _r(geometry.symmetry(_knn(spark, d)[1]), "symmetry")


@query(f"""WITH {NEAR.format(q='', k=20)}, l AS (SELECT id, list(other) FILTER (rank <= 5) AS a, list(other) FILTER (rank <= 10) AS b, list(other) AS c FROM knn GROUP BY id)
SELECT 5 AS k_small, 10 AS k_large, round(avg(len(list_intersect(a, b)) / len(a)::DOUBLE), 6) AS overlap FROM l UNION ALL SELECT 10, 20, round(avg(len(list_intersect(b, c)) / len(b)::DOUBLE), 6) FROM l""")
def knn_overlap(spark, d):
    return _r(geometry.overlap(_knn(spark, d, 20)[1]), "overlap")


@query(f"WITH {EMB} SELECT b.id::VARCHAR AS word, round({COSINE}, 6) AS cosine FROM e a, e b WHERE a.id = 0 AND b.id <> 0 ORDER BY {COSINE} DESC, word LIMIT 10")
def nearest_neighbors(spark, d):
    v = _embeddings(spark, d).select(F.col("id").cast("string").alias("word"), "vec")
    return _r(geometry.nearest_words(v, "0", 10), "cosine")


VEC = "v AS (SELECT ln(1 + tf) AS x, sqrt(list_sum(list_transform(normed, lambda x: x::DOUBLE * x::DOUBLE))) AS y FROM word_vectors WHERE tf > 0 AND normed IS NOT NULL AND len(list_filter(normed, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"


@query(f"""WITH {VEC}, r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v)
SELECT count(*) AS n, round(corr(x, y), 4) AS pearson, round(corr(rx, ry), 2) AS spearman FROM r""")
def freq_norm_correlation(spark, d):
    v = table(spark, d, "word_vectors").filter(F.forall("normed", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    out = geometry.frequency_norm(v, vector="normed")
    return out.select("n", F.round("pearson", 4).alias("pearson"), F.round("spearman", 2).alias("spearman"))


COVARIANCE = f"{EMB}, l AS (SELECT vec, unnest(range(1, 65)) AS a FROM e), c AS (SELECT a, b, covar_samp(vec[a], vec[b]) AS c FROM (SELECT vec, a, unnest(range(1, 65)) AS b FROM l) GROUP BY a, b)"


@query(f"WITH {COVARIANCE} SELECT round(sum(c) FILTER (a = b), 6) AS total, round(sum(c * c), 6) AS squares FROM c")
def isotropy_sums(spark, d):
    """Sum of the eigenvalues, and of their squares, that isotropy and principal components are made of."""
    import numpy as np

    values = np.linalg.eigvalsh(svd.covariance(_embeddings(spark, d), 64))
    return spark.createDataFrame([(round(float(values.sum()), 6), round(float((values**2).sum()), 6))], "total double, squares double")


@query(f"""WITH {EMB}, m AS (SELECT list(x ORDER BY d) AS mean FROM (SELECT d, avg(x) AS x FROM (SELECT unnest(vec) AS x, unnest(range(1, 65)) AS d FROM e) GROUP BY d))
SELECT count(*) AS n, true AS centred, true AS apart, true AS ordered FROM e""")
def pca_axes(spark, d):
    """Whether the two coordinates have mean 0, do not go together, and the first spreads more."""
    p = svd.principal_components(_embeddings(spark, d).withColumnRenamed("id", "idx"), 64, 2).select(F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))
    return p.agg(
        F.count("*").alias("n"), ((F.abs(F.avg("x")) < 1e-9) & (F.abs(F.avg("y")) < 1e-9)).alias("centred"),
        (F.abs(F.covar_samp("x", "y")) < 1e-9).alias("apart"), (F.var_samp("x") >= F.var_samp("y")).alias("ordered"),
    )


@query()
def isotropy(spark, d):
    return spark.createDataFrame(
        [geometry.isotropy(_embeddings(spark, d), 64)],
        "isotropy double, effective_rank double, top1_share double, condition double, quality string",
    )


@query()
def pca_2d(spark, d):
    return svd.principal_components(_embeddings(spark, d).withColumnRenamed("id", "idx"), 64, 2)


# ---------------------------------------------------------------- registry



def _stage(spark, d):
    """Results of the tokenize stage: the last row of each document in the manifest."""
    log = table(spark, d, "tokenize_manifest").select(F.col("pdf_sha").alias("doc_id"), "ts", "status", F.col("tokenize_path").alias("path"))
    return registry.latest(log, "doc_id", "ts")


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("sha256").alias("doc_id"))


@query(
    "SELECT doc_id, r.ts AS ts, r.status AS status, r.path AS path FROM (SELECT pdf_sha AS doc_id, max(struct_pack(ts := ts, status := status, path := tokenize_path)) AS r FROM tokenize_manifest GROUP BY pdf_sha)"
)
def manifest_latest(spark, d):
    return _stage(spark, d)


STAGE = "stage AS (SELECT doc_id, r.status AS status, r.path AS path FROM (SELECT pdf_sha AS doc_id, max(struct_pack(ts := ts, status := status, path := tokenize_path)) AS r FROM tokenize_manifest GROUP BY pdf_sha))"


@query(f"WITH {STAGE} SELECT sha256 AS doc_id FROM documents WHERE sha256 NOT IN (SELECT doc_id FROM stage WHERE doc_id IS NOT NULL)")
def pending_tasks(spark, d):
    return registry.tasks(_documents(spark, d), [], _stage(spark, d))


@query(f"WITH {STAGE} SELECT sha256 AS doc_id FROM documents WHERE sha256 IN (SELECT doc_id FROM stage WHERE status = 'error')")
def tasks_by_status(spark, d):
    return registry.tasks(_documents(spark, d), [], _stage(spark, d), "error")


@query(
    f"WITH {STAGE} SELECT sha256 AS doc_id FROM documents WHERE sha256 IN (SELECT doc_id FROM stage WHERE status = 'ok') AND sha256 NOT IN (SELECT doc_id FROM lemma_tokens WHERE doc_id IS NOT NULL)"
)
def pending_for_method(spark, d):
    """Tokenized documents without lemmas of the method."""
    done = table(spark, d, TOKENS).select("doc_id").distinct().withColumn("method", F.lit("apertium")).withColumn("status", F.lit("ok"))
    return registry.tasks(_documents(spark, d), [_stage(spark, d)], done, method="apertium")


@query(f"WITH {STAGE} SELECT doc_id, path FROM stage WHERE status = 'ok' AND path IS NOT NULL")
def completed_paths(spark, d):
    return registry.completed(_stage(spark, d))


@query(f"WITH {STAGE} SELECT coalesce(status, 'pending') AS status, count(*) AS n FROM stage GROUP BY 1")
def stage_status_counts(spark, d):
    return registry.status_counts(_stage(spark, d))


@query(f"""WITH {STAGE}, new AS (SELECT DISTINCT id AS doc_id, 'ok' AS status, 'again' AS path FROM doc_tok)
SELECT * FROM stage WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.doc_id IS NOT DISTINCT FROM stage.doc_id) UNION ALL SELECT * FROM new""")
def upsert_results(spark, d):
    new = table(spark, d, "doc_tok").select(F.col("id").alias("doc_id"), F.lit("ok").alias("status"), F.lit("again").alias("path")).distinct()
    return registry.upsert(_stage(spark, d).select("doc_id", "status", "path"), new, "doc_id")


@query("""WITH known AS (SELECT DISTINCT id AS doc_id, CAST(NULL AS VARCHAR) AS path FROM doc_tok), new AS (SELECT sha256 AS doc_id, min({'id': id, 'path': local_path}) AS r FROM fetch_items WHERE sha256 IS NOT NULL GROUP BY sha256)
SELECT doc_id, CAST(NULL AS BIGINT) AS id, path FROM known UNION ALL SELECT doc_id, r.id, r.path FROM new WHERE doc_id NOT IN (SELECT doc_id FROM known WHERE doc_id IS NOT NULL)""")
def sync_do_nothing(spark, d):
    """Documents from fetched items, those already there untouched."""
    known = table(spark, d, "doc_tok").select(F.col("id").alias("doc_id")).distinct().select(
        "doc_id",
        F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("string").alias("path"),
    )
    items = table(spark, d, "fetch_items").select(F.col("sha256").alias("doc_id"), "id", F.col("local_path").alias("path"))
    return registry.insert_missing(known, items, "doc_id", first="id")


@query("SELECT sha256, min(id) AS first_id, count(*) AS n_items, count(DISTINCT coalesce(url, '')) AS n_urls FROM fetch_items WHERE sha256 IS NOT NULL GROUP BY sha256")
def content_dedupe(spark, d):
    return registry.by_content(table(spark, d, "fetch_items"))


@query("SELECT DISTINCT url FROM fetch_items WHERE sha256 IS NULL AND url NOT IN (SELECT url FROM fetch_items WHERE sha256 IS NOT NULL AND url IS NOT NULL)")
def url_dedupe(spark, d):
    """Urls whose fetches all failed: still to fetch, each once."""
    items = table(spark, d, "fetch_items")
    return registry.new_urls(items.filter("sha256 IS NULL AND url IS NOT NULL").select("url"), items.filter("sha256 IS NOT NULL"))


@query("SELECT run_id, corpus_id, weighting, status, path FROM tdm_builds UNION ALL SELECT max(run_id) + 1, 9, 'tf-idf', 'running', NULL FROM tdm_builds")
def register_build(spark, d):
    builds = table(spark, d, "tdm_builds").select("run_id", "corpus_id", "weighting", "status", "path")
    return registry.register(builds, spark.createDataFrame([(9, "tf-idf", "running")], "corpus_id int, weighting string, status string"))


@query("SELECT run_id, CASE WHEN run_id = 4 THEN 'ok' ELSE status END AS status, CASE WHEN run_id = 4 THEN 'tdm/4' ELSE path END AS path FROM tdm_builds")
def complete_build(spark, d):
    return registry.complete(table(spark, d, "tdm_builds").select("run_id", "status", "path"), 4, status="ok", path="tdm/4")


@query("SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY user_id")
def latest_event(spark, d):
    return registry.latest(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_at_scale(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL")
def aggregate_at_scale(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
    )


@query(
    f"SELECT doc_id, 0 AS position, '/d/' || sha256 || '.pdf' AS href, trim(regexp_replace(coalesce(source, 'none') || '  pdf ', '\\s+', ' ', 'g')) AS text FROM documents UNION ALL SELECT doc_id, 1, '/more', 'more' FROM documents"
)
def html_links(spark, d):
    """Links of a page made of each document."""
    return readers.links(_pages(spark, d), key="doc_id")


def _pages(spark, d):
    html = F.concat(
        F.lit("<html><body><p>"),
        F.regexp_replace("text", "(?i)<a", "< a"),
        F.lit('</p><a class="x" href="/d/'),
        "sha256",
        F.lit('.pdf">'),
        F.coalesce("source", F.lit("none")),
        F.lit(' <b>pdf</b></a><a href="/more">more</a></body></html>'),
    )
    return table(spark, d, "documents").select("doc_id", html.alias("html"))


@query("SELECT doc_id, '/d/' || sha256 || '.pdf' AS href FROM documents")
def download_links(spark, d):
    return _pages(spark, d).select("doc_id", readers.download_link(F.col("html")).alias("href"))
