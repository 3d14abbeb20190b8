"""Command line: python -m tantu.cli <command> [options]. Exit codes: 0 done, 1 error, 2 network error, 130 interrupted.

With --registry builds are recorded in a table (run_id, kind, status, path, params, stats, at), and a build that starts from another is
told its run_id: it takes path and flags from there.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tantu.functions import text
from tantu.operators import fragments, geometry, lemmatize, matrix, registry, svd, tokens, vocabulary
from tantu.session import materialise, reach_workers
from tantu.sources import fetch, readers, writers


def _head(df: DataFrame, n: int | None, key: str = "doc_id") -> DataFrame:
    """The rows of the first n documents by key."""
    return df if n is None else df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


BUILDS = "run_id int, kind string, status string, path string, params string, stats string, at timestamp"


class NetworkError(Exception):
    pass


def _builds(spark: SparkSession, path: str) -> DataFrame:
    """The recorded builds, the last record of each run."""
    try:
        rows = spark.read.schema(BUILDS).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], BUILDS)
    return registry.latest(rows, "run_id", "at")


def _recorded(spark: SparkSession, a: argparse.Namespace, kind: str, params: dict, build: Callable[[], dict]) -> None:
    """Run the build and record it: running before, ok with its stats or error after."""
    if not a.registry:
        build()
        return
    run_id = registry.register(_builds(spark, a.registry).select("run_id"), spark.createDataFrame([(None,)], "run_id int")).agg(F.max("run_id")).first()[0]

    def mark(status: str, stats: dict | None) -> None:
        row = (run_id, kind, status, a.output, json.dumps(params, sort_keys=True), None if stats is None else json.dumps(stats, sort_keys=True, default=str))
        registry.append(spark.createDataFrame([row], BUILDS.removesuffix(", at timestamp")).withColumn("at", F.current_timestamp()), a.registry)

    mark("running", None)
    try:
        stats = build()
    except BaseException:
        mark("error", None)
        raise
    mark("ok", stats)


def _inherited(spark: SparkSession, a: argparse.Namespace) -> tuple[str, dict]:
    """Path and params of the build that --from-build names; without it the command's own."""
    if a.from_build is None:
        return a.vocabulary, {n: getattr(a, n) for n in FLAGS}
    row = registry.get_build(_builds(spark, a.registry), a.from_build, need_ok=True)
    return row["path"], registry.from_json(row)


def discover_links(spark: SparkSession, a: argparse.Namespace) -> None:
    """Links of pages in a table or, with --page-to, of list pages fetched by the template that the input then is."""
    pages = spark.read.parquet(a.input) if a.page_to is None else None
    if pages is None:
        got = fetch.fetched(readers.crawl_pages(spark, a.input, a.page_from, a.page_to, a.head)).select("url", "status", F.decode("content", "UTF-8").alias("html"))
        pages = materialise(got.withColumnRenamed("url", "page_id"), "list-pages")
        if pages.filter("status = 0").limit(1).count():
            raise NetworkError("a page could not be reached")
    readers.links(pages).write.mode("overwrite").parquet(a.output)


def fetch_pdfs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fetch the links (JSON lines) not fetched before into a folder, under the hash of their content; every try is a row of the registry table in it."""
    links = readers.fetch_tasks(spark, a.input, a.head)
    at = f"{a.output}/registry"
    try:
        links = registry.new_urls(links, spark.read.parquet(at).filter("sha256 IS NOT NULL"))
    except AnalysisException:
        pass
    rows = fetch.fetched(links, folder=f"{a.output}/files").select("url", "sha256", F.col("path").alias("local_path"), "status", "error")
    registry.append(rows.withColumn("ts", F.current_timestamp()), at)


READERS: dict[str, Callable[[bytes], Iterable[str]]] = {"text": lambda content: content.decode("utf-8").split("\f")}


def extract_text(spark: SparkSession, a: argparse.Namespace) -> None:
    """Pages of all files of a folder by the reader named; failures are results of status error. Documents with a result are done already."""
    files = readers.files(spark, a.input)
    results, status = f"{a.output}/results", a.target_status or registry.PENDING
    try:
        files = registry.tasks(files.withColumnRenamed("sha256", "doc_id"), [], spark.read.parquet(results), status)
    except AnalysisException:
        files = files.withColumnRenamed("sha256", "doc_id")
    if a.head is not None:
        files = files.orderBy("doc_id").limit(a.head)
    pages = materialise(lemmatize.page_texts(files, READERS[a.reader]), "pages")
    good = pages.filter("error IS NULL")
    page = good.select(text.page_id(F.col("doc"), F.col("page_num")).alias("id"), "text", F.struct("page_num").alias("meta"))
    registry.append(page, f"{a.output}/pages")
    done = pages.groupBy(F.col("doc").alias("doc_id")).agg(F.max("error").alias("error"), F.count("text").alias("n_pages"))
    registry.append(done.select("doc_id", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error", "n_pages"), results)


def copy_files(spark: SparkSession, a: argparse.Namespace) -> None:
    """Files of a folder, or of its part --stage, copied from any file system to any other; those there already are left, with --dry-run all."""
    sub = f"/{a.stage}" if a.stage else ""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    root = jvm.Path(a.input + sub)
    fs = root.getFileSystem(conf)
    found, base = fs.listFiles(root, True), fs.makeQualified(root).toUri().getPath()
    while found.hasNext():
        source = found.next().getPath()
        target = jvm.Path(a.output + sub + source.toUri().getPath()[len(base) :])
        if source.getName() == ".DS_Store" or target.getFileSystem(conf).exists(target):
            continue
        print(target.toString())
        if not a.dry_run:
            jvm.FileUtil.copy(fs, source, target.getFileSystem(conf), target, False, conf)


def tokenize_text(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = readers.json_lines(spark, a.input, readers.PAGE) if a.json else spark.read.parquet(a.input)
    books = _head(readers.books(pages), a.head)
    if a.state:
        books = registry.tasks(books, [], spark.read.parquet(a.state), None if a.target_status in ("none", "all") else a.target_status)
    clean = text.clean_devanagari(F.col("text"))
    out = books.select(F.col("doc_id").alias("id"), F.lit(a.lang).alias("lang"), F.transform(text.sentences(clean, ".?!।"), text.tokenize_padded).alias("sentences"))
    writers.write_sharded(out, a.output)


#: Lemmatizers by name; more can be put in.
LEMMATIZERS: dict[str, Callable[[], lemmatize.Lemmatizer]] = {"suffix": lambda: lemmatize.SuffixLemmatizer(lemmatize.MARATHI_SUFFIXES)}
#: What is done to lemmas when a vocabulary is built, and again when its corpus is indexed.
FLAGS = ("replace_ner", "normalize", "ignore_oov")


def lemmatize_text(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = _head(spark.read.parquet(a.input), a.head, "id")
    if a.state:
        done = spark.read.parquet(a.state).withColumnRenamed("doc_id", "id")
        status = None if a.target_status in ("none", "all") else a.target_status or registry.PENDING
        docs = registry.tasks(docs, [], done, status, method=a.lemmatize_func, none_is_all=True, key="id")
    if a.nested:
        lemmatize.lemmatize_documents(docs, LEMMATIZERS[a.lemmatize_func]()).write.mode("overwrite").parquet(a.output)
    else:
        lemmatize.lemmatize(tokens.exploded(docs), LEMMATIZERS[a.lemmatize_func]()).write.mode("overwrite").parquet(a.output)


def build_vocab(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _head(spark.read.parquet(a.input), a.head)
    kept = tokens.preprocess(rows, tokens.Options(a.replace_ner, a.normalize, a.ignore_oov))
    if not rows.limit(1).count():
        raise ValueError("no documents")

    def build() -> dict:
        writers.write_vocabulary(vocabulary.build(kept, rows, min_df=a.min_df, max_df=a.max_df, min_tf=a.min_tf), a.output)
        return {"n_terms": readers.vocabulary(spark, a.output).count()}

    _recorded(spark, a, "vocabulary", {n: getattr(a, n) for n in (*FLAGS, "min_df", "max_df", "min_tf")}, build)


def index_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    """The flags are those of the vocabulary's build, if --from-build names it."""
    path, flags = _inherited(spark, a)
    rows = _head(spark.read.parquet(a.input), a.head)
    kept = tokens.preprocess(rows, tokens.Options(*(bool(flags.get(n)) for n in FLAGS)))
    words, build_id = readers.vocabulary(spark, path), a.build_id if a.from_build is None else a.from_build

    def build() -> dict:
        fragments.fragments(kept, rows, words, size=a.fragment_size, build_id=build_id).write.mode("overwrite").parquet(a.output)
        return fragments.counters(kept, rows, words, size=a.fragment_size).first().asDict()

    _recorded(spark, a, "corpus", {n: bool(flags.get(n)) for n in FLAGS} | {"fragment_size": a.fragment_size, "vocabulary": path}, build)


def build_tdm(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = fragments.numbered(_head(spark.read.parquet(a.input), a.head, "source_doc_id"))
    tf = matrix.counts(rows)

    def build() -> dict:
        writers.write_matrix(matrix.weighted(tf, a.weighting_method), rows.select("row", "id", "source_doc_id", "position"), a.output)
        return matrix.stats(spark.read.parquet(f"{a.output}/entries")).first().asDict()

    _recorded(spark, a, "matrix", {"weighting": a.weighting_method}, build)


def build_svd(spark: SparkSession, a: argparse.Namespace) -> None:
    entries = spark.read.parquet(f"{a.input}/entries")
    params = {"k": a.k, "n_iter": a.n_iter, "oversampling": a.oversampling, "seed": a.random_state}

    def build() -> dict:
        parts = svd.truncated(entries, a.k, n_iter=a.n_iter, oversampling=a.oversampling, seed=a.random_state)
        stats = svd.spectrum_summary(svd.spectrum(parts.sigma, matrix.frobenius(entries))).first().asDict()
        writers.write_svd(parts, a.output, stats)
        return stats

    _recorded(spark, a, "svd", params, build)


def build_embeddings(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = svd.Svd(*(spark.read.parquet(f"{a.input}/{n}") for n in ("u", "sigma", "v")))
    params = {"sigma_power": a.sigma_power, "k": a.k}

    def build() -> dict:
        writers.write_embeddings(svd.word_vectors(parts, power=a.sigma_power, dims=a.k), a.output, params)
        return svd.norm_stats(spark.read.parquet(f"{a.output}/vectors")).first().asDict()

    _recorded(spark, a, "embeddings", params, build)


def explore_vocabulary(spark: SparkSession, a: argparse.Namespace) -> None:
    kept = tokens.preprocess(spark.read.parquet(a.input), tokens.Options(a.replace_ner, a.normalize, a.ignore_oov))
    writers.write_report(
        spark,
        vocabulary.report(kept, min_df=a.min_df, max_df=a.max_df).first().asDict() | {
            "top": [r.asDict() for r in vocabulary.most_frequent(vocabulary.frequencies(kept), a.top_n).collect()]
        },
        a.output,
    )


def explore_lemma_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _head(spark.read.parquet(a.input), a.head)
    pos = tokens.pos_histogram(rows).orderBy(F.desc("n_tokens"), "pos").limit(1000)
    writers.write_report(spark, tokens.lemma_quality(rows).first().asDict() | {"pos": {r["pos"]: r["n_tokens"] for r in pos.collect()}}, a.output)


def explore_embeddings_geometry(spark: SparkSession, a: argparse.Namespace) -> None:
    vectors = spark.read.parquet(f"{a.input}/vectors").withColumnRenamed("idx", "id")
    dims = vectors.select(F.max(F.size("vec"))).first()[0]
    writers.write_report(
        spark,
        geometry.tier_one(vectors, dims, n_pairs=a.n_pairs, k=a.knn_k, sample=a.knn_sample, overlap_sample=a.overlap_sample, seed=a.seed),
        a.output,
    )


COMMANDS = {"upload-files": copy_files, "load-files": copy_files} | {
    f.__name__.replace("_", "-"): f for f in (
        discover_links,
        fetch_pdfs,
        extract_text,
        tokenize_text,
        lemmatize_text,
        build_vocab,
        index_corpus,
        build_tdm,
        build_svd,
        build_embeddings,
        explore_vocabulary,
        explore_lemma_stats,
        explore_embeddings_geometry,
    )
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tantu")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("input")
    p.add_argument("output")
    limit = lambda x: float(x) if "." in x else int(x)
    for name, kind, default in (
        ("head", int, None), ("lang", str, "mr"), ("state", str, None), (
            "target-status",
            str,
            None,
        ), ("min-df", limit, 2), ("max-df", float, 0.9), ("min-tf", int, 1), ("top-n", int, 5), ("vocabulary", str, None),
        ("fragment-size", int, 8), ("build-id", int, 1), (
            "weighting-method",
            str,
            "log-entropy",
        ), ("k", int, 100), ("n-iter", int, 5), ("oversampling", int, 10), ("random-state", int, 0), ("sigma-power", float, 1.0),
        ("n-pairs", int, 100_000), ("knn-k", int, 10), ("knn-sample", int, 5000), (
            "overlap-sample",
            int,
            3000,
        ), ("seed", int, 42), ("page-from", int, 1), ("page-to", int, None),
        ("registry", str, None), ("from-build", int, None), ("lemmatize-func", str, "suffix"), ("reader", str, "text"), ("stage", str, None),
    ):
        p.add_argument(f"--{name}", type=kind, default=default)
    for name in ("json", "nested", "dry-run", "replace-ner", "normalize", "ignore-oov"):
        p.add_argument(f"--{name}", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        spark = spark or SparkSession.builder.getOrCreate()
        reach_workers(spark)
        COMMANDS[a.command](spark, a)
    except KeyboardInterrupt:
        return 130
    except NetworkError as e:
        print(f"{a.command}: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001
        print(f"{a.command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
