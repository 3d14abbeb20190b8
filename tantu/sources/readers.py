"""Sources: documents as lines, pages, JSON, HTML, tab-separated tables, files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tantu.functions.vectors import normalized
from tantu.operators import joins

PAGE = "schema_version string, id string, text string, meta struct<page_num: int>"
TOKENIZED = "schema_version string, id string, lang string, sentences array<array<string>>, meta map<string, string>"
TOKEN = "struct<token: string, lemma: string, pos: string, is_ne: boolean, ner_result: string, analyses: array<string>, is_oov: boolean, is_ambiguous: boolean>"
LEMMATIZED = f"id string, lang string, sentences array<array<{TOKEN}>>, meta map<string, string>"
FRAGMENT = "id string, source_doc_id string, position int, token_ids array<int>, vocab_id int"
LINK = "url string, lang string, source string, added_at timestamp"
VOCABULARY = "idx int, lemma string, tf bigint, df bigint"


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records of JSON lines, compressed or not by their suffix; blank and malformed lines are left out, missing files too."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreMissingFiles", "true").json(path)
    return rows.filter("_corrupt IS NULL AND id IS NOT NULL" if "id string" in schema else "_corrupt IS NULL").drop("_corrupt")


def zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) lines of zstd files, decompressed as a stream by the task that reads the file, for clusters whose Hadoop lacks the codec.

    Files in a folder that all executors mount are read piece by piece, others come as one row each, below 2 GB.
    """
    import io
    from collections.abc import Iterator

    import pandas as pd

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for frame in frames:
            for content in frame["content"]:
                packed = open(content, "rb") if mounted else io.BytesIO(content)  # noqa: SIM115: closed with the reader on it
                lines = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True, closefd=True), encoding="utf-8", newline="\n")
                part: list[str] = []
                for line in lines:
                    part.append(line.rstrip("\n"))
                    if len(part) == 10_000:
                        yield pd.DataFrame({"value": part})
                        part = []
                lines.close()
                yield pd.DataFrame({"value": part})

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    mounted = where.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(path)
    files = found.select(F.regexp_replace("path", "^file:/+", "/").alias("content") if mounted else "content")
    return files.mapInPandas(unpack, "value string")


def zstd_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of zstd JSON lines; blank and malformed lines are left out."""
    rows = zstd_lines(spark, path).select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return rows.filter("_corrupt IS NULL AND id IS NOT NULL" if "id string" in schema else "_corrupt IS NULL").drop("_corrupt")


def documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(raw, tokenized) documents of one file of both kinds: those with sentences are tokenized."""
    both = json_lines(spark, path, "id string, lang string, text string, sentences array<array<string>>, meta map<string, string>")
    return both.filter("sentences IS NULL").select("id", "text", "meta"), both.filter("sentences IS NOT NULL").select("id", "lang", "sentences", "meta")


def raw_lines(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(id, text) of the lines that are not blank; id is lang-number, numbered from 0 by file, offset in it and line, so the order of the file holds."""
    where = ("__file", F.col("_metadata.file_path")), ("__block", F.col("_metadata.file_block_start")), ("__line", F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.col("value").alias("text"), *[c.alias(n) for n, c in where])
    rows = joins.numbered(lines.filter(F.trim("text") != ""), *[F.col(n) for n, _ in where], out="__n")
    return rows.select(F.concat(F.lit(f"{lang}-"), F.col("__n").cast("string")).alias("id"), "text")


def books(pages: DataFrame, *, doc: Column | None = None) -> DataFrame:
    """(doc_id, text, n_pages): pages joined in order by an empty line. Repeated pages count once, null texts are left out."""
    doc = F.regexp_extract("id", "^([^#]*)", 1) if doc is None else doc
    order = F.coalesce(F.try_to_number(F.regexp_extract("id", "#([0-9]{1,9})$", 1), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))
    rows = pages.filter("text IS NOT NULL").select(doc.alias("doc_id"), order.alias("n"), "text")
    # repeated pages fall together before they are shuffled, and again where they meet
    books = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("n", "text"))).alias("pages"))
    return books.select("doc_id", F.array_join(F.transform("pages", lambda x: x["text"]), "\n\n").alias("text"), F.size("pages").cast("long").alias("n_pages"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary table with header; of a repeated lemma the last number counts, short lines are left out."""
    rows = spark.read.schema(VOCABULARY).option("sep", "\t").option("header", "true").csv(path).filter("lemma IS NOT NULL")
    return rows.groupBy("lemma").agg(F.max(F.struct("idx", "tf", "df")).alias("r")).select("r.idx", "lemma", "r.tf", "r.df")


def fields(lines: DataFrame, names: list[str], *, column: str = "value") -> DataFrame:
    """Lines of exactly as many fields between white space as names are given."""
    parts = F.split(F.trim(F.col(column)), "\\s+")
    return lines.withColumn("__p", parts).filter(F.size("__p") == len(names)).select(*[F.get("__p", F.lit(i)).alias(n) for i, n in enumerate(names)])


def frequency_list(spark: SparkSession, path: str, *, least_id: int = 101, most: int = 50_000) -> DataFrame:
    """(id, word, freq) of a word list, without the ids below ``least_id``, up to the ``most``-th in order of id."""
    rows = fields(spark.read.text(path), ["id", "word", "freq"]).select(
        F.expr("try_cast(id AS long)").alias("id"),
        "word",
        F.expr("try_cast(freq AS long)").alias("freq"),
    )
    return rows.filter((F.col("id") >= least_id) & F.col("freq").isNotNull()).orderBy("id").limit(most)


def cooccurrence_list(spark: SparkSession, path: str) -> DataFrame:
    """(w1, w2, n, sig) of lines of four fields."""
    rows = fields(spark.read.text(path), ["w1", "w2", "n", "sig"])
    return rows.select(*[F.expr(f"try_cast({c} AS {t})").alias(c) for c, t in (("w1", "long"), ("w2", "long"), ("n", "long"), ("sig", "double"))]).dropna()


def embeddings_with_vocabulary(vectors: DataFrame, words: DataFrame) -> DataFrame:
    """vectors (idx, vec) and vocabulary (idx, lemma, tf, df) joined, with ``normed`` (zero vectors stay zero) and ``centered`` (the mean
    vector taken away); ValueError unless both have the same number of rows."""
    n, m = vectors.count(), words.count()
    if n != m:
        raise ValueError(f"{n} vectors but {m} words")
    means = vectors.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("__mean"))
    centred = F.zip_with("vec", "__mean", lambda x, m: x - m)
    return vectors.join(words, "idx").crossJoin(F.broadcast(mean)).withColumn("normed", normalized(F.col("vec"))).withColumn("centered", centred).drop("__mean")


def anchors(html: Column) -> Column:
    """array<struct<href, text>> of the links of a page, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"']?[^\"'\s>]+[^>]*>.*?</a>"), F.lit(0))
    href = lambda t: F.regexp_extract(t, r"(?is)href\s*=\s*[\"']?([^\"'\s>]+)", 1)
    text = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "(?s)<[^>]*>", " "), r"\s+", " "))
    return F.transform(tags, lambda t: F.struct(href(t).alias("href"), text(t).alias("text")))


def links(pages: DataFrame, *, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, position, href, text): all links of all pages."""
    return pages.select(key, F.posexplode(anchors(F.col(html))).alias("position", "a")).select(key, "position", "a.href", "a.text")


def download_link(html: Column) -> Column:
    """The first link to a PDF file or a download; null if there is none."""
    good = F.filter(anchors(html), lambda a: F.lower(a["href"]).endswith(".pdf") | a["href"].contains("archive.org/download") | F.lower(a["text"]).rlike("download|pdf"))
    return F.get(good, F.lit(0))["href"]


def crawl_pages(spark: SparkSession, template: str, first: int, last: int, limit: int | None = None) -> DataFrame:
    """(page, url) of list pages; a page below 1 is a ValueError."""
    if first < 1:
        raise ValueError("pages count from 1")
    stop = last if limit is None else min(last, first + limit - 1)
    return spark.range(first, stop + 1).select(
        F.col("id").cast("int").alias("page"),
        F.replace(F.lit(template), F.lit("{page}"), F.col("id").cast("string")).alias("url"),
    )


def fetch_tasks(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    rows = json_lines(spark, path, LINK).filter("url IS NOT NULL")
    return rows if most is None else rows.limit(most)


def located(spark: SparkSession, relative: str, *roots: str) -> str:
    """The first that exists of the path under each root, as it is, then under each compressed (.gz); an absolute path stands for itself. FileNotFoundError if there is none."""
    absolute = "://" in relative or relative.startswith("/")
    under = [""] if absolute else [r.rstrip("/") + "/" for r in roots]
    for suffix in ("", ".gz"):
        for root in under:
            path = spark._jvm.org.apache.hadoop.fs.Path(root + relative + suffix)
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                return root + relative + suffix
    raise FileNotFoundError(relative)


def report(spark: SparkSession, path: str) -> dict:
    """A JSON report, as write_report leaves it."""
    return json.loads(spark.read.text(path).first()[0])


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, weight) of a graph as XML (node and edge elements, weight as data), one edge element a line."""
    line = spark.read.text(path).filter(F.col("value").contains("<edge"))
    at = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    return line.select(
        at(r'source="([^"]*)"').alias("source"),
        at(r'target="([^"]*)"').alias("target"),
        F.expr("try_cast(regexp_extract(value, '<data[^>]*>([^<]*)</data>', 1) AS double)").alias("weight"),
    )


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, length, content) of all files below a folder, without system ones."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.filter(~F.col("path").endswith(".DS_Store")).select("path", F.sha2("content", 256).alias("sha256"), "length", "content")
