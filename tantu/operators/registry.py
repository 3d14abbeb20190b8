"""Processing state: planning work by joins, upserts, build lineage, manifests, duplicates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

PENDING = "pending"
STATUSES = ("ok", "error", "pending", "running")


def latest(log: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last row of every key by the order given; equal rows count once, nulls are oldest, the other columns decide ties. Combined before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in keys and c not in order]
    return log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__last")).select(
        *keys,
        *[F.col(f"__last.{c}").alias(c) for c in log.columns if c not in keys]
    ).select(*log.columns)


def ok(results: DataFrame) -> DataFrame:
    return results.filter("status = 'ok'")


def tasks(
    documents: DataFrame,
    done: list[DataFrame],
    stage: DataFrame,
    status: str | None = None,
    *,
    method: str | None = None,
    none_is_all: bool = False,
    key: str = "doc_id",
    limit: int | None = None,
) -> DataFrame:
    """Documents to process at a stage.

    done: results of the stages before, of which a document needs status ok in each. status None or pending: without a
    row in ``stage`` (or, with none_is_all, None: all); otherwise those whose row has it. method: only rows of ``stage`` of this method count.
    """
    for d in done:
        documents = documents.join(ok(d).select(key).distinct(), key, "left_semi")
    if method is not None:
        stage = stage.filter(F.col("method") == method)
    if status is None and none_is_all:
        out = documents
    elif status in (None, PENDING):
        out = documents.join(stage.select(key), key, "left_anti")
    else:
        out = documents.join(stage.filter(F.col("status") == status).select(key).distinct(), key, "left_semi")
    return out if limit is None else out.orderBy(key).limit(limit)


def upsert(existing: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """new in the place of rows of the same key; null keys equal null keys."""
    keys = [key] if isinstance(key, str) else key
    a, b = existing.alias("a"), new.select(*keys).distinct().alias("b")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, match, "left_anti").select(*existing.columns).unionByName(new, allowMissingColumns=True)


def insert_missing(existing: DataFrame, new: DataFrame, key: str, *, first: str) -> DataFrame:
    """Rows of new whose key is not there yet, the first by ``first`` of each; null keys are left out."""
    others = [c for c in existing.columns if c != key]
    one = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(first, *[c for c in others if c != first])).alias("r"))
    fresh = one.join(existing.select(key), key, "left_anti").select(key, *[F.col(f"r.{c}").alias(c) for c in others])
    return existing.unionByName(fresh.select(*existing.columns))


def register(builds: DataFrame, build: DataFrame) -> DataFrame:
    """builds with one more: run_id is the next number."""
    next_id = builds.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("run_id"))
    return builds.unionByName(build.drop("run_id").crossJoin(F.broadcast(next_id)), allowMissingColumns=True).select(*builds.columns)


def complete(builds: DataFrame, run_id: int, **values) -> DataFrame:
    """The build's columns set to the values given, null ones too."""
    this = F.col("run_id") == run_id
    return builds.select(
        *[
            F.when(
                this,
                F.lit(values[c]).cast(builds.schema[c].dataType),
            ).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in builds.columns
        ]
    )


def get_build(builds: DataFrame, run_id: int, *, need_ok: bool = False) -> Row:
    """The build; ValueError if there is none, or it is not ok and has to be."""
    row = builds.filter(F.col("run_id") == run_id).first()
    if row is None:
        raise ValueError(f"no build {run_id}")
    if need_ok and row["status"] != "ok":
        raise ValueError(f"build {run_id} is {row['status']}")
    return row


def list_builds(builds: DataFrame, status: str | None = None) -> DataFrame:
    return (builds if status is None else builds.filter(F.col("status") == status)).orderBy("run_id")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("status", F.lit(PENDING)).alias("status")).agg(F.count("*").alias("n"))


def completed(results: DataFrame, path: str = "path", key: str = "doc_id") -> DataFrame:
    """(key, path) of the results of status ok that have a path, in order of the key."""
    return ok(results).filter(F.col(path).isNotNull()).select(key, path).orderBy(key)


def of(results: DataFrame, **values) -> DataFrame:
    """The results with these values, say of an artefact, a method or a build; None asks for null."""
    for c, v in values.items():
        results = results.filter(F.col(c).eqNullSafe(F.lit(v).cast(results.schema[c].dataType)))
    return results


def append(new: DataFrame, path: str) -> None:
    """Rows added to a table; what is there stays, repeated rows too."""
    new.write.mode("append").parquet(path)


def with_json(builds: DataFrame, **columns: Column) -> DataFrame:
    """builds with structs or maps as JSON strings, as params and stats are kept."""
    return builds.withColumns({name: F.to_json(c) for name, c in columns.items()})


def from_json(build: Row, column: str = "params") -> dict:
    return json.loads(build[column]) if build[column] else {}


def new_texts(texts: DataFrame, known: DataFrame, *, key: str = "id", text: str = "text") -> DataFrame:
    """(artefact, key, text): texts by the hash of their content, each once, with the smallest key that has it; those in known (artefact) are left out."""
    each = texts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("artefact"), key, text)
    fresh = each.join(known.select("artefact"), "artefact", "left_anti")
    return fresh.groupBy("artefact").agg(F.min(key).alias(key), F.first(text).alias(text))


def new_urls(links: DataFrame, fetched: DataFrame) -> DataFrame:
    """Links whose url was not fetched yet, each once."""
    return links.dropDuplicates(["url"]).join(fetched.select("url"), "url", "left_anti")


def by_content(items: DataFrame, *, order: str = "id") -> DataFrame:
    """(sha256, first_id, n_items, n_urls): contents, with the first item that has each; items without content are left out. Combined before the shuffle."""
    each = items.filter("sha256 IS NOT NULL").groupBy("sha256", "url").agg(F.min(order).alias("i"), F.count("*").alias("n"))
    return each.groupBy("sha256").agg(F.min("i").alias("first_id"), F.sum("n").alias("n_items"), F.count("*").alias("n_urls"))


def has(items: DataFrame, column: str, value: str) -> bool:
    return bool(items.filter(F.col(column) == value).limit(1).count())


def http_ok(status):
    return status.between(200, 299)


def running_number(df: DataFrame, by: str, *order: str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
