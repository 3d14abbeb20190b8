"""Truncated singular value decomposition of sparse matrices, word vectors, spectrum, principal components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tantu.functions.vectors import norm, scaled
from tantu.session import materialise


@dataclass(frozen=True)
class Svd:
    """u (row, vec), sigma (component, sigma), v (col, vec)."""

    u: DataFrame
    sigma: DataFrame
    v: DataFrame


def _sums(entries: DataFrame, by: str, other: DataFrame, dims: int) -> DataFrame:
    """(key, vec): for every ``by`` the sum of value times the vector of the entry's other side: one aggregate of dims sums, combined before the shuffle."""
    terms = entries.join(other, "key").select(F.col(by).alias("__by"), "value", "vec")
    summed = terms.groupBy("__by").agg(*[F.sum(F.col("value") * F.get("vec", F.lit(d))).alias(f"s{d}") for d in range(dims)])
    return summed.select(F.col("__by").alias("key"), F.array(*[f"s{d}" for d in range(dims)]).alias("vec"))


def _gram(tall: DataFrame, dims: int) -> np.ndarray:
    """vec' vec summed over all rows: dims by dims, summed in each task first."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((dims, dims))
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_numpy())
                g += x.T @ x
        yield pd.DataFrame({"k": np.arange(dims * dims), "x": g.ravel()})

    rows = tall.select("vec").mapInPandas(part, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    g = np.zeros(dims * dims)
    for r in rows:
        g[r["k"]] = r["x"]
    return g.reshape(dims, dims)


def _times(tall: DataFrame, m: np.ndarray) -> DataFrame:
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": b["key"], "vec": list(np.stack(b["vec"].to_numpy()) @ m)})

    return tall.mapInPandas(apply, tall.schema)


#: Below this share of the largest a squared length is lost in rounding.
LOST, NEARLY_LOST = 1e-12, 1e-10


def _orthonormal(tall: DataFrame, gram: np.ndarray) -> tuple[DataFrame, int]:
    """Columns made orthonormal by the inverse root of their Gram matrix, and their number; directions without length are dropped."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values.max(), 0) * LOST
    return _times(tall, vectors[:, keep] / np.sqrt(values[keep])), int(keep.sum())


def _apart(gram: np.ndarray) -> bool:
    """Whether even the shortest direction is told well from rounding."""
    values = np.linalg.eigvalsh(gram)
    return values.min() > max(values.max(), 0) * NEARLY_LOST


def truncated(matrix: DataFrame, k: int, *, n_iter: int = 5, oversampling: int = 10, seed: int = 0) -> Svd:
    """The k largest singular values of (row, col, value), by a randomised range finder with power iterations.

    The matrix stays distributed; only blocks of (k + oversampling) squared reach the driver. Each tall
    block is written before it is used again. Vectors' signs: the component of largest size is positive. Fewer
    than k come back if the matrix has a lower rank.
    """
    dims = k + oversampling
    a = matrix.filter(F.col("value") != 0).select("row", "col", "value")
    by_row, by_col = a.select("row", F.col("col").alias("key"), "value"), a.select("col", F.col("row").alias("key"), "value")
    cols = a.select(F.col("col").alias("key")).distinct()
    # the start block is a function of the column and the seed alone
    start = cols.select("key", F.array(*[(F.pmod(F.xxhash64("key", F.lit(seed), F.lit(d)), F.lit(2000001)) - 1000000) / 1e6 for d in range(dims)]).alias("vec"))
    y = materialise(_sums(by_row, "row", start, dims), "svd-range")
    q, rank = _orthonormal(y, _gram(y, dims))
    for _ in range(n_iter):
        # both products in one go, which squares the lengths' ratios; where that loses a direction, one after the other
        z = _sums(by_col, "col", q, rank)
        y = materialise(_sums(by_row, "row", z, rank), "svd-range")
        if not _apart(gram := _gram(y, rank)):
            z = materialise(z, "svd-range")
            z, rank = _orthonormal(z, _gram(z, rank))
            y = materialise(_sums(by_row, "row", z, rank), "svd-range")
            gram = _gram(y, rank)
        q, rank = _orthonormal(y, gram)
    bt = materialise(_sums(by_col, "col", q, rank), "svd-range")  # the transpose of q'A: a row for each column of A
    values, w = np.linalg.eigh(_gram(bt, rank))
    order = np.argsort(values)[::-1]
    order = order[values[order] > values.max() * 1e-14][:k]
    sigma, w = np.sqrt(values[order]), w[:, order]
    u, v = _times(q, w), _times(bt, w / sigma)
    largest = v.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.max_by("x", F.struct(F.abs("x"), "x")).alias("x")).collect()
    sign = np.ones(len(sigma))
    for r in largest:
        sign[r["d"]] = -1.0 if r["x"] < 0 else 1.0
    u, v = _times(u, np.diag(sign)), _times(v, np.diag(sign))
    spark = matrix.sparkSession
    return Svd(
        u.withColumnRenamed("key", "row"),
        spark.createDataFrame([(i, float(s)) for i, s in enumerate(sigma)], "component int, sigma double"),
        v.withColumnRenamed("key", "col"),
    )


def word_vectors(svd: Svd, *, power: float = 1.0, dims: int | None = None, all_ids: DataFrame | None = None) -> DataFrame:
    """(idx, vec): V times sigma to the power, of the first dims components. Ids of all_ids (idx) that no entry has get zeros."""
    one = svd.sigma.agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "sigma"))), lambda s: s["sigma"]).alias("sigma"))
    out = svd.v.crossJoin(F.broadcast(one)).select(F.col("col").alias("idx"), scaled(F.col("vec"), F.col("sigma"), power, dims).alias("vec"))
    if all_ids is not None:
        k = dims or svd.sigma.count()
        out = all_ids.select("idx").join(out, "idx", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), k)))
    return out


def transformed(svd: Svd) -> DataFrame:
    """(row, vec): U times sigma, the rows on the components."""
    one = svd.sigma.agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "sigma"))), lambda s: s["sigma"]).alias("sigma"))
    return svd.u.crossJoin(F.broadcast(one)).select("row", scaled(F.col("vec"), F.col("sigma"), 1.0, None).alias("vec"))


def identities(matrix: DataFrame, svd: Svd) -> DataFrame:
    """(component, length_u, length_v, residual): lengths of the vectors, and |A'u - sigma v| in units of sigma."""
    k = svd.sigma.count()
    parts = matrix.join(svd.u, "row").select("col", *[(F.col("value") * F.get("vec", F.lit(d))).alias(f"s{d}") for d in range(k)])
    image = parts.groupBy("col").agg(F.array(*[F.sum(f"s{d}") for d in range(k)]).alias("image"))
    apart = image.join(svd.v, "col").select(F.posexplode(F.zip_with("image", "vec", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("component", "x"))
    residual = apart.join(F.broadcast(svd.sigma), "component").groupBy("component", "sigma").agg(F.sum((F.col("x.a") - F.col("sigma") * F.col("x.b")) ** 2).alias("r"))
    lengths = [d.select(F.posexplode("vec").alias("component", "x")).groupBy("component").agg(F.sum(F.col("x") * F.col("x")).alias(n)) for d, n in ((svd.u, "length_u"), (svd.v, "length_v"))]
    return lengths[0].join(lengths[1], "component").join(residual, "component").select(
        "component",
        "length_u",
        "length_v",
        F.try_divide(F.sqrt("r"), "sigma").alias("residual"),
    )


def spectrum(sigma: DataFrame, frobenius: DataFrame) -> DataFrame:
    """(component, sigma, ratio, cumulative): shares of the matrix's squared length. At most k rows."""
    from pyspark.sql import Window

    ratio = F.try_divide(F.col("sigma") * F.col("sigma"), F.col("frobenius"))
    return sigma.crossJoin(F.broadcast(frobenius)).select("component", "sigma", ratio.alias("ratio"), F.sum(ratio).over(Window.orderBy("component")).alias("cumulative"))


def spectrum_summary(spec: DataFrame) -> DataFrame:
    """One row: effective ranks (k + 1 where the share is not reached) and the largest, smallest, middle and mean sigma."""
    rank = lambda p: (F.coalesce(F.min(F.when(F.col("cumulative") >= p, F.col("component"))), F.max("component") + 1) + 1).cast("long")
    return spec.agg(
        rank(0.9).alias("effective_rank_90"),
        rank(0.95).alias("effective_rank_95"),
        F.max("sigma").alias("sigma_max"),
        F.min("sigma").alias("sigma_min"),
        F.median("sigma").alias("sigma_median"),
        F.avg("sigma").alias("sigma_mean"),
    )


def norm_stats(vectors: DataFrame, vector: str = "vec") -> DataFrame:
    """One row: mean, population deviation, least and largest length, number of zero vectors."""
    n = vectors.filter(F.col(vector).isNotNull()).select(norm(F.col(vector)).alias("n"))
    return n.agg(
        F.avg("n").alias("mean_norm"),
        F.stddev_pop("n").alias("std_norm"),
        F.min("n").alias("min_norm"),
        F.max("n").alias("max_norm"),
        F.count_if(F.col("n") == 0).alias("n_zero"),
    )


def covariance(vectors: DataFrame, dims: int, vector: str = "vec") -> np.ndarray:
    """Sample covariance of the vectors: dims by dims, summed in each task."""
    tall = vectors.select(F.transform(vector, lambda x: x.cast("double")).alias("vec")).filter("vec IS NOT NULL")
    total = tall.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.count("*").alias("n")).collect()
    mean, n = np.zeros(dims), 0
    for r in total:
        mean[r["d"]], n = r["m"], r["n"]
    return (_gram(tall, dims) - n * np.outer(mean, mean)) / max(n - 1, 1)


def principal_components(vectors: DataFrame, dims: int, k: int, *, key: str = "idx", vector: str = "vec") -> DataFrame:
    """(key, vec): the centred vectors on their first k principal axes; the axis' largest entry is positive."""
    values, axes = np.linalg.eigh(covariance(vectors, dims, vector))
    axes = axes[:, np.argsort(values)[::-1][:k]]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
    mean = vectors.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    shift = np.zeros(dims)
    for r in mean:
        shift[r["d"]] = r["m"]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "vec": list((np.stack(b[vector].to_numpy()) - shift) @ axes)})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.filter(F.col(vector).isNotNull()).select(key, vector).mapInPandas(project, f"{key} {kind}, vec array<double>")
