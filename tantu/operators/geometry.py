"""Geometry of vector spaces: neighbours, cosine distribution, dimensions, isotropy, hubs, symmetry, stability."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tantu.functions.vectors import cosine, norm
from tantu.operators.joins import average_rank, numbered
from tantu.operators.svd import covariance
from tantu.session import materialise

#: Rows of the blocks that are compared with each other.
BLOCK = 4096


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): vectors that are not null, not all zero and finite throughout."""
    ok = F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(ok).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vec"))


def exact_neighbours(queries: DataFrame, base: DataFrame, k: int, *, block: int = BLOCK) -> DataFrame:
    """(id, other, rank, cosine): the k vectors of base nearest to each query, itself left out; equal cosines by id.

    Both tables (id, vec) are cut into blocks by a hash of the id; each pair of blocks is one group, compared as
    matrices, and gives at most k rows a query. The number of blocks follows the number of rows.
    """
    n_q, n_b = (max(1, -(-df.count() // block)) for df in (queries, base))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = queries.select("id", "vec", part(n_q).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))).alias("b"), F.lit(True).alias("asks"))
    b = base.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), part(n_b).alias("b"), F.lit(False).alias("asks"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        ask, own = g[g["asks"]], g[~g["asks"]]
        if not len(ask) or not len(own):
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        unit = lambda d: (x := np.stack(d["vec"].to_numpy())) / np.linalg.norm(x, axis=1, keepdims=True)
        x, y, ids, others = unit(ask), unit(own), ask["id"].to_numpy(), own["id"].to_numpy()
        order = np.argsort(others)
        y, others, out = y[order], others[order], []
        for at in range(0, len(x), 512):
            s = x[at : at + 512] @ y.T
            s[ids[at : at + 512, None] == others[None, :]] = -np.inf
            keep = min(k, s.shape[1])
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            # of equal cosines at the edge those of the smallest ids
            edge = np.take_along_axis(s, best, 1).min(1, keepdims=True)
            for r in np.flatnonzero((s >= edge).sum(1) > keep):
                best[r] = np.lexsort((others, -s[r]))[:keep]
            rows = np.repeat(ids[at : at + 512], keep)
            out.append(pd.DataFrame({"id": rows, "other": others[best].ravel(), "cosine": np.take_along_axis(s, best, 1).ravel()}))
        out = pd.concat(out)
        return out[np.isfinite(out["cosine"])]

    found = q.unionByName(b).groupBy("q", "b").applyInPandas(compare, "id long, other long, cosine double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 12)), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "other", "rank", "cosine")


def sampled(vectors: DataFrame, size: int | None, seed: int = 42) -> DataFrame:
    """At most size vectors, first in the order of a hash of the id: the same at any partitioning. None: all.

    Rows whose hash lies well beyond the share wanted are left out before the order is made.
    """
    if size is None:
        return vectors
    h, n = F.xxhash64("id", F.lit(seed)), vectors.count()
    share = min(1.0, 1.2 * size / n + 100 / n) if n else 1.0
    near = vectors.filter(h < int(-(2**63) + share * 2**64)) if share < 1 else vectors
    return near.orderBy(h, "id").limit(size)


def nearest_words(vectors: DataFrame, word: str, n: int, *, words: str = "word", vector: str = "vec") -> DataFrame:
    """(word, cosine): the n words most similar to one, itself left out. The one vector is sent to all tasks."""
    one = vectors.filter(F.col(words) == word).select(F.col(vector).alias("asked")).limit(1)
    other = vectors.filter((F.col(words) != word) & F.col(vector).isNotNull())
    return other.crossJoin(F.broadcast(one)).select(
        words,
        cosine(F.col(vector), F.col("asked")).alias("cosine"),
    ).filter("cosine IS NOT NULL").orderBy(F.desc("cosine"), words).limit(n)


def label(value: Column, *steps: tuple[float, str], otherwise: str = "POOR", below: bool = True) -> Column:
    out = None
    for bound, name in steps:
        test = value < bound if below else value > bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(value.isNull(), "N/A").otherwise(out.otherwise(otherwise))


def sampled_pairs(n: int, n_pairs: int, seed: int, spark) -> DataFrame:
    """(i, j), i <> j: pairs of positions below n, spread by arithmetic so that any engine draws the same."""
    k = F.col("id")
    return spark.range(n_pairs).select(((k * 7919 + seed) % n).alias("i"), ((k * 104729 + k * k % 1000003 + seed) % n).alias("j")).filter("i <> j")


def cosine_distribution(vectors: DataFrame, *, n_pairs: int = 100_000, seed: int = 42) -> DataFrame:
    """One row over sampled pairs of (id, vec), by their place in the order of the ids: mean, population deviation, median, 5th and 95th percentile, label."""
    n, first, last = vectors.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if n and (first, last) != (0, n - 1):
        vectors = numbered(vectors, F.col("id"), out="__k").select(F.col("__k").alias("id"), "vec")
    pairs = sampled_pairs(max(n, 1), n_pairs, seed, vectors.sparkSession)
    left, right = vectors.select(F.col("id").alias("i"), F.col("vec").alias("a")), vectors.select(F.col("id").alias("j"), F.col("vec").alias("b"))
    c = pairs.join(left, "i").join(right, "j").select(cosine(F.col("a"), F.col("b")).alias("c"))
    out = c.agg(
        F.count("c").alias("n_pairs"),
        F.avg("c").alias("mean"),
        F.stddev_pop("c").alias("std"),
        F.median("c").alias("median"),
        F.percentile("c", F.lit(0.05)).alias("p5"),
        F.percentile("c", F.lit(0.95)).alias("p95"),
    )
    return out.withColumn("quality", label(F.abs("mean"), (0.05, "GOOD"), (0.15, "OK"), (0.30, "MODERATE")))


def participation_ratio(vectors: DataFrame, dims: int) -> dict:
    """(trace C)^2 / |C|^2 of the covariance, and the dimensions for 90 and 95 % of the variance."""
    c = covariance(vectors, dims)
    values = np.sort(np.linalg.eigvalsh(c))[::-1]
    values = values[values > 0]
    share = np.cumsum(values) / values.sum() if len(values) else np.array([])
    dims_for = lambda p: int(np.searchsorted(share, p) + 1) if len(share) else None
    pr = float(np.trace(c) ** 2 / (c * c).sum()) if len(values) else None
    return {
        "participation_ratio": pr,
        "ratio": pr / dims if pr else None,
        "dims_90": dims_for(0.9),
        "dims_95": dims_for(0.95),
        "top1_share": float(share[0]) if len(share) else None,
        "top10_share": float(share[min(9, len(share) - 1)]) if len(share) else None,
    }


def isotropy(vectors: DataFrame, dims: int) -> dict:
    """Least over largest eigenvalue, effective rank exp(entropy), share of the first, condition number, label."""
    values = np.sort(np.linalg.eigvalsh(covariance(vectors, dims)))[::-1]
    values = values[values > 0]
    if not len(values):
        return {"isotropy": None, "effective_rank": None, "top1_share": None, "condition": None, "quality": "N/A"}
    p = values / values.sum()
    iso = float(values[-1] / values[0])
    return {
        "isotropy": iso,
        "effective_rank": float(np.exp(-(p * np.log(p)).sum())),
        "top1_share": float(p[0]),
        "condition": 1 / iso,
        "quality": "GOOD" if iso > 0.01 else "MODERATE" if iso > 0.001 else "POOR",
    }


def occurrences(found: DataFrame, all_ids: DataFrame) -> DataFrame:
    """(id, n): how often each id is among others' neighbours; ids never found have 0."""
    counts = found.groupBy("other").agg(F.count("*").alias("n")).withColumnRenamed("other", "id")
    return all_ids.select("id").join(counts, "id", "left").fillna(0, ["n"])


def hubness(found: DataFrame, all_ids: DataFrame) -> DataFrame:
    """One row: population skewness of the occurrences, hubs (more than mean + 2 deviations), antihubs (never found), the most, label."""
    n = occurrences(found, all_ids)
    s = n.agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("s"))
    out = n.crossJoin(F.broadcast(s)).agg(
        F.skewness("n").alias("skewness"),
        F.count_if(F.col("n") > F.col("m") + 2 * F.col("s")).alias("hubs"),
        F.count_if(F.col("n") == 0).alias("antihubs"),
        F.max("n").alias("max_n"),
    )
    return out.withColumn("quality", label(F.col("skewness"), (1.0, "GOOD"), (1.5, "OK"), (2.5, "MODERATE")))


def symmetry(found: DataFrame) -> DataFrame:
    """One row: share of the neighbour pairs that hold in both directions, label."""
    a, b = found.select("id", "other"), found.select(F.col("other").alias("id"), F.col("id").alias("other"), F.lit(1).alias("back"))
    out = a.join(b, ["id", "other"], "left").agg(F.count("*").alias("n_pairs"), F.count("back").alias("n_mutual"))
    out = out.withColumn("symmetry", F.try_divide(F.col("n_mutual").cast("double"), F.col("n_pairs")))
    return out.withColumn("quality", label(F.col("symmetry"), (0.50, "GOOD"), (0.35, "OK"), (0.20, "MODERATE"), below=False))


def overlap(found: DataFrame, k_values: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(k_small, k_large, overlap): how much of the k_small nearest is among the next larger list, averaged over the ids. found has max(k_values) ranks.

    Neighbours by one metric are nested, so this tests the ranking: 1 unless lists are short.
    """
    rows = found.filter(F.col("rank") <= max(k_values))
    out = None
    for a, b in zip(k_values[:-1], k_values[1:], strict=True):
        each = rows.groupBy("id").agg(
            F.collect_set(F.when(F.col("rank") <= a, F.col("other"))).alias("s"),
            F.collect_set(F.when(F.col("rank") <= b, F.col("other"))).alias("l"),
        )
        one = each.agg(
            F.lit(a).alias("k_small"),
            F.lit(b).alias("k_large"),
            F.avg(F.try_divide(F.size(F.array_intersect("s", "l")).cast("double"), F.size("s"))).alias("overlap"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def frequency_norm(vectors: DataFrame, *, tf: str = "tf", vector: str = "vec", least: int = 10) -> DataFrame:
    """One row: Pearson and Spearman correlation of ln(1 + tf) with the length, over terms with tf > 0; null below ``least`` terms."""
    rows = vectors.filter((F.col(tf) > 0) & F.col(vector).isNotNull()).select(
        F.log1p(tf).alias("x"),
        norm(F.col(vector)).alias("y"),
    ).filter(~F.isnan("y") & (F.col("y") < float("inf")))
    rows = materialise(rows, "frequency-norm")
    ranked = average_rank(average_rank(rows, "x", "rx"), "y", "ry")
    out = ranked.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))
    out = out.select("n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("pearson", "spearman")])
    return out.withColumn("quality", label(F.abs("spearman"), (0.2, "GOOD"), (0.4, "OK"), (0.6, "MODERATE")))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation by Student's t: the regularised incomplete beta function as a continued fraction."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + num * d or 1e-300)
                c = 1 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    if x >= 1:
        return 1.0
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def quality_counts(*reports: DataFrame) -> DataFrame:
    """(quality, n): how many metrics have each label; a missing label is N/A."""
    out = None
    for r in reports:
        one = r.select(F.coalesce(F.col("quality"), F.lit("N/A")).alias("quality"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("quality").agg(F.count("*").alias("n"))


def tier_one(vectors: DataFrame, dims: int, *, n_pairs: int = 100_000, k: int = 10, sample: int = 5000, overlap_sample: int = 3000, seed: int = 42) -> dict:
    """All metrics of (id, vec[, tf]) as one report."""
    near = sampled(vectors, sample, seed)
    found = exact_neighbours(near, near, k)
    part = sampled(vectors, overlap_sample, seed + 1)
    row = lambda df: df.first().asDict()
    out = {
        "cosine": row(cosine_distribution(vectors, n_pairs=n_pairs, seed=seed)),
        "participation": participation_ratio(vectors, dims),
        "isotropy": isotropy(vectors, dims),
        "hubness": row(hubness(found, near)),
        "symmetry": row(symmetry(found)),
        "overlap": [r.asDict() for r in overlap(exact_neighbours(part, part, 20)).collect()],
    }
    if "tf" in vectors.columns:
        out["frequency_norm"] = row(frequency_norm(vectors))
        for c in ("pearson", "spearman"):
            if (r := out["frequency_norm"][c]) is not None:
                out["frequency_norm"][f"{c}_p"] = correlation_p(r, out["frequency_norm"]["n"])
    return out
