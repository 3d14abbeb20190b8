import numpy as np
import pytest

from tantu.operators import geometry


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(5).normal(size=(90, 6))


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("block", [4096, 16])
def test_neighbours(spark, x, block):
    df = table(spark, x)
    got = {(r["id"], r["rank"]): r["other"] for r in geometry.exact_neighbours(df, df, 4, block=block).collect()}
    near, _ = brute(x, 4)
    assert got == {(i, k + 1): int(near[i, k]) for i in range(len(x)) for k in range(4)}


def test_ties_and_copies(spark):
    df = table(spark, np.ones((9, 3)))
    got = geometry.exact_neighbours(df, df, 2).collect()
    assert {(r["id"], r["rank"], r["other"]) for r in got} == {(i, k + 1, o) for i in range(9) for k, o in enumerate([j for j in range(9) if j != i][:2])}


def test_hubness_symmetry_overlap(spark, x):
    df = table(spark, x)
    found = geometry.exact_neighbours(df, df, 10)
    near, _ = brute(x, 10)
    n = np.bincount(near.ravel(), minlength=len(x))
    h = geometry.hubness(found, df).first()
    m = n.mean()
    assert h["skewness"] == pytest.approx(((n - m) ** 3).mean() / n.std() ** 3) and h["antihubs"] == (n == 0).sum() and h["hubs"] == (n > m + 2 * n.std()).sum()
    mutual = sum(i in near[j] for i in range(len(x)) for j in near[i])
    assert geometry.symmetry(found).first()["symmetry"] == pytest.approx(mutual / near.size)
    assert [r["overlap"] for r in geometry.overlap(found, (2, 5, 10)).collect()] == [1.0, 1.0]


def test_spectrum_metrics(spark, x):
    c = np.linalg.eigvalsh(np.cov(x.T))
    p = geometry.participation_ratio(table(spark, x), 6)
    assert p["participation_ratio"] == pytest.approx(c.sum() ** 2 / (c * c).sum()) and p["dims_95"] == 6
    assert geometry.isotropy(table(spark, x), 6)["isotropy"] == pytest.approx(c[0] / c[-1])


def test_correlations(spark):
    rng = np.random.default_rng(0)
    tf, x = rng.integers(1, 6, 60), rng.normal(size=(60, 3))
    df = spark.createDataFrame([(int(t), [float(v) for v in r]) for t, r in zip(tf, x, strict=True)] + [(0, [1.0]), (None, [1.0]), (3, None)], "tf long, vec array<double>")
    got = geometry.frequency_norm(df).first()
    a, b = np.log1p(tf), np.linalg.norm(x, axis=1)
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    assert got["n"] == 60 and got["pearson"] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got["spearman"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    few = geometry.frequency_norm(df.limit(5)).first()
    assert few["pearson"] is None and few["quality"] == "N/A"


@pytest.mark.parametrize(("r", "n", "p"), [(0.0, 20, 1.0), (0.5, 12, 0.0980), (0.9, 5, 0.0374), (-0.3, 50, 0.0343)])
def test_p_values(r, n, p):
    assert geometry.correlation_p(r, n) == pytest.approx(p, abs=6e-4)


def test_cosines_words_report(spark, x):
    df = table(spark, x)
    c = geometry.cosine_distribution(df, n_pairs=500).first()
    assert c["n_pairs"] <= 500 and -1 <= c["p5"] <= c["median"] <= c["p95"] <= 1
    words = df.selectExpr("cast(id AS string) AS word", "vec")
    near, _ = brute(x, 3)
    assert [int(r["word"]) for r in geometry.nearest_words(words, "7", 3).collect()] == list(near[7])
    report = geometry.tier_one(df.selectExpr("id", "vec", "id + 1 AS tf"), 6, n_pairs=200, k=3)
    assert set(report) == {"cosine", "participation", "isotropy", "hubness", "symmetry", "overlap", "frequency_norm"} and 0 <= report["frequency_norm"]["spearman_p"] <= 1


def test_unusable(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0]), (3, [float("nan")]), (4, [float("inf")]), (5, [1.0])], "k int, v array<double>")
    assert [r["id"] for r in geometry.usable(df, "k", "v").collect()] == [5]
