"""Vocabulary, fragments, matrices, SVD."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tantu.operators import fragments, matrix, svd, vocabulary


@pytest.mark.parametrize(
    ("policy", "low", "high", "want"),
    [("build", 2, 0.9, (2, 9)), ("build", 0.25, 0.9, (2, 9)), ("build", 0.05, 1.0, (1, 10)), ("build", 2, 5.0, (2, 5)), ("build", 3, 0.0, (3, 3)), ("report", 2, 5.0, (2, 50)), ("report", 0.05, 0.9, (1, 9))],
)
def test_limits(spark, policy, low, high, want):
    assert tuple(spark.range(1).select(*vocabulary.limits(F.lit(10), low, high, policy)).first()) == want


def test_numbering_is_by_tf_then_lemma(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{chr(97 + int(rng.integers(5)))}{i:03}", int(rng.integers(1, 6)), 1) for i in range(300)]
    got = vocabulary.numbered(spark.createDataFrame(rows, "lemma string, tf long, df long")).orderBy("idx").collect()
    assert [(r["lemma"], r["tf"]) for r in got] == [(w, t) for w, t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] and [r["idx"] for r in got] == list(range(300))


def build(spark, n, missing=()):
    sents = spark.createDataFrame([("d", s) for s in range(n)], "doc_id string, sent_no int")
    toks = spark.createDataFrame([("d", s, 0, "w" if s not in missing else "zz") for s in range(n)], "doc_id string, sent_no int, tok_no int, lemma string")
    vocab = spark.createDataFrame([("w", 1), ("u", 22)], "lemma string, idx int")
    return toks, sents, vocab


@pytest.mark.parametrize(("n", "kept", "tail"), [(3, 1, 0), (8, 2, 0), (9, 2, 1), (10, 3, 0), (0, 0, 0)])
def test_chunks(spark, n, kept, tail):
    toks, sents, vocab = build(spark, n)
    out = fragments.fragments(toks, sents, vocab, size=4, build_id=7).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(kept))
    c = fragments.counters(toks, sents, vocab, size=4).first()
    assert (c["fragments"], c["skipped_tail"], c["empty"]) == (kept, tail, 0)


def test_empty_chunk_takes_no_position(spark):
    toks, sents, vocab = build(spark, 12, missing=range(4, 8))
    out = fragments.fragments(toks, sents, vocab, size=4, build_id=7).orderBy("position").collect()
    assert [r["position"] for r in out] == [0, 1] and fragments.counters(toks, sents, vocab, size=4).first()["empty"] == 1


def tf(spark):
    rows = [("r0", [0, 0, 1]), ("r1", [1, 2]), ("r2", [0, 2, 2, 2])]
    return matrix.counts(spark.createDataFrame(rows, "id string, token_ids array<int>"))


WEIGHTS = {
    ("r0", 0): (0.445448950, 0.462098120), ("r0", 1): (0.281046997, 0.255820001), ("r1", 1): (0.281046997, 0.255820001),
    ("r1", 2): (0.281046997, 0.338353206), ("r2", 0): (0.281046997, 0.291551453), ("r2", 2): (0.562093993, 0.676706413),
}


def test_weights(spark):
    for k, name in enumerate(("tf-idf", "log-entropy")):
        got = {(r["row"], r["col"]): r["value"] for r in matrix.weighted(tf(spark), name).collect()}
        assert got == {x: pytest.approx(w[k], abs=1e-8) for x, w in WEIGHTS.items()}
    with pytest.raises(ValueError):
        matrix.weighted(tf(spark), "none")
    assert matrix.log_entropy(tf(spark).filter("row = 'r0'")).first()["value"] is None


def test_svd_of_the_small_matrix(spark):
    m = matrix.weighted(tf(spark), "log-entropy")
    s = svd.truncated(m, 3, oversampling=2)
    sigma = [r["sigma"] for r in s.sigma.orderBy("component").collect()]
    assert sigma == pytest.approx([0.840315, 0.475878, 0.263155], abs=1e-5)
    spec = svd.spectrum(s.sigma, matrix.frobenius(m))
    r = svd.spectrum_summary(spec).first()
    assert (r["effective_rank_90"], r["effective_rank_95"]) == (2, 3)
    one = svd.spectrum_summary(spec.filter("component = 0")).first()
    assert (one["effective_rank_90"], one["effective_rank_95"]) == (2, 2)


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((40, 12)) < 0.4) * rng.normal(size=(40, 12))
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(40) for j in range(12) if a[i, j]], "row int, col int, value double")
    s = svd.truncated(entries, 5, n_iter=6, oversampling=6)
    want = np.linalg.svd(a, compute_uv=False)
    sigma = np.array([r["sigma"] for r in s.sigma.orderBy("component").collect()])
    assert sigma == pytest.approx(want[:5], rel=1e-4)
    v = np.zeros((12, 5))
    for r in s.v.collect():
        v[r["col"]] = r["vec"]
    u = np.zeros((40, 5))
    for r in s.u.collect():
        u[r["row"]] = r["vec"]
    assert v.T @ v == pytest.approx(np.eye(5), abs=1e-6) and u.T @ u == pytest.approx(np.eye(5), abs=1e-6)
    assert np.linalg.norm(a - u * sigma @ v.T) == pytest.approx(np.sqrt((want[5:] ** 2).sum()), rel=1e-3)
    assert (np.abs(v).argmax(0) == v.argmax(0)).all()
    words = svd.word_vectors(s, power=0.0, all_ids=spark.range(14).selectExpr("cast(id AS int) AS idx"))
    assert words.count() == 14 and words.filter("idx = 13").first()["vec"] == [0.0] * 5


def test_components_and_norms(spark):
    x = np.random.default_rng(2).normal(size=(30, 4)) * [5, 2, 1, 0.5]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "idx int, vec array<double>")
    assert svd.covariance(df, 4) == pytest.approx(np.cov(x.T), rel=1e-9)
    got = np.array([r["vec"] for r in svd.principal_components(df, 4, 2).orderBy("idx").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c)[2][:2].T
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)
    n = svd.norm_stats(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "vec array<double>")).first()
    assert (n["mean_norm"], n["std_norm"], n["n_zero"]) == (2.5, 2.5, 1)


def test_cooccurrence(spark):
    pairs = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("a", "z", 5)], "w1 string, w2 string, n long")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "word string, idx int")
    assert {(r["i"], r["j"]): r["value"] for r in matrix.symmetric(pairs, vocab).collect()} == {(0, 1): 3, (1, 0): 3}
