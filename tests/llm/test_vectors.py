"""Problem 3 against brute force."""

import numpy as np

from tantu.llm import neighbours

SCHEMA = "idx int, word string, normed array<float>, cell int, part int, id string"


def rows(x, start=0):
    return [(i + start, f"w{i}", [float(v) for v in r], 1, 2, "x") for i, r in enumerate(x)]


def clustered(n, rng, dims=16):
    centres = rng.normal(size=(n // 20 + 1, dims))
    return centres[rng.integers(len(centres), size=n)] + 0.3 * rng.normal(size=(n, dims))


def test_recall(spark):
    x = clustered(3000, np.random.default_rng(3))
    got = neighbours.nearest(spark.createDataFrame(rows(x), SCHEMA), "idx", "normed", 10).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:10]}
    found = {(r["id"], r["other"]) for r in got}
    assert len(found) == 10 * len(x) and len(found & want) / len(want) >= 0.95
    assert all(abs(r["cosine"] - s[r["id"], r["other"]]) < 1e-4 for r in got[:2000])


def test_unusable_and_repeated_rows(spark):
    x = clustered(60, np.random.default_rng(1))
    bad = [(900, None, None, 1, 1, ""), (901, "z", [0.0] * 16, 1, 1, ""), (902, "n", [float("nan")] * 16, 1, 1, ""), (903, "i", [float("inf")] + [0.0] * 15, 1, 1, ""), (904, "s", [1.0], 1, 1, ""), (905, "e", [], 1, 1, "")]
    data = rows(x)
    data[0] = (0, None, *data[0][2:])
    got = neighbours.nearest(spark.createDataFrame(data + bad + data[:5], SCHEMA), "idx", "normed", 5)
    out = got.collect()
    assert {r["id"] for r in out} == set(range(60)) and {r["other"] for r in out} <= set(range(60))
    assert all(sum(r["id"] == i for r in out) == 5 for i in range(60)) and not any(r["id"] == r["other"] for r in out)
    pairs = neighbours.neighbour_pairs(got).collect()
    assert all(p["idx_a"] < p["idx_b"] for p in pairs) and len(set(pairs)) == len(pairs)


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return [set(np.argsort(-r)[:k].tolist()) for r in s]


def test_recall_on_vectors_without_clusters(spark):
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(4000, 32)) / np.arange(1, 33), rng.normal(size=(4000, 32))):
        # the codebooks are fitted on a part of the vectors
        got = neighbours.nearest(spark.createDataFrame(rows(x), SCHEMA), "idx", "normed", 10, sample=800).collect()
        want, found = brute(x, 10), {}
        for r in got:
            found.setdefault(r["id"], set()).add(r["other"])
        assert sum(len(found[i] & w) for i, w in enumerate(want)) >= 0.95 * 10 * len(x)


def test_exact_way(spark):
    x = np.random.default_rng(6).normal(size=(700, 16))
    got = neighbours.nearest(spark.createDataFrame(rows(x), SCHEMA), "idx", "normed", 7, recall=None).collect()
    want = brute(x, 7)
    assert {(r["id"], r["other"]) for r in got} == {(i, j) for i, w in enumerate(want) for j in w}


def test_group_of_copies_and_large_values(spark):
    one = np.ones(16)
    x = np.concatenate([np.tile(one, (300, 1)), 3e37 * clustered(100, np.random.default_rng(2))])
    got = neighbours.nearest(spark.createDataFrame(rows(x), SCHEMA), "idx", "normed", 3).collect()
    copies = [r for r in got if r["id"] < 300]
    assert len(copies) == 900 and all(r["other"] < 300 and r["cosine"] > 0.9999 for r in copies)
    # every vector has its neighbours, a group with its smallest ids
    assert len(got) == 1200 and {r["other"] for r in copies} == {0, 1, 2, 3}


def test_small_group_of_copies_leaves_room_for_others(spark):
    x = np.random.default_rng(7).normal(size=(50, 16))
    x[1] = x[2] = x[0]
    got = neighbours.nearest(spark.createDataFrame(rows(x), SCHEMA), "idx", "normed", 5, recall=None).collect()
    want = brute(x, 5)
    found = {}
    for r in got:
        found.setdefault(r["id"], set()).add(r["other"])
    assert all(found[i] == want[i] for i in (0, 1, 2)) and all(len(f) == 5 for f in found.values())


def test_hot_cell_is_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 100)
    monkeypatch.setattr(neighbours, "QUESTIONS", 150)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=16) + 0.1 * rng.normal(size=(500, 16)), rng.normal(size=(500, 16))])
    got = neighbours.nearest(spark.createDataFrame(rows(x), SCHEMA), "idx", "normed", 5).collect()
    want = brute(x, 5)
    assert sum(r["other"] in want[r["id"]] for r in got) >= 0.95 * 5000


def test_cell_buckets():
    rng = np.random.default_rng(9)
    words, counts = rng.normal(size=(200, 8)), rng.integers(0, 50, 200)
    counts[7] = 900
    first, slices = neighbours.cell_buckets(words, counts, 300)
    rows_in = np.zeros(first.max() + 1 + slices.max())
    np.add.at(rows_in, first[np.arange(200) != 7], counts[np.arange(200) != 7])
    assert slices[7] == 3 and rows_in.max() <= 300


def test_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), "idx", "normed", 3).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, "a", [1.0, 2.0], 1, 1, "")], SCHEMA), "idx", "normed", 3).count() == 0
