"""Problems 8, 9 and 10: round trips, capacities, shares."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tantu.llm import mixing, packing, queries, splitting
from tantu.session import shared_dir

DOCS = "doc_id long, text string, source string, n int, start int, bucket string, first int"
TEXTS = ["", "a", "शब्द " * 40, "Ein Satz. Noch einer! " * 30, "村庄。" * 100, "x" * 500, "para\n\n" * 60, None, "عالم۔ " * 50, "a" * 200_000]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, f"s{i % 2}", 1, 2, "b", 3) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize(("limit", "overlap"), [(100, 0), (100, 20), (64, 9)])
def test_split_round_trip(spark, limit, overlap):
    out = splitting.split_texts(docs(spark), limit, overlap).orderBy("doc_id", "piece_no").collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {i for i, t in enumerate(TEXTS) if t is not None}
    for i, pieces in by.items():
        raw = TEXTS[i].encode()
        assert [p["piece_no"] for p in pieces] == list(range(len(pieces))) and all(p["n_pieces"] == len(pieces) for p in pieces)
        assert (len(pieces) == 1) == (len(raw) <= limit)
        end = 0
        for k, p in enumerate(pieces):
            assert p["n_tokens"] <= limit and p["piece"].encode() == raw[p["start"] : p["start"] + p["n_tokens"]]
            if k:
                assert overlap <= end - p["start"] <= overlap + 3
            else:
                assert p["start"] == 0
            end = p["start"] + p["n_tokens"]
        assert end == len(raw)


def test_split_takes_the_strongest_boundary(spark):
    text = "word " * 12 + "end. " + "more " * 4 + "\n\n" + "tail " * 30
    first = splitting.split_texts(docs(spark, [text]), 110, 0).filter("piece_no = 0").first()["piece"]
    assert first.endswith("\n\n")


def test_split_empty_table_and_bad_limit(spark):
    assert splitting.split_texts(spark.createDataFrame([], DOCS), 100, 10).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(docs(spark), 20, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_sum_of_squares(sizes):
    p, fills = packing.SumOfSquares(50), {}
    for n in sizes:
        window, at = p.place(n)
        assert fills.get(window, 0) == at
        fills[window] = at + n
    assert all(f <= 50 for f in fills.values()) and sum(fills.values()) == sum(sizes)
    levels = np.bincount([f for f in fills.values() if f < 50], minlength=51)
    assert (levels == p.levels).all()


def test_sum_of_squares_leaves_little_room():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 4000)
    p = packing.SumOfSquares(1000)
    for n in sizes:
        p.place(int(n))
    assert sizes.sum() / (p.made * 1000) > 0.98


def test_pack(spark):
    out = packing.pack_texts(docs(spark), 64).collect()
    count = packing.token_counter(f"{packing.TOKENIZER_DIR}/{packing.TOKENIZER}")
    fills = {}
    for r in sorted(out, key=lambda r: (r["container"], r["at"])):
        assert fills.get(r["container"], 0) == r["at"]
        fills[r["container"]] = r["at"] + r["n_tokens"]
        assert fills[r["container"]] <= 64
    for i, t in enumerate(TEXTS):
        parts = sorted((r["piece_no"], r["start"], r["n_tokens"]) for r in out if r["doc_id"] == i)
        n = count(t) if t else 0
        assert sum(x[2] for x in parts) == n and all(x[2] == 64 for x in parts[:-1])
        assert n > 64 or len(parts) <= 1
    assert packing.pack_texts(spark.createDataFrame([], DOCS), 64).count() == 0
    assert packing.container_fill(packing.pack_texts(docs(spark), 64), 64).agg({"n_tokens": "sum"}).first()[0] == sum(fills.values())


def test_packing_account(spark):
    kept = packing.packing_account(packing.pack_texts(docs(spark), 64), 64).first()
    assert (kept["n_over"], kept["n_gaps"], kept["n_needless"]) == (0, 0, 0) and 0 < kept["fill"] <= 1
    assert kept["n_texts"] == sum(bool(t) for t in TEXTS)
    bad = spark.createDataFrame([("c", 0, 1, 0, 0, 40), ("c", 50, 2, 0, 0, 30), ("e", 0, 3, 0, 0, 9), ("f", 0, 3, 1, 0, 9)], "container string, at int, doc_id long, piece_no int, start int, n_tokens int")
    broken = packing.packing_account(bad, 64).first()
    assert (broken["n_over"], broken["n_gaps"], broken["n_needless"]) == (1, 1, 1)
    none = packing.packing_account(bad.limit(0), 64).first()
    assert none["n_texts"] == 0 and none["fill"] is None


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**63))
def test_permutation(n, key):
    got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
    assert sorted(got) == list(range(n))


def test_blocks_lay_every_text_end_to_end(spark):
    data = docs(spark)
    parts = mixing.token_blocks(data, block=64).collect()
    for i, t in enumerate(TEXTS):
        mine = sorted((r["start"], r["n"]) for r in parts if r["doc_id"] == i)
        at = 0
        for start, n in mine:
            assert start == at
            at += n
        assert at == len((t or "").encode())
    by = {}
    for r in parts:
        by[r["source"], r["block_no"]] = by.get((r["source"], r["block_no"]), 0) + r["n"]
    for s in ("s0", "s1"):
        sizes = [by[s, b] for b in range(sum(k[0] == s for k in by))]
        assert all(x == 64 for x in sizes[:-1])


def test_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "x" * int(rng.integers(50, 400)), s) for i, s in enumerate(["big"] * 600 + ["small"] * 30 + [None] * 20 + ["other"] * 50)]
    data = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("gone", 0.1, 4)], "source string, target_share double, max_repeat int")
    mixed, _ = mixing.mixture(data, targets, block=64)
    total = sum(len(r[1]) for r in rows)
    report = {r["source"]: r for r in mixing.mixture_report(data, targets, block=64).collect()}
    size = {s: sum(len(r[1]) for r in rows if r[2] == s) for s in ("big", "small")}
    assert report["big"]["total_tokens"] == total and report["big"]["n_tokens"] == size["big"]
    assert report["big"]["actual_share"] == pytest.approx(0.5, abs=0.05) and not report["big"]["short"]
    assert report["small"]["short"] and report["small"]["mixed_tokens"] == 3 * size["small"]
    assert report["gone"]["mixed_tokens"] == 0 and report["gone"]["short"]
    assert sum(r["mixture_share"] for r in report.values()) == pytest.approx(1) and report["small"]["exhausted"] and report["gone"]["exhausted"]
    assert report["small"]["slots_drawn"] > 3 * report["small"]["n_tokens"] / 64
    used = mixed.groupBy("doc_id", "start").count().agg({"count": "max"}).first()[0]
    assert used <= 3
    again = mixing.mixture(data, targets, block=64)[0]
    assert mixed.exceptAll(again).count() == 0


def test_mixture_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    assert mixing.mixture(none, targets)[0].count() == 0
    assert mixing.mixture_report(none, targets).first()["short"] is False
    assert mixing.mixture_report(none, targets.limit(0)).count() == 0


def test_p9_found_makes_the_mixture(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("s0", 0.5, 1), ("s1", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeat int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    assert {r["source"] for r in queries.p9_found(spark, str(tmp_path)).collect()} == {"s0", "none"}
    made = {r["source"]: r["mixed_tokens"] for r in spark.read.parquet(f"{shared_dir(spark)}/mixture-report-*").collect()}
    assert made["s0"] > 0 and made["s1"] > 0 and made["none"] == 0
