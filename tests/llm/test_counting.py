"""Problems 1 and 5 against brute force, with nulls, repeated and corrected rows, ties, an empty table and clashing columns."""

import math
from collections import Counter, defaultdict
from datetime import datetime

import pytest

from tantu.llm import frequency, relevance, tokens

SCHEMA = "doc_id string, sent_no int, tok_no int, lemma string, is_oov boolean, updated_at timestamp, rec int, block string, tf int, word_no int"
T = [datetime(2024, 1, d) for d in range(1, 10)]


def rows():
    out = [("a", 0, i, w, False, T[0], 1, "x", 2, 3) for i, w in enumerate("x x y z z z".split())]
    out += [("a", 0, 0, "x", False, T[0], 1, "x", 2, 3)]  # repeated
    out += [("a", 0, 2, "w", True, T[5], 1, "x", 2, 3)]  # corrected later
    out += [("b", 0, 0, "x", None, T[1], None, None, None, None), ("b", 0, 1, None, True, T[1], 1, "", 1, 1), ("b", 1, 0, "", True, T[1], 1, "", 1, 1), ("b", None, None, "q", None, None, 1, "", 1, 1)]
    out += [("c", 5000, 40000, "z", True, T[1], 1, "", 1, 1), ("c", 1, 1, "z", False, T[1], 1, "", 1, 1), ("c", 1, 2, "x", False, T[1], 1, "", 1, 1)]  # two blocks of one record
    out += [(None, 0, 0, "x", False, T[1], 1, "", 1, 1), ("d", 0, 0, None, False, T[1], 1, "", 1, 1)]
    return out


def counted(data):
    last = {}
    for r in data:
        if r[0] is not None:
            k, v = r[:3], (r[5] or datetime(1, 1, 1), bool(r[4]), r[3] is not None, r[3] or "")
            last[k] = max(last.get(k, v), v)
    return [(k[0], v[3], v[1]) for k, v in last.items() if v[3]]


def test_frequencies(spark):
    terms, n = frequency.term_frequencies(spark.createDataFrame(rows(), SCHEMA))
    c = counted(rows())
    tf, docs = Counter(w for _, w, _ in c), defaultdict(set)
    for d, w, _ in c:
        docs[w].add(d)
    known = Counter(w for _, w, o in c if not o)
    assert n == 4
    assert {r["lemma"]: (r["tf"], r["df"], r["tf_known"]) for r in terms.collect()} == {w: (tf[w], len(docs[w]), known[w]) for w in tf}


def test_bitmaps_are_unions(spark):
    data = [(f"d{i:04}", 0, 0, "all" if i % 2 else "even", False, T[0], 1, "", 1, 1) for i in range(700)]
    terms, n = frequency.term_frequencies(spark.createDataFrame(data + data, SCHEMA))
    assert n == 700 and {r["lemma"]: r["df"] for r in terms.collect()} == {"all": 350, "even": 350}


def weighted(spark, data, **options):
    weights, docs = relevance.term_weights(spark.createDataFrame(data, SCHEMA), **options)
    return weights.join(docs, "rec").drop("rec")


@pytest.mark.parametrize("term_rows", [1, 1_000_000])
def test_weights_match_brute_force(spark, term_rows):
    data = rows()
    got = {(r["doc_id"], r["lemma"]): r for r in weighted(spark, data, term_rows=term_rows).collect()}
    c = counted(data)
    tf, n = Counter((d, w) for d, w, _ in c), 4
    df = Counter(w for _, w in tf)
    length = Counter(d for d, _, _ in c)
    avg = sum(length.values()) / len(length)
    assert set(got) == set(tf)
    for (d, w), f in tf.items():
        bm = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[d] / avg))
        g = sum(v for (_, x), v in tf.items() if x == w)
        h = -sum(v / g * math.log(v / g) for (_, x), v in tf.items() if x == w)
        assert got[d, w]["relevance"] == pytest.approx(bm)
        assert got[d, w]["tf_idf"] == pytest.approx(math.log(1 + f) * math.log(n / df[w]))
        assert got[d, w]["log_entropy"] == pytest.approx(math.log(1 + f) * (1 - h / math.log(n)))


def test_ties_go_to_the_first_lemma(spark):
    data = [("a", 0, i, w, False, T[0], 1, "", 1, 1) for i, w in enumerate(["m", "k", "l"])] + [("b", 0, 0, "o", False, T[0], 1, "", 1, 1)]
    top = {r["doc_id"]: r["lemma"] for r in relevance.most_typical(spark.createDataFrame(data, SCHEMA)).collect()}
    assert top == {"a": "k", "b": "o"}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert relevance.most_typical(none).count() == 0
    terms, n = frequency.term_frequencies(none)
    assert n == 0 and terms.count() == 0
    assert tokens.distinct_records(none)[2] == 0


def test_verdicts(spark):
    data = [(f"d{i}", 0, j, w, False, T[0], 1, "", 1, 1) for i in range(10) for j, w in enumerate(["all"] + (["half"] if i % 2 else []) + ([f"one{i}"] if i == 3 else []))]
    params = "params struct<min_df: double, max_df: double, min_tf: int, ignore_oov: boolean>"
    builds = spark.createDataFrame([(1, "ok", (2.0, 0.9, None, None)), (2, "error", (2.0, 0.9, None, False)), (3, "ok", (None, None, None, False)), (4, "ok", (0.05, 0.0, 6, True))], f"run_id int, status string, {params}")
    got = {(r["run_id"], r["lemma"]): r["verdict"] for r in frequency.verdicts(spark.createDataFrame(data, SCHEMA), builds).collect()}
    assert got == {
        (1, "all"): "common", (1, "half"): "keep", (1, "one3"): "rare", (3, "all"): "keep", (3, "half"): "keep", (3, "one3"): "keep",
        (4, "all"): "common", (4, "half"): "rare", (4, "one3"): "rare",
    }
