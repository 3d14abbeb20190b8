"""Text, script and token expressions on the rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tantu.functions import script, text, vectors
from tantu.operators import tokens


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_simple_tokenizer(spark):
    got = one(spark, "Hello, world! It's (ok)... x2-y _z_. मुलगा!", text.tokenize)
    assert got == [["Hello", "world"], ["It's", "ok"], ["x2-y", "_z_"], ["मुलग"]]
    assert one(spark, "", text.tokenize) == [] and one(spark, None, text.tokenize) is None


@pytest.mark.parametrize("any_text", [True, False])
def test_clean(spark, any_text):
    given = "भेट द्या http://x.in/a १२३?! “छान”… abc।।"
    assert one(spark, given, lambda c: text.clean_devanagari(c, any_text=any_text)) == "भेट द्या 123! छान … ।"


def test_normalize(spark):
    assert one(spark, " <b>Ａ</b>\n b ", text.normalize_text) == "A b"
    assert one(spark, "ऩ क्‍ष​", text.normalize_devanagari) == "ऩ क्ष"


def test_padded_and_helpers(spark):
    assert one(spark, "घर, (मोठे).", text.tokenize_padded) == ["घर", ",", "(", "मोठे", ")", "."]
    assert one(spark, "*घर", text.strip_marker) == "घर" and one(spark, "*@घर", lambda c: text.strip_marker(c, "*@#")) == "घर"
    assert one(spark, "B-Location", text.label_class) == "Location"
    assert one(spark, "a", lambda c: text.shard(c, ".json")) == "0a/a.json"
    assert one(spark, "/a\\b", text.relative_path) == "a/b" and one(spark, "a/../b", text.relative_path) is None
    got = one(spark, [1, 22], lambda c: text.fragment_id(F.lit(7), F.lit("d1"), F.lit(0), c), "array<int>")
    assert got == "b15ee1da3b55863225c8f781145247d79158e4fba529a56281c7e3257b593cba"
    r = spark.createDataFrame([(["घर", "त"], [["n"], ["post"]])], "l array<string>, t array<array<string>>").select(text.reading(F.col("l"), F.col("t")).alias("r")).first()["r"]
    assert r == "घर<n>+त<post>"


CLASSES = [
    ("मुलगा", "ok", False), ("क्ष", "ok", False), ("१२", "ok", False), ("।", "ok", False), ("घर।", "ok", False), ("", "non_devanagari", True), ("abc", "non_devanagari", True), ("घर1", "non_devanagari", True),
    ("ाघर", "invalid_deva", False), ("क्अ", "ocr_garbage", False), ("क््क", "ocr_garbage", False), ("वावावा", "ocr_garbage", False), ("काकाका", "ocr_garbage", False), ("क" * 31, "ocr_garbage", False), ("क्ख्ग्", "ocr_garbage", False),
]


def test_classes(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in CLASSES] + [(None,)], "x string")
    got = [(r[0], r[1]) for r in df.select(script.classify(F.col("x")), script.is_weird(F.col("x"))).collect()]
    assert got == [(c, w) for _, c, w in CLASSES] + [("non_devanagari", True)]
    assert one(spark, "straße", lambda c: script.classify(c, script.LATIN)) == "ok"


TOKEN = "doc_id string, sent_no int, tok_no int, token string, lemma string, pos string, is_ne boolean, ner_result string, analyses array<string>, is_oov boolean, is_ambiguous boolean"


def token_rows(spark):
    return spark.createDataFrame(
        [
            ("a", 0, 0, "मुंबई", "मुंबई", "", True, "Location", None, False, True), ("a", 0, 1, "घर", "घर", "n", False, None, ["x", "y"], None, False),
            ("b", 0, 0, "x", "x", None, True, None, [], True, None), ("b", 0, 1, None, None, "n", None, None, None, True, False),
        ], TOKEN,
    )


def test_names_and_preprocessing(spark):
    t = token_rows(spark)
    assert [r["lemma"] for r in tokens.preprocess(t, tokens.Options(replace_ner=True)).collect()] == ["<LOCATION>", "घर", "<NONE>"]
    assert [r["lemma"] for r in tokens.preprocess(t, tokens.Options(replace_ner=True, normalize=True)).collect()] == ["<LOCATION>", "घर", "<NONE>"]
    assert [r["lemma"] for r in tokens.preprocess(t, tokens.Options(normalize=True)).collect()] == ["मुंबई", "घर"]
    assert [r["lemma"] for r in tokens.preprocess(t, tokens.Options(ignore_oov=True)).collect()] == ["मुंबई", "घर"]


def test_quality(spark):
    r = tokens.lemma_quality(token_rows(spark)).first()
    assert (r["n_tokens"], r["n_oov"], r["n_ambiguous"], r["analyses_per_token"]) == (4, 2, 1, 1.25)
    assert {r["pos"]: r["n_tokens"] for r in tokens.pos_histogram(token_rows(spark)).collect()} == {"null": 2, "n": 2}
    empty = tokens.lemma_quality(token_rows(spark).limit(0)).first()
    assert empty["n_tokens"] == 0 and empty["oov_rate"] is None


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("b")), vectors.normalized(F.col("a")), vectors.scaled(F.col("a"), F.array(F.lit(4.0), F.lit(9.0)), 0.5, 1)).collect()
    assert tuple(got[0]) == (5.0, pytest.approx(0.96), [0.6, 0.8], [6.0]) and got[1][1] is None and got[1][2] == [0.0, 0.0]


def test_marks_out_of_order_and_markers(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from tantu.functions import text

    words = ["\u0915\u094d\u093c", "\u0928\u0951\u0952\u093c", "\u0958", "\u0933\u093c", "\u0915\u0951\u094d", "plain", ""]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    assert [r[0] for r in df.orderBy("i").select(text.nfc_devanagari(F.col("w"))).collect()] == [unicodedata.normalize("NFC", w) for w in words]
    one = spark.createDataFrame([(["*b", "a", "b", "#a", "@c"], ["n", "sg"], "*x"), (None, None, None)], "l array<string>, t array<string>, w string")
    got = one.select(text.stripped_distinct(F.col("l")).alias("l"), text.has_tag(F.col("t"), "sg").alias("t"), text.is_unknown(F.col("w")).alias("u")).collect()
    assert tuple(got[0]) == (["b", "a", "c"], True, True) and tuple(got[1]) == (None, False, None)
