import pytest

from tantu.operators import lemmatize, registry


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture(scope="module")
def state(spark):
    docs = spark.createDataFrame([(c,) for c in "abcd"], "doc_id string")
    ocr = spark.createDataFrame([("a", "ok"), ("b", "error"), ("c", "ok")], "doc_id string, status string")
    tok = spark.createDataFrame([("a", "ok")], "doc_id string, status string")
    lem = spark.createDataFrame([], "doc_id string, method string, status string")
    return docs, ocr, tok, lem


def test_planning(spark, state):
    docs, ocr, tok, lem = state
    assert ids(registry.tasks(docs, [], ocr)) == ["d"] == ids(registry.tasks(docs, [], ocr, "pending"))
    assert ids(registry.tasks(docs, [], ocr, "error")) == ["b"]
    assert ids(registry.tasks(docs, [ocr], tok)) == ["c"] and ids(registry.tasks(docs, [ocr], tok, "ok")) == ["a"]
    assert ids(registry.tasks(docs, [ocr, tok], lem, "pending", method="m1", none_is_all=True)) == ["a"] == ids(registry.tasks(docs, [ocr, tok], lem, None, none_is_all=True))
    done = registry.upsert(lem, spark.createDataFrame([("a", "m1", "ok")], lem.schema), ["doc_id", "method"])
    assert ids(registry.tasks(docs, [ocr, tok], done, method="m1")) == [] and ids(registry.tasks(docs, [ocr, tok], done, method="m2")) == ["a"]
    assert ids(registry.tasks(docs, [], tok, limit=2)) == ["b", "c"]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "k string, v string")
    new = spark.createDataFrame([("b", "n"), (None, "m")], "k string, v string")
    assert sorted(map(tuple, registry.upsert(old, new, "k").collect()), key=str) == [("a", "x"), ("b", "n"), (None, "m")]
    got = registry.insert_missing(old, spark.createDataFrame([("b", "q"), ("c", "2"), ("c", "1"), (None, "0")], "k string, v string"), "k", first="v")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "x"), ("b", "y"), ("c", "1"), (None, "z")]


def test_latest(spark):
    log = spark.createDataFrame([(1, "t1", "a"), (1, "t2", "b"), (1, "t2", "b"), (2, None, "c"), (2, None, "d")], "id int, ts string, v string")
    assert sorted(map(tuple, registry.latest(log, "id", "ts").collect())) == [(1, "t2", "b"), (2, None, "d")]
    assert registry.latest(log.limit(0), "id", "ts").count() == 0


def test_builds(spark):
    builds = spark.createDataFrame([], "run_id int, status string, path string")
    one = spark.createDataFrame([("running", None)], "status string, path string")
    two = registry.register(registry.register(builds, one), one)
    assert ids(two) == [1, 2]
    done = registry.complete(two, 2, status="ok", path="p")
    assert registry.get_build(done, 2, need_ok=True)["path"] == "p"
    assert registry.complete(done, 2, path=None).filter("run_id = 2").first()["path"] is None
    for call in (lambda: registry.get_build(done, 9), lambda: registry.get_build(done, 1, need_ok=True)):
        with pytest.raises(ValueError):
            call()
    assert ids(registry.list_builds(done, "ok")) == [2]


def test_duplicates(spark):
    items = spark.createDataFrame([(1, "u", "s"), (2, "u", "s"), (3, "v", "s"), (4, "w", None)], "id long, url string, sha256 string")
    assert tuple(registry.by_content(items).first()) == ("s", 1, 3, 2)
    links = spark.createDataFrame([("u",), ("x",), ("x",)], "url string")
    assert ids(registry.new_urls(links, items)) == ["x"] and registry.has(items, "url", "w") and not registry.has(items, "url", "y")


def test_lemmatizer(spark):
    class Broken(lemmatize.SuffixLemmatizer):
        def analyse(self, tokens):
            for t in tokens:
                if t == "bad":
                    raise RuntimeError("no")
                yield from super().analyse([t])

    toks = spark.createDataFrame([("d", 0, i, t) for i, t in enumerate(["घरात", "घरात", "घरी", "bad", "abc", None])], "doc_id string, sent_no int, tok_no int, token string")
    out = {r["token"]: r for r in lemmatize.lemmatize(toks, Broken(("ात", "त")), drop_weird=False).collect()}
    assert out["घरात"]["lemma"] == "घर" and not out["घरात"]["is_oov"] and out["घरी"]["is_oov"] and out["bad"]["status"] == "error" and "no" in out["bad"]["error"]
    assert lemmatize.lemmatize(toks, Broken(("ात",))).count() == 3
    assert lemmatize.packed_sentences([50, 40, 30, 200, 1]) == [[0], [1, 2], [3], [4]]


def test_labels_and_pages(spark):
    words = spark.createDataFrame([("d", 0, 0, "a"), ("d", 0, 1, "b")], "doc_id string, sent_no int, tok_no int, token string")
    labels = spark.createDataFrame([("d", 0, 0, "B-Location")], "doc_id string, sent_no int, tok_no int, label string")
    assert sorted((r["token"], r["ner_result"], r["is_ne"]) for r in lemmatize.label_names(words, labels).collect()) == [("a", "Location", True), ("b", "Other", False)]

    def read(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return content.decode().split("|")

    files = spark.createDataFrame([(b"one|two",), (b"bad",)], "content binary")
    got = {(r["page_num"], r["text"], r["error"]) for r in lemmatize.page_texts(files, read).collect()}
    assert got == {(1, "one", None), (2, "two", None), (None, None, "ValueError: unreadable")}


def test_new_texts_and_json(spark):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([("b", "same"), ("a", "same"), ("c", "known"), ("d", None)], "id string, text string")
    known = texts.filter("id = 'c'").select(F.sha2("text", 256).alias("artefact"))
    assert [(r["id"], r["text"]) for r in registry.new_texts(texts, known).collect()] == [("a", "same")]
    builds = spark.createDataFrame([(1, "ok", (2.0, True)), (2, None, None)], "run_id int, status string, params struct<min_df: double, flag: boolean>")
    row = registry.of(registry.with_json(builds, params=F.col("params")), run_id=1).first()
    assert registry.from_json(row) == {"min_df": 2.0, "flag": True}
    assert registry.of(builds, status=None).first()["run_id"] == 2


def test_lemmatized_documents_and_chunks(spark):
    from tantu.operators import lemmatize

    docs = spark.createDataFrame([("a", "mr", [["घरात", "abc"], ["x"], [], ["दार"]], {"k": "v"}), ("b", None, None, None), ("c", "mr", [], None)], "id string, lang string, sentences array<array<string>>, meta map<string,string>")
    out = lemmatize.lemmatize_documents(docs, lemmatize.SuffixLemmatizer(("ात",))).collect()
    assert len(out) == 1 and [[w["lemma"] for w in s] for s in out[0]["sentences"]] == [["घर"], [], [], ["दार"]] and out[0]["meta"] == {"k": "v"}
    assert sorted(map(tuple, lemmatize.chunks(docs, 2).collect())) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 1), ("a", 3, 1)]
