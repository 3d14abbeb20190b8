import json

from tantu import cli


def test_chain(spark, tmp_path):
    d = lambda n: str(tmp_path / n)
    run = lambda *a: cli.main(list(a), spark)
    pages = [(None, f"b{i}#1", "घरात मोठे दार आहे. दारात मुलगा आहे। " * 6 + ("नदी वाहते. " * i), (1,)) for i in range(6)]
    spark.createDataFrame(pages, "schema_version string, id string, text string, meta struct<page_num: int>").write.parquet(d("pages"))
    assert run("tokenize-text", d("pages"), d("tok"), "--head", "5") == 0 and spark.read.parquet(d("tok")).count() == 5
    assert run("lemmatize-text", d("tok"), d("lemma")) == 0
    assert run("build-vocab", d("lemma"), d("vocab"), "--min-df", "2", "--max-df", "1.0") == 0
    assert run("index-corpus", d("lemma"), d("frag"), "--vocabulary", d("vocab"), "--fragment-size", "4") == 0
    assert run("build-tdm", d("frag"), d("tdm"), "--weighting-method", "log-entropy") == 0
    assert run("build-svd", d("tdm"), d("svd"), "--k", "2", "--oversampling", "2", "--n-iter", "2") == 0
    assert run("build-embeddings", d("svd"), d("emb"), "--sigma-power", "0.5") == 0 and spark.read.parquet(d("emb") + "/vectors").count() > 2
    assert run("explore-embeddings-geometry", d("emb"), d("geo"), "--n-pairs", "50", "--knn-k", "2") == 0
    assert run("explore-vocabulary", d("lemma"), d("voc")) == 0 and run("explore-lemma-stats", d("lemma"), d("stats")) == 0
    assert json.loads(spark.read.text(d("voc")).first()[0])["n_docs"] == 5
    assert run("build-vocab", d("missing"), d("x")) == 1


def test_builds_inherit_from_the_registry(spark, tmp_path):
    d = lambda n: str(tmp_path / n)
    rows = [(f"d{i}", s, t, w, w, False, None, i == 0) for i in range(4) for s in range(4) for t, w in enumerate(["घर", "दार", "घर", "x"])]
    spark.createDataFrame(rows, "doc_id string, sent_no int, tok_no int, token string, lemma string, is_ne boolean, ner_result string, is_oov boolean").write.parquet(d("lemma"))
    assert cli.main(["build-vocab", d("lemma"), d("vocab"), "--max-df", "1.0", "--ignore-oov", "--normalize", "--registry", d("builds")], spark) == 0
    assert cli.main(["index-corpus", d("lemma"), d("frag"), "--fragment-size", "4", "--registry", d("builds"), "--from-build", "1"], spark) == 0
    assert {r["source_doc_id"] for r in spark.read.parquet(d("frag")).collect()} == {"d1", "d2", "d3"}
    builds = {r["kind"]: r for r in cli._builds(spark, d("builds")).collect()}
    assert builds["corpus"]["run_id"] == 2 and json.loads(builds["corpus"]["params"])["ignore_oov"] and json.loads(builds["vocabulary"]["stats"]) == {"n_terms": 2}
    assert cli.main(["index-corpus", d("lemma"), d("frag"), "--registry", d("builds"), "--from-build", "9"], spark) == 1


def test_acquisition(spark, tmp_path, monkeypatch):
    d = lambda n: str(tmp_path / n)
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "a.txt").write_text("पान एक\fपान दोन", encoding="utf-8")
    (tmp_path / "web" / "b.txt").write_bytes(b"\xff\xfe")
    urls = [(tmp_path / "web" / n).as_uri() for n in ("a.txt", "b.txt", "gone.txt")]
    (tmp_path / "links.jsonl").write_text("".join(json.dumps({"url": u, "lang": "mr"}) + "\n" for u in urls))
    assert cli.main(["fetch-pdfs", d("links.jsonl"), d("got")], spark) == 0
    tries = {r["url"]: r for r in spark.read.parquet(d("got/registry")).collect()}
    assert tries[urls[0]]["sha256"] and tries[urls[2]]["status"] == 0 and tries[urls[2]]["error"]
    assert cli.main(["fetch-pdfs", d("links.jsonl"), d("got")], spark) == 0 and spark.read.parquet(d("got/registry")).count() == 4
    assert cli.main(["extract-text", d("got/files"), d("text")], spark) == 0
    assert sorted(r["text"] for r in spark.read.parquet(d("text/pages")).collect()) == ["पान एक", "पान दोन"]
    assert sorted(r["status"] for r in spark.read.parquet(d("text/results")).collect()) == ["error", "ok"]
    assert cli.main(["extract-text", d("got/files"), d("text")], spark) == 0 and spark.read.parquet(d("text/results")).count() == 2
    assert cli.main(["upload-files", d("got"), d("copy"), "--stage", "files", "--dry-run"], spark) == 0 and not (tmp_path / "copy").exists()
    assert cli.main(["upload-files", d("got"), d("copy"), "--stage", "files"], spark) == 0
    assert len([p for p in (tmp_path / "copy" / "files").iterdir() if not p.name.startswith(".")]) == 2
    assert cli.main(["discover-links", "http://127.0.0.1:9/{page}", d("x"), "--page-to", "1"], spark) == 2
