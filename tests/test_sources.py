import json

import pytest
from pyspark.sql import functions as F

from tantu.operators import registry
from tantu.sources import fetch, readers, writers
from tantu.streaming import incremental


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a", "text": "t", "meta": {"n": "1"}}\n\nbroken\n{"id": "b", "lang": "mr", "sentences": [["x"]]}\n')
    raw, tok = readers.documents(spark, str(p))
    assert [r["id"] for r in raw.collect()] == ["a"] and tok.first()["sentences"] == [["x"]]
    for codec in ("none", "gzip"):
        out = str(tmp_path / codec)
        writers.write_json_lines(tok, out, codec)
        assert readers.json_lines(spark, out, readers.TOKENIZED).first()["id"] == "b"


def test_zstd(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.ZstdCompressor(10).compress('{"id": "a", "lang": "mr"}\n\nbroken\n{"id": "ब"}\n'.encode()))
    assert sorted(r["id"] for r in readers.zstd_json(spark, str(tmp_path), "id string, lang string").collect()) == ["a", "ब"]


def test_lines_and_lists(spark, tmp_path):
    (tmp_path / "r").write_text("one\n\n two\n")
    assert sorted(tuple(r) for r in readers.raw_lines(spark, str(tmp_path / "r"), "mr").collect()) == [("mr-0", "one"), ("mr-1", " two")]
    (tmp_path / "w").write_text("100 the 9\n101 घर 5\n102 x y 3\n103 दार 4\n104 z no\n")
    assert [(r["id"], r["word"]) for r in readers.frequency_list(spark, str(tmp_path / "w"), most=2).collect()] == [(101, "घर"), (103, "दार")]
    (tmp_path / "c").write_text("1 2 5 0.5\n1 2 3\n")
    assert [tuple(r) for r in readers.cooccurrence_list(spark, str(tmp_path / "c")).collect()] == [(1, 2, 5, 0.5)]


def test_books(spark):
    rows = [("a#2", "zwei"), ("a#10", "zehn"), ("a#1", "eins"), ("a#1", "eins"), ("b#1", None), ("c", "solo")]
    got = {r["doc_id"]: (r["text"], r["n_pages"]) for r in readers.books(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"a": ("eins\n\nzwei\n\nzehn", 3), "c": ("solo", 1)}


def test_vocabulary_file(spark, tmp_path):
    v = spark.createDataFrame([(0, "घर", 3, 2), (1, "दार", 1, 1)], readers.VOCABULARY)
    writers.write_vocabulary(v, str(tmp_path / "v"))
    assert sorted(map(tuple, readers.vocabulary(spark, str(tmp_path / "v")).collect())) == [(0, "घर", 3, 2), (1, "दार", 1, 1)]
    with pytest.raises(ValueError):
        readers.embeddings_with_vocabulary(spark.createDataFrame([(0, [1.0])], "idx int, vec array<double>"), v)


def test_vectors_with_words(spark):
    v = spark.createDataFrame([(0, "a", 3, 2), (1, "b", 1, 1)], readers.VOCABULARY)
    x = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "idx int, vec array<double>")
    got = {r["lemma"]: (r["normed"], r["centered"]) for r in readers.embeddings_with_vocabulary(x, v).collect()}
    assert got == {"a": ([0.6, 0.8], [1.5, 2.0]), "b": ([0.0, 0.0], [-1.5, -2.0])}


def test_fetch(spark):
    def get(url):
        if url == "slow":
            raise TimeoutError
        return (200, b"book-bytes") if url == "good" else (404, b"no")

    links = spark.createDataFrame([("good",), ("good",), ("gone",), ("slow",), (None,)], "url string")
    got = {r["url"]: (r["status"], r["size_bytes"], r["error"], bool(r["sha256"])) for r in fetch.fetched(links, get).collect()}
    assert got == {"good": (200, 10, None, True), "gone": (404, 0, "http_404", False), "slow": (0, 0, "TimeoutError", False)}


def test_fetch_in_chunks_into_a_folder(spark, tmp_path):
    def get(url):
        def chunks():
            yield b"book-"
            if url == "broken":
                raise ConnectionError
            yield b"bytes"

        return 200, chunks()

    out = {r["url"]: r for r in fetch.fetched(spark.createDataFrame([("good",), ("broken",)], "url string"), get, str(tmp_path)).collect()}
    assert out["good"]["size_bytes"] == 10 and out["good"]["content"] is None and out["broken"]["error"] == "ConnectionError"
    # parts of what broke off are gone
    assert [p.name for p in tmp_path.iterdir()] == [out["good"]["sha256"]] and (tmp_path / out["good"]["sha256"]).read_bytes() == b"book-bytes"


def test_located_and_graphs(spark, tmp_path):
    import gzip

    for n in ("local", "cloud"):
        (tmp_path / n).mkdir()
    (tmp_path / "cloud" / "a.txt").write_text("plain")
    (tmp_path / "local" / "b.txt.gz").write_bytes(gzip.compress(b"packed"))
    roots = [str(tmp_path / n) for n in ("local", "cloud")]
    assert readers.located(spark, "a.txt", *roots) == roots[1] + "/a.txt"
    assert spark.read.text(readers.located(spark, "b.txt", *roots)).first()[0] == "packed"
    with pytest.raises(FileNotFoundError):
        readers.located(spark, "c.txt", *roots)
    (tmp_path / "g.xml").write_text('<graph>\n<node id="a"/>\n<edge source="a" target="b"><data key="w">0.5</data></edge>\n<edge source="b" target="c"/>\n</graph>')
    assert sorted(map(tuple, readers.edges(spark, str(tmp_path / "g.xml")).collect())) == [("a", "b", 0.5), ("b", "c", None)]


def test_html(spark):
    html = '<a href="/a">x</a><div><A class=b HREF=\'http://h/B.PDF\'>go <b>now</b></A><a href="/c">Download</a></div>'
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    assert [(r["position"], r["href"], r["text"]) for r in readers.links(df).collect()] == [(0, "/a", "x"), (1, "http://h/B.PDF", "go now"), (2, "/c", "Download")]
    assert [r[0] for r in df.select(readers.download_link(F.col("html"))).collect()] == ["http://h/B.PDF", None, None]
    assert [r["url"] for r in readers.crawl_pages(spark, "u/{page}", 1, 89, 2).collect()] == ["u/1", "u/2"]
    with pytest.raises(ValueError):
        readers.crawl_pages(spark, "u/{page}", 0, 3)


def test_files_shards_reports(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.bin").write_bytes(b"abc")
    (tmp_path / "in" / ".DS_Store").write_bytes(b"x")
    got = readers.files(spark, str(tmp_path / "in")).collect()
    assert len(got) == 1 and got[0]["sha256"].startswith("ba7816bf")
    df = spark.createDataFrame([("abc", 1), ("x", 2)], "id string, n int")
    writers.write_sharded(df, str(tmp_path / "out"))
    assert {r["shard"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"ab", "0x"}
    writers.write_report(spark, {"a": 1}, str(tmp_path / "rep"))
    assert json.loads(spark.read.text(str(tmp_path / "rep")).first()[0]) == {"a": 1}
    assert json.loads(writers.report_json(df).first()[0])["id"] in ("abc", "x")


def test_manifest(spark, tmp_path):
    p, schema = str(tmp_path / "m"), "id string, value int"
    writers.append_manifest(spark.createDataFrame([("a", 1), ("b", 2)], schema), p)
    writers.append_manifest(spark.createDataFrame([("a", 9)], schema), p)
    assert sorted(map(tuple, writers.read_manifest(spark, p, schema).collect())) == [("a", 9), ("b", 2)] and spark.read.json(p).count() == 3


def test_incremental_equals_batch(spark, tmp_path):
    src, out, seen = (str(tmp_path / n) for n in ("src", "out", "seen"))
    schema = "id string, v int"
    run = lambda: incremental.process_new(spark, src, schema, lambda b: b.withColumn("v", F.col("v") + 1), out, seen)
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(src)
    run()
    run()
    assert sorted(map(tuple, incremental.current(spark, out, "id").collect())) == [("a", 2), ("b", 3)]
    spark.createDataFrame([("a", 7)], schema).write.mode("append").parquet(src)
    run()
    assert sorted(map(tuple, incremental.current(spark, out, "id").collect())) == [("a", 8), ("b", 3)]
    incremental.running_counts(spark, src, schema, "id", str(tmp_path / "n"), str(tmp_path / "n_seen"))
    assert {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "n")).groupBy("id").agg(F.sum("n")).collect()} == {"a": 2, "b": 1}


def test_http_and_status(spark):
    df = spark.createDataFrame([(200,), (299,), (300,), (None,)], "s int")
    assert [r[0] for r in df.select(registry.http_ok(F.col("s"))).collect()] == [True, True, False, None]
