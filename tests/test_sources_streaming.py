import json
import os
import struct
import unicodedata

from pyspark.sql import functions as F

from scriptoria.operators import tape
from scriptoria.sources import files
from scriptoria.streaming import ingest


def _tree(root):
    for name, data in {"notes/a.md": b"---\ntitle: A\n---\n# X\nbody ![i](p.png)", "notes/B c.md": b"no heading", "wisdom/w.md": b"# W", "skip/x.md": b"# S", "bad.md": b"\xff\xfe\x00", "empty.md": b""}.items():
        p = os.path.join(root, name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)


def test_markdown_scan(spark, tmp_path):
    _tree(str(tmp_path))
    got = {r["path"]: r for r in files.parse_markdown(files.markdown_files(spark, str(tmp_path), ("skip/*",))).collect()}
    assert sorted(got) == ["bad.md", "empty.md", "notes/B c.md", "notes/a.md"]
    assert got["notes/a.md"]["title"] == "A" and got["notes/a.md"]["n_images"] == 1 and got["notes/B c.md"]["title"] == "B c"
    assert got["bad.md"]["error"].startswith("encoding_error") and got["empty.md"]["error"] == "empty_body"
    docs = files.as_documents(files.parse_markdown(files.markdown_files(spark, str(tmp_path), ("skip/*",))), "source")
    assert "source:notes/b c.md" in {r["doc_id"] for r in docs.collect()}


def test_images_are_content_addressed(spark, rows):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 5)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\0" * 8
    df = spark.createDataFrame([("a.png", bytearray(png)), ("b.png", bytearray(png)), ("c.jpg", bytearray(jpg))], "path string, content binary")
    got = {tuple(r["original_paths"]): (r["mime"], r["width"], r["height"]) for r in files.assets(df).collect()}
    assert got == {("a.png", "b.png"): ("image/png", 3, 5), ("c.jpg",): ("image/jpeg", 9, 7)}
    assert files.asset_path("abcdef0123", "x/é  !!b.PNG") == "ab/abcdef01-" + unicodedata.normalize("NFC", "é") + "-b.png"


def test_bundle_and_sample(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": f"d/{i}", "title": "", "text": f"t{i}"}) for i in range(6)))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": f"q{i}", "text": "x"}) for i in range(3)))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq0\td/1\t1\nq0\td/2\t0\nq1\tgone\t1\nq2\td/3\t2\n")
    corpus, queries, judged = files.retrieval_bundle(spark, str(tmp_path))
    assert sorted(tuple(r) for r in judged.collect()) == [("q0", "d/1"), ("q2", "d/3")]
    c, q, j = files.query_first_sample(corpus, queries, judged, 1, 3)
    assert c.count() == 3 and q.count() == 1 and j.count() == 1


def test_manifest(spark, rows):
    d = spark.createDataFrame([("p", "a", "1", 1), ("p", "b", "1", 1), ("q", "c", "1", 1)], "package string, path string, sha256 string, bytes int")
    f = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("z", "1", 1)], "path string, sha256 string, bytes int")
    assert {(r[1], r[2]) for r in rows(files.manifest_verify(d, f))} == {("z", "orphan_file"), ("b", "sha_mismatch"), ("c", "missing")}
    assert files.params_digest({"b": 1, "a": 2}) == files.params_digest({"a": 2, "b": 1})


def test_incremental_ingest_is_idempotent(spark, tmp_path, rows):
    reg = spark.createDataFrame([("a", "h", True, 1.0), ("b", "h", True, 1.0), ("c", "h", False, 1.0)], "doc_id string, body_hash string, active boolean, mtime double")
    new = spark.createDataFrame([("a", "h", 0), ("b", "x", 0), ("c", "h", 0), ("d", "h", 0)], "doc_id string, body_hash string, n_images int")
    assert [r[0] for r in rows(ingest.changed(new, reg))] == ["b", "c", "d"]
    sink = ingest.merge_batch(str(tmp_path / "s"))
    sink(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int"), 0)
    for _ in range(2):
        sink(spark.createDataFrame([("b", 2)], "doc_id string, v int"), 1)
    assert rows(ingest.merged(spark, str(tmp_path / "s"))) == [("a", 1), ("b", 2)]
    ingest.merge_batch(str(tmp_path / "s"), order=("at",))(spark.createDataFrame([("b", 9, 1), ("b", 3, 5), ("b", 4, 2)], "doc_id string, v int, at int"), 2)
    ingest.compact(spark, str(tmp_path / "s"), str(tmp_path / "t"))
    assert rows(ingest.merged(spark, str(tmp_path / "t")).select("doc_id", "v")) == rows(ingest.merged(spark, str(tmp_path / "s")).select("doc_id", "v")) == [("a", 1), ("b", 3)]


def test_tape_stream_equals_batch(spark, tmp_path):
    ev = [(i, t, i, json.dumps({"type": "final" if i == 4 else "log"})) for t in ("t", "u") for i in range(7)] + [(50, "v", 0, None), (51, "v", 1, "cut {")]
    ev = [(n, *e[1:]) for n, e in enumerate(ev)]
    schema = "event_id long, task_id string, seq int, body string"
    spark.createDataFrame(ev, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.tape_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tape").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["task_id"], r["event_id"], r["new_seq"]) for r in spark.sql("SELECT * FROM tape").collect())
    want = sorted((r["task_id"], r["event_id"], r["new_seq"]) for r in tape.admitted(spark.createDataFrame(ev, schema)).collect())
    assert got == want and len(got) == 12


def test_embedding_batches_retry_then_skip(spark):
    def provider(texts):
        if any("slow" in t for t in texts):
            raise TimeoutError("slow")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "slow")], "id int, t string").coalesce(1)
    got = {r["id"]: (r["embedding"], r["error"]) for r in ingest.embed_batches(df, "id", "t", provider, batch=1).collect()}
    assert got == {1: ([2.0], None), 2: ([0.0], None), 3: (None, "slow")}
