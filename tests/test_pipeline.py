"""Ingest and synthesis from files to tables, the connectors around them, and writing rules."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria import pipeline
from scriptoria.functions import sql
from scriptoria.operators import chunking, store
from scriptoria.sources import connectors, files


def _write(root, path, text):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(text.encode() if isinstance(text, str) else text)


def test_ingest_cold_warm_changed_and_gone(spark, tmp_path):
    root, at = tmp_path / "vault", str(tmp_path / "base")
    for i in range(6):
        _write(root, f"notes/n{i}.md", f"---\ntitle: Note {i}\n---\n\n# H{i}\n\nwords of note {i} [[n{(i + 1) % 6}]]\n")
    _write(root, "notes/bad.md", b"\xff\xfe\x00bad")
    _write(root, "wisdom/w.md", "# left out")
    first = pipeline.ingest(spark, str(root), at, pipeline.hashed_provider)
    assert first == {"scanned": 7, "changed": 6, "gone": 0, "errors": 1}
    assert pipeline.ingest(spark, str(root), at, pipeline.hashed_provider) == {"scanned": 7, "changed": 0, "gone": 0, "errors": 1}
    _write(root, "notes/n1.md", "# H1\n\nnew words\n\nmore of them\n")
    os.remove(root / "notes/n2.md")
    assert pipeline.ingest(spark, str(root), at, pipeline.hashed_provider) == {"scanned": 6, "changed": 1, "gone": 1, "errors": 1}
    now = pipeline.read_base(spark, at)
    assert {r["doc_id"] for r in now["documents"].where("active").collect()} == {f"source:notes/n{i}.md" for i in (0, 1, 3, 4, 5)}
    held = {r["doc_id"]: r["text"] for r in now["chunks"].collect()}
    assert "source:notes/n2.md" not in held and "new words" in held["source:notes/n1.md"]
    assert now["links"].where("doc_id = 'source:notes/n1.md'").count() == 0 and now["vectors"].count() == 5


def test_synthesis_reads_blocks_and_folds_pages(spark):
    docs = spark.createDataFrame([("s:a", "a.md", "# A\n\nalpha text"), ("s:b", "b.md", "# B\n\nbeta text"), ("s:c", "c.md", "# C\n\ncut")], "doc_id string, path string, body string")

    def model(prompt):
        if "cut" in prompt:
            return '<page category="tool" slug="x">never closed'
        return f'<page category="concept" slug="shared">\n---\ntags: [t]\n---\n# Shared\n\nfrom {prompt.split()[0]}</page>'

    pages, errors = pipeline.synthesize(docs, model, {"concept", "tool"}, "inbox", "{path} says: {text}")
    got = pages.collect()
    assert [(r["path"], r["n"], r["sources"]) for r in got] == [("knowledge/concept/shared.md", 2, ["a.md", "b.md"])] and "---" in got[0]["body"]
    assert [r["error"] for r in errors.collect()] == ["truncated"]


def test_formats_converters_preflight_and_bundles(spark, tmp_path, rows):
    fs = spark.createDataFrame([("p/a.md", 1.0, bytearray("# A\n\n![x](img/one.png) ![y](My Pic.png) ![w](https://e.example/z.png)".encode())), ("b.csv", 1.0, bytearray(b"k,v")), ("c.bin", 1.0, bytearray(b"\x00"))], "path string, mtime double, content binary")
    connectors.CONVERTERS["csv"] = lambda raw: "# Table\n\n" + raw.decode()
    try:
        got = {r["path"]: (r["title"], r["error"]) for r in connectors.parse_any(fs).collect()}
    finally:
        del connectors.CONVERTERS["csv"]
    assert got == {"p/a.md": ("A", None), "b.csv": ("Table", None), "c.bin": (None, "unsupported_format: bin")}
    present = spark.createDataFrame([("p/img/one.png",)], "path string")
    assert rows(connectors.preflight(fs.where("path LIKE '%.md'"), present).select("problem", "detail")) == [("asset_missing", "My Pic.png")]
    members = spark.createDataFrame([("k", "a.md", bytearray(b"x"), False, True), ("k", "i.png", bytearray(b"y"), True, True), ("k", "i.png", bytearray(b"y"), True, True), ("k", "o.png", bytearray(b"z"), True, False)], "package string, path string, content binary, is_asset boolean, referenced boolean")
    manifest, lost = connectors.bundle(members)
    assert manifest.count() == 2 and manifest.select("digest").distinct().count() == 1 and rows(lost) == [("k", "o.png")]
    declared = spark.createDataFrame([("k", "a.md"), ("j", "b.md"), ("i", "c.md"), ("i", "c.md")], "package string, path string")
    assert rows(connectors.rejected_packages(spark.createDataFrame([("a.md", "missing")], "path string, problem string"), declared)) == [("i",), ("k",)]
    assert files.contained("a/b.md", str(tmp_path)) and not files.contained("../x", str(tmp_path))
    assert files.asset_path("ab" * 32, "con.PNG").endswith("con-file.png")
    new = spark.createDataFrame([("s1", ["n.png"]), ("s2", ["m.png"])], "asset_id string, original_paths array<string>")
    old = spark.createDataFrame([("s1", ["o.png"])], "asset_id string, original_paths array<string>")
    assert {r["asset_id"]: (r["original_paths"], r["was_new"]) for r in files.materialized(new, old).collect()} == {"s1": (["o.png", "n.png"], False), "s2": (["m.png"], True)}


def test_datasets_logs_pages_and_templates(spark, tmp_path, rows):
    pytest.importorskip("yaml")
    _write(tmp_path, "ds/dataset.yaml", "name: d\nthresholds: {hit_at_10: 0.5}\n")
    _write(tmp_path, "ds/queries.yaml", "queries:\n- {id: q1, q: what, expect_any: [a, b]}\n")
    ds = connectors.load_dataset(spark, str(tmp_path / "ds"))
    assert ds["name"] == "d" and rows(ds["relevant"]) == [("q1", "a"), ("q1", "b")] and rows(ds["thresholds"]) == [("hit_at_10", 0.5)]
    _write(tmp_path, "ds/queries.yaml", "queries:\n- {id: q1, q: what, expect_targets: [nowhere]}\n")
    with pytest.raises(ValueError):
        connectors.load_dataset(spark, str(tmp_path / "ds"))
    connectors.append_runs(spark.createDataFrame([("a", 0.5, 1)], "arm string, mrr double, n long"), str(tmp_path / "log"))
    connectors.append_runs(spark.createDataFrame([("b", 0.75, 2)], "arm string, mrr double, n long"), str(tmp_path / "log"))
    assert rows(connectors.read_runs(spark, str(tmp_path / "log")).where("metric = 'mrr'")) == [("a", "mrr", 0.5), ("b", "mrr", 0.75)]
    text = connectors.page_text({"title": "T", "tags": ["x"]}, {"title": "no", "extra": 1}, "body")
    connectors.write_file(str(tmp_path), "knowledge/t.md", text)
    assert connectors.trash(str(tmp_path), "knowledge/t.md", "2026-01-01") == "trash/knowledge/t.md"
    connectors.write_file(str(tmp_path), "knowledge/t.md", text)
    assert connectors.trash(str(tmp_path), "knowledge/t.md", "2026-01-01") == "trash/knowledge/t-1.md"
    assert '"T"' in text and "no" not in text.split("title:")[1][:5]
    with pytest.raises(ValueError):
        connectors.write_file(str(tmp_path), "../out.md", "x")
    assert connectors.fill("{a} {b}", {"a": "{b}", "b": "2"}) == "{b} 2"
    assert connectors.template_problems("{a} {z}", {"a", "b"}, {"a", "b"}) == ["missing {b}", "unknown {z}"]
    lines = list(connectors.ndjson(spark.range(2)))
    assert len(lines) == 4 and '"rows": 2' in lines[-1]
    assert connectors.long_poll(lambda n: [], 0, wait=0.05, pause=0.01) == [] and connectors.long_poll(lambda n: [n], 3) == [3]


def test_providers_fail_softly(spark):
    calls = []

    def model(p):
        if p == "down":
            raise TimeoutError("down")
        return p.upper()

    got = {r["id"]: (r["reply"], r["error"]) for r in connectors.complete(spark.createDataFrame([(1, "a"), (2, "down"), (3, None)], "id int, prompt string"), "id", "prompt", model).collect()}
    assert got == {1: ("A", None), 2: (None, "down"), 3: ("", None)} and not calls
    mixed = connectors.embed_mixed(spark.createDataFrame([(1, "abc", None), (2, None, bytearray(b"xy"))], "id int, text string, image binary"), "id", lambda pairs: [[float(len(t or "")), float(len(i or b""))] for t, i in pairs])
    assert {r["id"]: r["embedding"] for r in mixed.collect()} == {1: [3.0, 0.0], 2: [0.0, 2.0]}


def test_writing_rules(spark, rows):
    refs = spark.createDataFrame([(1, "s", "alt", 3, 10), (1, "gone", None, 11, 13)], "chunk_id int, asset_id string, alt string, start_in_chunk int, end_in_chunk int")
    chunks = spark.createDataFrame([(1, "ab ![](x) zz end"), (2, "plain"), (3, None)], "chunk_id int, text string")
    assets = spark.createDataFrame([("s", "assets/s.png")], "asset_id string, stored_path string")
    assert rows(store.rendered(chunks, refs, assets)) == [(1, "ab ![alt](assets/s.png)zz end"), (2, "plain"), (3, None)]
    vec = spark.createDataFrame([(1, 1, [1.0, 2.0])], "k int, version_id int, embedding array<float>")
    assert store.upsert_vectors(vec, vec, "k", 2).count() == 1
    with pytest.raises(Exception, match="must have 3"):
        store.upsert_vectors(vec, vec, "k", 3).collect()
    log = spark.createDataFrame([(4, 1.0, "x")], "id long, ts double, note string")
    assert rows(store.append_log(log, spark.createDataFrame([(1.0, "b"), (1.0, "a")], "ts double, note string"), ["ts", "note"])) == [(4, 1.0, "x"), (5, 1.0, "a"), (6, 1.0, "b")]
    print_ = store.schema_fingerprint({"log": log})
    store.refuse_other_schema({"log": log}, print_)
    with pytest.raises(ValueError):
        store.refuse_other_schema({"log": log.drop("note")}, print_)
    assert [store.category_problem(x) for x in ("a/b", "", "/a", "a//b", "a/..", "a/b.", "a/b?", "产品/移动端")] == [None, "empty", "not a relative path with slashes", "blank at the edge of a segment", "dots", "dots", "reserved character", None]
    v = spark.createDataFrame([([0.5, -2.0],), (None,)], "v array<float>").select(store.packed_vector(F.col("v")).alias("b"))
    raw = v.collect()
    assert bytes(raw[0]["b"]) == np.array([0.5, -2.0], dtype="<f4").tobytes() and raw[1]["b"] is None
    assert [r[0] for r in v.select(store.unpacked_vector(F.col("b"))).collect()] == [[0.5, -2.0], None]
    docs = spark.createDataFrame([("d", "# X\n\npara\n\nmore")], "id string, body string")
    spans = spark.createDataFrame([("d", 5, 9), ("d", 0, 400)], "id string, start int, end int")
    assert rows(store.outside_chunks(spans, chunking.chunk(docs, "id", "body"), "id")) == [("d", 0, 400)]
    assert rows(store.picked(spans, ["start"], [0, 1], [1])) == [("d", 0, 400, 0)]
    shown = spark.createDataFrame([(1, "s", 1), (1, "t", 0), (2, "s", 0)], "chunk_id int, asset_id string, ord int")
    of = spark.createDataFrame([(1, "d", 1), (2, "d", 0)], "chunk_id int, doc_id string, seq int")
    assert rows(store.page_assets(shown, of, spark.createDataFrame([("s",), ("t",)], "asset_id string"))) == [("d", "s", 0), ("d", "t", 1)]
    pid = spark.createDataFrame([("c", "T"), (None, None)], "c string, t string").select(store.page_id(F.col("c"), F.col("t"))).collect()
    assert pid[0][0].startswith("K-") and len(pid[0][0]) == 14 and pid[1][0] is None
    assert spark.createDataFrame([("检索x",)], "t string").select(store.spaced_runs(F.col("t"), list)).first()[0] == " 检 索 x"
    assert spark.createDataFrame([('{"kind":"image","width":3}',), ("no",)], "j string").select(store.media_meta(F.col("j"))["width"]).collect()[0][0] == 3


def test_sql_functions(spark):
    names = sql.register(spark)
    assert "path_key" in names
    r = spark.sql("SELECT path_key('A\\\\Straße') AS p, page_slug('Über Größe') AS s, page_slug('知') AS u, vector_cosine(array(1D, 0D), array(1D, 1D)) AS c, text_language('') AS l").first()
    assert (r["p"], r["s"], r["u"], round(r["c"], 6), r["l"]) == ("a/strasse", "ber-gre", "untitled", 0.707107, "other")
    assert spark.sql("SELECT kind, target, line FROM parse_links('x [[A#b]]\\n[t](u.md)')").collect() == [("wikilink", "A", 1), ("markdown", "u.md", 2)]
