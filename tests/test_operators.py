import hashlib

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import pages
from scriptoria.operators import evals, ordering, search, base, chunking, fixes, graph, lint, parsing, retrieval, stats, tape


def test_links_in_source_order():
    body = "see [[Page One|alias]] and [[Two#part]]\n![img](a.png) [t](notes/x.md \"T\") [m](mailto:a@b.c) [w](https://e.org/a#b)\nhttps://plain.org/x"
    got = [(k, t, a, n) for _, k, t, a, n in parsing.find_links(body)]
    assert got == [("wikilink", "Page One", None, 1), ("wikilink", "Two", "part", 1), ("markdown", "notes/x.md", None, 2), ("url", "https://e.org/a", "b", 2), ("url", "https://plain.org/x", None, 3)]


def test_images_and_front_matter():
    assert parsing.find_images('x ![a](b\\c.png "t") ![[d.jpg|e]]') == [(2, 19, "a", "b/c.png"), (20, 32, "e", "d.jpg")]
    fields, body, error = parsing.front_matter("---\ntitle: 'A b'\ntags: [x, y]\nsources:\n - s1\n - s2\n---\n# H\n")
    assert fields == {"title": "A b", "tags": ["x", "y"], "sources": ["s1", "s2"]} and body == "# H\n" and error is None
    assert parsing.front_matter("no block") == ({}, "no block", None)
    assert parsing.front_matter("---\n{bad\n---\nx")[2]


def test_page_blocks_and_verdicts():
    text = '<page category="concept" slug="a">\n---\ntags: [t]\n---\n# One\nbody\n</page>\n<page category="nope">\n# Two\n</page>\n<page category="concept">cut'
    found, error = parsing.page_blocks(text, {"concept"}, "inbox")
    assert [(p["category"], p["title"], p["tags"]) for p in found] == [("concept", "One", ["t"]), ("inbox", "Two", [])] and error == "truncated"
    assert parsing.verdict('```json\n{"verdict": "YES"}\n```') == "yes" and parsing.verdict("x") is None and parsing.verdict('{"verdict": "maybe"}') is None


def test_chunker_golden():
    body = "# A\n\n" + "one two three.\n\n" * 3 + "# B\n\nlast words here\n"
    spans = list(chunking.pack(chunking.paragraphs(body), 8, 0.15))
    assert [body[a:b] for a, b in spans] == ["# A\n\none two three.\n\none two three.".replace("\n\none two three.\n\none", "\n\none two three.\n\none")[: len("# A\n\none two three.\n\none two three.")], "one two three.\n\none two three.", "one two three.\n\n# B\n\nlast words here"]
    whole = chunking.sections(body, spans)
    assert whole[0][0] == spans[0][0] and whole[-1][1] == spans[-1][1]
    assert list(chunking.pack(chunking.paragraphs(""), 8, 0.15)) == []


def test_chunk_frames(spark, rows):
    df = spark.createDataFrame([("a", "# X\n\npara"), ("b", None), ("c", " \n\n "), ("d", "")], "id string, body string")
    assert rows(chunking.chunk(df, "id", "body")) == [("a", 0, 0, 9, 3)]
    refs = spark.createDataFrame([("a", 5, 7, "r")], "id string, start int, end int, ref string")
    assert rows(chunking.refs_in_chunks(refs, chunking.chunk(df, "id", "body"), "id")) == [("a", "r", 0, 5, 7, 0)]


def test_title_resolution(spark):
    pages_df = spark.createDataFrame([("Cats", "p1"), ("Cats", "p2"), ("Cat", "p3"), ("C++", "p4"), ("Node.js,", "p5"), (None, "p6")], "title string, path string")
    asked = spark.createDataFrame([("Cats",), ("C++",), ("c++s",), ("node.js",), ("nothing",), ("class",)], "title string")
    loose = {r[0]: (r[1], r[2]) for r in graph.resolve_titles(asked, pages_df).collect()}
    assert loose["Cats"] == ("p3", "fuzzy") and loose["C++"] == ("p4", "exact") and loose["node.js"] == ("p5", "fuzzy") and loose["nothing"] == (None, None)
    strict = {r[0]: r[1] for r in graph.resolve_titles(asked, pages_df, strict=True).collect()}
    assert strict["Cats"] is None and strict["C++"] == "p4"


def test_lookup_stems_plurals_on_one_side_only(spark):
    words = ["networks", "class", "as", "gas", "uses", "Big Networks"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(graph.lookup_title(F.col("w"))).collect()] == ["network", "class", "as", "gas", "use", "big network"]


def test_fusion_ties_and_single_elements(spark):
    a = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 5.0, 2)], "query_id int, chunk_id int, score double, rank int")
    b = spark.createDataFrame([(1, 12, 0.9, 1)], "query_id int, chunk_id int, score double, rank int")
    legs = retrieval.legs(a=(a, 1.0), b=(b, 0.0))
    assert [r["chunk_id"] for r in retrieval.rrf(legs).orderBy("rank").collect()] == [10, 11, 12]
    assert {r["chunk_id"]: r["score"] for r in retrieval.comb(legs, mnz=True).collect()} == {10: 1.0, 11: 1.0, 12: 0.0}
    docs = spark.createDataFrame([(10, "d"), (11, "d")], "chunk_id int, doc_id string")
    flat = retrieval.diversify(retrieval.rrf(legs), docs, alpha=0.0)
    assert [r["chunk_id"] for r in flat.orderBy("rank").collect()] == [10, 11, 12]


def test_rerank_keeps_membership_and_survives_failure(spark):
    fused = spark.createDataFrame([(1, c, 1.0 / c, c) for c in range(1, 6)], "query_id int, chunk_id int, score double, rank int")
    texts = spark.createDataFrame([(c, "x" * c) for c in range(1, 6)], "chunk_id int, text string")
    q = spark.createDataFrame([(1, "q")], "query_id int, q string")
    got = [r["chunk_id"] for r in retrieval.rerank(fused, texts, q, lambda q, t: [len(x) for x in t], 3).orderBy("rank").collect()]
    assert got == [5, 4, 3]

    def fail(q, t):
        raise TimeoutError

    assert [r["chunk_id"] for r in retrieval.rerank(fused, texts, q, fail, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, key string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("m", "a")], "query_id string, key string")
    got = {r["query_id"]: r for r in retrieval.rank_metrics(ranked, rel).collect()}
    assert got["q"]["rr"] == 0.5 and got["q"]["recall"] == 0.5 and got["m"]["hit"] == 0 and got["m"]["ndcg"] == 0
    assert got["q"]["ndcg"] == pytest.approx(0.63093 / 1.63093, abs=1e-4)


def test_storage_semantics(spark, rows):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert rows(base.upsert(old, new, ["k"])) == [("a", 1), ("b", 2), ("c", 2)]
    assert rows(base.insert_if_absent(old, new, ["k"])) == [("c", 2)]
    left = base.cascade_delete(spark.createDataFrame([("a",)], "doc string"), "doc", t=(old, "k"))
    assert rows(left["t"]) == [("b", 1)]
    cursor = base.encode_cursor("2024-01-01", "x")
    assert base.decode_cursor(cursor) == ("2024-01-01", "x")
    v = spark.createDataFrame([(1, "m", "text", True), (2, "m", "image", True)], "version_id int, model string, modality string, is_active boolean")
    v = base.register_version(v, {"model": "n", "modality": "text"}, 0)
    assert sorted((r["version_id"], r["is_active"]) for r in v.collect()) == [(1, False), (2, True), (3, True)]
    v = base.register_version(v, {"model": "m", "modality": "text"}, 0)
    assert sorted((r["version_id"], r["is_active"]) for r in v.collect()) == [(1, True), (2, True), (3, False)]


def test_tape_drops_what_follows_the_final_event(spark):
    ev = [(1, "t", 0, '{"type": "progress"}'), (2, "t", 1, '{"type": "final"}'), (3, "t", 2, '{"type": "log"}'), (3, "t", 2, '{"type": "log"}'), (4, None, 0, "x"), (5, "u", 0, "cut {"), (6, "u", 1, None)]
    got = tape.admitted(spark.createDataFrame(ev, "event_id long, task_id string, seq int, body string"))
    assert sorted((r["event_id"], r["new_seq"]) for r in got.collect()) == [(1, 0), (2, 1), (5, 0), (6, 1)]


def test_stats(spark):
    import math

    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", x) for x in (2.0, 4.0, 6.0, 9.0)], "g string, x double")
    w = stats.welch(df, "g", "x", "a").first()
    # means 2.5 and 5.25, variances 5/3 and 26.75/3, four values each
    assert w["t"] == pytest.approx(2.75 / math.sqrt((5 / 3 + 26.75 / 3) / 4)) and 0.1 < w["p"] < 0.3
    assert stats._beta_fraction(0.5, 0.5, 0.5) == pytest.approx(0.5) and stats._beta_fraction(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-4)
    assert math.isclose(stats._beta_fraction(10, 0.5, 0.9), 1 - stats._beta_fraction(0.5, 10, 0.1), rel_tol=1e-9)
    b = stats.bootstrap(df, "x", 200).first()
    assert b["low"] < b["mean"] < b["high"]
    base_df, seen = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "metric string, value double"), spark.createDataFrame([("a", 0.5), ("c", 1.0)], "metric string, value double")
    assert {r["metric"]: r["verdict"] for r in stats.against_baseline(base_df, seen, 0.1).collect()} == {"a": "regressed", "b": "missing", "c": "extra"}


def test_sweep(spark):
    legs = spark.createDataFrame([(1, 10, 1, "bm25"), (1, 11, 1, "vector"), (1, 10, 2, "vector")], "query_id int, chunk_id int, rank int, leg string")
    rel = spark.createDataFrame([(1, 11)], "query_id int, chunk_id int")
    grid = spark.createDataFrame([(60, 1.0, 0.1), (60, 0.0, 1.0)], "rrf_k int, w_bm25 double, w_vector double")
    got = {r["w_bm25"]: r["ndcg"] for r in stats.sweep(legs, rel, grid).collect()}
    assert got[0.0] == 1.0 and got[1.0] < 1.0


def test_lint_rules(spark, rows):
    pages_df = spark.createDataFrame([("p1", "T", "# T\ntext", []), ("p2", "T", "no heading", ["a/x", "b/y"]), ("k/untitled.md", "…", "# …\n", None)], "path string, title string, body string, tags array<string>")
    assert rows(lint.duplicate_titles(pages_df)) == [("duplicate_title", "p2", "p1")]
    assert rows(lint.non_atomic(pages_df)) == [("non_atomic_page", "p2", "n_domains")]
    assert rows(lint.title_quality(pages_df)) == [("title_slug_quality", "k/untitled.md", "punctuation_only,untitled_slug"), ("title_slug_quality", "p2", "no_heading")]
    docs = spark.createDataFrame([("k1", "p1", "h", True), ("k2", "p2", "h", True), ("k3", "p3", "h", False)], "path_key string, path string, body_hash string, active boolean")
    files = spark.createDataFrame([("k1", "p1", "other"), ("k3", "p3", "h")], "path_key string, path string, body_hash string")
    assert rows(lint.missing_files(docs, files)) == [("missing_file", "p2", "")]
    assert rows(lint.stale_index(docs, files)) == [("stale_index", "p1", "other")]
    assert rows(lint.untracked_files(docs, files)) == [("untracked_file", "p3", "")]
    skips = spark.createDataFrame([("p1", "stale_index"), ("p2", "missing_file")], "path string, kind string")
    assert rows(lint.run([lint.missing_files(docs, files), lint.stale_index(docs, files)], skips)) == [("missing_file", "p2", "")]
    a = spark.createDataFrame([("p", "k", "K"), ("p", "l", "l")], "path string, source_key string, source_path string")
    b = spark.createDataFrame([("p", "k", "k"), ("p", "m", "m")], "path string, source_key string, source_path string")
    assert [r[2] for r in rows(lint.missing_provenance(a, b))] == ["K", "l", "m"]


def test_fuzzy_targets_and_apply(spark):
    lost = spark.createDataFrame([("x/network-planing.md",), ("x/zzz.md",)], "target string")
    known = spark.createDataFrame([("x/network-planning.md",), ("x/other-thing.md",)], "path string")
    assert [tuple(r)[:2] for r in fixes.fuzzy_targets(lost, known).collect()] == [("x/network-planing.md", "x/network-planning.md")]
    h = hashlib.sha256(b"see [[Old]] and [[Old#x]]").hexdigest()
    state, report = fixes.apply_operations(
        {"a": "see [[Old]] and [[Old#x]]", "b": "z"},
        [{"op": "rewrite_link", "path": "a", "old": "Old", "new": "New", "expects": h, "proposal": 1}, {"op": "delete", "path": "a", "expects": h, "proposal": 2}, {"op": "delete", "path": "b", "proposal": 2}],
    )
    assert state == {"a": "see [[New]] and [[New#x]]", "b": "z"} and [r["reason"] for r in report] == [None, "changed since", "proposal aborted"]


def test_fuzzy_targets_against_brute_force(spark):
    import difflib
    import random

    rng = random.Random(4)
    stems = ["abcdefghij", "abcde", "aaaaaa", "plan", "abc", "知识图谱"] + ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 14))) for _ in range(60)]
    wrong = ["abcxdefyghzij", "abxcde", "aaaaaa", "plan", "abc", "知识图谱"] + [x[:i] + rng.choice("abcdez") + x[i + rng.randrange(2) :] for x in stems[6:] for i in [rng.randrange(len(x))]]
    got = {r["target"]: (r["path"], r["ratio"]) for r in fixes.fuzzy_targets(spark.createDataFrame([(f"x/{w}.md",) for w in sorted(set(wrong))], "target string"), spark.createDataFrame([(f"y/{x}.md",) for x in stems], "path string")).collect()}
    want = {}
    for w in wrong:
        ratio, path = min((-round(difflib.SequenceMatcher(None, w, x, autojunk=False).ratio(), 6), f"y/{x}.md") for x in stems)
        if -ratio >= 0.85 and len(w) >= 4:
            want[f"x/{w}.md"] = (path, -ratio)
    assert got == want and {"x/abcxdefyghzij.md", "x/abxcde.md", "x/aaaaaa.md", "x/plan.md"} <= set(got)


def test_page_expressions(spark):
    df = spark.createDataFrame([("知识 图谱 abc",), ("plain english words",), ("123 !?",), ("",)], "t string")
    assert [r[0] for r in df.select(pages.language(F.col("t"))).collect()] == ["cjk", "en", "other", "other"]
    body = "# H\n```\ncode is not a claim here.\n```\nOne real claim here. [[Only Link]]\n\n短。知识图谱很好。"
    got = spark.createDataFrame([(body,)], "b string").select(pages.claims(F.col("b"))).first()[0]
    assert got == ["One real claim here.", "知识图谱很好。"]
    assert spark.createDataFrame([("Über die Größe!",), ("知识",)], "t string").select(pages.slug(F.col("t"))).collect()[1][0] == "untitled"


def test_bm25_and_knn_blocks_against_brute_force(spark, monkeypatch):
    import math
    import random

    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(30)] + ["字", "über"]
    texts = {i: " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 25))) for i in range(300)}
    chunks = spark.createDataFrame([(i, t, i % 3 > 0) for i, t in texts.items()] + [(900, None, True), (901, "", True)], "chunk_id long, text string, live boolean")
    asked = {i: [rng.choice(vocab) for _ in range(4)] for i in range(40)}
    queries = spark.createDataFrame([(i, " ".join(w) + " AND") for i, w in asked.items()] + [(90, ""), (91, None), (92, "absent")], "query_id long, q string")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 5)) for r in retrieval.bm25(queries, chunks, 5).collect()}
    n, avg = 301, sum(len(t.split()) for t in texts.values()) / 301
    df = {w: sum(w in t.split() for t in texts.values()) for w in vocab}
    want = {}
    for q, words in asked.items():
        scores = []
        for c, t in texts.items():
            tf, dl = t.split(), len(t.split())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf.count(w) * 2.2 / (tf.count(w) + 1.2 * (0.25 + 0.75 * dl / avg)) for w in set(words))
            if s > 0 and c % 3 > 0:
                scores.append((-round(s, 6), c))
        want |= {(q, i + 1): (c, round(-s, 5)) for i, (s, c) in enumerate(sorted(scores)[:5])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert retrieval.bm25(queries.limit(0), chunks, 5).count() == 0 and retrieval.bm25(queries, chunks.limit(0), 5).count() == 0
    # One chunk with many vectors takes one place, however many of them are near.
    v = lambda a: [math.cos(a), math.sin(a)]
    vec = spark.createDataFrame([(1, v(0.001 * i)) for i in range(200)] + [(2, v(0.5)), (3, v(0.6)), (4, [0.0, 0.0]), (5, None)], "chunk_id long, vec array<double>")
    near = retrieval.knn(spark.createDataFrame([(i, v(0.0)) for i in range(9)], "query_id long, vec array<double>"), vec, 3, dim=2)
    assert sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in near.collect()) == [(i, k, k) for i in range(9) for k in (1, 2, 3)]


def test_bootstrap_of_equal_rows(spark):
    """Two thousand rows of 0 and 1: equal rows weigh on their own."""
    b = stats.bootstrap(spark.range(2000).selectExpr("cast(id % 2 as double) AS x", "'same' AS k"), "x").first()
    assert b["mean"] == 0.5 and 0.47 < b["low"] < 0.49 and 0.51 < b["high"] < 0.53
    assert stats.bootstrap(spark.range(0).selectExpr("cast(id as double) AS x"), "x").first()["low"] is None


def test_orphan_scores_by_all_terms(spark, monkeypatch):
    import random

    rng = random.Random(6)
    tags, words = ["a/x", "a/y", "b/x", "c", "a"], ["red", "Cat!", "Über", "two", "ＴＷＯ"]
    pages = [(f"p{i:02}", " ".join(rng.sample(words, rng.randrange(4))) or None, rng.sample(tags, rng.randrange(4)) + [None, ""], rng.choice([None, ["s1"], ["s1", "s2", " "], ["s3"]])) for i in range(40)]
    vecs = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in rng.sample(range(40), 25)}
    df = spark.createDataFrame(pages, "id string, title string, tags array<string>, sources array<string>")
    vec = spark.createDataFrame([(f"p{i:02}", v) for i, v in vecs.items()] + [("p00", [1.0, 0.0, 0.0, 0.0])], "id string, vec array<float>")
    monkeypatch.setattr(fixes, "ORPHAN_BLOCK", 5)
    got = {(r["orphan"], r["rank"]): (r["other"], r["score"]) for r in fixes.orphan_candidates(fixes.signals(df, vec), df.where("id < 'p12'").select("id"), 2).collect()}
    import unicodedata

    import numpy as np

    norm = lambda t: {w.strip("!") for w in unicodedata.normalize("NFKC", t or "").casefold().split()}
    held = {f"p{i:02}": [np.array(v, dtype=np.float32).astype(float)] for i, v in vecs.items()}
    held.setdefault("p00", []).append(np.array([1.0, 0, 0, 0]))
    want = {}
    for a in pages[:12]:
        scored = []
        for b in pages:
            if a[0] == b[0]:
                continue
            ta, tb = {t for t in a[2] if t}, {t for t in b[2] if t}
            da, db = {t.split("/")[0] for t in ta if "/" in t}, {t.split("/")[0] for t in tb if "/" in t}
            wa, wb = norm(a[1]), norm(b[1])
            cos = max((x @ y / np.linalg.norm(x) / np.linalg.norm(y) for x in held.get(a[0], []) for y in held.get(b[0], [])), default=0)
            s = 3 * len({x for x in a[3] or () if x.strip()} & {x for x in b[3] or () if x.strip()}) + len(ta & tb) + 0.5 * len((da & db) - {t.split("/")[0] for t in ta & tb})
            s += (2 * len(wa & wb) / len(wa | wb) if wa and wb else 0) + 3 * min(1, max(0, cos))
            if round(s, 6) > 0:
                scored.append((-round(s, 6), b[0]))
        want |= {(a[0], i + 1): (o, -s) for i, (s, o) in enumerate(sorted(scored)[:2])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_near_links_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 8))
    x[40:60] = x[0] + 0.05 * rng.normal(size=(20, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8)], "id long, vec array<double>")
    got = {r["id"]: r["links"] for r in evals.near_links(df, 0.85, dim=8, block=17).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = ((u @ u.T).round(9) >= 0.85).sum(axis=1) - 1
    assert got == {**{i: int(n[i]) for i in range(90)}, 500: 0, 501: 0}
    d = evals.duplicate_ratio(evals.near_links(df, 0.85, dim=8)).first()
    assert d["n_pairs"] == n.sum() / 2 and evals.duplicate_ratio(evals.near_links(df.limit(1), 0.85, dim=8)).first()["ratio"] == 0


def test_numbers_over_ranges(spark):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id * 7 % 2003 AS s", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r["id"]: r["n"] for r in ordering.numbered_within(df, "k", ["s", "id"], "n").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in df.collect():
        by.setdefault(r["k"], []).append((r["s"], r["id"]))
    assert got == {i: n for rows in by.values() for n, (_, i) in enumerate(sorted(rows))}


def test_search_legs_modes_and_assets(spark):
    chunks = spark.createDataFrame([(1, "d1", 0, "red cat"), (2, "d1", 1, "red red dog"), (3, "d2", 0, "blue fish"), (4, "d3", 0, "gone cat"), (5, "d4", 0, "linked page")], "chunk_id long, doc_id string, seq int, text string")
    docs = spark.createDataFrame([("d1", "p1", "T1", "source", True), ("d2", "p2", None, "source", True), ("d3", "p3", "T3", "source", False), ("d4", "p4", "T4", "knowledge", True)], "doc_id string, path string, title string, layer string, active boolean")
    vec = spark.createDataFrame([(1, [1.0] + [0.0] * 63), (3, [0.0, 1.0] + [0.0] * 62), (4, [1.0] + [0.0] * 63)], "chunk_id long, vec array<double>")
    links = spark.createDataFrame([("d1", "p4", "wikilink")] * 2 + [("d1", "p2", "markdown")], "src_doc_id string, dst_path string, link_type string")
    pictures = spark.createDataFrame([("a", [0.0, 1.0] + [0.0] * 62)], "asset_id string, vec array<double>")
    refs = spark.createDataFrame([(3, "a", 0), (5, "a", 0)], "chunk_id long, asset_id string, ord int")
    q = spark.createDataFrame([(9, "red CAT", [0.6, 0.8] + [0.0] * 62), (8, "???", None)], "query_id long, q string, vec array<double>")
    full = search.Base(chunks, docs, vec, links, pictures, refs)
    got = {m: [(r["query_id"], r["chunk_id"]) for r in search.search(q, full, mode=m, graph=True).orderBy("query_id", "rank").collect()] for m in search.MODES}
    assert got["bm25"] == [(9, 1), (9, 2)] and got["vector"] == [(9, 3), (9, 1)]
    assert {c for _, c in got["hybrid"]} == {1, 2, 3, 5} and all(i == 9 for i, _ in got["hybrid"])
    one = search.search(q, full, mode="hybrid", layer="knowledge", graph=True).collect()
    assert [(r["chunk_id"], r["path"], r["assets"]) for r in one] == [(5, "p4", ["a"])]
    pages = search.retrieve(q, full, limit=3)[1].collect()
    assert {r["path"] for r in pages} <= {"p1", "p2", "p4"} and pages
    again = search.search(q, full, rerank=lambda q, texts: [-len(t) for t in texts], limit=2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in again] == [1, 3]
    with pytest.raises(ValueError):
        search.search(q, full, mode="other")


def _counted_base(spark):
    """A base whose chunks and vectors count how often their rows are made."""
    seen = {n: spark.sparkContext.accumulator(0) for n in ("chunks", "vectors")}

    def told(df, n):
        def run(batches, of=seen[n]):
            for b in batches:
                of.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 7}", 0, f"word{i % 5} word{i % 3} and more") for i in range(30)], "chunk_id string, doc_id string, seq int, text string")
    docs = spark.createDataFrame([(f"d{i}", f"p/{i}.md", f"T{i}", "knowledge", True) for i in range(7)], "doc_id string, path string, title string, layer string, active boolean")
    vec = spark.createDataFrame([(f"c{i}", [float(i % 7 + 1)] * 32 + [float(i % 4)] * 32) for i in range(30)], "chunk_id string, vec array<double>")
    links = spark.createDataFrame([("d0", "p/1.md", "wikilink"), ("d2", "p/3.md", "wikilink")], "src_doc_id string, dst_path string, link_type string")
    queries = spark.createDataFrame([(i, f"word{i % 5} more", [1.0] * 32 + [float(i % 4)] * 32) for i in range(20)], "query_id long, q string, vec array<double>")
    return queries, search.Base(told(chunks, "chunks"), docs, told(vec, "vectors"), links), seen


def test_hybrid_search_makes_its_tables_once_for_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    queries, base, seen = _counted_base(spark)
    assert search.search(queries, base, graph=True, limit=3).count() == 60
    assert {n: a.value for n, a in seen.items()} == {"chunks": 30, "vectors": 30}


def test_fuzzy_targets_compares_only_what_can_be_alike(spark, monkeypatch, tmp_path):
    import difflib
    import random

    import numpy as np

    asked = str(tmp_path / "asked")
    whole = difflib.SequenceMatcher

    class Told(whole):
        def ratio(self):
            with open(asked, "a") as f:
                f.write("x\n")
            return super().ratio()

    rng = random.Random(5)
    stems = ["".join(rng.sample("abcdefghijkl", 12)) for _ in range(150)]
    wrong = stems[:10] + [x[:5] + "z" + x[6:] for x in stems[10:20]]
    monkeypatch.setattr(fixes, "TILE", 40)
    monkeypatch.setattr(fixes, "STEM_BLOCK", 6)
    monkeypatch.setattr(difflib, "SequenceMatcher", Told)
    best: dict = {}
    order = sorted(wrong, key=len)
    fixes._closest(order, stems, stems, 0.85 - 1e-6, best)
    want = {i: min((-round(whole(None, a, b, autojunk=False).ratio(), 6), b) for b in stems) for i, a in enumerate(order)}
    assert best == {i: x for i, x in want.items() if -x[0] >= 0.85}
    # All stems hold the same twelve characters, so the bound by characters alone lets every pair pass.
    assert len(open(asked).readlines()) < 150 < len(order) * len(stems)
    some = ["".join(rng.choice("abc知") for _ in range(rng.choice([1, 5, 30, 63, 64, 65, 80]))) for _ in range(60)]
    for x, y, got in zip(some, some[1:], fixes._in_order(some[:-1], some[1:], np.arange(59), np.arange(59))):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for k, d in enumerate(y):
                new.append(row[k] + 1 if c == d else max(row[k + 1], new[k]))
            row = new
        assert got == (row[-1] if len(x) <= 64 else min(len(x), len(y)))
    monkeypatch.setattr(difflib, "SequenceMatcher", whole)
    got = fixes.fuzzy_targets(spark.createDataFrame([(x,) for x in wrong], "target string"), spark.createDataFrame([(x,) for x in stems], "path string"))
    assert {r["target"]: (-r["ratio"], r["path"]) for r in got.collect()} == {order[i]: x for i, x in best.items()}


@pytest.mark.parametrize("how", ["retrieve", "combsum"])
def test_retrieve_and_combsum_make_their_tables_once_for_all_blocks(spark, monkeypatch, how):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    queries, base, seen = _counted_base(spark)
    if how == "retrieve":
        pages = search.retrieve(queries, base, graph=True, limit=3)[1].collect()
        assert sum(len(r["chunk_ids"]) for r in pages) == 60
    else:
        assert search.search(queries, base, graph=True, fusion="combsum", limit=3).count() == 60
    assert {n: a.value for n, a in seen.items()} == {"chunks": 30, "vectors": 30}


def test_words_are_scored_in_small_tiles_and_ranked_exactly(spark):
    """Scores of a tile are held for few queries at once, as float32; what is answered is as exact as in float64."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n_q, n_c, n_w, k = 3000, 2500, 400, 5
    share = np.r_[np.full(20, 0.3), np.full(n_w - 20, 0.004)]
    share[-1] = 1 / n_c
    tf = (rng.random((n_c, n_w)) < share) * rng.integers(1, 3, (n_c, n_w))
    dl = np.maximum(1, tf.sum(axis=1)) + rng.integers(0, 2, n_c)
    tf[:, -1] = np.arange(n_c) == 7
    asks = rng.random((n_q, n_w)) < np.r_[np.full(20, 0.25), np.full(n_w - 20, 0.005)]
    asks[0], asks[1] = False, np.arange(n_w) == n_w - 1
    lists = lambda of: pa.array([x[y > 0].tolist() for x, y in zip(of, tf)], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{i}" for i in range(n_c)]), pa.array(dl, pa.int32()), lists(np.tile(np.arange(n_w), (n_c, 1))), lists(tf)], ["chunk_id", "dl", "terms", "tf"])
    q, term = np.nonzero(asks)
    words, df = pa.array([f"w{i}" for i in range(n_w)]), (tf > 0).sum(axis=0).astype(float)
    counted = SimpleNamespace(sparkSession=spark, mapInArrow=lambda f, kind: f)
    counted.where = counted.select = lambda *_: counted
    score = retrieval._bm25_block(counted, pa.table({"query_id": q, "term": words.take(pa.array(term))}), words, df, n_c, dl.mean(), k, "")
    tracemalloc.start()
    got = [(r["query_id"], r["chunk_id"], r["score"]) for b in score([batch]) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    weight = np.log(1 + (n_c - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[:, None] / dl.mean()))
    want, names = [], np.array([f"c{i}" for i in range(n_c)])
    for i, row in enumerate(np.round(asks.astype(float) @ weight.T, 6)):
        some = np.flatnonzero(row >= 1e-6)
        want += [(i, names[j], row[j]) for j in some[np.lexsort((names[some], -row[some]))[:k]]]
    assert sorted(x[:2] for x in got) == sorted(x[:2] for x in want) and [x for x in got if x[0] < 2][0][:2] == (1, "c7")
    assert max(abs(a[2] - b[2]) for a, b in zip(sorted(got), sorted(want))) < 1e-9
    assert most < 40e6


def test_best_sorts_as_by_three_keys():
    import numpy as np

    rng = np.random.default_rng(5)
    for wide in (1, 1e12):
        q, number, score = rng.integers(0, 50, 3000), rng.integers(0, 90, 3000), np.round(rng.choice([-1.5, 0, 0.25, 7.123456], 3000) * wide, 6)
        for by_score, keys in ((True, (number, -score, q)), (False, (-score, number, q))):
            order = np.lexsort(keys)
            assert all((a == b[order]).all() for a, b in zip(retrieval._sorted(q, number, score, by_score), (q, number, score)))
