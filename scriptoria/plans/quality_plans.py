"""Figures, lookups, page folds and repair over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import text
from scriptoria.operators import base, evals, fixes, graph, lint, retrieval
from scriptoria.plans import base_plans as bp
from scriptoria.plans import retrieval_plans as rp
from scriptoria.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_VEC = """vec AS (SELECT DISTINCT vec_id, owner_kind, chunk_id, CAST(embedding AS DOUBLE[64]) AS e FROM vec_index
  WHERE version_id = 2 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
# Punctuation at the ends of a title's words.
_MARKS = r"""[.,!?;:"''()\[\]{}<>。、《》〈〉「」『』【】“”‘’]+"""
_WIDE = "nfc_normalize(array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) BETWEEN 65281 AND 65374 THEN chr(ord(c) - 65248) WHEN ord(c) IN (160, 8199, 8239, 12288) OR ord(c) BETWEEN 8192 AND 8202 THEN ' ' ELSE c END), ''))"
# Full case folding and the compatibility forms that titles hold.
_FOLDED = f"replace(replace(replace(replace(replace(replace(lower({_WIDE}), 'ß', 'ss'), 'ς', 'σ'), 'ⅲ', 'iii'), 'ⅱ', 'ii'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
_WORDS = rf"list_filter(list_transform(regexp_split_to_array({_FOLDED}, '\s+'), lambda w: regexp_replace(w, '^{_MARKS}|{_MARKS}$', '', 'g')), lambda w: w <> '')"
_TITLE = f"array_to_string({_WORDS}, ' ')"


# --- claims against chunks -------------------------------------------------------------------------------------

def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vec_index").where("version_id = 2").select("vec_id", "owner_kind", "chunk_id", F.col("embedding").alias("vec")).dropDuplicates(["vec_id"])


def _source_chunks(s: SparkSession, d: str) -> DataFrame:
    """(source_path, seq, chunk_id) of chunks with text."""
    docs = table(s, d, "doc_records").where("layer = 'source'").select("doc_id", F.col("path").alias("source_path")).distinct()
    rows = table(s, d, "embed_queue").where(text.has_ink(F.col("text"))).select("chunk_id", "doc_id", "seq").distinct()
    return rows.join(docs, "doc_id").select("source_path", "seq", "chunk_id")


def _argmax(s: SparkSession, d: str) -> DataFrame:
    vec = _vectors(s, d)
    claims = table(s, d, "grounding_claims").select("claim_id", "page_path", "source_path", "vec_id").distinct().join(vec.select("vec_id", "vec"), "vec_id", "left")
    chunks = _source_chunks(s, d).join(vec.where("owner_kind = 'chunk'").select("chunk_id", "vec"), "chunk_id")
    return evals.claim_argmax(claims, chunks)


_ARGMAX = f"""{_VEC}, sc AS (SELECT DISTINCT d.path AS source_path, e.seq, e.chunk_id FROM embed_queue e JOIN (SELECT DISTINCT doc_id, path FROM doc_records WHERE layer = 'source') d USING (doc_id) WHERE regexp_matches(e.text, '[^\\s\\p{{Z}}]')),
cl AS (SELECT DISTINCT claim_id, page_path, source_path, vec_id FROM grounding_claims),
cc AS (SELECT claim_id, sc.seq, round(array_cosine_similarity(q.e, v.e), 6) AS cos FROM cl JOIN vec q USING (vec_id) JOIN sc USING (source_path) JOIN vec v ON v.chunk_id = sc.chunk_id AND v.owner_kind = 'chunk'),
am AS (SELECT cl.claim_id, page_path, source_path, cos AS max_cosine, seq AS best_chunk_seq FROM cl LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY cos DESC, seq) AS n FROM cc) x ON x.claim_id = cl.claim_id AND n = 1)"""


@query(f"WITH {_ARGMAX} SELECT * FROM am")
def join18_claim_argmax(s, d):
    return _argmax(s, d)


@query(f"""WITH {_ARGMAX}, g AS (SELECT page_path AS path, avg(CASE WHEN max_cosine >= 0.5 THEN 1.0 ELSE 0 END) AS r FROM am GROUP BY 1)
SELECT count(*) AS n_pages, round(avg(coalesce(r, 1.0)), 6) AS grounding FROM (SELECT DISTINCT path FROM knowledge_pages) LEFT JOIN g USING (path)""")
def agg18_grounding(s, d):
    pages = evals.grounding(table(s, d, "knowledge_pages"), _argmax(s, d), 0.5)
    return pages.agg(F.count("*").alias("n_pages"), F.round(F.avg("ratio"), 6).alias("grounding"))


@query(f"""WITH {_ARGMAX}, h AS (SELECT DISTINCT source_path, best_chunk_seq AS seq FROM am WHERE max_cosine >= 0.5), a AS (SELECT DISTINCT source_path, seq FROM sc)
SELECT (SELECT count(*) FROM a JOIN h USING (source_path, seq)) AS n_covered, count(*) AS n_chunks, round((SELECT count(*) FROM a JOIN h USING (source_path, seq)) / count(*), 6) AS coverage FROM a""")
def agg19_coverage(s, d):
    return evals.coverage(_source_chunks(s, d), _argmax(s, d), 0.5)


@query(f"""WITH {_ARGMAX} SELECT claim_id, am.source_path, best_chunk_seq, t.text AS evidence FROM am LEFT JOIN
(SELECT source_path, seq, min(text) AS text FROM sc JOIN (SELECT DISTINCT chunk_id, text FROM embed_queue) USING (chunk_id) GROUP BY ALL) t ON t.source_path = am.source_path AND t.seq = best_chunk_seq""")
def join22_evidence(s, d):
    """The text each claim rests on; null where nothing was comparable."""
    texts = table(s, d, "embed_queue").select("chunk_id", "text").distinct()
    of = _source_chunks(s, d).join(texts, "chunk_id").groupBy("source_path", F.col("seq").alias("best_chunk_seq")).agg(F.min("text").alias("evidence"))
    return _argmax(s, d).select("claim_id", "source_path", "best_chunk_seq").join(of, ["source_path", "best_chunk_seq"], "left").select("claim_id", "source_path", "best_chunk_seq", "evidence")


# --- pages against pages ---------------------------------------------------------------------------------------

def _page_vectors(s, d):
    """The hashed bag of words of every body, as a dense vector."""
    e = retrieval.hashed_embedding(table(s, d, "knowledge_pages").select("id", "body").distinct(), "id", "body")
    held = e.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return held.select(F.col("key").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


_PAGEVEC = """w AS (SELECT id, lower(unnest(regexp_extract_all(body, '[A-Za-z]+'))) AS w FROM (SELECT DISTINCT id, body FROM knowledge_pages)),
b AS (SELECT id, CAST(('0x' || substr(sha1(w), 1, 8)) AS BIGINT) % 64 AS k, count(*) AS n FROM w GROUP BY ALL),
pv AS (SELECT id, CAST(list_transform(range(64), lambda i: coalesce(map_from_entries(list((k, CAST(n AS DOUBLE))))[i], 0.0)) AS DOUBLE[64]) AS e FROM b GROUP BY id),
pp AS (SELECT x.id AS a, y.id AS b FROM pv x JOIN pv y ON x.id < y.id AND round(array_cosine_similarity(x.e, y.e), 9) >= 0.85)"""


@query(f"WITH {_PAGEVEC} SELECT pv.id, count(u.id) AS links FROM pv LEFT JOIN (SELECT a AS id FROM pp UNION ALL SELECT b FROM pp) u USING (id) GROUP BY pv.id")
def join19_near_pages(s, d):
    """Per page with words: how many other pages have a body of cosine 0.85 or more."""
    return evals.near_links(_page_vectors(s, d), 0.85)


@query(f"WITH {_PAGEVEC} SELECT count(*) AS n_pages, (SELECT count(*) FROM pp) AS n_pairs, round((SELECT count(*) FROM pp) / (count(*) * (count(*) - 1) / 2), 9) AS ratio FROM pv")
def agg20_duplicate_ratio(s, d):
    return evals.duplicate_ratio(evals.near_links(_page_vectors(s, d), 0.85))


@query(rf"""WITH {bp._PROV}, src AS (SELECT path_key AS k, min(body) AS body FROM doc_records WHERE active AND layer = 'source' GROUP BY 1),
x AS (SELECT p.body AS a, src.body AS b FROM prov JOIN (SELECT DISTINCT id, body FROM knowledge_pages) p USING (id) JOIN src ON k = source_key WHERE p.body IS NOT NULL AND src.body IS NOT NULL),
c AS (SELECT len(regexp_extract_all(substr(a, 1, 200), '{bp.CJK}')) AS ac, len(regexp_extract_all(substr(a, 1, 200), '[A-Za-z]')) AS al, len(regexp_extract_all(substr(b, 1, 200), '{bp.CJK}')) AS bc, len(regexp_extract_all(substr(b, 1, 200), '[A-Za-z]')) AS bl FROM x)
SELECT count(*) AS n, round(avg(CASE WHEN (CASE WHEN ac + al = 0 THEN 'o' WHEN ac / (ac + al) > 0.3 THEN 'c' ELSE 'e' END) = (CASE WHEN bc + bl = 0 THEN 'o' WHEN bc / (bc + bl) > 0.3 THEN 'c' ELSE 'e' END) THEN 1.0 ELSE 0 END), 6) AS fidelity FROM c""")
def agg23_language_fidelity(s, d):
    pages = bp._pages(s, d)
    src = table(s, d, "doc_records").where("active AND layer = 'source'").groupBy(F.col("path_key").alias("source_key")).agg(F.min("body").alias("source_text"))
    pairs = graph.provenance(pages, table(s, d, "doc_records")).join(src, "source_key").join(pages.select("id", F.col("body").alias("page_text")).distinct(), "id")
    return evals.language_fidelity(pairs)


@query(f"""WITH a AS (SELECT DISTINCT title, {_TITLE.replace('{0}', 'title')} AS k FROM doc_records WHERE layer = 'wisdom' AND title IS NOT NULL), b AS (SELECT DISTINCT {_TITLE.replace('{0}', 'title')} AS k FROM knowledge_pages WHERE title IS NOT NULL)
SELECT count(*) AS n_expected, coalesce(round(avg(CASE WHEN k IN (SELECT k FROM b) THEN 1.0 ELSE 0 END), 6), 1.0) AS coverage FROM a""")
def agg24_expected_coverage(s, d):
    """Titles of the wisdom layer that are titles of knowledge pages."""
    return evals.expected_coverage(table(s, d, "doc_records").where("layer = 'wisdom'"), table(s, d, "knowledge_pages"))


@query(f"""WITH {bp._RES}, w AS (SELECT * FROM r WHERE link_type = 'wikilink'), p AS (SELECT DISTINCT id, title FROM knowledge_pages),
sl AS (SELECT id, CASE WHEN x = '' THEN 'untitled' ELSE x END AS slug FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM p WHERE title IS NOT NULL))
SELECT (SELECT coalesce(round(count(dst_doc_id) / nullif(count(*), 0), 6), 1.0) FROM w) AS links_resolved,
 (SELECT coalesce(round((SELECT count(*) FROM p) / nullif(count(DISTINCT doc_id), 0), 6), 0.0) FROM doc_records WHERE active AND layer = 'source') AS page_density,
 (SELECT coalesce(round((count(*) - count(DISTINCT slug)) / nullif(count(*), 0), 6), 0.0) FROM sl) AS slug_merges""")
def agg25_ratios(s, d):
    from scriptoria.functions import pages as rules

    links = bp._resolved(s, d).where("link_type = 'wikilink'").agg(evals.share(F.count("dst_doc_id"), F.count("*"), 1.0).alias("links_resolved"))
    pages = table(s, d, "knowledge_pages").select("id", "title").distinct()
    n = pages.agg(F.count("*").alias("n"))
    sources = table(s, d, "doc_records").where("active AND layer = 'source'").agg(F.count_distinct("doc_id").alias("m"))
    slugs = pages.where("title IS NOT NULL").select(rules.slug(F.col("title")).alias("slug")).agg(evals.share(F.count("*") - F.count_distinct("slug"), F.count("*"), 0.0).alias("slug_merges"))
    one = links.join(F.broadcast(n)).join(F.broadcast(sources)).join(F.broadcast(slugs))
    return one.select("links_resolved", evals.share(F.col("n"), F.col("m"), 0.0).alias("page_density"), "slug_merges")


@query(rp._q(""", dd AS (SELECT query_id, doc_id, round(min(1 - score), 6) AS distance FROM vectors JOIN (SELECT DISTINCT chunk_id, doc_id FROM chunks) USING (chunk_id) WHERE rank <= 40 GROUP BY ALL),
rd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM dd) SELECT query_id, doc_id, distance, rank FROM rd WHERE rank <= 5"""))
def agg28_best_documents(s, d):
    return evals.best_document(rp._vectors(s, d), rp._chunks(s, d).select("chunk_id", "doc_id").distinct(), 5)


@query(f"""WITH {bp._RES} SELECT dst_path, n_pages FROM (SELECT dst_path, count(DISTINCT src_doc_id) AS n_pages FROM r WHERE link_type = 'wikilink' AND dst_doc_id IS NULL AND trim(dst_path) <> '' GROUP BY 1) ORDER BY n_pages DESC, dst_path LIMIT 5""")
def agg29_priority_targets(s, d):
    """The five unresolved targets that most pages ask for."""
    lost = bp._resolved(s, d).where("link_type = 'wikilink' AND dst_doc_id IS NULL AND trim(dst_path) <> ''")
    return lost.groupBy("dst_path").agg(F.count_distinct("src_doc_id").alias("n_pages")).orderBy(F.desc("n_pages"), "dst_path").limit(5)


_DIG = "SELECT count(*) AS n, sha256(concat_ws('-', count(*), bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)), bit_xor(CAST('0x' || substr(h, 16, 15) AS BIGINT)), bit_xor(CAST('0x' || substr(h, 31, 15) AS BIGINT)), bit_xor(CAST('0x' || substr(h, 46, 15) AS BIGINT)))) AS digest FROM"


@query(f"{_DIG} (SELECT sha256(concat_ws(chr(31), doc_id, path, coalesce(title, chr(0)), layer, CAST(active AS VARCHAR), body_hash)) AS h FROM (SELECT DISTINCT doc_id, path, title, layer, active, body_hash FROM doc_records))")
def agg10_revision(s, d):
    """One digest of the whole register."""
    cols = ["doc_id", "path", "title", "layer", "active", "body_hash"]
    return evals.digest(table(s, d, "doc_records").select(*cols).distinct(), cols)


@query(f"{_DIG} (SELECT sha256(concat_ws(chr(31), path, CAST(rev AS VARCHAR), coalesce(CAST(strlen(text) AS VARCHAR), chr(0)))) AS h FROM (SELECT DISTINCT path, rev, doc_id, text FROM documents))")
def agg11_corpus_key(s, d):
    """Digest of (path, revision, bytes) of every document."""
    rows = table(s, d, "documents").select("path", "rev", "doc_id", F.octet_length("text").alias("bytes"))
    return evals.digest(rows, ["path", "rev", "bytes"])


# --- lookups and adjacency -------------------------------------------------------------------------------------

@query("SELECT DISTINCT doc_id, path, title, layer FROM doc_records WHERE doc_id = (SELECT min(doc_id) FROM doc_records)")
def fil2_point_lookup(s, d):
    docs = table(s, d, "doc_records")
    return base.lookup(docs, "doc_id", docs.agg(F.min("doc_id")).first()[0]).select("doc_id", "path", "title", "layer").distinct()


@query("SELECT DISTINCT doc_id, path, active FROM doc_records WHERE doc_id IN (SELECT doc_id FROM embed_queue)")
def fil3_batch_lookup(s, d):
    return base.lookup_batch(table(s, d, "doc_records"), "doc_id", table(s, d, "embed_queue").select("doc_id")).select("doc_id", "path", "active").distinct()


@query("SELECT doc_id, chunk_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq, chunk_id) AS place FROM (SELECT DISTINCT doc_id, chunk_id, seq FROM embed_queue WHERE doc_id = (SELECT min(doc_id) FROM embed_queue))")
def fil4_chunk_list(s, d):
    q = table(s, d, "embed_queue")
    rows = base.lookup(q, "doc_id", q.agg(F.min("doc_id")).first()[0]).select("doc_id", "chunk_id", "seq").distinct()
    return retrieval.ranked_by(rows, "doc_id", ["seq", "chunk_id"]).withColumnRenamed("rank", "place")


@query("SELECT DISTINCT link_id, src_doc_id, dst_path, link_type, line_no FROM links WHERE dst_path = (SELECT min(path) FROM doc_records WHERE layer = 'knowledge' AND path IN (SELECT dst_path FROM links))")
def fil5_adjacency(s, d):
    """Links to one exact path."""
    links = table(s, d, "links")
    to = table(s, d, "doc_records").where("layer = 'knowledge'").join(links.select(F.col("dst_path").alias("path")), "path", "left_semi").agg(F.min("path")).first()[0]
    return base.lookup(links, "dst_path", to).select("link_id", "src_doc_id", "dst_path", "link_type", "line_no").distinct()


@query("""SELECT DISTINCT doc_id, CASE WHEN layer = 'knowledge' AND len(string_split(path, '/')) >= 3 THEN array_to_string(string_split(path, '/')[2:-2], '/') END AS category,
CASE WHEN layer = 'wisdom' AND len(string_split(path, '/')) >= 3 THEN string_split(path, '/')[2] END AS author FROM doc_records WHERE layer IN ('knowledge', 'wisdom')""")
def fil8_place_of_path(s, d):
    p = F.split("path", "/")
    deep = F.size(p) >= 3
    rows = table(s, d, "doc_records").where("layer IN ('knowledge', 'wisdom')")
    return rows.select("doc_id", F.when((F.col("layer") == "knowledge") & deep, F.array_join(F.slice(p, 2, F.size(p) - 2), "/")).alias("category"), F.when((F.col("layer") == "wisdom") & deep, F.element_at(p, 2)).alias("author")).distinct()


@query("""SELECT DISTINCT l.link_id, l.src_doc_id, d.doc_id AS dst_doc_id FROM (SELECT DISTINCT * FROM links) l JOIN (SELECT DISTINCT doc_id, path FROM doc_records) d ON d.path = l.dst_path
WHERE l.src_doc_id IN (SELECT doc_id FROM doc_records WHERE active)""")
def join10_incoming(s, d):
    return graph.incoming(bp._links(s, d), table(s, d, "doc_records"))


@query("SELECT event_id, task_id, ts FROM (SELECT DISTINCT event_id, task_id, ts FROM task_events WHERE ts >= TIMESTAMP '2026-01-01') ORDER BY ts, event_id LIMIT 100")
def sort4_log_order(s, d):
    return table(s, d, "task_events").where("ts >= timestamp'2026-01-01'").select("event_id", "task_id", "ts").distinct().orderBy("ts", "event_id").limit(100)


@query(f"""WITH {bp._RES}, o AS (SELECT src_doc_id AS doc_id, 'out' AS way, dst_doc_id AS other, link_id FROM r WHERE dst_doc_id IS NOT NULL
 UNION ALL SELECT d.doc_id, 'in', l.src_doc_id, l.link_id FROM l JOIN (SELECT DISTINCT doc_id, path FROM doc_records) d ON d.path = l.dst_path WHERE l.src_doc_id IN (SELECT doc_id FROM doc_records WHERE active))
SELECT doc_id, way, other, link_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, way ORDER BY link_id) AS n FROM o) WHERE n <= 3""")
def sort9_limits(s, d):
    """At most three links of every document in each direction."""
    return graph.both_ways(bp._resolved(s, d), graph.incoming(bp._links(s, d), table(s, d, "doc_records")), 3)


@query(f"""WITH {bp._RES} SELECT src_doc_id, dst_doc_id, dst_path, anchor, weight FROM (SELECT src_doc_id, dst_doc_id, dst_path, anchor, count(*) AS weight FROM r WHERE dst_doc_id IS NOT NULL GROUP BY ALL)
ORDER BY src_doc_id, dst_doc_id, dst_path, coalesce(anchor, '') LIMIT 200""")
def sort10_edge_order(s, d):
    return graph.edges(bp._resolved(s, d)).orderBy("src_doc_id", "dst_doc_id", "dst_path", F.coalesce("anchor", F.lit(""))).limit(200)


# --- folds over pages ------------------------------------------------------------------------------------------

@query(f"""WITH x AS (SELECT id, unnest(sources) AS v, generate_subscripts(sources, 1) AS p FROM (SELECT DISTINCT id, sources FROM knowledge_pages)),
k AS (SELECT id, {bp.FOLD.format('v')} AS key, min(p) AS p FROM x WHERE v IS NOT NULL GROUP BY ALL) SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY p, key) - 1 AS ord FROM k""")
def win4_first_seen(s, d):
    """Distinct sources of a page by key, in order of first appearance."""
    rows = table(s, d, "knowledge_pages").select("id", "sources").distinct().select("id", F.posexplode("sources").alias("pos", "v"))
    return evals.order_kept(rows, "id", "pos", text.path_key(F.col("v")))


@query(r"""WITH p AS (SELECT DISTINCT id, title, category, body, tags, sources FROM knowledge_pages),
s AS (SELECT *, CASE WHEN x = '' THEN 'untitled' ELSE x END AS slug FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\x00-\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM p)),
u AS (SELECT slug, count(*) AS n, list(title ORDER BY id)[1] AS title, list(category ORDER BY id)[1] AS category, coalesce(string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY id), '') AS body,
 flatten(list(coalesce(tags, []) ORDER BY id)) AS t, flatten(list(coalesce(sources, []) ORDER BY id)) AS r FROM s GROUP BY slug)
SELECT slug, n, title, category, body, list_filter(t, lambda x, i: x IS NOT NULL AND list_position(t, x) = i) AS tags, list_filter(r, lambda x, i: x IS NOT NULL AND list_position(r, x) = i) AS sources FROM u""")
def win10_merged_pages(s, d):
    """Pages of one slug folded into one, in the order of their ids."""
    from scriptoria.functions import pages as rules

    pages = table(s, d, "knowledge_pages").select("id", "title", "category", "body", "tags", "sources").distinct()
    return evals.merge_pages(pages.withColumn("slug", rules.slug(F.coalesce("title", F.lit("")))), "slug", "id").withColumn("n", F.col("n").cast("long"))


@query("""WITH l AS (SELECT DISTINCT link_id, src_doc_id, line_no FROM links), d AS (SELECT DISTINCT doc_id, path FROM doc_records), p AS (SELECT DISTINCT path, string_split(body, chr(10)) AS b FROM knowledge_pages WHERE body IS NOT NULL)
SELECT link_id, CASE WHEN line_no BETWEEN 1 AND len(b) THEN array_to_string(b[greatest(line_no - 1, 1):line_no + 1], chr(10)) ELSE array_to_string(b[1:3], chr(10)) END AS context FROM l JOIN d ON d.doc_id = l.src_doc_id JOIN p USING (path)""")
def win13_line_context(s, d):
    """Every link of a page with the lines around it."""
    links = table(s, d, "links").select("link_id", "src_doc_id", "line_no").distinct()
    docs = table(s, d, "doc_records").select(F.col("doc_id").alias("src_doc_id"), "path").distinct()
    bodies = table(s, d, "knowledge_pages").where("body IS NOT NULL").select("path", "body").distinct()
    return links.join(docs, "src_doc_id").join(bodies, "path").select("link_id", evals.line_context(F.col("body"), F.col("line_no")).alias("context"))


@query("""SELECT id, list_filter(u, lambda x, i: x IS NOT NULL AND list_position(u, x) = i) AS names FROM (SELECT DISTINCT id, list_concat(coalesce(tags, []), coalesce(list_transform(sources, lambda v: string_split(v, '/')[-1]), [])) AS u FROM knowledge_pages)""")
def set4_ordered_union(s, d):
    """Tags and the file names of sources in one list, first seen first."""
    none = F.array().cast("array<string>")
    files = F.transform("sources", lambda v: F.element_at(F.split(v, "/"), -1))
    return table(s, d, "knowledge_pages").select("id", F.array_compact(F.array_distinct(F.concat(F.coalesce("tags", none), F.coalesce(files, none)))).alias("names")).distinct()


@query("SELECT path FROM (SELECT path FROM doc_records WHERE layer = 'knowledge' AND active EXCEPT SELECT path FROM knowledge_pages) UNION ALL SELECT path FROM (SELECT path FROM knowledge_pages EXCEPT SELECT path FROM doc_records WHERE active)")
def set5_difference(s, d):
    """Paths on one side only of register and pages."""
    reg, pages = table(s, d, "doc_records").where("active").select("path", "layer"), table(s, d, "knowledge_pages").select("path")
    only = reg.where("layer = 'knowledge'").select("path").distinct().join(pages, "path", "left_anti")
    return only.unionByName(pages.distinct().join(reg, "path", "left_anti"))


@query("""SELECT doc_id, list_filter(CAST(json_extract(j, '$.tags') AS JSON[]), lambda x: json_type(x) = 'VARCHAR').list_transform(lambda x: x ->> '$') AS tags FROM (SELECT DISTINCT doc_id, CAST(frontmatter AS JSON) AS j FROM doc_records WHERE frontmatter IS NOT NULL) WHERE json_type(j, '$.tags') = 'ARRAY'""")
def str14_front_matter_tags(s, d):
    """The tags of front matter that hold a list; entries that are no strings are left out."""
    rows = table(s, d, "doc_records").where("frontmatter IS NOT NULL").select("doc_id", "frontmatter").distinct()
    held = base.string_list(F.col("frontmatter"), "tags")
    return rows.select("doc_id", held.alias("tags")).where(F.try_variant_get(F.try_parse_json("frontmatter"), "$.tags", "array<variant>").isNotNull())


@query(f"""SELECT id, {_WORDS.replace('{0}', "coalesce(title, '')")} AS words, len(list_distinct({_WORDS.replace('{0}', "coalesce(title, '')")})) AS n FROM (SELECT DISTINCT id, title FROM knowledge_pages)""")
def str20_title_words(s, d):
    words = F.filter(F.split(graph.index_title(F.coalesce("title", F.lit(""))), " "), lambda w: w != "")
    return table(s, d, "knowledge_pages").select("id", "title").distinct().select("id", words.alias("words"), F.size(F.array_distinct(words)).cast("long").alias("n"))


# --- repair and lint -------------------------------------------------------------------------------------------

@query(f"""WITH {_VEC}, p0 AS (SELECT DISTINCT id, path, title, coalesce(tags, []) AS tg, coalesce(sources, []) AS so FROM knowledge_pages),
p AS (SELECT id, path, list_distinct(list_filter(so, lambda v: trim(v) <> '')) AS so, list_distinct(list_filter(tg, lambda v: trim(v) <> '')) AS tg, list_distinct({_WORDS.replace('{0}', "coalesce(title, '')")}) AS w FROM p0),
pd AS (SELECT *, list_distinct(list_transform(list_filter(tg, lambda t: contains(t, '/')), lambda t: trim(string_split(t, '/')[1]))) AS dm FROM p),
pv AS (SELECT DISTINCT id, e FROM pd JOIN (SELECT DISTINCT page_path, vec_id FROM grounding_claims) c ON c.page_path = pd.path JOIN vec USING (vec_id)),
o AS (SELECT * FROM pd WHERE path NOT IN (SELECT dst_path FROM links WHERE link_type = 'wikilink' AND dst_path IS NOT NULL)),
cs AS (SELECT a.id AS orphan, b.id AS other, max(array_cosine_similarity(a.e, b.e)) AS c FROM pv a JOIN pv b ON a.id <> b.id WHERE a.id IN (SELECT id FROM o) GROUP BY ALL),
x AS (SELECT o.id AS orphan, b.id AS other, round(3 * len(list_intersect(o.so, b.so)) + len(list_intersect(o.tg, b.tg))
  + 0.5 * len(list_filter(list_intersect(o.dm, b.dm), lambda dd: NOT list_contains(list_transform(list_intersect(o.tg, b.tg), lambda t: string_split(t, '/')[1]), dd)))
  + CASE WHEN len(o.w) > 0 AND len(b.w) > 0 THEN 2 * len(list_intersect(o.w, b.w)) / len(list_distinct(list_concat(o.w, b.w))) ELSE 0 END + 3 * greatest(0, least(1, coalesce(round(c, 9), 0))), 6) AS score
  FROM o JOIN pd b ON o.id <> b.id LEFT JOIN cs ON cs.orphan = o.id AND cs.other = b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY orphan ORDER BY score DESC, other) AS n FROM x WHERE score > 0) SELECT orphan, other, score FROM r WHERE n = 1""")
def fix3_orphan_scores(s, d):
    """The best partner of every orphan by all five terms; a page's vectors are those of its claims."""
    pages = bp._pages(s, d).select("id", "path", "title", "tags", "sources").distinct()
    lone = pages.join(graph.inbound(bp._links(s, d)), pages.path == F.col("dst_path"), "left_anti").select("id")
    claims = table(s, d, "grounding_claims").select("page_path", "vec_id").distinct()
    good = _vectors(s, d).where(retrieval.usable_vector(F.col("vec"), 64)).select("vec_id", "vec")
    vectors = claims.join(good, "vec_id").join(pages.select("id", F.col("path").alias("page_path")), "page_path").select("id", "vec")
    return fixes.orphan_candidates(fixes.signals(pages, vectors), lone).select("orphan", "other", "score")


def _files(s, d):
    """The pages as the files on disk."""
    return table(s, d, "knowledge_pages").select("path", text.path_key(F.col("path")).alias("path_key"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_hash")).distinct()


def _register(s, d):
    return table(s, d, "doc_records").where("layer = 'knowledge'").select("path", "path_key", "body_hash", "active").distinct()


_FILES = f"f AS (SELECT DISTINCT path, {bp.FOLD.format('path')} AS k, sha256(coalesce(body, '')) AS h FROM knowledge_pages), g AS (SELECT DISTINCT path, path_key AS k, body_hash FROM doc_records WHERE layer = 'knowledge' AND active)"


@query(f"WITH {_FILES} SELECT 'missing_file' AS kind, path, '' AS detail FROM g WHERE k NOT IN (SELECT k FROM f)")
def lint10_missing_files(s, d):
    return lint.missing_files(_register(s, d), _files(s, d))


@query(f"WITH {_FILES} SELECT 'stale_index' AS kind, g.path, h AS detail FROM g JOIN f USING (k) WHERE body_hash <> h")
def lint11_stale_index(s, d):
    return lint.stale_index(_register(s, d), _files(s, d))


@query(f"WITH {_FILES} SELECT 'untracked_file' AS kind, path, '' AS detail FROM f WHERE k NOT IN (SELECT k FROM g)")
def lint12_untracked_files(s, d):
    return lint.untracked_files(_register(s, d), _files(s, d))


_H1 = "regexp_replace(regexp_extract(regexp_replace(body, '(?s)```.*?```', '', 'g'), '(?m)^\\s{0,3}#\\s+(.*)$', 1), '^\\s+|\\s+$', '', 'g')"


@query(rf"""WITH p AS (SELECT path, {_H1} AS h, regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g') AS t, regexp_replace(list_extract(string_split(path, '/'), -1), '\.[^.]*$', '') AS stem FROM (SELECT DISTINCT * FROM knowledge_pages) WHERE body IS NOT NULL),
f AS (SELECT path, concat_ws(',', CASE WHEN h = '' THEN 'no_heading' END, CASE WHEN h <> '' AND NOT regexp_matches(h, '[\p{{L}}\p{{N}}]') THEN 'punctuation_only' END, CASE WHEN t <> '' AND h <> '' AND t <> h THEN 'title_drift' END,
 CASE WHEN stem = 'untitled' AND NOT regexp_matches(CASE WHEN t <> '' THEN t ELSE h END, '[A-Za-z0-9]') THEN 'untitled_slug' END) AS detail FROM p) SELECT 'title_slug_quality' AS kind, path, detail FROM f WHERE detail <> ''""")
def lint9_title_quality(s, d):
    return lint.title_quality(bp._pages(s, d))


@query(rf"""WITH a AS (SELECT DISTINCT title FROM doc_records WHERE title IS NOT NULL), n AS (SELECT DISTINCT title, path FROM knowledge_pages WHERE title IS NOT NULL),
ex AS (SELECT title, min(path) AS path, count(DISTINCT path) AS n FROM n GROUP BY 1), fz AS (SELECT k, min(path) AS path FROM (SELECT {_TITLE.replace('{0}', 'title')} AS k, path FROM n) GROUP BY k HAVING count(DISTINCT path) = 1),
q AS (SELECT title, CASE WHEN regexp_matches(k, '(^| )[a-z]{{2,60}}[a-rt-z]s$') THEN left(k, -1) ELSE k END AS k FROM (SELECT title, {_TITLE.replace('{0}', 'title')} AS k FROM a))
SELECT q.title, CASE WHEN ex.n = 1 THEN ex.path ELSE fz.path END AS path, CASE WHEN ex.n = 1 THEN 'exact' WHEN fz.path IS NOT NULL THEN 'fuzzy' END AS how FROM q LEFT JOIN ex USING (title) LEFT JOIN fz USING (k)""")
def join12_titles(s, d):
    """Every title of the register, looked up among the titles of the pages."""
    asked = table(s, d, "doc_records").where("title IS NOT NULL").select("title").distinct()
    return graph.resolve_titles(asked, table(s, d, "knowledge_pages").select("title", "path"))


def _issues(s, d):
    pages, links = bp._pages(s, d), bp._links(s, d)
    docs = table(s, d, "doc_records")
    return lint.run(
        [
            lint.broken_links(bp._resolved(s, d)), lint.orphan_pages(pages.select("path").distinct(), links), lint.duplicate_titles(pages), lint.non_atomic(pages.select("path", "body", "tags", "id").distinct()), lint.title_quality(pages),
            lint.uncategorized(pages, "inbox").distinct(), lint.invalid_status(docs).distinct(), lint.dangling_provenance(graph.provenance(pages, docs), pages.select("id", "path").distinct()),
            lint.missing_files(_register(s, d), _files(s, d)), lint.stale_index(_register(s, d), _files(s, d)), lint.untracked_files(_register(s, d), _files(s, d)),
        ],
        lint.skips(table(s, d, "knowledge_pages").select("path", "extras").distinct(), "extras"),
    )


_LINTS = [bp.SQL[n] for n in ("lint1_broken_links", "lint2_orphans", "lint3_duplicate_titles", "lint4_non_atomic", "lint6_dangling", "lint8_uncategorized")]
_LINTS += [SQL[n] for n in ("lint9_title_quality", "lint10_missing_files", "lint11_stale_index", "lint12_untracked_files")]
_LINTS.append("SELECT DISTINCT 'invalid_wisdom_status' AS kind, path, status AS detail FROM doc_records WHERE layer = 'wisdom' AND active AND status NOT IN ('draft', 'published', 'favorite', 'archived')")
_PASS = " UNION ALL ".join(f"SELECT kind, path, CAST(detail AS VARCHAR) AS detail FROM ({x})" for x in _LINTS)


@query(f"WITH every_issue AS ({_PASS}) SELECT kind, path, detail FROM every_issue")
def lint13_pass(s, d):
    """All issues of the whole base; what a page's front matter silences is left out."""
    return _issues(s, d)


@query(f"WITH every_issue AS ({_PASS}) SELECT kind, count(*) AS n_issues FROM every_issue GROUP BY kind")
def agg26_lint_tally(s, d):
    return _issues(s, d).groupBy("kind").agg(F.count("*").alias("n_issues"))


@query(f"WITH every_issue AS ({_PASS}) SELECT kind, path, detail, action FROM (SELECT *, CASE kind WHEN 'missing_file' THEN 'drop_row' WHEN 'stale_index' THEN 'reindex' WHEN 'untracked_file' THEN 'reindex' WHEN 'dangling_provenance' THEN 'drop_source' END AS action FROM every_issue) WHERE action IS NOT NULL")
def fix6_single_operations(s, d):
    """The proposals that need no search: one operation per issue."""
    return fixes.single_operations(_issues(s, d))
