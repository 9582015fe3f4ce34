"""Pages, storage, graph, lint, tasks and statistics over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import pages as rules
from scriptoria.functions import text
from scriptoria.operators import base, chunking, fixes, graph, lint, parsing, stats, tape
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


def _pages(s, d):
    return table(s, d, "knowledge_pages").distinct()


def _docs(s, d):
    return table(s, d, "doc_records").distinct()


def _links(s, d):
    return table(s, d, "links").distinct()


CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
FOLD = "replace(replace(replace(replace(replace(lower(nfc_normalize(replace({0}, chr(92), '/'))), 'ß', 'ss'), 'ς', 'σ'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"


# --- text rules ------------------------------------------------------------------------------------------------

@query(rf"""WITH c AS (SELECT doc_id, len(regexp_extract_all(substr(text, 1, 200), '{CJK}')) AS c, len(regexp_extract_all(substr(text, 1, 200), '[A-Za-z]')) AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN c + a = 0 THEN 'other' WHEN c / (c + a) > 0.3 THEN 'cjk' ELSE 'en' END AS language FROM c""")
def str16_language(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", rules.language(F.col("text")).alias("language"))


@query(rf"""WITH p AS (SELECT DISTINCT id, body FROM knowledge_pages WHERE body IS NOT NULL),
t AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(body, '(?s)```.*?```', '', 'g'), '(?m)^\s{{0,3}}#+\s+.*$', '', 'g'), '\[\[([^\]\|\n]+?)(?:\|[^\]\n]+?)?\]\]', ' ', 'g') AS t FROM p),
c AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.。])', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
  lambda x: len(regexp_extract_all(x, '[A-Za-z]{{2,}}')) >= 3 OR len(regexp_extract_all(x, '{CJK}')) >= 4) AS c FROM t)
SELECT id, generate_subscripts(c, 1) - 1 AS claim_no, unnest(c) AS claim FROM c""")
def str15_claims(s, d):
    return _pages(s, d).select("id", "body").where("body IS NOT NULL").distinct().select("id", F.posexplode(rules.claims(F.col("body"))).alias("claim_no", "claim"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '[\x{4e00}-\x{9fff}]+', ' ', 'g'), '\s+'), lambda x: x <> ''))
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]+'), lambda r: greatest(1, length(r) // 2))), 0) AS n_tokens FROM documents WHERE text IS NOT NULL""")
def str3_token_count(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", rules.token_count(F.col("text")).cast("long").alias("n_tokens"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) > 240 THEN substr(t, 1, 240) || '…' ELSE t END AS snippet FROM t""")
def str11_snippet(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", rules.snippet(F.col("text")).alias("snippet"))


@query(r"""SELECT DISTINCT id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\x00-\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM knowledge_pages WHERE title IS NOT NULL)""")
def str8_slug(s, d):
    return table(s, d, "knowledge_pages").where("title IS NOT NULL").select("id", rules.slug(F.col("title")).alias("slug")).distinct()


_ATOM = r"""a AS (SELECT DISTINCT id, path, length(body) AS n_chars,
  len(regexp_extract_all(regexp_replace(body, '(?s)```.*?```', '', 'g'), '(?m)^\s{0,3}#\s+\S')) AS n_h1,
  len(regexp_extract_all(regexp_replace(body, '(?s)```.*?```', '', 'g'), '(?m)^\s{0,3}##\s+\S')) AS n_h2,
  len(list_distinct(regexp_extract_all(body, '\[\[([^\]\|\n]+?)(?:\|[^\]\n]+?)?\]\]', 1))) AS n_links,
  len(list_distinct(list_transform(list_filter(coalesce(tags, []), lambda t: contains(t, '/')), lambda t: split_part(t, '/', 1)))) AS n_domains
  FROM knowledge_pages WHERE body IS NOT NULL)"""


@query(f"WITH {_ATOM} SELECT id, n_chars, n_h1, n_h2, n_links, n_domains, n_chars <= 2500 AND n_h1 <= 1 AND n_h2 <= 3 AND n_links <= 15 AND n_domains <= 1 AS atomic FROM a")
def str17_atomicity(s, d):
    counts = rules.atomicity(F.col("body"), F.col("tags"))
    out = _pages(s, d).where("body IS NOT NULL").select("id", *[c.alias(n) for n, c in counts.items()]).distinct()
    ok = F.lit(True)
    for n, most in rules.ATOMIC.items():
        ok = ok & (F.col(n) <= most)
    return out.withColumn("atomic", ok)


@query(f"WITH {_ATOM} SELECT count(*) AS n_pages, round(avg(CASE WHEN n_chars <= 2500 AND n_h1 <= 1 AND n_h2 <= 3 AND n_links <= 15 AND n_domains <= 1 THEN 1 ELSE 0 END), 6) AS atomicity FROM a")
def agg22_atomicity(s, d):
    return str17_atomicity(s, d).agg(F.count("*").alias("n_pages"), F.round(F.avg(F.col("atomic").cast("int")), 6).alias("atomicity"))


@query(r"""WITH d AS (SELECT DISTINCT doc_id, title, body, path FROM doc_records WHERE layer = 'source')
SELECT doc_id, coalesce(title, nullif(trim(regexp_extract(body, '(?m)^[ \t]{0,3}#{1,6}[ \t]+([^\r\n]*)', 1)), ''), regexp_replace(list_extract(string_split(path, '/'), -1), '\.[^.]*$', '')) AS title FROM d""")
def src3_title(s, d):
    docs = _docs(s, d).where("layer = 'source'").select("doc_id", "title", "body", "path").distinct()
    return docs.select("doc_id", F.coalesce("title", rules.first_heading(F.col("body")), rules.stem(F.col("path"))).alias("title"))


# --- storage ---------------------------------------------------------------------------------------------------

@query("SELECT layer, count(DISTINCT doc_id) AS n_active FROM doc_records WHERE active GROUP BY layer")
def agg1_counts(s, d):
    return table(s, d, "doc_records").where("active").select("layer", "doc_id").distinct().groupBy("layer").agg(F.count("*").alias("n_active"))


@query("SELECT DISTINCT doc_id, path, layer, mtime FROM doc_records WHERE layer = 'source' AND active AND mtime >= 1767225600")
def fil1_listing(s, d):
    return table(s, d, "doc_records").where("layer = 'source' AND active AND mtime >= 1767225600").select("doc_id", "path", "layer", "mtime").distinct()


@query("SELECT doc_id, active, mtime, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mtime DESC NULLS LAST, active DESC, first_seen DESC) AS n FROM (SELECT DISTINCT doc_id, active, mtime, first_seen FROM doc_records)) WHERE n = 1")
def dml1_last_state(s, d):
    return base.last_wins(table(s, d, "doc_records").select("doc_id", "active", "mtime", "first_seen"), ["doc_id"], ["mtime", "active", "first_seen"])


@query("SELECT chunk_id FROM embed_queue EXCEPT SELECT chunk_id FROM vec_index WHERE version_id = 2 AND owner_kind = 'chunk' AND embedding IS NOT NULL")
def join5_missing_vectors(s, d):
    have = table(s, d, "vec_index").where("version_id = 2 AND owner_kind = 'chunk' AND embedding IS NOT NULL").select("chunk_id")
    return table(s, d, "embed_queue").select("chunk_id").distinct().join(have, "chunk_id", "left_anti")


@query("SELECT owner_kind, max(version_id) AS version_id FROM vec_index GROUP BY owner_kind")
def fil11_active_version(s, d):
    return base.active_version(table(s, d, "vec_index"), "owner_kind")


@query("SELECT owner_kind, version_id, count(DISTINCT vec_id) AS n_vectors, min(embedded_at) AS first_at, max(embedded_at) AS last_at FROM vec_index GROUP BY ALL")
def dml11_versions(s, d):
    return table(s, d, "vec_index").groupBy("owner_kind", "version_id").agg(F.count_distinct("vec_id").alias("n_vectors"), F.min("embedded_at").alias("first_at"), F.max("embedded_at").alias("last_at"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1")
def join26_cache_probe(s, d):
    hashed = table(s, d, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"))


@query("""SELECT path, rev, doc_id FROM (SELECT path, rev, doc_id, row_number() OVER (PARTITION BY path ORDER BY rev DESC, doc_id DESC) AS n FROM documents WHERE path IS NOT NULL) WHERE n = 1""")
def set6_last_revision(s, d):
    rows = table(s, d, "documents").where("path IS NOT NULL").select("path", "rev", "doc_id")
    return base.last_wins(rows, ["path"], ["rev", "doc_id"])


@query("SELECT doc_id, chunk_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq, chunk_id) - 1 AS dense_seq FROM (SELECT DISTINCT doc_id, chunk_id, seq FROM embed_queue)")
def win5_dense_seq(s, d):
    from pyspark.sql import Window

    rows = table(s, d, "embed_queue").select("doc_id", "chunk_id", "seq").distinct()
    return rows.withColumn("dense_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "chunk_id")) - 1)


# --- graph -----------------------------------------------------------------------------------------------------

_RES = f"""l AS (SELECT DISTINCT * FROM links), b AS (SELECT path_key, arg_min(struct_pack(doc_id := doc_id, active := active), list_position(['source', 'knowledge', 'wisdom'], layer)) AS t FROM
  (SELECT path_key, doc_id, layer, bool_or(active) AS active FROM doc_records GROUP BY ALL) GROUP BY path_key),
r AS (SELECT l.*, CASE WHEN t.active THEN t.doc_id END AS dst_doc_id FROM l LEFT JOIN b ON b.path_key = {FOLD.format('l.dst_path')})"""


def _doc_states(s, d):
    return table(s, d, "doc_records").groupBy("path_key", "doc_id", "layer").agg(F.max("active").alias("active"))


def _resolved(s, d):
    return graph.outgoing(_links(s, d), _doc_states(s, d))


@query(f"WITH {_RES} SELECT link_id, src_doc_id, dst_doc_id FROM r WHERE link_type IS DISTINCT FROM 'url'")
def join9_outgoing(s, d):
    return _resolved(s, d).where("link_type IS NULL OR link_type <> 'url'").select("link_id", "src_doc_id", "dst_doc_id")


@query(f"WITH {_RES} SELECT src_doc_id, dst_doc_id, dst_path, anchor, count(*) AS weight FROM r WHERE dst_doc_id IS NOT NULL GROUP BY ALL")
def agg7_edges(s, d):
    return graph.edges(_resolved(s, d))


@query(f"""WITH {_RES}, p AS (SELECT DISTINCT src_doc_id, dst_doc_id FROM r WHERE dst_doc_id IS NOT NULL),
x AS (SELECT src_doc_id AS doc_id, 1 AS o, 0 AS i FROM p UNION ALL SELECT dst_doc_id, 0, 1 FROM p) SELECT doc_id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM x GROUP BY doc_id""")
def agg8_degrees(s, d):
    return graph.degrees(graph.edges(_resolved(s, d)))


@query(f"WITH {_RES} SELECT src_doc_id, dst_path, anchor, count(*) AS n FROM r WHERE dst_doc_id IS NULL AND link_type IS DISTINCT FROM 'url' GROUP BY ALL")
def agg9_unresolved(s, d):
    lost = _resolved(s, d).where("dst_doc_id IS NULL AND (link_type IS NULL OR link_type <> 'url')")
    return lost.groupBy("src_doc_id", "dst_path", "anchor").agg(F.count("*").alias("n"))


@query("SELECT dst_path, count(*) AS n_inbound FROM (SELECT DISTINCT * FROM links) WHERE link_type = 'wikilink' AND dst_path IS NOT NULL GROUP BY dst_path")
def agg27_inbound(s, d):
    return graph.inbound(_links(s, d))


@query("""WITH docs AS (SELECT DISTINCT doc_id, path FROM doc_records WHERE active),
c AS (SELECT DISTINCT doc_id || '#' || chunk_id AS chunk_id, doc_id FROM embed_queue UNION SELECT DISTINCT doc_id, doc_id FROM doc_records WHERE layer = 'wisdom' OR layer = 'knowledge'),
sk AS (SELECT chunk_id, doc_id FROM c WHERE doc_id LIKE 'wisdom:%'),
h AS (SELECT l.dst_path FROM sk JOIN (SELECT DISTINCT * FROM links) l ON l.src_doc_id = sk.doc_id WHERE link_type = 'wikilink')
SELECT c.chunk_id, count(*) AS edge_count FROM h JOIN docs ON docs.path = h.dst_path JOIN c ON c.doc_id = docs.doc_id WHERE c.chunk_id NOT IN (SELECT chunk_id FROM sk) GROUP BY 1""")
def join4_neighbours(s, d):
    """What the wisdom layer leads to: a page is its own chunk, a source has those of the queue."""
    own = table(s, d, "doc_records").where("layer IN ('knowledge', 'wisdom')").select(F.col("doc_id").alias("chunk_id"), "doc_id")
    chunks = table(s, d, "embed_queue").select(F.concat_ws("#", "doc_id", "chunk_id").alias("chunk_id"), "doc_id").unionByName(own).distinct()
    seeds = chunks.where(F.col("doc_id").startswith("wisdom:")).select("chunk_id")
    return graph.neighbours(seeds, _links(s, d), table(s, d, "doc_records").where("active").select("doc_id", "path", "active").distinct(), chunks)


_PROV = f"""prov AS (SELECT id, s AS source_path, k AS source_key, EXISTS (SELECT 1 FROM doc_records x WHERE x.active AND x.layer = 'source' AND x.path_key = k) AS resolved FROM
  (SELECT id, s, {FOLD.format('s')} AS k, row_number() OVER (PARTITION BY id, {FOLD.format('s')} ORDER BY pos, s) AS n FROM
    (SELECT id, unnest(sources) AS s, generate_subscripts(sources, 1) AS pos FROM (SELECT DISTINCT * FROM knowledge_pages)) WHERE trim(s) <> '') WHERE n = 1)"""


@query(f"WITH {_PROV} SELECT * FROM prov")
def join11_provenance(s, d):
    return graph.provenance(_pages(s, d), table(s, d, "doc_records"))


@query(f"WITH {_PROV} SELECT source_key, count(*) AS n_pages FROM prov WHERE resolved GROUP BY 1")
def fil6_reverse_provenance(s, d):
    return graph.provenance(_pages(s, d), table(s, d, "doc_records")).where("resolved").groupBy("source_key").agg(F.count("*").alias("n_pages"))


# --- lint ------------------------------------------------------------------------------------------------------

@query("SELECT 'orphan_page' AS kind, path, '' AS detail FROM (SELECT DISTINCT path FROM knowledge_pages) WHERE path NOT IN (SELECT dst_path FROM links WHERE link_type = 'wikilink' AND dst_path IS NOT NULL)")
def lint2_orphans(s, d):
    return lint.orphan_pages(table(s, d, "knowledge_pages").select("path").distinct(), _links(s, d))


@query(r"""WITH n AS (SELECT DISTINCT path, coalesce(title, regexp_replace(list_extract(string_split(path, '/'), -1), '\.[^.]*$', '')) AS t FROM knowledge_pages)
SELECT 'duplicate_title' AS kind, path, f AS detail FROM (SELECT path, first_value(path) OVER w AS f, row_number() OVER w AS n FROM n WINDOW w AS (PARTITION BY t ORDER BY path)) WHERE n > 1""")
def lint3_duplicate_titles(s, d):
    return lint.duplicate_titles(table(s, d, "knowledge_pages"))


@query(f"""WITH {_ATOM} SELECT 'non_atomic_page' AS kind, path, concat_ws(',', CASE WHEN n_chars > 2500 THEN 'n_chars' END, CASE WHEN n_h1 > 1 THEN 'n_h1' END, CASE WHEN n_h2 > 3 THEN 'n_h2' END, CASE WHEN n_links > 15 THEN 'n_links' END, CASE WHEN n_domains > 1 THEN 'n_domains' END) AS detail
FROM a WHERE NOT (n_chars <= 2500 AND n_h1 <= 1 AND n_h2 <= 3 AND n_links <= 15 AND n_domains <= 1)""")
def lint4_non_atomic(s, d):
    return lint.non_atomic(_pages(s, d))


@query(f"WITH {_RES} SELECT 'broken_wikilink' AS kind, regexp_replace(src_doc_id, '^[^:]*:', '') AS path, concat_ws(':', line_no, dst_path) AS detail FROM r WHERE link_type = 'wikilink' AND dst_doc_id IS NULL AND trim(dst_path) <> ''")
def lint1_broken_links(s, d):
    return lint.broken_links(_resolved(s, d))


@query(f"WITH {_PROV} SELECT 'dangling_provenance' AS kind, path, source_path AS detail FROM prov JOIN (SELECT DISTINCT id, path FROM knowledge_pages) USING (id) WHERE NOT resolved")
def lint6_dangling(s, d):
    pages = _pages(s, d)
    return lint.dangling_provenance(graph.provenance(pages, table(s, d, "doc_records")), pages.select("id", "path").distinct())


@query("SELECT DISTINCT 'uncategorized' AS kind, path, 'inbox' AS detail FROM knowledge_pages WHERE category = 'inbox'")
def lint8_uncategorized(s, d):
    return lint.uncategorized(_pages(s, d), "inbox")


# --- tasks -----------------------------------------------------------------------------------------------------

_TAPE = """e AS (SELECT DISTINCT * FROM task_events WHERE task_id IS NOT NULL), t AS (SELECT *, json_extract_string(TRY_CAST(body AS JSON), '$.type') AS type FROM e),
c AS (SELECT *, coalesce(max(CASE WHEN type = 'final' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM t),
tape AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq, event_id) - 1 AS new_seq FROM c WHERE closed = 0)"""


@query(f"WITH {_TAPE} SELECT event_id, task_id, seq, new_seq, type FROM tape")
def stm5_tape(s, d):
    return tape.admitted(table(s, d, "task_events")).select("event_id", "task_id", "seq", "new_seq", "type")


@query(f"WITH {_TAPE} SELECT task_id, count(*) AS n_events, max(seq) AS last_seq FROM tape WHERE seq >= 5 GROUP BY task_id")
def sort6_replay(s, d):
    return tape.replay(tape.admitted(table(s, d, "task_events")), 5)


@query("""WITH o AS (SELECT *, coalesce(list_position(['pending', 'running', 'failed', 'cancelled', 'succeeded'], status), 0) AS stage FROM tasks),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY stage DESC, finished_at DESC NULLS LAST, started_at DESC NULLS LAST, created_at DESC NULLS LAST, op DESC NULLS LAST) AS n FROM o)
SELECT task_id, status, op, created_at, started_at, finished_at FROM r WHERE n = 1""")
def win11_latest_status(s, d):
    return tape.latest_status(table(s, d, "tasks"))


@query("SELECT op, status, count(*) AS n FROM (SELECT DISTINCT * FROM tasks) GROUP BY ALL")
def fil16_task_counts(s, d):
    return table(s, d, "tasks").distinct().groupBy("op", "status").agg(F.count("*").alias("n"))


@query("SELECT op, count(*) AS n, round(quantile_cont(s, 0.5), 3) AS p50, round(quantile_cont(s, 0.95), 3) AS p95 FROM (SELECT DISTINCT task_id, op, epoch_us(finished_at) / 1e6 - epoch_us(started_at) / 1e6 AS s FROM tasks WHERE finished_at IS NOT NULL AND started_at IS NOT NULL) GROUP BY op")
def agg36_latency(s, d):
    took = table(s, d, "tasks").where("finished_at IS NOT NULL AND started_at IS NOT NULL").select("task_id", "op", (F.unix_micros(F.col("finished_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6).alias("s")).distinct()
    return took.groupBy("op").agg(F.count("*").alias("n"), F.round(F.percentile("s", 0.5), 3).alias("p50"), F.round(F.percentile("s", 0.95), 3).alias("p95"))


@query("SELECT task_id, op, status, created_at FROM (SELECT DISTINCT task_id, op, status, created_at FROM tasks) WHERE created_at < TIMESTAMP '2026-01-01' OR (created_at = TIMESTAMP '2026-01-01' AND task_id > '0') ORDER BY created_at DESC NULLS LAST, task_id, status LIMIT 51")
def sort5_keyset_page(s, d):
    rows = table(s, d, "tasks").select("task_id", "op", "status", "created_at").distinct()
    return base.keyset_page(rows, "created_at", "task_id", 50, base.encode_cursor("2026-01-01 00:00:00", "0"))


# --- evaluation and statistics ---------------------------------------------------------------------------------

@query("SELECT category, n_pages, round(n_pages / sum(n_pages) OVER (), 6) AS share FROM (SELECT category, count(DISTINCT id) AS n_pages FROM knowledge_pages GROUP BY category)")
def agg21_categories(s, d):
    n = table(s, d, "knowledge_pages").select("category", "id").distinct().groupBy("category").agg(F.count("*").alias("n_pages"))
    total = n.agg(F.sum("n_pages").alias("total"))
    return n.join(F.broadcast(total)).select("category", "n_pages", F.round(F.col("n_pages") / F.col("total"), 6).alias("share"))


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(coalesce(stddev_samp(n_chars), 0), 4) AS std FROM documents GROUP BY lang")
def agg31_mean_std(s, d):
    return stats.mean_std(table(s, d, "documents"), "lang", "n_chars").select("lang", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("""WITH a AS (SELECT source, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source), b AS (SELECT * FROM a WHERE source = 'vault_notes')
SELECT a.source, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 3) AS df,
round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 4) AS d FROM a, b WHERE a.source <> 'vault_notes' AND a.n > 1""")
def agg32_welch(s, d):
    w = stats.welch(table(s, d, "documents").where("source IS NOT NULL AND n_chars IS NOT NULL"), "source", "n_chars", "vault_notes")
    return w.select("source", F.round("t", 4).alias("t"), F.round("df", 3).alias("df"), F.round("d", 4).alias("d"))


@query("""SELECT metric, CASE WHEN value IS NULL THEN false WHEN metric LIKE '%\\_max' ESCAPE '\\' THEN value <= bound ELSE value >= bound END AS passed FROM (VALUES ('share_en', 0.5), ('share_null_max', 0.1), ('absent', 1.0)) t(metric, bound)
LEFT JOIN (SELECT 'share_en' AS metric, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0 END) AS value FROM documents UNION ALL SELECT 'share_null_max', avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0 END) FROM documents) USING (metric)""")
def agg17_gate(s, d):
    docs = table(s, d, "documents")
    one = docs.agg(F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)).alias("share_en"), F.avg(F.col("lang").isNull().cast("double")).alias("share_null_max"))
    values = one.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in one.columns]))).alias("metric", "value"))
    bounds = s.createDataFrame([("share_en", 0.5), ("share_null_max", 0.1), ("absent", 1.0)], "metric string, bound double")
    return stats.gate(values, bounds).select("metric", "passed")


# --- parsing, chunking, fixes ----------------------------------------------------------------------------------

@query(r"""SELECT id, len(list_filter(regexp_extract_all(body, '\[\[([^\]\|\n]+?)(?:\|[^\]\n]+?)?\]\]'), lambda x: true)) AS n_wikilinks, len(list_distinct(list_transform(regexp_extract_all(body, '\[\[([^\]\|\n]+?)(?:\|[^\]\n]+?)?\]\]', 1), lambda t: trim(string_split(trim(t), '#')[1])))) AS n_targets
FROM (SELECT DISTINCT id, body FROM knowledge_pages) WHERE body IS NOT NULL""")
def str7_links(s, d):
    """Wikilinks of every page body, and how many targets they name."""
    pages = table(s, d, "knowledge_pages").where("body IS NOT NULL").select("id", "body").distinct()
    found = parsing.links(pages, "id", "body").where("kind = 'wikilink'").groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("target").alias("m"))
    return pages.join(found, pages.id == found.key, "left").select("id", F.coalesce("n", F.lit(0)).alias("n_wikilinks"), F.coalesce("m", F.lit(0)).alias("n_targets"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '!\[[^\]]*\]\(\s*[^)\n]+?(?:\s+"[^"\n]*")?\s*\)|!\[\[[^\]|]+?(?:\|[^\]]+)?\]\]')) AS n_images FROM documents WHERE text IS NOT NULL""")
def src6_image_counts(s, d):
    found = parsing.images(table(s, d, "documents"), "doc_id", "text").groupBy("key").agg(F.count("*").alias("n_images"))
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id")
    return docs.join(found, docs.doc_id == found.key, "left").select("doc_id", F.coalesce("n_images", F.lit(0)).alias("n_images"))


def _bodies(s, d):
    return table(s, d, "doc_records").where("layer = 'source' AND body IS NOT NULL").select("doc_id", "body").distinct()


@query()
def win8_chunks(s, d):
    return chunking.chunk(_bodies(s, d), "doc_id", "body")


@query()
def win7_groups(s, d):
    """Sections of 300 tokens packed into groups of 900."""
    return chunking.group(_bodies(s, d), "doc_id", "body", max_tokens=300, target_tokens=900)


@query()
def str19_fuzzy_targets(s, d):
    """For every unresolved link the most similar known path of the same folder."""
    lost = _resolved(s, d).where("dst_doc_id IS NULL AND (link_type IS NULL OR link_type <> 'url') AND trim(dst_path) <> ''").select(F.col("dst_path").alias("target")).distinct()
    return fixes.fuzzy_targets(lost, table(s, d, "doc_records").where("active").select("path").distinct())
