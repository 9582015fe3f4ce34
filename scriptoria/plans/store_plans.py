"""Writing rules, page views, evaluation tables and SQL functions over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import sql as functions
from scriptoria.operators import graph, stats, store
from scriptoria.plans import base_plans as bp
from scriptoria.plans import quality_plans as qp
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


@query("""SELECT doc_id, bool_or(CASE WHEN layer = 'wisdom' AND status = 'archived' THEN false ELSE active END) AS active FROM
(SELECT doc_id, layer, status, active AND doc_id NOT IN (SELECT doc_id FROM doc_records WHERE layer = 'wisdom' AND status = 'archived') AS active FROM doc_records) GROUP BY doc_id""")
def dml7_deactivate(s, d):
    """The register once all archived wisdom is put out of sight."""
    docs = table(s, d, "doc_records").select("doc_id", "layer", "status", "active")
    out = store.deactivate(docs, docs.where("layer = 'wisdom' AND status = 'archived'"))
    return out.groupBy("doc_id").agg(F.max("active").alias("active"))


@query("""SELECT src_doc_id, dst_path, line_no, link_id, link_type FROM (SELECT *, row_number() OVER (PARTITION BY src_doc_id, dst_path, line_no ORDER BY link_id DESC) AS n FROM (SELECT DISTINCT src_doc_id, dst_path, line_no, link_id, link_type FROM links)) WHERE n = 1""")
def dml5_links(s, d):
    """All links written anew: one per source, target and line, the last one given."""
    links = table(s, d, "links").select("src_doc_id", "dst_path", "line_no", "link_id", "link_type").distinct()
    return store.replace_links(links.limit(0), links, "link_id").select("src_doc_id", "dst_path", "line_no", "link_id", "link_type")


@query(f"""SELECT id AS src_doc_id, source_path, source_key AS source_path_key FROM (WITH {bp._PROV} SELECT * FROM prov)""")
def dml6_provenance(s, d):
    rows = bp._pages(s, d).select(F.col("id").alias("src_doc_id"), "sources").distinct().select("src_doc_id", F.posexplode("sources").alias("pos", "source_path")).where("trim(source_path) <> ''")
    return store.replace_provenance(rows.drop("pos").withColumn("source_path_key", F.lit("")).limit(0), rows).select("src_doc_id", "source_path", "source_path_key")


@query("""SELECT doc_id, layer, CASE WHEN layer = 'wisdom' AND status IN ('draft', 'published', 'favorite', 'archived') THEN status END AS status FROM (SELECT DISTINCT doc_id, layer, status FROM doc_records)""")
def fil9_status(s, d):
    return table(s, d, "doc_records").select("doc_id", "layer", store.clamp_status(F.col("layer"), F.col("status")).alias("status")).distinct()


@query("""WITH o AS (SELECT doc_id, max(mtime) AS old, min(body_hash) AS h FROM doc_records GROUP BY 1), n AS (SELECT DISTINCT doc_id, body_hash, CASE WHEN line_no % 3 = 0 THEN 0.0 END AS m FROM doc_records JOIN (SELECT src_doc_id AS doc_id, max(line_no) AS line_no FROM links GROUP BY 1) USING (doc_id))
SELECT n.doc_id, coalesce(CASE WHEN m > 0 THEN m END, CASE WHEN n.body_hash = o.h AND o.old > 0 THEN o.old END, 1.0) AS mtime FROM n JOIN o USING (doc_id)""")
def fil10_mtime(s, d):
    """Files without a time of their own take the stored one while their content is the same."""
    old = table(s, d, "doc_records").groupBy("doc_id").agg(F.max("mtime").alias("old"), F.min("body_hash").alias("h"))
    last = table(s, d, "links").groupBy(F.col("src_doc_id").alias("doc_id")).agg(F.max("line_no").alias("line_no"))
    new = table(s, d, "doc_records").join(last, "doc_id").select("doc_id", "body_hash", F.when(F.col("line_no") % 3 == 0, F.lit(0.0)).alias("m")).distinct()
    return new.join(old, "doc_id").select("doc_id", store.known_mtime(F.col("m"), F.col("body_hash") == F.col("h"), F.col("old"), F.lit(1.0)).alias("mtime"))


@query("""SELECT DISTINCT path, regexp_matches(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), '^[a-z0-9]+(?:-[a-z0-9]+)*$') AS ok FROM doc_records WHERE layer = 'wisdom'""")
def str9_kebab_names(s, d):
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return table(s, d, "doc_records").where("layer = 'wisdom'").select("path", store.kebab(name).alias("ok")).distinct()


@query(r"SELECT doc_id, regexp_replace(text, '([\x{4e00}-\x{9fff}]+)', ' \1 ', 'g') AS spaced FROM documents WHERE text IS NOT NULL")
def str2_spaced_runs(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", store.spaced_runs(F.col("text")).alias("spaced"))


@query(r"SELECT stem, count(*) AS n_ids FROM (SELECT DISTINCT doc_id, regexp_replace(trim(doc_id), '[^A-Za-z0-9_\-]', '_', 'g') AS stem FROM doc_records) GROUP BY stem")
def str24_stems(s, d):
    """Stems of all ids; a stem of several ids is a collision."""
    return table(s, d, "doc_records").select("doc_id", store.safe_stem(F.col("doc_id")).alias("stem")).distinct().groupBy("stem").agg(F.count("*").alias("n_ids"))


@query(r"SELECT DISTINCT link_id, regexp_replace(dst_path, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]*@', '\1') AS url FROM links WHERE link_type = 'url'")
def str23_urls(s, d):
    return table(s, d, "links").where("link_type = 'url'").select("link_id", store.without_credentials(F.col("dst_path")).alias("url")).distinct()


@query("SELECT DISTINCT doc_id, strftime(make_timestamp(CAST(floor(mtime * 1000000) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS at FROM doc_records WHERE mtime IS NOT NULL")
def sca3_times(s, d):
    return table(s, d, "doc_records").where("mtime IS NOT NULL").select("doc_id", store.iso_time(F.col("mtime")).alias("at")).distinct()


@query("SELECT DISTINCT doc_id, list_sort(json_keys(CAST(frontmatter AS JSON))) AS fields FROM doc_records WHERE frontmatter IS NOT NULL")
def sca8_fields(s, d):
    """Names of the fields of front matter, as a map's keys."""
    return table(s, d, "doc_records").where("frontmatter IS NOT NULL").select("doc_id", F.array_sort(F.map_keys(F.from_json("frontmatter", "map<string,string>"))).alias("fields")).distinct()


@query("""WITH l AS (SELECT DISTINCT link_id, d.path AS src_path, dst_path, line_no FROM links JOIN (SELECT DISTINCT doc_id, path FROM doc_records) d ON d.doc_id = src_doc_id WHERE link_type = 'wikilink'),
p AS (SELECT DISTINCT path, title, body, string_split(body, chr(10)) AS b FROM knowledge_pages)
SELECT link_id, src_path, array_to_string(s.b[greatest(least(greatest(line_no, 1), len(s.b)) - 1, 1):least(greatest(line_no, 1), len(s.b)) + 1], chr(10)) AS context, l.dst_path AS target_path, t.title AS target_title, substr(t.body, 1, 1200) AS target_body
FROM l JOIN p s ON s.path = src_path AND s.body <> '' JOIN p t ON t.path = l.dst_path WHERE src_path <> l.dst_path""")
def join23_link_units(s, d):
    docs = table(s, d, "doc_records").select(F.col("doc_id").alias("src_doc_id"), F.col("path").alias("src_path")).distinct()
    links = bp._links(s, d).where("link_type = 'wikilink'").join(docs, "src_doc_id").select("link_id", "src_path", "dst_path", "line_no").distinct()
    return store.link_units(links, bp._pages(s, d).select("path", "title", "body").distinct())


@query("""WITH r AS (SELECT coalesce(lang, '-') AS arm, coalesce(source, '-') AS metric, n_chars AS value FROM documents WHERE n_chars IS NOT NULL), a AS (SELECT metric, arm, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM r GROUP BY ALL)
SELECT metric, arm, n, round(m, 4) AS mean, round(s, 4) AS std, row_number() OVER (PARTITION BY metric ORDER BY m DESC, arm) = 1 AS best FROM a""")
def agg33_matrix(s, d):
    """Languages as arms, sources as metrics, length as the value."""
    runs = table(s, d, "documents").select(F.coalesce("lang", F.lit("-")).alias("arm"), F.coalesce("source", F.lit("-")).alias("metric"), F.col("n_chars").cast("double").alias("value"))
    return stats.model_matrix(runs, "en").select("metric", "arm", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "best")


@query(f"""WITH {qp._ARGMAX}, v AS (SELECT page_path, CASE WHEN max_cosine >= 0.7 THEN 1.0 WHEN max_cosine >= 0.5 THEN 0.5 WHEN max_cosine IS NOT NULL THEN 0.0 END AS v FROM am),
a AS (SELECT page_path, count(*) AS r, count(v) AS n, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM v GROUP BY 1)
SELECT page_path, n, r - n AS n_errors, round(m, 6) AS score, round(greatest(m - 1.96 * s / sqrt(n), 0), 6) AS low, round(least(m + 1.96 * s / sqrt(n), 1), 6) AS high, n > 0 AND r - n <= 0.1 * r AS trustworthy FROM a WHERE n > 0""")
def agg35_summaries(s, d):
    """Claims judged by their cosine: yes from 0.7, partial from 0.5; those without one are errors."""
    c = F.col("max_cosine")
    verdicts = qp._argmax(s, d).select("page_path", F.when(c >= 0.7, "yes").when(c >= 0.5, "partial").when(c.isNotNull(), "no").alias("verdict"))
    out = stats.judge_summary(verdicts, "page_path").where("n > 0")
    return out.select("page_path", "n", "n_errors", *[F.round(x, 6).alias(x) for x in ("score", "low", "high")], "trustworthy")


@query(f"""WITH {bp._RES}, e AS (SELECT DISTINCT src_doc_id, dst_doc_id, dst_path, anchor FROM r WHERE dst_doc_id IS NOT NULL)
SELECT (SELECT count(DISTINCT doc_id) FROM doc_records WHERE active) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM r WHERE dst_doc_id IS NULL AND link_type IS DISTINCT FROM 'url') AS n_unresolved""")
def top6_graph_totals(s, d):
    return store.to_graph_page(s, bp._resolved(s, d), table(s, d, "doc_records"))["totals"]


@query("""SELECT layer, count(DISTINCT doc_id) AS n FROM doc_records WHERE active GROUP BY 1 UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM embed_queue
UNION ALL SELECT 'links', count(DISTINCT link_id) FROM links UNION ALL SELECT 'vectors', count(DISTINCT vec_id) FROM vec_index WHERE version_id = 2 UNION ALL SELECT 'tasks', count(DISTINCT task_id) FROM tasks""")
def top10_status(s, d):
    """Counts of the whole base."""
    one = lambda name, df, key: df.agg(F.count_distinct(key).alias("n")).select(F.lit(name).alias("layer"), "n")
    out = table(s, d, "doc_records").where("active").groupBy("layer").agg(F.count_distinct("doc_id").alias("n"))
    for name, t, key in (("chunks", table(s, d, "embed_queue"), "chunk_id"), ("links", table(s, d, "links"), "link_id"), ("vectors", table(s, d, "vec_index").where("version_id = 2"), "vec_id"), ("tasks", table(s, d, "tasks"), "task_id")):
        out = out.unionByName(one(name, t, key))
    return out


@query(r"""SELECT id, CASE WHEN x = '' THEN 'untitled' ELSE x END AS slug, c AS language FROM (SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\x00-\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS x,
CASE WHEN n + a = 0 THEN 'other' WHEN n / (n + a) > 0.3 THEN 'cjk' ELSE 'en' END AS c FROM (SELECT id, title, len(regexp_extract_all(substr(body, 1, 200), '""" + bp.CJK + r"""')) AS n, len(regexp_extract_all(substr(body, 1, 200), '[A-Za-z]')) AS a FROM knowledge_pages WHERE title IS NOT NULL AND body IS NOT NULL))""")
def udf8_sql_functions(s, d):
    """The functions as SQL sees them."""
    functions.register(s)
    table(s, d, "knowledge_pages").createOrReplaceTempView("pages_for_sql")
    return s.sql("SELECT DISTINCT id, page_slug(title) AS slug, text_language(body) AS language FROM pages_for_sql WHERE title IS NOT NULL AND body IS NOT NULL")


@query("""SELECT task_id, CASE WHEN status IN ('pending', 'running') THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM (SELECT DISTINCT * FROM tasks) GROUP BY ALL""")
def stm8_cancelled(s, d):
    """Every task asked to stop at once."""
    from scriptoria.operators import tape

    t = table(s, d, "tasks").distinct()
    return tape.cancelled(t, t.select("task_id")).groupBy("task_id", "status").agg(F.count("*").alias("n"))


@query("""SELECT source_path, arg_max(CASE WHEN max_cosine >= 0.5 THEN 'done' ELSE 'failed' END, claim_id) AS action FROM (SELECT DISTINCT claim_id, source_path, max_cosine FROM grounding_claims WHERE source_path IS NOT NULL) GROUP BY 1""")
def stm9_source_state(s, d):
    """The last marker of every source; a claim that holds marks it done."""
    from scriptoria.operators import tape

    m = table(s, d, "grounding_claims").where("source_path IS NOT NULL").select("claim_id", "source_path", F.when(F.col("max_cosine") >= 0.5, "done").otherwise("failed").alias("action")).distinct()
    return tape.marker_state(m, "source_path", "action", ["claim_id"])


@query("SELECT chunk_id FROM (SELECT DISTINCT chunk_id FROM embed_queue) WHERE chunk_id NOT IN (SELECT chunk_id FROM vec_index WHERE version_id = 1 AND chunk_id IS NOT NULL AND embedding IS NOT NULL)")
def stm4_resume(s, d):
    """What a run for version 1 would have to embed first."""
    return store.pending_vectors(table(s, d, "embed_queue").select("chunk_id").distinct(), table(s, d, "vec_index"), "chunk_id", 1)
