"""References of links, page sources and task events, held against documents and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import text
from scriptoria.operators import orphans as op
from scriptoria.session import table


def _path_refs(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links").where("link_type IS NULL OR link_type <> 'url'").select(
        F.lit("links").alias("ref_table"), F.col("link_id").cast("string").alias("rec_id"), F.col("dst_path").alias("ref_key"), F.col("seen_at").alias("at")
    )
    pages = table(spark, d, "knowledge_pages").select("id", "updated", F.explode("sources").alias("ref_key")).select(
        F.lit("knowledge_pages").alias("ref_table"), F.col("id").alias("rec_id"), "ref_key", F.col("updated").alias("at")
    )
    return links.unionByName(pages).where(text.has_ink(F.col("ref_key"))).withColumn("key", text.path_key(F.col("ref_key")))


def _task_refs(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "task_events")
        .select(F.lit("task_events").alias("ref_table"), F.col("event_id").cast("string").alias("rec_id"), F.col("task_id").alias("ref_key"), F.col("ts").alias("at"))
        .where(text.has_ink(F.col("ref_key")))
        .withColumn("key", F.col("ref_key"))
    )


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "doc_records").where("active").select(F.col("path_key").alias("key"), F.col("first_seen").alias("since"))
    tasks = table(spark, d, "tasks").select(F.col("task_id").alias("key"), F.col("created_at").alias("since"))
    found = op.orphans(_path_refs(spark, d), docs).unionByName(op.orphans(_task_refs(spark, d), tasks))
    return found.select("ref_table", "rec_id", "ref_key", "at").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per record and stored reference without a target at its time; a row delivered twice counts once."""
    return _orphans(spark, d).select("ref_table", "rec_id", "ref_key").distinct()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per table and month of the reference."""
    month = F.date_format("at", "yyyy-MM").alias("ref_month")
    all_refs = _path_refs(spark, d).drop("key").unionByName(_task_refs(spark, d).drop("key")).distinct()
    total = all_refs.groupBy("ref_table", month).agg(F.count("*").alias("n_refs"))
    found = _orphans(spark, d).groupBy("ref_table", month).agg(F.count("*").alias("n_orphans"))
    same = (total.ref_table == found.ref_table) & total.ref_month.eqNullSafe(found.ref_month)
    return total.join(found, same, "left").select(total.ref_table, total.ref_month, "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))


def p1_foreign_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose integer chunk_id is in no run of the chunks of active documents."""
    live = table(spark, d, "doc_records").where("active").select("doc_id")
    chunks = table(spark, d, "embed_queue").join(live, "doc_id", "left_semi").select("chunk_id")
    return op.integer_orphans(table(spark, d, "vec_index").select("vec_id", "chunk_id").distinct(), chunks, "chunk_id")


_FOLD = "replace(replace(replace(replace(replace(lower(nfc_normalize(replace({0}, chr(92), '/'))), 'ß', 'ss'), 'ς', 'σ'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"
_REFS = f"""
refs AS (
  SELECT 'links' AS ref_table, CAST(link_id AS VARCHAR) AS rec_id, dst_path AS ref_key, seen_at AS ref_at, {_FOLD.format('dst_path')} AS k
  FROM links WHERE link_type IS DISTINCT FROM 'url' AND trim(dst_path) <> ''
  UNION
  SELECT 'knowledge_pages', id, s, updated, {_FOLD.format('s')}
  FROM (SELECT id, updated, unnest(sources) AS s FROM knowledge_pages) WHERE trim(s) <> ''
  UNION
  SELECT 'task_events', CAST(event_id AS VARCHAR), task_id, ts, task_id FROM task_events WHERE trim(task_id) <> ''
),
parents AS (
  SELECT 'path' AS what, path_key AS k, min(first_seen) AS since FROM doc_records WHERE active GROUP BY path_key
  UNION ALL SELECT 'task', task_id, min(created_at) FROM tasks GROUP BY task_id
),
lost AS (
  SELECT r.* FROM refs r LEFT JOIN parents p
    ON p.k = r.k AND p.what = CASE WHEN r.ref_table = 'task_events' THEN 'task' ELSE 'path' END AND p.since <= r.ref_at
  WHERE p.k IS NULL
)"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_foreign_chunks": p1_foreign_chunks}
SQL = {
    "p1_found": f"WITH {_REFS} SELECT DISTINCT ref_table, rec_id, ref_key FROM lost",
    "p1_counts": f"""WITH {_REFS}, a AS (SELECT ref_table, strftime(ref_at, '%Y-%m') AS m, count(*) AS n FROM refs GROUP BY 1, 2),
b AS (SELECT ref_table, strftime(ref_at, '%Y-%m') AS m, count(*) AS n FROM lost GROUP BY 1, 2)
SELECT a.ref_table, a.m AS ref_month, a.n AS n_refs, coalesce(b.n, 0) AS n_orphans
FROM a LEFT JOIN b ON a.ref_table = b.ref_table AND a.m IS NOT DISTINCT FROM b.m""",
    "p1_foreign_chunks": "SELECT DISTINCT vec_id, chunk_id FROM vec_index WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT c.chunk_id FROM embed_queue c WHERE doc_id IN (SELECT doc_id FROM doc_records WHERE active))",
}
