"""Search over chunks and pages with all legs, its modes, and the pages it leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators import search as op
from scriptoria.session import table


def _base(s: SparkSession, d: str) -> op.Base:
    """Chunks of the queue (c...), and every knowledge page as a chunk of its own (its id)."""
    queue = table(s, d, "embed_queue").select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("chunk_id"), "doc_id", "seq", "text")
    pages = table(s, d, "knowledge_pages").select("id", "path", "body").distinct()
    reg = table(s, d, "doc_records").select("doc_id", "path", "title", "layer", "active")
    known = reg.where("layer = 'knowledge'").select("doc_id", F.col("path").alias("p")).distinct()
    own = pages.join(known, pages.path == known.p).select(F.col("id").alias("chunk_id"), "doc_id", F.lit(0).alias("seq"), F.col("body").alias("text"))
    docs = reg.groupBy("doc_id", "path", "layer").agg(F.max("title").alias("title"), F.max("active").alias("active"))
    vec = table(s, d, "vec_index").where("version_id = 2 AND owner_kind = 'chunk' AND chunk_id IS NOT NULL")
    vec = vec.select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("chunk_id"), F.col("embedding").alias("vec"))
    return op.Base(queue.unionByName(own).distinct(), docs, vec, table(s, d, "links").distinct())


def _queries(s: SparkSession, d: str) -> DataFrame:
    vec = table(s, d, "vec_index").where("version_id = 2").select("vec_id", F.col("embedding").alias("vec")).dropDuplicates(["vec_id"])
    claims = table(s, d, "grounding_claims").select("claim_id", "vec_id", "claim").distinct()
    return claims.join(vec, "vec_id", "left").select(F.col("claim_id").alias("query_id"), F.col("claim").alias("q"), "vec")


COLS = ["query_id", "rank", "score", "chunk_id", "doc_id", "path", "layer", "seq"]


def top2_hybrid(s, d):
    """Words, vectors and links of the graph; ten chunks per query."""
    return op.search(_queries(s, d), _base(s, d), graph=True).select(*COLS, "snippet")


def top2_combsum(s, d):
    return op.search(_queries(s, d), _base(s, d), graph=True, fusion="combsum").select(*COLS)


def top11_bm25_knowledge(s, d):
    """The word leg alone, among active pages of the knowledge layer."""
    return op.search(_queries(s, d), _base(s, d), mode="bm25", layer="knowledge").select(*COLS)


def top11_vector_source(s, d):
    return op.search(_queries(s, d), _base(s, d), mode="vector", layer="source").select(*COLS)


def top1_retrieve(s, d):
    """Five chunks per query, as pages."""
    return op.retrieve(_queries(s, d), _base(s, d), graph=True)[1]


QUERIES = {f.__name__: f for f in (top2_hybrid, top2_combsum, top11_bm25_knowledge, top11_vector_source, top1_retrieve)}

_BASE = r"""docs AS (SELECT doc_id, path, layer, max(title) AS title, bool_or(active) AS active FROM doc_records GROUP BY ALL),
chunks AS (SELECT DISTINCT 'c' || chunk_id AS chunk_id, doc_id, seq, text FROM embed_queue
  UNION SELECT p.id, k.doc_id, 0, p.body FROM (SELECT DISTINCT id, path, body FROM knowledge_pages) p JOIN (SELECT DISTINCT doc_id, path FROM doc_records WHERE layer = 'knowledge') k USING (path)),
live AS (SELECT chunk_id, doc_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM docs WHERE active{layer})),
claims AS (SELECT DISTINCT claim_id, vec_id, claim FROM grounding_claims),
terms AS (SELECT DISTINCT claim_id AS query_id, lower(w) AS term FROM (SELECT claim_id, unnest(regexp_extract_all(claim, '[\p{{L}}\p{{N}}_]+')) AS w FROM claims) WHERE upper(w) NOT IN ('AND', 'OR', 'NOT', 'NEAR')),
sized AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM chunks WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM sized),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM sized) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
words0 AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM terms JOIN post USING (term) JOIN dfs USING (term), stats WHERE chunk_id IN (SELECT chunk_id FROM live) GROUP BY query_id, chunk_id),
words AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM words0) WHERE rank <= 40),
vec AS (SELECT DISTINCT vec_id, owner_kind, chunk_id, CAST(embedding AS DOUBLE[64]) AS e FROM vec_index
  WHERE version_id = 2 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT claim_id AS query_id, 'c' || v.chunk_id AS chunk_id, max(round(array_cosine_similarity(q.e, v.e), 6)) AS score
  FROM claims JOIN vec q USING (vec_id), vec v WHERE v.owner_kind = 'chunk' AND 'c' || v.chunk_id IN (SELECT chunk_id FROM live) GROUP BY ALL),
vectors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near) WHERE rank <= 40),
seed0 AS (SELECT query_id, chunk_id, min(rank * 10 + leg) AS pos FROM (SELECT query_id, chunk_id, rank, 0 AS leg FROM vectors WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM words WHERE rank <= 20) GROUP BY ALL),
seeds AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id) AS n FROM seed0) WHERE n <= 20),
hops AS (SELECT s.query_id, t.doc_id FROM seeds s JOIN chunks c USING (chunk_id) JOIN (SELECT DISTINCT * FROM links) l ON l.src_doc_id = c.doc_id AND l.link_type = 'wikilink' JOIN docs t ON t.path = l.dst_path AND t.active),
graph0 AS (SELECT query_id, chunk_id, CAST(count(*) AS DOUBLE) AS score FROM hops JOIN live USING (doc_id) GROUP BY ALL),
graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM graph0 WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM seeds)) WHERE rank <= 40),
legs AS ({legs}),
norm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM legs WINDOW w AS (PARTITION BY query_id, leg_no)),
fused0 AS (SELECT query_id, chunk_id, round({fuse}, 6) AS score, min(leg_no * 1000 + rank) AS seen FROM norm GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS r0 FROM fused0),
div0 AS (SELECT query_id, chunk_id, doc_id, seq, text, r0, round(score / (1 + 0.3 * (row_number() OVER (PARTITION BY query_id, doc_id ORDER BY r0) - 1)), 6) AS score FROM fused JOIN chunks USING (chunk_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank FROM div0),
shown AS (SELECT query_id, rank, score, chunk_id, doc_id, path, layer, seq, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n', ' ', 'g') AS flat FROM hits LEFT JOIN docs USING (doc_id))"""
_LEG = "SELECT query_id, chunk_id, score, rank, {1} AS leg_no, {2} AS weight FROM {0}"
_ALL = " UNION ALL ".join(_LEG.format(*x) for x in (("words", 0, 0.3), ("vectors", 1, 1.5), ("graph", 2, 0.3)))
_RRF = "sum(weight / (60 + rank))"
_C = "query_id, rank, score, chunk_id, doc_id, path, layer, seq"


def _sql(tail: str, legs: str = _ALL, fuse: str = _RRF, layer: str = "") -> str:
    return "WITH " + _BASE.format(legs=legs, fuse=fuse, layer=layer) + tail


SQL = {
    "top2_hybrid": _sql(f" SELECT {_C}, CASE WHEN length(flat) > 240 THEN substr(flat, 1, 240) || '…' ELSE flat END AS snippet FROM shown WHERE rank <= 10"),
    "top2_combsum": _sql(f" SELECT {_C} FROM shown WHERE rank <= 10", fuse="sum(weight * norm)"),
    "top11_bm25_knowledge": _sql(f" SELECT {_C} FROM shown WHERE rank <= 10", legs=_LEG.format("words", 0, 0.3), layer=" AND layer = 'knowledge'"),
    "top11_vector_source": _sql(f" SELECT {_C} FROM shown WHERE rank <= 10", legs=_LEG.format("vectors", 0, 1.5), layer=" AND layer = 'source'"),
    "top1_retrieve": _sql(""", p AS (SELECT query_id, path, max(score) AS score, min(rank) AS f, list(chunk_id ORDER BY rank) AS chunk_ids FROM shown WHERE rank <= 5 AND path IS NOT NULL GROUP BY ALL)
SELECT query_id, path, score, chunk_ids, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS rank FROM p"""),
}
