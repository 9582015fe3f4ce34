"""Claims as queries over the chunk queue: words, vectors, fusion, pages, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators import retrieval as op
from scriptoria.session import table

#: Rows per leg; the fused list of an evaluation is cut to EVAL.
DEEP, EVAL = 40, 100


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embed_queue").distinct()


def _claims(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "grounding_claims").select("claim_id", "vec_id", "source_path", "claim").distinct()


def _queries(s: SparkSession, d: str) -> DataFrame:
    return _claims(s, d).select(F.col("claim_id").alias("query_id"), F.col("claim").alias("q"))


def _words(s: SparkSession, d: str, k: int = DEEP) -> DataFrame:
    return op.bm25(_queries(s, d), _chunks(s, d), k)


def _vectors(s: SparkSession, d: str, k: int = DEEP) -> DataFrame:
    vec = table(s, d, "vec_index").where("version_id = 2").select("vec_id", "owner_kind", "chunk_id", F.col("embedding").alias("vec")).dropDuplicates(["vec_id"])
    asked = _claims(s, d).join(vec, "vec_id").select(F.col("claim_id").alias("query_id"), "vec")
    return op.knn(asked, vec.where("owner_kind = 'chunk' AND chunk_id IS NOT NULL").select("chunk_id", "vec"), k)


def _legs(s: SparkSession, d: str) -> DataFrame:
    return op.legs(bm25=(_words(s, d), 0.3), vector=(_vectors(s, d), 1.5))


COLS = ["query_id", "chunk_id", "score", "rank"]


def agg38_bm25(s, d):
    return _words(s, d, 10).select(*COLS)


def join3_knn(s, d):
    return _vectors(s, d, 10).select(*COLS)


def agg2_rrf(s, d):
    return op.rrf(_legs(s, d)).where("rank <= 10").select(*COLS)


def agg4_combsum(s, d):
    return op.comb(_legs(s, d)).where("rank <= 10").select(*COLS)


def agg5_combmnz(s, d):
    return op.comb(_legs(s, d), mnz=True).where("rank <= 10").select(*COLS)


def agg3_minmax(s, d):
    return op.normalised(_legs(s, d)).select("query_id", "leg", "chunk_id", F.round("norm", 5).alias("norm"))


def win2_diversity(s, d):
    docs = _chunks(s, d).select("chunk_id", "doc_id")
    return op.diversify(op.rrf(_legs(s, d)), docs).where("rank <= 10").select(*COLS, "doc_id")


def agg6_page_refs(s, d):
    docs = table(s, d, "doc_records").where("active").select("doc_id", "path").distinct()
    hits = op.rrf(_legs(s, d)).where("rank <= 10").join(_chunks(s, d).select("chunk_id", "doc_id"), "chunk_id").join(docs, "doc_id", "left")
    return op.page_refs(hits)


def win9_round_robin(s, d):
    return op.interleave(vector=_vectors(s, d), bm25=_words(s, d)).where("rank <= 20")


def win3_best_per_doc(s, d):
    hits = _words(s, d).join(_chunks(s, d).select("chunk_id", "doc_id"), "chunk_id")
    first = hits.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("chunk_id", "score", "rank"), "rank").alias("h"))
    return first.select("query_id", "doc_id", "h.chunk_id", "h.score", "h.rank")


def sort11_best_match(s, d):
    return _vectors(s, d, 1).select("query_id", F.col("score").alias("best_match"))


def _doc_ranks(s, d):
    paths = table(s, d, "doc_records").select("doc_id", F.col("path").alias("key")).distinct()
    hits = op.rrf(_legs(s, d)).where(F.col("rank") <= EVAL).join(_chunks(s, d).select("chunk_id", "doc_id"), "chunk_id").join(paths, "doc_id")
    first = hits.groupBy("query_id", "key").agg(F.min("rank").alias("r"))
    from pyspark.sql import Window

    return first.select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "key")).alias("rank"))


def agg12_metrics(s, d):
    relevant = _claims(s, d).where("source_path IS NOT NULL").select(F.col("claim_id").alias("query_id"), F.col("source_path").alias("key"))
    m = op.rank_metrics(_doc_ranks(s, d), relevant)
    return m.select("query_id", "n_rel", "hit3", "hit", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


def agg16_mean_metrics(s, d):
    m = agg12_metrics(s, d)
    return m.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("hit3", "hit", "rr", "ndcg", "recall")])


def src25_embedding(s, d):
    e = op.hashed_embedding(table(s, d, "documents"), "doc_id", "text")
    return e.select(F.col("key").alias("doc_id"), "bucket", F.round("weight", 6).alias("weight"))


def str1_query_terms(s, d):
    return _queries(s, d).select("query_id", F.array_join(op.query_terms(F.col("q")), " OR ").alias("terms"))


QUERIES = {f.__name__: f for f in (agg38_bm25, join3_knn, agg2_rrf, agg3_minmax, agg4_combsum, agg5_combmnz, win2_diversity, agg6_page_refs, win9_round_robin, win3_best_per_doc, sort11_best_match, agg12_metrics, agg16_mean_metrics, src25_embedding, str1_query_terms)}

_BASE = r"""chunks AS (SELECT DISTINCT * FROM embed_queue),
claims AS (SELECT DISTINCT claim_id, vec_id, source_path, claim FROM grounding_claims),
terms AS (SELECT DISTINCT claim_id AS query_id, lower(w) AS term FROM (SELECT claim_id, unnest(regexp_extract_all(claim, '[\p{L}\p{N}_]+')) AS w FROM claims) WHERE upper(w) NOT IN ('AND', 'OR', 'NOT', 'NEAR')),
sized AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM chunks WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM sized),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM sized) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
words_all AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM terms JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY query_id, chunk_id),
words AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM words_all),
vec AS (SELECT DISTINCT vec_id, owner_kind, chunk_id, CAST(embedding AS DOUBLE[64]) AS e FROM vec_index
  WHERE version_id = 2 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (SELECT claim_id AS query_id, v.chunk_id, max(round(array_cosine_similarity(q.e, v.e), 6)) AS score
  FROM claims JOIN vec q USING (vec_id), vec v WHERE v.owner_kind = 'chunk' AND v.chunk_id IS NOT NULL GROUP BY ALL),
vectors AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near),
legs AS (SELECT query_id, chunk_id, score, rank, 'bm25' AS leg, 0 AS leg_no, 0.3 AS weight FROM words WHERE rank <= 40
  UNION ALL SELECT query_id, chunk_id, score, rank, 'vector', 1, 1.5 FROM vectors WHERE rank <= 40),
rrf0 AS (SELECT query_id, chunk_id, round(sum(weight / (60 + rank)), 6) AS score, min(leg_no * 1000 + rank) AS seen FROM legs GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM rrf0),
norm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM legs WINDOW w AS (PARTITION BY query_id, leg))"""


def _q(tail: str) -> str:
    return f"WITH {_BASE}{tail}"


def _comb(score: str) -> str:
    return _q(f""", f AS (SELECT query_id, chunk_id, round({score}, 6) AS score, min(leg_no * 1000 + rank) AS seen FROM norm GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM f) SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10""")


_METRICS = """, paths AS (SELECT DISTINCT doc_id, path FROM doc_records),
dr AS (SELECT query_id, path AS key, min(rank) AS r FROM rrf JOIN chunks USING (chunk_id) JOIN paths USING (doc_id) WHERE rank <= 100 GROUP BY ALL),
ranked AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY r, key) AS rank FROM dr),
rel AS (SELECT DISTINCT claim_id AS query_id, source_path AS key FROM claims WHERE source_path IS NOT NULL),
nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
fnd AS (SELECT query_id, max(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS hit3, max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hit, 1.0 / min(rank) AS rr, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 100) AS nf FROM ranked JOIN rel USING (query_id, key) GROUP BY 1),
m AS (SELECT query_id, n_rel, coalesce(hit3, 0) AS hit3, coalesce(hit, 0) AS hit, round(coalesce(rr, 0), 6) AS rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(coalesce(nf, 0) / n_rel, 6) AS recall FROM nr LEFT JOIN fnd USING (query_id))"""

SQL = {
    "agg38_bm25": _q(" SELECT query_id, chunk_id, score, rank FROM words WHERE rank <= 10"),
    "join3_knn": _q(" SELECT query_id, chunk_id, score, rank FROM vectors WHERE rank <= 10"),
    "agg2_rrf": _q(" SELECT query_id, chunk_id, score, rank FROM rrf WHERE rank <= 10"),
    "agg3_minmax": _q(" SELECT query_id, leg, chunk_id, round(norm, 5) AS norm FROM norm"),
    "agg4_combsum": _comb("sum(weight * norm)"),
    "agg5_combmnz": _comb("sum(weight * norm) * count(*) FILTER (weight <> 0)"),
    "win2_diversity": _q(""", n AS (SELECT query_id, chunk_id, doc_id, rank, round(score / (1 + 0.3 * (row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) - 1)), 6) AS score FROM rrf JOIN chunks USING (chunk_id)),
r AS (SELECT query_id, chunk_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank FROM n) SELECT * FROM r WHERE rank <= 10"""),
    "agg6_page_refs": _q(""", docs AS (SELECT DISTINCT doc_id, path FROM doc_records WHERE active),
p AS (SELECT query_id, path, max(score) AS score, min(rank) AS f, list(chunk_id ORDER BY rank) AS chunk_ids FROM rrf JOIN chunks USING (chunk_id) JOIN docs USING (doc_id) WHERE rank <= 10 GROUP BY ALL)
SELECT query_id, path, score, chunk_ids, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS rank FROM p"""),
    "win9_round_robin": _q(""", f AS (SELECT query_id, chunk_id, min(rank * 10 + 1 - leg_no) AS pos FROM legs GROUP BY ALL),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id) AS rank FROM f) SELECT * FROM r WHERE rank <= 20"""),
    "win3_best_per_doc": _q(" SELECT query_id, doc_id, arg_min(chunk_id, rank) AS chunk_id, arg_min(score, rank) AS score, min(rank) AS rank FROM words JOIN chunks USING (chunk_id) WHERE rank <= 40 GROUP BY query_id, doc_id"),
    "sort11_best_match": _q(" SELECT query_id, score AS best_match FROM vectors WHERE rank = 1"),
    "agg12_metrics": _q(_METRICS + " SELECT * FROM m"),
    "agg16_mean_metrics": _q(_METRICS + " SELECT count(*) AS n_queries, round(avg(hit3), 6) AS mean_hit3, round(avg(hit), 6) AS mean_hit, round(avg(rr), 6) AS mean_rr, round(avg(ndcg), 6) AS mean_ndcg, round(avg(recall), 6) AS mean_recall FROM m"),
    "src25_embedding": """WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(sha1(w), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM b""",
    "str1_query_terms": r"""SELECT DISTINCT claim_id AS query_id, array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END), lambda x: x IS NOT NULL), ' OR ') AS terms
FROM (SELECT claim_id, list_transform(list_filter(regexp_extract_all(claim, '[\p{L}\p{N}_]+'), lambda x: upper(x) NOT IN ('AND', 'OR', 'NOT', 'NEAR')), lambda x: lower(x)) AS w FROM grounding_claims)""",
}
