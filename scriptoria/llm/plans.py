"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import knn, mixing, neardup, pii, plain, split, tokens
from scriptoria.session import cut, table

BODY = (4000, 400)
CHUNK = (1600, 160)


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bodies = table(spark, d, "doc_records").select(F.lit("doc_records").alias("item_table"), F.col("doc_id").alias("item_id"), F.col("body").alias("text"))
    chunks = table(spark, d, "embed_queue").select(F.lit("embed_queue").alias("item_table"), F.col("chunk_id").cast("string").alias("item_id"), "text")
    return bodies, chunks


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that the cutting expression has to cut; an item delivered twice counts once."""
    bodies, chunks = (df.where(F.size(split.cuts(F.col("text"), *size)) > 1) for df, size in zip(_items(spark, d), (BODY, CHUNK)))
    return bodies.unionByName(chunks).select("item_table", "item_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all bodies and chunk texts."""
    bodies, chunks = (split.split(df.dropDuplicates(), "text", *size) for df, size in zip(_items(spark, d), (BODY, CHUNK)))
    return bodies.unionByName(chunks)


def _joined(limit: int, overlap: int):
    def step(a, x):
        n, lap = F.length(x["piece"]), a["end"] - x["start_pos"]
        ok = a["ok"] & (n <= limit) & (lap == F.least(F.lit(overlap), a["end"])) & (n > lap)
        return F.struct((x["start_pos"] + n).alias("end"), F.concat(a["text"], F.substring(x["piece"], lap + 1, n)).alias("text"), ok.alias("ok"))

    return step


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every item put together again from its pieces, and whether each piece keeps limit and overlap."""
    out = None
    for df, (limit, overlap) in zip(_items(spark, d), (BODY, CHUNK)):
        made = df.where("text <> ''").dropDuplicates().select("item_table", "item_id", F.xxhash64("text").alias("version"), split.pieces(F.col("text"), limit, overlap).alias("p"))
        whole = F.aggregate("p", F.expr("named_struct('end', 0, 'text', '', 'ok', true)"), _joined(limit, overlap))
        rows = made.select("item_table", "item_id", whole.alias("w")).select("item_table", "item_id", F.sha2("w.text", 256).alias("text_hash"), F.col("w.ok").alias("kept"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _forms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, field_name, value) of all pages and (field_name, value, plain, is_case) of their distinct values."""
    pages = table(spark, d, "knowledge_pages")
    long = pages.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("category", "title")])).alias("p")).select("id", "p.*")
    long = long.where("value IS NOT NULL").distinct()
    field = lambda f: long.where(F.col("field_name") == f).select("value")
    tree = table(spark, d, "category_tree").select(F.col("category").alias("value")).where("value IS NOT NULL").distinct()
    titles = field("title")
    every = cut(plain.plain_forms(titles.unionByName(field("category")).unionByName(tree)))
    titles = every.join(titles.distinct(), "value", "left_semi").select(F.lit("title").alias("field_name"), "value", "plain", (F.col("plain") != F.col("value")).alias("is_case"))
    tree = every.join(tree, "value", "left_semi").select("skeleton", F.col("value").alias("spelling"))
    forms = every.join(field("category").distinct(), "value", "left_semi").join(tree, "skeleton", "left")
    reads_like = F.col("spelling").isNotNull() & (plain.folded(F.col("value")) != plain.folded(F.col("spelling")))
    cats = forms.select(F.lit("category").alias("field_name"), "value", F.coalesce("spelling", "plain").alias("plain"), ((F.col("plain") != F.col("value")) | F.coalesce(reads_like, F.lit(False))).alias("is_case"))
    return long, titles.unionByName(cats)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages and fields that are not in plain form."""
    long, forms = _forms(spark, d)
    return long.join(forms.where("is_case"), ["field_name", "value"], "left_semi").select("id", "field_name").distinct()


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every category and title with its one consistent form (category_tree's spelling where it reads alike)."""
    long, forms = _forms(spark, d)
    return long.join(forms.drop("is_case"), ["field_name", "value"], "left").select("id", "field_name", "value", F.coalesce("plain", "value").alias("plain"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a cosine of 0.82 or more, one among the five most similar of the other."""
    near = knn.neighbours(table(spark, d, "vec_index"), "vec_id", "embedding", "version_id", min_cos=0.82)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def p4_forest(spark: SparkSession, d: str) -> DataFrame:
    """``p4_found`` by a forest of many small leaves, some split again, so that it is no whole scan on small tables either."""
    near = knn.neighbours(table(spark, d, "vec_index"), "vec_id", "embedding", "version_id", min_cos=0.82, leaf_rows=60, sample_rows=100, block=300)
    return near.select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 100, against all of its version."""
    near = knn.neighbours(table(spark, d, "vec_index"), "vec_id", "embedding", "version_id", queries=lambda i: i % 100 == 0, exact=True)
    return near.select("id", "neighbour", F.round("cosine", 5).alias("cosine"))


#: TESTDATA's definition: runs of three words, at least half of them shared; no pair lies between 0.4 and 0.6.
ALIKE = {"threshold": 0.5, "sure": 0.6}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages whose bodies share at least half of their runs of three words."""
    reps, members = neardup.classes(table(spark, d, "knowledge_pages"), "id", "body", 3)
    return neardup.expand_pairs(neardup.similar_pairs(reps, **ALIKE), members).distinct()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its class of equal texts, its group of similar ones and its number of links."""
    out = neardup.groups(table(spark, d, "knowledge_pages"), "id", "body", words=3, **ALIKE)
    return out.select(F.col("member").alias("id"), "rep", F.col("component").alias("group_id"), "links")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k; null and empty texts have the empty list."""
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """For each mix the documents chosen and how often."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).selection


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Targets and what was reached."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report()


def p7_even_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same where the mix is made smaller until every source that has documents fills its share."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), keep="shares").report()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with its kind and the place of its first character."""
    found = pii.mentions(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "people_names"))
    return found.select(F.col("key").alias("doc_id"), F.explode("mentions").alias("m")).select("doc_id", "m.kind", "m.start_pos")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text with typed placeholders."""
    return pii.redacted(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "people_names")).withColumnRenamed("key", "doc_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rebuilt": p2_rebuilt, "p3_found": p3_found, "p3_forms": p3_forms, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_forest": p4_forest, "p5_found": p5_found, "p5_groups": p5_groups, "p6_ids": p6_ids, "p7_selection": p7_selection, "p7_shares": p7_shares, "p7_even_shares": p7_even_shares, "p8_found": p8_found, "p8_redacted": p8_redacted}

_V = """v AS (SELECT DISTINCT vec_id, version_id, CAST(embedding AS DOUBLE[64]) AS e FROM vec_index
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

_RUNS = r"""w AS (SELECT DISTINCT id, regexp_extract_all(lower(body), '[\p{Han}\p{Hiragana}\p{Katakana}]|[^\P{L}\p{Han}\p{Hiragana}\p{Katakana}]+(?:[^\P{L}\p{Han}\p{Hiragana}\p{Katakana}]|\p{N})*|\p{N}+(?:[^\P{L}\p{Han}\p{Hiragana}\p{Katakana}]|\p{N})*') AS w FROM knowledge_pages WHERE trim(body) <> ''),
s AS (SELECT DISTINCT id, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL)"""

SQL = {
    "p2_found": """SELECT DISTINCT 'doc_records' AS item_table, doc_id AS item_id FROM doc_records WHERE length(body) > 4000
UNION SELECT DISTINCT 'embed_queue', CAST(chunk_id AS VARCHAR) FROM embed_queue WHERE length(text) > 1600""",
    "p4_found": f"""WITH {_V}, c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(array_cosine_similarity(a.e, b.e), 12) AS s
  FROM v a JOIN v b ON a.version_id = b.version_id AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM c)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE n <= 5 AND s >= 0.82""",
    "p4_forest": f"""WITH {_V}, c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(array_cosine_similarity(a.e, b.e), 12) AS s
  FROM v a JOIN v b ON a.version_id = b.version_id AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM c)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE n <= 5 AND s >= 0.82""",
    "p4_neighbours": f"""WITH {_V}, c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(array_cosine_similarity(a.e, b.e), 12) AS s
  FROM v a JOIN v b ON a.version_id = b.version_id AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM c)
SELECT a AS id, b AS neighbour, round(s, 5) AS cosine FROM r WHERE n <= 5""",
    "p5_found": f"WITH {_RUNS} SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.5 * (x.n + y.n - c)",
    "p5_groups": f"""WITH RECURSIVE {_RUNS}, cls AS (SELECT id, min(id) OVER (PARTITION BY k) AS rep FROM (SELECT id, list_sort(list(s)) AS k FROM s GROUP BY id)),
pairs AS (SELECT id_a AS a, id_b AS b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.5 * (x.n + y.n - c) AND id_a IN (SELECT rep FROM cls) AND id_b IN (SELECT rep FROM cls)),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT cls.id, rep, coalesce((SELECT min(least(a, b)) FROM reach WHERE a = rep), rep) AS group_id, (SELECT count(*) FROM e WHERE a = rep) AS links FROM cls""",
    "p2_rebuilt": """SELECT DISTINCT 'doc_records' AS item_table, doc_id AS item_id, sha256(body) AS text_hash, true AS kept FROM doc_records WHERE body <> ''
UNION ALL SELECT DISTINCT 'embed_queue', CAST(chunk_id AS VARCHAR), sha256(text), true FROM embed_queue WHERE text <> ''""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
