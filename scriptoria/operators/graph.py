"""Links, provenance and titles: who points where, and what it resolves to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.text import nfkc, casefold, path_key

EDGE_MARKS = r"""[.,!?;:"'()\[\]{}<>。、《》〈〉「」『』【】“”‘’]+"""


def index_title(c):
    """Title as the index holds it: compatible, folded, words without punctuation at their ends."""
    words = F.transform(F.split(casefold(nfkc(c)), r"\s+"), lambda w: F.regexp_replace(w, f"^{EDGE_MARKS}|{EDGE_MARKS}$", ""))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def lookup_title(c):
    """Title as it is asked for: the index form with one plural s less on the last word."""
    return F.regexp_replace(index_title(c), r"(?<=(?:^| )[a-z]{2,60}[a-rt-z])s$", "")


def title_universe(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(title, path) and (title_key, path) of titles that name exactly one path."""
    rows = pages.where("title IS NOT NULL").select("title", "path").distinct()
    one = lambda c, n: rows.groupBy(c.alias(n)).agg(F.min("path").alias("path"), F.count_distinct("path").alias("n"))
    return one(F.col("title"), "title"), one(index_title(F.col("title")), "title_key").where("n = 1").drop("n")


def resolve_titles(asked: DataFrame, pages: DataFrame, strict: bool = False) -> DataFrame:
    """``asked`` (title) with path and how: exact, fuzzy, or null for neither. ``strict`` refuses ambiguous exact titles."""
    exact, fuzzy = title_universe(pages)
    exact, fuzzy = exact.withColumnRenamed("path", "exact_path"), fuzzy.withColumnRenamed("path", "fuzzy_path")
    out = asked.join(exact, "title", "left").withColumn("title_key", lookup_title(F.col("title"))).join(fuzzy, "title_key", "left")
    hit = F.when(F.col("n") == 1, F.col("exact_path"))
    soft = F.when(F.col("n") >= 2, None).otherwise(F.col("fuzzy_path")) if strict else F.col("fuzzy_path")
    return out.select(*asked.columns, F.coalesce(hit, soft).alias("path"), F.when(hit.isNotNull(), "exact").when(soft.isNotNull(), "fuzzy").alias("how"))


def outgoing(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Page links with the document they lead to, by path key: source before knowledge before wisdom; null if none is active."""
    layer_no = F.array_position(F.array(F.lit("source"), F.lit("knowledge"), F.lit("wisdom")), F.col("layer"))
    best = docs.groupBy("path_key").agg(F.min_by(F.struct("doc_id", "active"), layer_no).alias("t"))
    out = links.withColumn("path_key", path_key(F.col("dst_path"))).join(best, "path_key", "left")
    return out.select(*links.columns, F.when(F.col("t.active"), F.col("t.doc_id")).alias("dst_doc_id"))


def incoming(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(link_id, src_doc_id, dst_doc_id): links to a document's exact path from active documents."""
    live = docs.where("active").select(F.col("doc_id").alias("src_doc_id")).distinct()
    target = docs.select(F.col("doc_id").alias("dst_doc_id"), F.col("path").alias("dst_path")).distinct()
    return links.join(live, "src_doc_id", "left_semi").join(target, "dst_path").select("link_id", "src_doc_id", "dst_doc_id").distinct()


def both_ways(resolved: DataFrame, coming: DataFrame, limit: int) -> DataFrame:
    """(doc_id, way, other, link_id): at most ``limit`` links of a document in each direction, by link."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    out = resolved.where("dst_doc_id IS NOT NULL").select(F.col("src_doc_id").alias("doc_id"), F.lit("out").alias("way"), F.col("dst_doc_id").alias("other"), "link_id")
    every = out.unionByName(coming.select(F.col("dst_doc_id").alias("doc_id"), F.lit("in").alias("way"), F.col("src_doc_id").alias("other"), "link_id"))
    w = Window.partitionBy("doc_id", "way").orderBy("link_id")
    return every.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


def inbound(links: DataFrame) -> DataFrame:
    """Wikilinks per exact target path, occurrences counted."""
    return links.where("link_type = 'wikilink' AND dst_path IS NOT NULL").groupBy("dst_path").agg(F.count("*").alias("n_inbound"))


def edges(resolved: DataFrame) -> DataFrame:
    """Weight per source, target, target text and anchor (a null anchor is a group)."""
    return resolved.where("dst_doc_id IS NOT NULL").groupBy("src_doc_id", "dst_doc_id", "dst_path", "anchor").agg(F.count("*").alias("weight"))


def degrees(edge_rows: DataFrame) -> DataFrame:
    """Distinct connected documents per document, in and out."""
    pairs = edge_rows.select("src_doc_id", "dst_doc_id").distinct()
    out = pairs.groupBy(F.col("src_doc_id").alias("doc_id")).agg(F.count("*").alias("n_out"), F.lit(0).alias("n_in"))
    inn = pairs.groupBy(F.col("dst_doc_id").alias("doc_id")).agg(F.lit(0).alias("n_out"), F.count("*").alias("n_in"))
    return out.unionByName(inn).groupBy("doc_id").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))


def neighbours(seeds: DataFrame, links: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, edge_count): chunks one wikilink away from the seed chunks, by exact path, join rows counted; no seeds."""
    start = seeds.join(chunks, "chunk_id").select("doc_id")
    target = docs.where("active").select(F.col("doc_id").alias("dst_doc"), F.col("path").alias("dst_path"))
    hops = start.join(links.where("link_type = 'wikilink'"), F.col("doc_id") == F.col("src_doc_id")).select("dst_path").join(target, "dst_path")
    return hops.join(chunks, F.col("dst_doc") == chunks["doc_id"]).groupBy("chunk_id").agg(F.count("*").alias("edge_count")).join(seeds, "chunk_id", "left_anti")


def provenance(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, source_path, source_key, resolved): first spelling per key; resolved means an active source document has the key."""
    rows = pages.select("id", F.posexplode("sources").alias("pos", "source_path")).where("trim(source_path) <> ''").withColumn("source_key", path_key(F.col("source_path")))
    w = Window.partitionBy("id", "source_key").orderBy("pos", "source_path")
    first = rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "source_path", "source_key")
    live = docs.where("active AND layer = 'source'").select(F.col("path_key").alias("source_key"), F.lit(True).alias("resolved")).distinct()
    return first.join(live, "source_key", "left").select("id", "source_path", "source_key", F.coalesce("resolved", F.lit(False)).alias("resolved"))
