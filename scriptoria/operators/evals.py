"""Figures about a knowledge base: grounding, coverage, near-duplicates, fidelity, ratios, digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import pages as rules
from scriptoria.operators import graph, retrieval


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; null where either is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def claim_argmax(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, page_path, source_path, max_cosine, best_chunk_seq): every claim against the chunks of its source.

    ``claims``: claim_id, page_path, source_path, vec; ``chunks``: source_path, seq, vec. Ties go to the first chunk. Claims
    without a usable vector or whose source has no chunk with one have null. A popular source is a hot join key, which
    the skew join splits; pairs are folded to one row per claim on the map side.
    """
    c = chunks.where(retrieval.usable_vector(F.col("vec"), 64)).select(F.col("source_path").alias("_s"), "seq", F.col("vec").alias("cv"))
    q = claims.where(retrieval.usable_vector(F.col("vec"), 64)).select("claim_id", F.col("source_path").alias("_p"), F.col("vec").alias("qv"))
    near = q.join(c, F.col("_p") == F.col("_s")).select("claim_id", F.round(cosine(F.col("qv"), F.col("cv")), 6).alias("cos"), "seq")
    best = near.groupBy("claim_id").agg(F.max(F.struct("cos", (-F.col("seq")).alias("minus"))).alias("b"))
    out = claims.select("claim_id", "page_path", "source_path").join(best, "claim_id", "left")
    return out.select("claim_id", "page_path", "source_path", F.col("b.cos").alias("max_cosine"), (-F.col("b.minus")).cast("int").alias("best_chunk_seq"))


def grounding(pages: DataFrame, claims: DataFrame, tau: float) -> DataFrame:
    """(path, n_claims, ratio) of every page: the share of its claims at ``tau`` or more.

    A page without claims counts 1; claims of a source without chunks (null cosine) count as not grounded.
    """
    hit = F.coalesce(F.col("max_cosine") >= tau, F.lit(False)).cast("double")
    per_page = claims.groupBy(F.col("page_path").alias("path")).agg(F.count("*").alias("n_claims"), F.avg(hit).alias("ratio"))
    return pages.select("path").distinct().join(per_page, "path", "left").select("path", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("ratio", F.lit(1.0)).alias("ratio"))


def coverage(chunks: DataFrame, claims: DataFrame, tau: float) -> DataFrame:
    """(n_covered, n_chunks, coverage): chunks that are the best of some claim at ``tau`` or more, of all chunks (source_path, seq)."""
    every = chunks.select("source_path", "seq").distinct()
    hit = claims.where(F.col("max_cosine") >= tau).select("source_path", F.col("best_chunk_seq").alias("seq"), F.lit(1).alias("hit")).distinct()
    out = every.join(hit, ["source_path", "seq"], "left").agg(F.count("hit").alias("n_covered"), F.count("*").alias("n_chunks"))
    return out.withColumn("coverage", F.coalesce(F.round(F.try_divide("n_covered", "n_chunks"), 6), F.lit(0.0)))


def near_links(vectors: DataFrame, tau: float, dim: int = 64, block: int = 4000) -> DataFrame:
    """(id, links) of every id: how many others have a cosine of ``tau`` or more. ``vectors``: id, vec.

    The whole upper triangle of block pairs, counted where two blocks meet, so pairs themselves are never rows. Its work
    is the square of the ids, as the figure asks for; ids without a usable vector have no link.
    """
    good = vectors.where(retrieval.usable_vector(F.col("vec"), dim)).select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    n = good.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias("n"))
    own = good.join(F.broadcast(n)).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    low = own.select("id", "vec", F.col("mine").alias("a"), F.explode(F.sequence("mine", F.col("n") - 1)).alias("b"), F.lit(0).alias("side"))
    high = own.where("mine > 0").select("id", "vec", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)).alias("a"), F.col("mine").alias("b"), F.lit(1).alias("side"))
    kind = vectors.schema["id"].dataType.simpleString()

    def count(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").combine_chunks(), retrieval._rows(t.column("vec").combine_chunks(), dim)
        side = t.column("side").to_numpy()
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = np.zeros(len(ids), dtype=np.int64)
        if t.column("a")[0].as_py() == t.column("b")[0].as_py():
            n[p] = (np.round(x[p] @ x[p].T, 9) >= tau).sum(axis=1) - 1
        elif len(q):
            hit = np.round(x[p] @ x[q].T, 9) >= tau
            n[p], n[q] = hit.sum(axis=1), hit.sum(axis=0)
        return pa.table({"id": ids, "n": pa.array(n)})

    counted = low.unionByName(high).groupBy("a", "b").applyInArrow(count, f"id {kind}, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return vectors.select("id").distinct().join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("links"))


def duplicate_ratio(links: DataFrame) -> DataFrame:
    """(n_pages, n_pairs, ratio) from ``near_links``; fewer than two pages have ratio 0."""
    out = links.agg(F.count("*").alias("n_pages"), (F.coalesce(F.sum("links"), F.lit(0)) / 2).cast("long").alias("n_pairs"))
    return out.withColumn("ratio", F.coalesce(F.round(F.try_divide(F.col("n_pairs"), F.col("n_pages") * (F.col("n_pages") - 1) / 2), 9), F.lit(0.0)))


def language_fidelity(pairs: DataFrame) -> DataFrame:
    """(n, fidelity) of pairs (page_text, source_text): the share whose language classes are equal; none gives 1."""
    same = (rules.language(F.col("page_text")) == rules.language(F.col("source_text"))).cast("double")
    return pairs.where("page_text IS NOT NULL AND source_text IS NOT NULL").agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(same), 6), F.lit(1.0)).alias("fidelity"))


def expected_coverage(expected: DataFrame, titles: DataFrame) -> DataFrame:
    """(n_expected, coverage): expected titles whose normal form is among the page titles; no expectation gives 1."""
    want = expected.where("title IS NOT NULL").select("title").distinct().withColumn("k", graph.index_title(F.col("title")))
    have = titles.where("title IS NOT NULL").select(graph.index_title(F.col("title")).alias("k"), F.lit(1.0).alias("hit")).distinct()
    return want.join(have, "k", "left").agg(F.count("*").alias("n_expected"), F.coalesce(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6), F.lit(1.0)).alias("coverage"))


def share(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole), 6), F.lit(empty))


def best_document(near: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, distance, rank): the least distance of a document's chunks in a query's list; the k nearest documents."""
    rows = near.join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("query_id", "doc_id").agg(F.round(F.min(1 - F.col("score")), 6).alias("distance"))
    return retrieval.ranked_by(rows, "query_id", ["distance", "doc_id"]).where(F.col("rank") <= k)


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest) of a whole table, whatever its order and size.

    Every row's SHA-256 is cut into four numbers of 60 bits; their exclusive sums, which combine on the map side, are
    hashed once more. Rows must be unique, as two equal ones cancel out. Nulls count as such.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    h = rows.select(F.sha2(text, 256).alias("h"))
    part = lambda i: F.bit_xor(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("long"))
    out = h.agg(F.count("*").alias("n"), *[part(i).alias(f"x{i}") for i in range(4)])
    return out.select("n", F.sha2(F.concat_ws("-", "n", *[f"x{i}" for i in range(4)]), 256).alias("digest"))


def order_kept(rows: DataFrame, owner: str, pos: str, key: Column) -> DataFrame:
    """(owner, key, ord): every key once per owner, in the order of its first appearance."""
    first = rows.select(owner, F.col(pos).alias("_p"), key.alias("key")).where("key IS NOT NULL").groupBy(owner, "key").agg(F.min("_p").alias("_p"))
    return first.select(owner, "key", (F.row_number().over(Window.partitionBy(owner).orderBy("_p", "key")) - 1).alias("ord"))


def merge_pages(pages: DataFrame, path: str, pos: str, rule: str = "\n\n---\n\n") -> DataFrame:
    """Pages of one path folded in order: the first one's title and category, all bodies joined by a rule, ordered unions of
    tags and sources. The joined body is the result, so one path's pages come together; null bodies are passed over."""
    s = F.struct(pos, *[c for c in ("title", "category", "body", "tags", "sources")])
    none = F.array().cast("array<string>")
    all_ = pages.groupBy(path).agg(F.array_sort(F.collect_list(s)).alias("p"))
    union = lambda c: F.array_compact(F.array_distinct(F.flatten(F.transform("p", lambda x: F.coalesce(x[c], none)))))
    return all_.select(path, F.size("p").alias("n"), F.col("p")[0]["title"].alias("title"), F.col("p")[0]["category"].alias("category"), F.array_join(F.transform("p", lambda x: x["body"]), rule).alias("body"), union("tags").alias("tags"), union("sources").alias("sources"))


def line_context(body: Column, line: Column, around: int = 1) -> Column:
    """The lines around a line (from 1), clamped to the body; a line that is not there gives the head of the body."""
    lines = F.split(body, "\n")
    start = F.when(line.between(1, F.size(lines)), F.greatest(line - around, F.lit(1))).otherwise(F.lit(1))
    stop = F.when(line.between(1, F.size(lines)), F.least(line + around, F.size(lines))).otherwise(F.least(F.lit(2 * around + 1), F.size(lines)))
    return F.array_join(F.slice(lines, start, stop - start + 1), "\n")
