"""Search and retrieve as one entry each: legs, fusion, diversity, rerank, hydration, page references.

A table of queries goes through at once. Filters on the documents (active, layer) come before the top k of every leg,
statistics of words cover all chunks. Single-leg modes stay pure: graph, assets and rerank take part in ``hybrid`` only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import pages as rules
from scriptoria.operators import retrieval as op
from scriptoria.session import store

MODES = ("bm25", "vector", "hybrid")
FUSIONS = ("rrf", "combsum", "combmnz")
# The shipped weights of the legs; assets count like vectors.
WEIGHTS = {"bm25": 0.3, "vector": 1.5, "asset": 1.5, "graph": 0.3}


class Base(NamedTuple):
    """What is searched. chunks: chunk_id, doc_id, seq, text; docs: doc_id, path, title, layer, active; vectors: chunk_id,
    vec (of one version); links: src_doc_id, dst_path, link_type; asset_vectors: asset_id, vec; refs: chunk_id, asset_id, ord."""

    chunks: DataFrame
    docs: DataFrame
    vectors: DataFrame | None = None
    links: DataFrame | None = None
    asset_vectors: DataFrame | None = None
    refs: DataFrame | None = None


def live_chunks(base: Base, layer: str | None = None) -> DataFrame:
    """(chunk_id, doc_id) of chunks of active documents, of one layer if asked."""
    docs = base.docs.where("active")
    if layer is not None:
        docs = docs.where(F.col("layer") == layer)
    return base.chunks.select("chunk_id", "doc_id").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def word_leg(queries: DataFrame, base: Base, live: DataFrame, k: int) -> DataFrame:
    marked = base.chunks.select("chunk_id", "text").join(live.select("chunk_id", F.lit(True).alias("live")), "chunk_id", "left")
    return op.bm25(queries, marked, k)


def vector_leg(asked: DataFrame, base: Base, live: DataFrame, k: int) -> DataFrame:
    return op.knn(asked, base.vectors.join(live.select("chunk_id"), "chunk_id", "left_semi"), k)


def asset_leg(asked: DataFrame, base: Base, live: DataFrame, k: int) -> DataFrame:
    """Asset hits brought to the chunks that show them: the first asset to reach a chunk gives its rank, the best its score."""
    hits = op.knn(asked, base.asset_vectors.select(F.col("asset_id").alias("chunk_id"), "vec"), k).withColumnRenamed("chunk_id", "asset_id")
    shown = base.refs.select("asset_id", "chunk_id", "ord").join(live.select("chunk_id"), "chunk_id", "left_semi")
    reached = hits.join(shown, "asset_id").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("first"), F.max("score").alias("score"))
    return op.ranked_by(reached, "query_id", ["first", "chunk_id"]).select("query_id", "chunk_id", "score", "rank")


def graph_leg(seeds: DataFrame, base: Base, live: DataFrame, k: int) -> DataFrame:
    """Chunks one wikilink away from a query's seeds (query_id, chunk_id), by exact path; join rows count, seeds are left out.

    Links are counted per target document before they meet its chunks. The seed's own document need not be active.
    """
    start = seeds.join(base.chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("query_id", F.col("doc_id").alias("src_doc_id")).agg(F.count("*").alias("n"))
    out = base.links.where("link_type = 'wikilink' AND dst_path IS NOT NULL").groupBy("src_doc_id", "dst_path").agg(F.count("*").alias("m"))
    target = base.docs.where("active").select("doc_id", F.col("path").alias("dst_path"))
    to = start.join(out, "src_doc_id").join(target, "dst_path").groupBy("query_id", "doc_id").agg(F.sum(F.col("n") * F.col("m")).alias("edge_count"))
    near = to.join(live, "doc_id").groupBy("query_id", "chunk_id").agg(F.sum("edge_count").cast("double").alias("score"))
    return op.top(near.join(seeds, ["query_id", "chunk_id"], "left_anti"), "query_id", "score", "chunk_id", k).select("query_id", "chunk_id", "score", "rank")


def fused(
    queries: DataFrame, base: Base, *, mode: str = "hybrid", layer: str | None = None, per_leg: int = 40, fusion: str = "rrf", rrf_k: int = 60,
    weights: dict[str, float] = WEIGHTS, alpha: float = 0.3, graph: bool = False, seed_top: int = 20,
) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank): the legs of ``mode``, fused and freed of crowding by one document.

    ``queries``: query_id, q, and vec for the vector and asset legs (a null vec asks no vector). Queries without words or
    hits have no row.
    """
    if mode not in MODES or fusion not in FUSIONS:
        raise ValueError(f"mode is one of {MODES}, fusion one of {FUSIONS}")
    live = store(live_chunks(base, layer))
    parts: dict[str, tuple[DataFrame, float]] = {}
    asked = queries.select("query_id", "vec") if "vec" in queries.columns else None
    if mode != "vector":
        parts["bm25"] = (store(word_leg(queries.select("query_id", "q"), base, live, per_leg)), weights["bm25"])
    if mode != "bm25" and base.vectors is not None and asked is not None:
        parts["vector"] = (store(vector_leg(asked, base, live, per_leg)), weights["vector"])
    if mode == "hybrid" and base.asset_vectors is not None and base.refs is not None and asked is not None:
        parts["asset"] = (store(asset_leg(asked, base, live, per_leg)), weights["asset"])
    if not parts:
        raise ValueError("the vector mode needs vectors of chunks and of queries")
    if mode == "hybrid" and graph and base.links is not None:
        both = {n: parts[n][0].where(F.col("rank") <= seed_top) for n in ("vector", "bm25") if n in parts}
        seeds = store(op.interleave(**both).where(F.col("rank") <= seed_top).select("query_id", "chunk_id"))
        parts["graph"] = (graph_leg(seeds, base, live, per_leg), weights["graph"])
    legs = op.legs(**parts)
    made = op.rrf(legs, rrf_k) if fusion == "rrf" else op.comb(legs, mnz=fusion == "combmnz")
    return op.diversify(made, base.chunks.select("chunk_id", "doc_id"), alpha).select("query_id", "chunk_id", "doc_id", "score", "rank")


def hydrated(hits: DataFrame, base: Base) -> DataFrame:
    """Hits with path, title, layer, seq, snippet and the assets of their chunk in order; a chunk that is gone has no row."""
    docs = base.docs.select(F.col("doc_id").alias("_d"), "path", "title", "layer").dropDuplicates(["_d"])
    chunks = base.chunks.select("chunk_id", "seq", rules.snippet(F.col("text")).alias("snippet"))
    out = hits.join(chunks, "chunk_id").join(docs, F.col("doc_id") == F.col("_d"), "left").drop("_d")
    if base.refs is None:
        return out
    shown = base.refs.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "asset_id"))), lambda x: x["asset_id"]).alias("assets"))
    return out.join(shown, "chunk_id", "left")


def search(queries: DataFrame, base: Base, *, limit: int = 10, rerank: Callable[[str, list[str]], list[float]] | None = None, window: int = 40, mode: str = "hybrid", **how) -> DataFrame:
    """(query_id, rank, score, chunk_id, doc_id, path, title, layer, seq, snippet): the ``limit`` best chunks of every query.

    ``rerank`` scores the best ``max(window, limit)`` anew, in hybrid mode only; a scorer that fails leaves the fused order.
    """
    # Legs, fusion and hydration each read these: what they are made of is worked out once.
    queries, base = store(queries), base._replace(chunks=store(base.chunks), docs=store(base.docs))
    hits = fused(queries, base, mode=mode, **how)
    if rerank is not None and mode == "hybrid":
        docs = base.chunks.select("chunk_id", "doc_id")
        hits = op.rerank(hits, base.chunks.select("chunk_id", "text"), queries.select("query_id", "q"), rerank, limit, window).join(docs, "chunk_id")
    return hydrated(hits.where(F.col("rank") <= limit), base)


def retrieve(queries: DataFrame, base: Base, *, limit: int = 5, **how) -> tuple[DataFrame, DataFrame]:
    """The best chunks, and the pages they lie on (query_id, path, score, chunk_ids, rank)."""
    hits = search(queries, base, limit=limit, **how)
    return hits, op.page_refs(hits)
