"""Writing to the base as table transformations: pages, links, versions, deletions, resumption, and their checks."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.functions import text
from scriptoria.operators import base

# The statuses of a wisdom page.
STATUSES = ("draft", "published", "favorite", "archived")


def clamp_status(layer: Column, status: Column) -> Column:
    """The status of a wisdom page if it is a known one, else null."""
    return F.when((layer == "wisdom") & status.isin(*STATUSES), status)


def known_mtime(mtime: Column, same_hash: Column, old_mtime: Column, now: Column) -> Column:
    """The file's own time, else the stored one of the same content, else now; times of 0 and below are unknown."""
    return F.coalesce(F.when(mtime > 0, mtime), F.when(same_hash & (old_mtime > 0), old_mtime), now)


def upsert_documents(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Stored documents with the last row per incoming doc_id in their stead; statuses are clamped."""
    rows = base.last_wins(incoming, ["doc_id"], order)
    return base.upsert(stored, rows.withColumn("status", clamp_status(F.col("layer"), F.col("status"))), ["doc_id"])


def deactivate(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents named in ``gone`` (doc_id) stay, but no leg sees them."""
    out = docs.join(gone.select("doc_id", F.lit(True).alias("_gone")).distinct(), "doc_id", "left")
    return out.withColumn("active", F.when(F.col("_gone"), False).otherwise(F.col("active"))).drop("_gone")


def replace_links(stored: DataFrame, incoming: DataFrame, pos: str) -> DataFrame:
    """All links of the incoming sources anew; of one (source, target, line) the last by ``pos`` stays."""
    return base.replace_children(stored, base.last_wins(incoming, ["src_doc_id", "dst_path", "line_no"], [pos]), "src_doc_id")


def replace_provenance(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """All sources of the incoming pages (src_doc_id, source_path, pos) anew; of one key the first spelling stays."""
    keyed = base.first_spelling(incoming, "src_doc_id", text.path_key(F.col("source_path")), "pos").withColumn("source_path_key", text.path_key(F.col("source_path")))
    return base.replace_children(stored, keyed.drop("pos"), "src_doc_id")


def upsert_vectors(stored: DataFrame, incoming: DataFrame, key: str, dim: int) -> DataFrame:
    """Vectors of (key, version_id) replaced; one of another length ends the job. Serves chunks and assets alike."""
    checked = incoming.withColumn("embedding", F.when(F.assert_true(F.size("embedding") == dim, F.lit(f"a vector must have {dim} numbers")).isNull(), F.col("embedding")))
    return base.upsert(stored, checked, [key, "version_id"])


def append_log(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """New entries behind the stored ones; ids go on from the largest, so equal seconds keep their order. A batch is small."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = incoming.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return stored.unionByName(numbered.join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n")).drop("_n", "_top"), allowMissingColumns=True)


def schema_fingerprint(tables: dict[str, DataFrame]) -> str:
    """Eight hex digits of the names and types of all tables."""
    said = {n: [(f.name, f.dataType.simpleString()) for f in df.schema] for n, df in tables.items()}
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()[:8]


def refuse_other_schema(tables: dict[str, DataFrame], expected: str) -> None:
    """There is no upgrade in place: another fingerprint is an error."""
    if (got := schema_fingerprint(tables)) != expected:
        raise ValueError(f"schema {got} found where {expected} is needed; build the base anew")


def blast_radius(links: DataFrame, path: str, doc_id: str) -> DataFrame:
    """How many other documents point to a path that is about to go."""
    return links.where((F.col("dst_path") == path) & (F.col("src_doc_id") != doc_id)).agg(F.count_distinct("src_doc_id").alias("n"))


def pending_vectors(items: DataFrame, have: DataFrame, key: str, version: int) -> DataFrame:
    """What a new run must embed first: items without a vector of the version."""
    return items.join(have.where((F.col("version_id") == version) & F.col("embedding").isNotNull()).select(key), key, "left_anti")


def pending_assets(assets: DataFrame, have: DataFrame, refs: DataFrame, version: int, kinds: tuple[str, ...] = ("image/png", "image/jpeg", "image/gif", "image/webp")) -> DataFrame:
    """Assets to embed later: of an embeddable kind, there, shown by some chunk, and without a vector."""
    return pending_vectors(assets.where(F.col("mime").isin(*kinds) & (F.col("bytes") > 0)), have, "asset_id", version).join(refs.select("asset_id"), "asset_id", "left_semi")


def page_assets(refs: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """(doc_id, asset_id, place): the assets of a page in the order in which its chunks first show them."""
    first = refs.join(chunks.select("chunk_id", "doc_id", "seq"), "chunk_id").groupBy("doc_id", "asset_id").agg(F.min(F.struct("seq", "ord")).alias("at"))
    w = Window.partitionBy("doc_id").orderBy("at", "asset_id")
    return first.join(assets.select("asset_id"), "asset_id", "left_semi").select("doc_id", "asset_id", (F.row_number().over(w) - 1).alias("place"))


def page_view(docs: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """(doc_id, path, title, body, anchors): one page with its chunk offsets, unless the body changed since it was indexed."""
    d = docs.where((F.col("path") == path) & F.col("active"))
    held = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "start_off", "end_off"))).alias("a"))
    fresh = F.sha2(F.coalesce("body", F.lit("")), 256) == F.col("body_hash")
    return d.join(held, "doc_id", "left").select("doc_id", "path", "title", "body", F.when(fresh, F.col("a")).alias("anchors"))


def rendered(chunks: DataFrame, refs: DataFrame, assets: DataFrame, root: str = "") -> DataFrame:
    """(chunk_id, text): every image reference of a known asset by a link to its stored file, by position; others stay.

    ``refs``: chunk_id, asset_id, alt, start_in_chunk, end_in_chunk; ``assets``: asset_id, stored_path.
    """
    known = refs.join(assets.select("asset_id", "stored_path"), "asset_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("start_in_chunk", "end_in_chunk", "alt", "stored_path"))).alias("r"))
    prefix = F.lit(root.rstrip("/") + "/" if root else "")
    out = chunks.select("chunk_id", "text").join(known, "chunk_id", "left")

    def step(a: Column, r: Column) -> Column:
        gap = F.substring("text", a["at"] + 1, r["start_in_chunk"] - a["at"])
        link = F.concat(F.lit("!["), F.coalesce(r["alt"], F.lit("")), F.lit("]("), prefix, r["stored_path"], F.lit(")"))
        return F.struct(r["end_in_chunk"].alias("at"), F.concat(a["made"], gap, link).alias("made"))

    whole = F.aggregate("r", F.struct(F.lit(0).alias("at"), F.lit("").alias("made")), step, lambda a: F.concat(a["made"], F.substring("text", a["at"] + 1, F.length("text"))))
    return out.select("chunk_id", F.when(F.col("r").isNull(), F.col("text")).otherwise(whole).alias("text"))


def outside_chunks(spans: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end) that lie whole in no chunk (key, start_off, end_off); there should be none."""
    c = chunks.select(F.col(key).alias("_k"), "start_off", "end_off")
    return spans.join(c, (spans[key] == F.col("_k")) & (F.col("start_off") <= spans["start"]) & (spans["end"] <= F.col("end_off")), "left_anti")


def picked(rows: DataFrame, order: list[str], pick: list[int] | None, skip: list[int] = ()) -> DataFrame:
    """Rows by their place (from 0) in an order: those picked (all if null) and not skipped. For lists a person looks at."""
    n = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)
    n = n if pick is None else n.where(F.col("place").isin(list(pick)))
    return n.where(~F.col("place").isin(list(skip))) if skip else n


def link_units(links: DataFrame, pages: DataFrame, around: int = 1, cap: int = 1200) -> DataFrame:
    """(link_id, src_path, context, target_path, target_title, target_body): resolved links from page to page with the lines
    around them and the head of their target. ``links``: link_id, src_path, dst_path, line_no. Links of a page to itself,
    to what is no page, and from pages without a body are passed over; a line out of range is moved to the nearest one.
    """
    src = pages.where("body <> ''").select(F.col("path").alias("src_path"), F.split("body", "\n").alias("lines"))
    dst = pages.select(F.col("path").alias("dst_path"), F.col("title").alias("target_title"), F.left("body", F.lit(cap)).alias("target_body"))
    met = links.where("src_path <> dst_path").join(src, "src_path").join(dst, "dst_path")
    at = F.least(F.greatest(F.col("line_no"), F.lit(1)), F.size("lines"))
    low, high = F.greatest(at - around, F.lit(1)), F.least(at + around, F.size("lines"))
    return met.select("link_id", "src_path", F.array_join(F.slice("lines", low, high - low + 1), "\n").alias("context"), F.col("dst_path").alias("target_path"), "target_title", "target_body")


def kebab(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single hyphens between them."""
    return F.coalesce(c.rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"), F.lit(False))


def category_problem(path: str) -> str | None:
    """Why a category's folder path is refused, or None; it must be relative, composed, and of ordinary segments."""
    norm = unicodedata.normalize("NFC", path).strip()
    if not norm:
        return "empty"
    if norm[0] in "/\\" or "\\" in norm:
        return "not a relative path with slashes"
    for part in norm.split("/"):
        if not part.strip() or part != part.strip():
            return "blank at the edge of a segment"
        if part in (".", "..") or part[-1] in ". ":
            return "dots"
        if re.search(r'[<>:"|?*\x00-\x1f]', part):
            return "reserved character"
    return None


def page_id(category: Column, title: Column) -> Column:
    """K- and six bytes of BLAKE2b of category and title; Arrow batches, as no built-in has that hash."""

    @F.pandas_udf("string")
    def made(c: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else "K-" + hashlib.blake2b(f"{x or ''}:{y}".encode(), digest_size=6).hexdigest() for x, y in zip(c, t)])

    return made(category, title)


def safe_stem(c: Column) -> Column:
    """A file stem of an upstream id: letters, digits, _ and - stay; blank ids have none. Equal stems are the caller's error."""
    return F.when(F.trim(c) != "", F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_\-]", "_"))


def without_credentials(url: Column) -> Column:
    """A URL without user and password."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]*@", "$1")


def spaced_runs(c: Column, segment=None) -> Column:
    """CJK runs set off by blanks, ASCII untouched; ``segment`` (text -> words) cuts the runs in Arrow batches."""
    if segment is None:
        return F.regexp_replace(c, r"([一-鿿]+)", " $1 ")

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else re.sub("[一-鿿]+", lambda m: " " + " ".join(segment(m.group())) + " ", t))

    return cut(c)


def packed_vector(v: Column) -> Column:
    """An array of floats as little-endian float32 bytes."""

    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return pack(v)


def unpacked_vector(b: Column) -> Column:
    """Little-endian float32 bytes as an array of floats."""

    @F.pandas_udf("array<float>")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.frombuffer(bytes(x), dtype="<f4"))

    return unpack(b)


def iso_time(epoch: Column, millis: bool = False) -> Column:
    """Seconds since 1970 as ISO 8601 in UTC."""
    return F.date_format(F.timestamp_micros(F.floor(epoch * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss" + (".SSS" if millis else "") + "'Z'")


def media_meta(document: Column) -> Column:
    """JSON of an asset's properties as a struct told apart by ``kind``; unreadable text is null."""
    return F.from_json(document, "kind string, width int, height int, duration double, pages int")


def to_graph_page(spark: SparkSession, resolved: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """Nodes, edges, unresolved links and totals of the whole base."""
    from scriptoria.operators import graph

    edges = graph.edges(resolved)
    nodes = docs.where("active").select("doc_id", "path", "title", "layer").dropDuplicates(["doc_id"]).join(graph.degrees(edges), "doc_id", "left").na.fill(0, ["n_in", "n_out"])
    lost = resolved.where("dst_doc_id IS NULL AND (link_type IS NULL OR link_type <> 'url')").groupBy("src_doc_id", "dst_path", "anchor").agg(F.count("*").alias("n"))
    totals = nodes.agg(F.count("*").alias("n_nodes")).join(F.broadcast(edges.agg(F.count("*").alias("n_edges")))).join(F.broadcast(lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_unresolved"))))
    return {"nodes": nodes, "edges": edges, "unresolved": lost, "totals": totals}
