"""Ingest and synthesis as one entry each, over a base that is kept as tables of deltas.

Every table of a base lies below its folder as ``<table>/batch=<n>``. The last row of a document counts; its chunks,
links, sources and vectors are those of the same batch, so replacing or removing them is writing none. Nothing stored
is rewritten, and a run that is broken off leaves no document behind that has not all of its parts: documents come last.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import text
from scriptoria.operators import base as tables
from scriptoria.operators import chunking, evals, parsing
from scriptoria.sources import connectors, files
from scriptoria.streaming import ingest as stream

CHILDREN = ("chunks", "links", "vectors")


def _exists(path: str) -> bool:
    return "://" in path or os.path.isdir(path)


def read_base(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    """documents, chunks, links, vectors as they are now; an empty dict for a base without a run."""
    if not _exists(f"{at}/documents"):
        return {}
    docs = tables.last_wins(spark.read.parquet(f"{at}/documents"), ["doc_id"], ["batch"])
    current = docs.where("active").select("doc_id", "batch")
    out = {"documents": docs}
    for name in CHILDREN:
        if _exists(f"{at}/{name}"):
            out[name] = spark.read.parquet(f"{at}/{name}").join(current, ["doc_id", "batch"], "left_semi")
    return out


def ingest(spark: SparkSession, root: str, at: str, provider: Callable[[list[str]], list[list[float]]] | None = None, ignore: tuple[str, ...] = ()) -> dict[str, int]:
    """Bring the markdown files below ``root`` into the base at ``at``; only new and changed ones are worked on.

    Returns counts: scanned, changed, gone, errors. A file that cannot be read is told and passed over; a file that is
    gone makes its document inactive. Without ``provider`` no vectors are made.
    """
    parsed = connectors.parse_any(files.markdown_files(spark, root, ignore)).cache()
    docs = files.as_documents(parsed, "source").join(parsed.select("path", "n_images"), "path")
    known = read_base(spark, at)
    fresh, gone = docs, None
    if known:
        fresh = stream.changed(docs, known["documents"])
        gone = known["documents"].where("active").join(docs.select("doc_id"), "doc_id", "left_anti").withColumn("active", F.lit(False)).drop("batch")
    fresh = fresh.drop("n_images").cache()
    n = 1 + (known["documents"].agg(F.max("batch")).first()[0] or 0) if known else 1
    counts = {"scanned": parsed.count(), "changed": fresh.count(), "gone": gone.count() if gone is not None else 0, "errors": parsed.where("error IS NOT NULL").count()}
    if counts["changed"] or counts["gone"]:
        bodies = fresh.select("doc_id", "body").withColumn("text", F.col("body"))
        chunks = chunking.chunk(fresh, "doc_id", "body").join(bodies, "doc_id").select("doc_id", "seq", "start_off", "end_off", F.expr("substring(body, start_off + 1, end_off - start_off)").alias("text"))
        chunks.write.mode("overwrite").parquet(f"{at}/chunks/batch={n}")
        links = parsing.links(fresh, "doc_id", "body").select(F.col("key").alias("doc_id"), F.col("target").alias("dst_path"), F.col("kind").alias("link_type"), "anchor", F.col("line").alias("line_no"))
        links.write.mode("overwrite").parquet(f"{at}/links/batch={n}")
        if provider is not None:
            texts = spark.read.parquet(f"{at}/chunks/batch={n}").select(F.struct("doc_id", "seq").alias("id"), "text")
            made = stream.embed_batches(texts.select(F.to_json("id").alias("id"), "text"), "id", "text", provider)
            made.select(F.from_json("id", "doc_id string, seq int").alias("i"), "embedding", "error").select("i.doc_id", "i.seq", "embedding", "error").write.mode("overwrite").parquet(f"{at}/vectors/batch={n}")
        out = fresh if gone is None else fresh.unionByName(gone)
        out.write.mode("overwrite").parquet(f"{at}/documents/batch={n}")
    parsed.unpersist(), fresh.unpersist()
    return counts


def synthesize(docs: DataFrame, model: Callable[[str], str], categories: set[str], fallback: str, template: str, target_tokens: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) a language model makes of source documents (doc_id, path, body).

    Documents are cut into groups of sections, each goes through the model, the ``<page>`` blocks of the replies are
    read, and pages of one path are folded in order. ``template`` has the places {path} and {text}. A reply that is cut
    off or failed is told per group; its whole blocks still count.
    """
    grouped = chunking.group(docs, "doc_id", "body", target_tokens=target_tokens).join(docs.select("doc_id", "path", "body"), "doc_id")
    asked = grouped.select(F.concat_ws("\x1f", "doc_id", "group_no").alias("id"), "path", F.expr("substring(body, start_off + 1, end_off - start_off)").alias("text"))
    before, between, after = template.partition("{path}")[0], template.partition("{path}")[2].partition("{text}")[0], template.partition("{text}")[2]
    prompts = asked.select("id", F.concat(F.lit(before), "path", F.lit(between), "text", F.lit(after)).alias("prompt"))
    replies = connectors.complete(prompts, "id", "prompt", model).join(asked.select("id", "path"), "id")

    @F.udtf(returnType="no int, category string, slug string, title string, tags array<string>, body string, error string")
    class Blocks:
        def eval(self, reply: str):
            pages, error = parsing.page_blocks(reply or "", categories, fallback)
            for i, p in enumerate(pages):
                yield i, p["category"], p["slug"], p["title"], p["tags"], p["body"], None
            if error:
                yield None, None, None, None, None, None, error

    docs.sparkSession.udtf.register("page_blocks_of", Blocks)
    replies.createOrReplaceTempView("replies_to_read")
    read = docs.sparkSession.sql("SELECT r.id, r.path AS source, r.error AS failed, b.* FROM replies_to_read r LEFT JOIN LATERAL page_blocks_of(r.reply) b")
    errors = read.select("id", F.coalesce("failed", "error").alias("error")).where("error IS NOT NULL")
    made = read.where("no IS NOT NULL").select(
        F.concat(F.lit("knowledge/"), F.when(F.col("category") != "", F.concat("category", F.lit("/"))).otherwise(""), F.coalesce("slug", F.lit("untitled")), F.lit(".md")).alias("path"),
        F.struct("source", "id", "no").alias("pos"), "title", "category", "body", "tags", F.array("source").alias("sources"),
    )
    return evals.merge_pages(made, "path", "pos"), errors


def hashed_provider(texts: list[str], dim: int = 64) -> list[list[float]]:
    """The hermetic embedder for texts at hand: letters-only words in buckets of their SHA-1, length 1."""
    import hashlib
    import re

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in re.findall("[A-Za-z]+", t):
            v[int(hashlib.sha1(w.lower().encode()).hexdigest()[:8], 16) % dim] += 1
        size = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / size for x in v])
    return out


def provenance_of(pages: DataFrame) -> DataFrame:
    """(path, source_path, source_path_key) of pages; of one key the first spelling stays."""
    rows = pages.select("path", F.posexplode("sources").alias("pos", "source_path")).where("trim(source_path) <> ''")
    return tables.first_spelling(rows, "path", text.path_key(F.col("source_path")), "pos").select("path", "source_path", text.path_key(F.col("source_path")).alias("source_path_key"))
