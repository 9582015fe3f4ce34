"""File-shaped inputs: markdown trees, images, retrieval bundles, run logs, import manifests."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import text
from scriptoria.operators.parsing import find_images, front_matter

PARSED = "path string, title string, body string, body_hash string, frontmatter string, status string, mtime double, n_images int, error string"
STATUSES = ("draft", "published", "favorite", "archived")


def _empty_files(spark: SparkSession, base: str, suffix: str) -> DataFrame:
    """(path, modificationTime, content) of files without a byte, which Spark's file scan passes over."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(base)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    rows = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(suffix):
            rows.append((f.getPath().toUri().getPath(), f.getModificationTime() / 1000, bytearray()))
    return spark.createDataFrame(rows, "path string, at double, content binary").select("path", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("modificationTime"), "content")


def markdown_files(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, mtime, content) of the markdown files below ``root``; ``wisdom/`` and ignored globs are left out."""
    base = root.rstrip("/") if "://" in root else os.path.abspath(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(base).select("path", "modificationTime", "content")
    raw = raw.unionByName(_empty_files(spark, base, ".md"))
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + "\\Q" + base + "\\E/?", "")  # other schemes keep theirs, as ``base`` does
    out = raw.select(F.url_decode(F.regexp_replace(path, r"\+", "%2B")).alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content").where(~F.col("path").startswith("wisdom/"))
    for glob in ignore:
        out = out.where(~F.col("path").rlike("^" + fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$") + ""))
    return out


def parse_markdown(files: DataFrame) -> DataFrame:
    """Front matter, title (field, first heading, file stem), body and its hash; bad files come out with an error, not an exception."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        names = [c.split()[0] for c in PARSED.split(", ")]
        types = [pa.string()] * 6 + [pa.float64(), pa.int32(), pa.string()]
        for b in batches:
            rows = []
            for path, mtime, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    fields, body, error = front_matter(raw.decode("utf-8-sig"))
                except UnicodeDecodeError as e:
                    rows.append((path, None, None, None, None, None, mtime, 0, f"encoding_error: {e.reason}"))
                    continue
                heading = re.search(r"^#{1,6}\s+(.+?)\s*$", body, re.MULTILINE)
                title = fields.get("title") if isinstance(fields.get("title"), str) else None
                title = title or (heading.group(1) if heading else os.path.splitext(os.path.basename(path))[0])
                status = fields.get("status") if fields.get("status") in STATUSES else None
                problem = f"frontmatter_error: {error}" if error else None if body.strip() else "empty_body"
                rows.append((path, title, body, hashlib.sha256(body.encode()).hexdigest(), json.dumps(fields, ensure_ascii=False) if fields else None, status, mtime, len(find_images(body)), problem))
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    return files.select("path", "mtime", "content").mapInArrow(run, PARSED)


def as_documents(parsed: DataFrame, layer: str) -> DataFrame:
    """Rows of the document register: key, id, active."""
    key = text.path_key(F.col("path"))
    return parsed.where("error IS NULL OR error = 'empty_body'").select(F.concat_ws(":", F.lit(layer), key).alias("doc_id"), "path", key.alias("path_key"), "title", "body", "body_hash", "frontmatter", "mtime", F.lit(layer).alias("layer"), F.lit(True).alias("active"), F.when(F.lit(layer) == "wisdom", F.col("status")).alias("status"))


def sniff(head: bytes) -> tuple[str | None, int | None, int | None]:
    """(mime, width, height) from the first bytes of an image."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return "image/png", *struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return "image/gif", *struct.unpack("<HH", head[6:10])
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "image/webp", None, None
    if head[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 < len(head) and head[at] == 0xFF:
            kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return "image/jpeg", int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
            at += 2 + size
        return "image/jpeg", None, None
    if b"<svg" in head[:512].lower():
        return "image/svg+xml", None, None
    return None, None, None


# Types by extension, for bytes that say nothing.
BY_EXTENSION = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}


def assets(files: DataFrame) -> DataFrame:
    """Content-addressed images: (asset_id, mime, width, height, bytes, original_paths); equal bytes are one asset."""

    @F.pandas_udf("mime string, width int, height int")
    def probe(head: pd.Series, path: pd.Series) -> pd.DataFrame:
        seen = [sniff(bytes(h)) for h in head]
        return pd.DataFrame([(m or BY_EXTENSION.get(p.rsplit(".", 1)[-1].lower()), w, h) for (m, w, h), p in zip(seen, path)], columns=["mime", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    one = files.select(F.sha2("content", 256).alias("asset_id"), "path", F.length("content").alias("bytes"), probe(F.substring("content", 1, 65536), "path").alias("p"))
    return one.groupBy("asset_id").agg(F.max("p.mime").alias("mime"), F.max("p.width").alias("width"), F.max("p.height").alias("height"), F.max("bytes").alias("bytes"), F.array_sort(F.collect_set("path")).alias("original_paths"))


def materialized(found: DataFrame, stored: DataFrame) -> DataFrame:
    """``found`` (of ``assets``) with ``was_new`` and the paths known so far before the new ones; stored bytes are not written again."""
    old = stored.select("asset_id", F.col("original_paths").alias("_old"))
    none = F.array().cast("array<string>")
    out = found.join(old, "asset_id", "left").withColumn("was_new", F.col("_old").isNull())
    return out.withColumn("original_paths", F.array_distinct(F.concat(F.coalesce("_old", none), "original_paths"))).drop("_old")


# Names that some file systems keep for devices.
RESERVED = frozenset(["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]])


def asset_path(asset_id: str, name: str) -> str:
    """<h2>/<h8>-<stem>.<ext>: letters, digits, - and _ stay; at most 150 bytes of stem."""
    import unicodedata

    import regex

    stem, ext = os.path.splitext(os.path.basename(unicodedata.normalize("NFC", name)))
    stem = regex.sub(r"-{2,}", "-", regex.sub(r"[^\p{L}\p{N}_-]", "-", stem)).strip("-") or "asset"
    while len(stem.encode()) > 150:
        stem = stem[:-1]
    if stem.upper() in RESERVED:
        stem += "-file"
    return f"{asset_id[:2]}/{asset_id[:8]}-{stem}{ext.lower()}"


def package_digest(hashes: DataFrame, by: str, value: str) -> DataFrame:
    """SHA-256 of a package's sorted distinct hashes; packages are small (a page and its images)."""
    return hashes.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(value)), "\n"), 256).alias("digest"))


def contained(path: str, base: str) -> bool:
    """Does a path stay below its base once links and dots are resolved?"""
    inside, outside = os.path.realpath(base), os.path.realpath(os.path.join(base, path))
    return os.path.commonpath([inside, outside]) == inside


def retrieval_bundle(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (doc_id, title, text), queries (query_id, q), judgements (query_id, doc_id) of a BEIR-style folder.

    Judgements of score 0 and of documents that are not there are dropped.
    """
    corpus = spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl").withColumnRenamed("_id", "doc_id")
    queries = spark.read.schema("_id string, text string").json(f"{root}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("q"))
    raw = spark.read.csv(f"{root}/qrels/{split}.tsv", sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score int")
    judged = raw.where("score > 0").select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id")).distinct()
    return corpus, queries, judged.join(corpus.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id")


def query_first_sample(corpus: DataFrame, queries: DataFrame, judged: DataFrame, n_queries: int, n_docs: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """n judgable queries, all of their documents, and distractors up to ``n_docs``; repeatable by hash."""
    kept = queries.join(judged, "query_id", "left_semi").orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(n_queries)
    rel = judged.join(kept, "query_id", "left_semi")
    own = corpus.join(rel, "doc_id", "left_semi")
    rest = corpus.join(rel, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max(0, n_docs - own.count()))
    return own.unionByName(rest), kept, rel


def ranked_dump(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, q_id, bm25, vector, expect_any) per judged query of a dump of ranked lists."""
    raw = spark.read.schema("dataset string, q_id string, mode string, ranked array<string>, expect_any array<string>, expect_none boolean").json(path)
    good = raw.where("NOT coalesce(expect_none, false) AND size(expect_any) > 0")
    return good.groupBy("dataset", "q_id").pivot("mode", ["bm25", "vector"]).agg(F.first("ranked")).join(good.groupBy("dataset", "q_id").agg(F.first("expect_any").alias("expect_any")), ["dataset", "q_id"])


def manifest_verify(declared: DataFrame, disk: DataFrame) -> DataFrame:
    """(package, path, problem): declared (package, path, sha256, bytes) against disk (path, sha256, bytes)."""
    d, f = declared.alias("d"), disk.alias("f")
    both = d.join(f, F.col("d.path") == F.col("f.path"), "full")
    problem = (
        F.when(F.col("f.path").isNull(), "missing")
        .when(F.col("d.path").isNull(), "orphan_file")
        .when(F.col("d.bytes") != F.col("f.bytes"), "size_mismatch")
        .when(F.col("d.sha256") != F.col("f.sha256"), "sha_mismatch")
    )
    return both.select(F.col("d.package").alias("package"), F.coalesce("d.path", "f.path").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")


def params_digest(params: dict) -> str:
    """16 hex digits of the canonical JSON of a task's parameters."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]
