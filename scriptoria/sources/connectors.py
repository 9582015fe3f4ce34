"""Formats, converters, evaluation sets, bundles, run logs, providers and the edges of the service: what plugs in from outside."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.operators.parsing import find_images
from scriptoria.sources import files as md

#: extension -> parser of (path, mtime, content) into the columns of ``files.PARSED``
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"md": md.parse_markdown}
#: extension -> bytes to markdown text
CONVERTERS: dict[str, Callable[[bytes], str]] = {}


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def parse_any(files: DataFrame) -> DataFrame:
    """Every file by the parser of its extension, converted to markdown first where a converter is known; others come out as errors."""
    ext = extension(F.col("path"))
    known = [*PARSERS, *(e for e in CONVERTERS if e not in PARSERS)]
    out = files.where(~ext.isin(known)).select("path", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in md.PARSED.split(", ")[1:-1] if not c.startswith("mtime")], "mtime", F.concat(F.lit("unsupported_format: "), ext).alias("error"))
    out = out.select(*[c.split()[0] for c in md.PARSED.split(", ")])
    for e, parse in PARSERS.items():
        out = out.unionByName(parse(files.where(ext == e)))
    for e in CONVERTERS:
        if e not in PARSERS:
            out = out.unionByName(md.parse_markdown(converted(files.where(ext == e), e)))
    return out


def converted(files: DataFrame, ext: str) -> DataFrame:
    """(path, mtime, content) with the content as markdown bytes."""
    make = CONVERTERS[ext]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([make(bytes(x)).encode() for x in b.column(2).to_pylist()], pa.binary())], ["path", "mtime", "content"])

    return files.select("path", "mtime", "content").mapInArrow(run, "path string, mtime double, content binary")


def preflight(files: DataFrame, present: DataFrame) -> DataFrame:
    """(path, problem, detail): all problems of all markdown files; ``present`` (path) are the files an image may name.

    An image is looked for beside its page and from the root; web addresses are not looked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                body = bytes(raw).decode("utf-8", "replace")
                for _, _, _, image in find_images(body):
                    if "://" not in image:
                        rows.append((path, image, os.path.normpath(os.path.join(os.path.dirname(path), image)), os.path.normpath(image)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], ["path", "image", "beside", "rooted"])

    refs = files.select("path", "content").mapInArrow(run, "path string, image string, beside string, rooted string")
    have = present.select(F.col("path").alias("_p")).distinct()
    lost = refs.join(have, F.col("beside") == F.col("_p"), "left_anti").join(have, F.col("rooted") == F.col("_p"), "left_anti")
    parsed = md.parse_markdown(files).where("error IS NOT NULL").select("path", F.split("error", ":")[0].alias("problem"), "error")
    return parsed.select("path", "problem", F.col("error").alias("detail")).unionByName(lost.select("path", F.lit("asset_missing").alias("problem"), F.col("image").alias("detail")).distinct())


def bundle(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, rejected) of files to be sent: package, path, content, is_asset, referenced.

    One entry per package and archive path with size and hash, and the package's digest; assets that no page shows are rejected.
    """
    lost = members.where("is_asset AND NOT referenced").select("package", "path").distinct()
    kept = members.where("NOT is_asset OR referenced").select("package", "path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256")).dropDuplicates(["package", "path"])
    return kept.join(md.package_digest(kept, "package", "sha256"), "package"), lost


def rejected_packages(problems: DataFrame, declared: DataFrame) -> DataFrame:
    """The packages that a bad file touches, and those whose paths are declared twice; the others go on."""
    touched = problems.select("path").distinct().join(declared.select("package", "path"), "path").select("package")
    twice = declared.groupBy("package", "path").agg(F.count("*").alias("n")).where("n > 1").select("package")
    return touched.unionByName(twice).distinct()


def parquet_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (doc_id, text), queries (query_id, q), judgements (query_id, doc_id) of parquet shards; only these columns are read."""
    text = lambda name: spark.read.parquet(f"{root}/{name}").select(F.col("id").cast("string"), "text")
    judged = spark.read.parquet(f"{root}/qrels").where("score > 0").select(F.col("qid").cast("string").alias("query_id"), F.col("pid").cast("string").alias("doc_id"))
    return text("corpus").withColumnRenamed("id", "doc_id"), text("queries").toDF("query_id", "q"), judged


def load_dataset(spark: SparkSession, root: str) -> dict:
    """An evaluation set of YAML files: name, thresholds, queries, targets. Queries that name unknown targets are an error."""
    import yaml

    def read(name: str, empty):
        path = os.path.join(root, name)
        if not os.path.exists(path):
            return empty
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or empty

    meta, asked, targets = read("dataset.yaml", {}), read("queries.yaml", {}), read("targets.yaml", {})
    asked = asked.get("queries", []) if isinstance(asked, dict) else asked
    named = targets.get("targets", targets) if isinstance(targets, dict) else {}
    unknown = sorted({t for q in asked for t in q.get("expect_targets", []) if t not in named})
    if unknown:
        raise ValueError(f"queries name targets that are not there: {unknown}")
    ids = [str(q["id"]) for q in asked]
    if len(set(ids)) < len(ids):
        raise ValueError("query ids must be unique")
    queries = spark.createDataFrame([(str(q["id"]), str(q["q"])) for q in asked], "query_id string, q string")
    relevant = spark.createDataFrame([(str(q["id"]), str(x)) for q in asked for x in q.get("expect_any", [])], "query_id string, key string")
    bounds = spark.createDataFrame([(k, float(v)) for k, v in (meta.get("thresholds") or {}).items()], "metric string, bound double")
    return {"name": meta.get("name") or os.path.basename(root), "queries": queries, "relevant": relevant, "thresholds": bounds, "targets": named}


def append_runs(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(arm, metric, value) of a log of flat runs: one JSON object per run, of an arm and its figures."""
    raw = spark.read.json(path)
    figures = [c for c, t in raw.dtypes if c != "arm" and t in ("double", "bigint")]
    return raw.select("arm", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in figures])).alias("m")).select("arm", "m.metric", "m.value")


# --- pages as files --------------------------------------------------------------------------------------------

# The fields a page's own columns fill.
OWN_FIELDS = ("id", "title", "category", "tags", "sources", "created", "updated")


def page_text(own: dict, extras: dict, body: str) -> str:
    """Front matter and body; a page's own fields win over extras of the same name."""
    fields = {**{k: v for k, v in extras.items() if k not in OWN_FIELDS}, **{k: v for k, v in own.items() if v is not None}}
    lines = [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in fields.items()]
    return "---\n" + "\n".join(lines) + "\n---\n\n" + body.strip("\n") + "\n"


def write_file(root: str, path: str, text: str) -> None:
    """Write beside, then rename: a reader sees the old file or the new one. The path must stay below the root."""
    if not md.contained(path, root):
        raise ValueError(f"{path} leaves the base")
    at = os.path.join(root, path)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(at))
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, at)


def trash(root: str, path: str, at: str) -> str:
    """Move a page below ``trash/`` with the time in its front matter; a name that is taken gets a number."""
    source = os.path.join(root, path)
    if not md.contained(path, root):
        raise ValueError(f"{path} leaves the base")
    with open(source, encoding="utf-8") as f:
        text = f.read()
    text = text.replace("---\n", f"---\ntrashed: {at}\n", 1) if text.startswith("---\n") else f"---\ntrashed: {at}\n---\n\n{text}"
    stem, ext = os.path.splitext(path)
    to, n = f"trash/{path}", 1
    while os.path.exists(os.path.join(root, to)):
        to, n = f"trash/{stem}-{n}{ext}", n + 1
    write_file(root, to, text)
    os.remove(source)
    return to


# --- providers -------------------------------------------------------------------------------------------------

def complete(prompts: DataFrame, key: str, prompt: str, model: Callable[[str], str], retries: int = 3) -> DataFrame:
    """(key, reply, error) of every prompt by a language model; a transient failure is tried again, then told."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies, errors = [], []
            for text in b.column(1).to_pylist():
                reply = error = None
                for attempt in range(retries):
                    try:
                        reply, error = model(text or ""), None
                        break
                    except (TimeoutError, ConnectionError) as e:
                        error = str(e) or type(e).__name__
                        time.sleep(0.01 * attempt)
                replies.append(reply), errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string())], [key, "reply", "error"])

    return prompts.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, reply string, error string")


def embed_mixed(items: DataFrame, key: str, model: Callable[[list[tuple[str | None, bytes | None]]], list[list[float]]], batch: int = 16) -> DataFrame:
    """(key, embedding) of items (key, text, image) in one space: a text, an image, or both."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            made = [v for at in range(0, len(pairs), batch) for v in model(pairs[at : at + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.float32()))], [key, "embedding"])

    return items.select(key, "text", "image").mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def fill(template: str, values: dict[str, str]) -> str:
    """Placeholders ``{name}`` by their values in one pass: what a value holds is not filled again. Unknown names are an error."""
    return re.sub(r"\{(\w+)\}", lambda m: values[m.group(1)], template)


def template_problems(template: str, needed: set[str], allowed: set[str]) -> list[str]:
    """What is wrong with a template that shall stand in for another."""
    used = set(re.findall(r"\{(\w+)\}", template))
    return [f"missing {{{x}}}" for x in sorted(needed - used)] + [f"unknown {{{x}}}" for x in sorted(used - allowed)]


# --- edges of the service --------------------------------------------------------------------------------------

def ndjson(rows: DataFrame) -> Iterator[str]:
    """A result as lines: started, one partial per row as partitions come in, final."""
    yield json.dumps({"type": "started"})
    n = 0
    for r in rows.toLocalIterator(prefetchPartitions=True):
        n += 1
        yield json.dumps({"type": "partial", "row": r.asDict(recursive=True)}, default=str, ensure_ascii=False)
    yield json.dumps({"type": "final", "rows": n})


def long_poll(read: Callable[[int], list], start: int, wait: float = 60.0, pause: float = 0.5) -> list:
    """What ``read(start)`` gives as soon as it gives something, or nothing after ``wait`` seconds."""
    until = time.monotonic() + wait
    while not (found := read(start)) and time.monotonic() < until:
        time.sleep(min(pause, max(0.0, until - time.monotonic())))
    return found
