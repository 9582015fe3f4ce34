"""Data-quality rules. Each gives (kind, path, detail); ``run`` unites them without the suppressed ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import pages as rules
from scriptoria.operators import graph

STATUSES = ("draft", "published", "favorite", "archived")
#: Kinds about the files themselves; a page cannot silence them.
FIXED_KINDS = ("missing_file", "untracked_file")


def _issue(df: DataFrame, kind: str, path, detail) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), path.alias("path"), detail.cast("string").alias("detail"))


def broken_links(resolved: DataFrame) -> DataFrame:
    """Wikilinks that lead to no active document."""
    lost = resolved.where("link_type = 'wikilink' AND dst_doc_id IS NULL AND trim(dst_path) <> ''")
    return _issue(lost, "broken_wikilink", F.regexp_replace("src_doc_id", "^[^:]*:", ""), F.concat_ws(":", "line_no", "dst_path"))


def orphan_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    lone = pages.join(graph.inbound(links), pages.path == F.col("dst_path"), "left_anti")
    return _issue(lone, "orphan_page", F.col("path"), F.lit(""))


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Every path after the first of a title; an untitled page goes by its stem."""
    named = pages.select("path", F.coalesce("title", rules.stem(F.col("path"))).alias("t")).distinct()
    w = Window.partitionBy("t").orderBy("path")
    again = named.withColumn("n", F.row_number().over(w)).withColumn("first", F.first("path").over(w)).where("n > 1")
    return _issue(again, "duplicate_title", F.col("path"), F.col("first"))


def non_atomic(pages: DataFrame) -> DataFrame:
    counts = rules.atomicity(F.col("body"), F.col("tags"))
    over = F.array_compact(F.array(*[F.when(c > rules.ATOMIC[n], F.lit(n)) for n, c in counts.items()]))
    bad = pages.where("body IS NOT NULL").select("path", over.alias("over")).where(F.size("over") > 0)
    return _issue(bad, "non_atomic_page", F.col("path"), F.array_join("over", ","))


def dangling_provenance(prov: DataFrame, pages: DataFrame) -> DataFrame:
    return _issue(prov.where("NOT resolved").join(pages.select("id", "path"), "id"), "dangling_provenance", F.col("path"), F.col("source_path"))


def missing_provenance(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Front-matter against table, both (path, source_key, source_path): on one side only, or spelled otherwise."""
    a, b = declared.alias("a"), stored.alias("b")
    both = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.source_key") == F.col("b.source_key")), "full")
    off = both.where(~F.col("a.source_path").eqNullSafe(F.col("b.source_path")))
    return _issue(off, "missing_provenance", F.coalesce("a.path", "b.path"), F.coalesce("a.source_path", "b.source_path"))


def invalid_status(docs: DataFrame) -> DataFrame:
    bad = docs.where((F.col("layer") == "wisdom") & F.col("active") & F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES))
    return _issue(bad, "invalid_wisdom_status", F.col("path"), F.col("status"))


def uncategorized(pages: DataFrame, fallback: str) -> DataFrame:
    return _issue(pages.where(F.col("category") == fallback), "uncategorized", F.col("path"), F.lit(fallback))


def title_quality(pages: DataFrame) -> DataFrame:
    flaws = pages.where("body IS NOT NULL").select("path", rules.title_flaws(F.col("body"), F.col("title"), F.col("path")).alias("f")).where(F.size("f") > 0)
    return _issue(flaws, "title_slug_quality", F.col("path"), F.array_join("f", ","))


def missing_files(docs: DataFrame, files: DataFrame) -> DataFrame:
    return _issue(docs.where("active").join(files.select("path_key").distinct(), "path_key", "left_anti"), "missing_file", F.col("path"), F.lit(""))


def stale_index(docs: DataFrame, files: DataFrame) -> DataFrame:
    both = docs.where("active").join(files.select("path_key", F.col("body_hash").alias("disk_hash")), "path_key")
    return _issue(both.where("body_hash <> disk_hash"), "stale_index", F.col("path"), F.col("disk_hash"))


def untracked_files(docs: DataFrame, files: DataFrame) -> DataFrame:
    return _issue(files.join(docs.where("active").select("path_key").distinct(), "path_key", "left_anti"), "untracked_file", F.col("path"), F.lit(""))


def skips(pages: DataFrame, front_matter: str) -> DataFrame:
    """(path, kind) that pages silence in the ``skip`` list of their front matter's ``lint``; anything else there silences nothing."""
    kinds = F.try_variant_get(F.try_parse_json(F.col(front_matter)), "$.lint.skip", "array<string>")
    return pages.select("path", F.explode(kinds).alias("kind")).where("kind IS NOT NULL").distinct()


def run(issues: list[DataFrame], skips: DataFrame | None = None) -> DataFrame:
    """All issues but those a page silences (``skips``: path, kind)."""
    out = reduce(DataFrame.unionByName, issues)
    if skips is None:
        return out
    silent = skips.where(~F.col("kind").isin(*FIXED_KINDS))
    return out.join(silent, ["path", "kind"], "left_anti").select("kind", "path", "detail")
