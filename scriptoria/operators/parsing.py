"""Links and image references with their offsets, front matter, page blocks: what needs match positions."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The link and image syntaxes.
WIKI = re.compile(r"\[\[([^\]\|\n]+?)(?:\|([^\]\n]+?))?\]\]")
MARKDOWN = re.compile(r"(?<!!)\[([^\]\n]+?)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)")
BARE = re.compile(r"(?<![\[(])\b(https?://[^\s)]+)")
IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*([^)\n]+?)(?=\s+\"[^\"\n]*\"\s*\)|\s*\))(?:\s+\"[^\"\n]*\")?\s*\)|!\[\[([^\]|]+?)(?:\|([^\]]+))?\]\]")
SKIPPED = ("mailto:", "tel:", "#")


def find_links(body: str) -> list[tuple[int, str, str, str | None, int]]:
    """(start, kind, target, anchor, line from 1) in source order."""
    breaks = [m.start() for m in re.finditer("\n", body)]
    out = []

    def add(at: int, kind: str, whole: str) -> None:
        target, _, anchor = whole.strip().partition("#")
        out.append((at, kind, target.strip(), anchor or None, bisect.bisect_left(breaks, at) + 1))

    for m in WIKI.finditer(body):
        add(m.start(), "wikilink", m.group(1))
    for m in MARKDOWN.finditer(body):
        if not (href := m.group(2)).startswith(SKIPPED):
            add(m.start(), "url" if href.startswith(("http://", "https://")) else "markdown", href)
    for m in BARE.finditer(body):
        add(m.start(), "url", m.group(1))
    return sorted(out, key=lambda x: x[0])


def find_images(body: str) -> list[tuple[int, int, str, str]]:
    """(start, end, alt, path) of image references in both syntaxes; backslashes read as slashes."""
    return [(m.start(), m.end(), (m.group(1) or m.group(4) or ""), (m.group(2) or m.group(3)).strip().replace("\\", "/")) for m in IMAGE.finditer(body)]


def _explode(docs: DataFrame, key: str, text: str, find, names: list[str], types: list[pa.DataType], ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for x in find(t) if t else ():
                    keys.append(i), rows.append(x)
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *[pa.array(list(c), t) for c, t in zip(cols, types)]], ["key", *names])

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {ddl}")


def links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, kind, target, anchor, line); null and empty texts have none."""
    return _explode(docs, key, text, find_links, ["start", "kind", "target", "anchor", "line"], [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()], "start int, kind string, target string, anchor string, line int")


def images(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, alt, path)."""
    return _explode(docs, key, text, find_images, ["start", "end", "alt", "path"], [pa.int32(), pa.int32(), pa.string(), pa.string()], "start int, end int, alt string, path string")


def _scalar(v: str):
    v = v.strip()
    if v[:1] == v[-1:] and v[:1] in "'\"" and len(v) > 1:
        return v[1:-1]
    if v.startswith("[") and v.endswith("]"):
        return [_scalar(x) for x in v[1:-1].split(",") if x.strip()]
    return {"true": True, "false": False, "null": None, "": None}.get(v.lower(), v)


def front_matter(text: str) -> tuple[dict, str, str | None]:
    """(fields, body, error). The block between two ``---`` lines: scalars, inline lists and dash lists; a line of
    another form is an error, and the text counts as body."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\Z)", text, re.DOTALL)
    if not m:
        return {}, text, None
    fields: dict = {}
    name = None
    for line in m.group(1).splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if (item := re.match(r"\s*-\s+(.*)", line)) and name:
            fields[name] = [*(fields[name] or []), _scalar(item.group(1))] if isinstance(fields[name], (list, type(None))) else fields[name]
        elif pair := re.match(r"([\w.-]+)\s*:(?:\s+(.*))?$", line):
            name = pair.group(1)
            fields[name] = _scalar(pair.group(2) or "")
        else:
            return {}, text, f"front matter line not understood: {line.strip()[:60]}"
    return fields, text[m.end() :], None


def page_blocks(text: str, categories: set[str], fallback: str) -> tuple[list[dict], str | None]:
    """``<page category=".." slug="..">`` blocks of a generated text: pages, and an error when the last one is cut off."""
    pages, end = [], 0
    for m in re.finditer(r"<page\b([^>]*)>(.*?)</page>", text, re.DOTALL):
        attrs = dict(re.findall(r"([\w-]+)\s*=\s*\"([^\"]*)\"", m.group(1)))
        fields, body, _ = front_matter(m.group(2).strip())
        title = re.search(r"^#\s+(.+)$", body, re.MULTILINE)
        category = attrs.get("category", "")
        tags = [t for t in fields.get("tags") or [] if isinstance(t, str)] if isinstance(fields.get("tags"), list) else []
        pages.append({"category": category if category in categories else fallback, "slug": attrs.get("slug"), "title": title.group(1).strip() if title else None, "tags": tags, "body": body.strip()})
        end = m.end()
    return pages, "truncated" if re.search(r"<page\b", text[end:]) else None


def verdict(text: str, allowed: frozenset[str] = frozenset({"yes", "partial", "no"})) -> str | None:
    """Verdict of a judge's JSON reply, code fence or not; None unless it is one of the closed set."""
    try:
        v = json.loads(re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)).get("verdict")
    except (ValueError, AttributeError):
        return None
    v = v.strip().lower() if isinstance(v, str) else None
    return v if v in allowed else None
