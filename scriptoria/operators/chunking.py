"""Heading-aware paragraph packing with overlap, and packing of sections into groups: ordered folds per document."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Blank lines, headings, Chinese runs.
_BREAK = re.compile(r"\n[ \t]*\n|\r\n[ \t]*\r\n")
_HEADING = re.compile(r"\s{0,3}(#{1,6})\s+\S")
_HAN = re.compile(r"[一-鿿]+")
_TITLE = re.compile(r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", re.MULTILINE)


def tokens(text: str) -> int:
    return len(_HAN.sub(" ", text).split()) + sum(max(1, len(r) // 2) for r in _HAN.findall(text))


class Part(NamedTuple):
    start: int
    end: int
    size: int
    heading: bool


def paragraphs(body: str) -> Iterator[Part]:
    at = 0
    for stop in [*((m.start(), m.end()) for m in _BREAK.finditer(body)), (len(body), len(body))]:
        raw = body[at : stop[0]]
        start = at + len(raw) - len(raw.lstrip("\r\n"))
        text = raw.strip("\r\n").rstrip()
        if text.strip() and (size := tokens(text)):
            yield Part(start, start + len(text), size, bool(_HEADING.match(text)))
        at = stop[1]


def cut_points(sizes: list[int], heads: list[int], budget: int, allowance: int) -> Iterator[tuple[int, int]]:
    """(first, stop) of spans of consecutive paragraphs; ``heads`` are the places of headings, in order.

    With P the running sum of sizes, a span from i stops at the first place where the next paragraph would lift it over
    the budget, or at the first heading before which it holds more than the allowance: both are searches in P. The next span
    reaches back over the last paragraph, if that alone is under the budget, and as far as the allowance bears; it
    starts afresh where the paragraph at the stop would not fit beside that.
    """
    total = [0, *accumulate(sizes)]
    n, first, least = len(sizes), 0, 1
    fits = lambda i, j: total[j + 1] - total[i] <= budget

    def back(i: int, j: int) -> int:
        if sizes[j - 1] >= budget:
            return j
        return max(i, min(j - 1, bisect_left(total, total[j] - allowance)))

    while first < n:
        full = max(least, bisect_right(total, total[first] + budget) - 1)
        at = bisect_left(heads, max(least, bisect_right(total, total[first] + allowance)))
        head = heads[at] if at < len(heads) else n
        stop = min(full, head, n)
        yield first, stop
        if stop == n:
            return
        kept = back(first, stop)
        if stop == head and kept < stop and not fits(kept, stop):
            # What a heading hands on may itself be too much: it stands alone, and hands on in turn.
            yield kept, stop
            kept = back(kept, stop)
        first, least = (kept if fits(kept, stop) else stop), stop + 1


def pack(parts: Iterator[Part], budget: int, share: float) -> Iterator[tuple[int, int]]:
    """Character spans of consecutive paragraphs within ``budget`` tokens, of which ``share`` may overlap."""
    held = list(parts)
    for i, j in cut_points([p.size for p in held], [i for i, p in enumerate(held) if p.heading], budget, int(budget * share)):
        yield held[i].start, held[j - 1].end


def sections(body: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Cut at span starts: section i reaches to the start of the next; the last keeps its own end."""
    edges = [a for a, _ in spans] + ([spans[-1][1]] if spans else [])
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def groups(body: str, cut: list[tuple[int, int]], target: int) -> Iterator[list[tuple[int, int]]]:
    """Sections packed up to ``target`` tokens; a section that opens with an H1 starts a new group."""
    held: list[tuple[int, int]] = []
    used = 0
    for a, b in cut:
        size = tokens(body[a:b])
        head = _HEADING.match(body[a:b].lstrip("\r\n"))
        if held and ((head and head.group(1) == "#") or used + size > target):
            yield held
            held, used = [], 0
        held.append((a, b))
        used += size
    if held:
        yield held


def _run(docs: DataFrame, key: str, text: str, make, names: list[str], types: list, ddl: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows, at = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for x in make(t) if t else ():
                    at.append(i), rows.append(x)
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(list(c), t) for c, t in zip(cols, types)]], [key, *names])

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {ddl}")


def chunk(docs: DataFrame, key: str, text: str, max_tokens: int = 900, overlap: float = 0.15) -> DataFrame:
    """(key, seq, start_off, end_off, n_tokens): offsets are code points; null, empty and blank bodies have no chunk."""

    def make(body: str):
        return [(i, a, b, tokens(body[a:b])) for i, (a, b) in enumerate(pack(paragraphs(body), max_tokens, overlap))]

    return _run(docs, key, text, make, ["seq", "start_off", "end_off", "n_tokens"], [pa.int32()] * 4, "seq int, start_off int, end_off int, n_tokens int")


def group(docs: DataFrame, key: str, text: str, max_tokens: int = 900, overlap: float = 0.15, target_tokens: int = 3600) -> DataFrame:
    """(key, group_no, start_off, end_off, n_tokens, headings): groups of sections with their distinct headings in order."""

    def make(body: str):
        spans = list(pack(paragraphs(body), max_tokens, overlap))
        for i, g in enumerate(groups(body, sections(body, spans), target_tokens)):
            whole = body[g[0][0] : g[-1][1]]
            yield i, g[0][0], g[-1][1], tokens(whole), list(dict.fromkeys(_TITLE.findall(whole)))

    return _run(docs, key, text, make, ["group_no", "start_off", "end_off", "n_tokens", "headings"], [pa.int32()] * 4 + [pa.list_(pa.string())], "group_no int, start_off int, end_off int, n_tokens int, headings array<string>")


def covering(points: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Each point (key, pos) with the first chunk that holds it; points in no chunk are left out."""
    from pyspark.sql import functions as F

    c = chunks.select(F.col(key).alias("_k"), "seq", "start_off", "end_off")
    hit = points.join(c, (points[key] == F.col("_k")) & (points["pos"] >= F.col("start_off")) & (points["pos"] < F.col("end_off")))
    return hit.groupBy(*points.columns).agg(F.min("seq").alias("seq"))


def refs_in_chunks(refs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """References (key, start, end, ...) that lie within a chunk, with offsets inside it and a dense number; overlap may hold one twice."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    c = chunks.select(F.col(key).alias("_k"), "seq", "start_off", "end_off")
    hit = refs.join(c, (refs[key] == F.col("_k")) & (F.col("start_off") <= refs["start"]) & (refs["end"] <= F.col("end_off")))
    w = Window.partitionBy("_k", "seq").orderBy("start", "end")
    return hit.select(*[refs[x] for x in refs.columns if x not in ("start", "end")], "seq", (refs["start"] - F.col("start_off")).alias("start_in_chunk"), (refs["end"] - F.col("start_off")).alias("end_in_chunk"), (F.row_number().over(w) - 1).alias("ord"))
