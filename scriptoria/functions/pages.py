"""Expressions over page bodies: language, claims, atomicity, titles, tokens, snippets, slugs. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿぀-ゟ゠-ヿ가-힯]"
FENCE = r"(?s)```.*?```"
WIKILINK = r"\[\[([^\]\|\n]+?)(?:\|[^\]\n]+?)?\]\]"
#: Limits beyond which a page is more than one page: characters, H1, H2, distinct links, tag domains.
ATOMIC = {"n_chars": 2500, "n_h1": 1, "n_h2": 3, "n_links": 15, "n_domains": 1}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def language(text: Column) -> Column:
    """'cjk' when over 0.3 of the countable characters among the first 200 are CJK, else 'en'; 'other' without any."""
    head = F.left(text, F.lit(200))
    cjk, latin = F.regexp_count(head, F.lit(CJK)), F.regexp_count(head, F.lit("[A-Za-z]"))
    return F.when(cjk + latin == 0, "other").when(cjk / (cjk + latin) > 0.3, "cjk").otherwise("en")


def claims(body: Column) -> Column:
    """Sentences that claim something: no fences, headings or wikilinks; three Latin words or four CJK characters."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, FENCE, ""), r"(?md)^\s{0,3}#+\s+.*$", ""), WIKILINK, " ")
    parts = F.transform(F.split(text, r"(?<=[.。])|\n{2,}"), strip)
    return F.filter(parts, lambda p: (F.regexp_count(p, F.lit("[A-Za-z]{2,}")) >= 3) | (F.regexp_count(p, F.lit(CJK)) >= 4))


def token_count(text: Column) -> Column:
    """Blank-separated tokens; a CJK run of n characters counts max(1, n // 2)."""
    run = r"[一-鿿]+"
    words = F.size(F.filter(F.split(F.regexp_replace(text, run, " "), r"\s+"), lambda w: w != ""))
    runs = F.aggregate(F.regexp_extract_all(text, F.lit(run), F.lit(0)), F.lit(0), lambda s, r: s + F.greatest(F.lit(1), F.floor(F.length(r) / 2).cast("int")))
    return words + runs


def snippet(text: Column, size: int = 240) -> Column:
    flat = F.regexp_replace(strip(text), r"\n", " ")
    return F.when(F.length(flat) > size, F.concat(F.left(flat, F.lit(size)), F.lit("…"))).otherwise(flat)


def slug(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), r"[^\x00-\x7f]", "")
    kebab = F.regexp_replace(F.regexp_replace(kept, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(kebab == "", "untitled").otherwise(kebab)


def first_heading(body: Column) -> Column:
    found = strip(F.regexp_extract(body, r"(?md)^\s{0,3}#{1,6}\s+(.*)$", 1))
    return F.when(found != "", found)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def atomicity(body: Column, tags: Column) -> dict[str, Column]:
    """What STR-17 counts, by name."""
    prose = F.regexp_replace(body, FENCE, "")
    links = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1)), lambda t: F.regexp_replace(strip(t), "#.*$", "")))
    domains = F.array_distinct(F.transform(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.contains(t, F.lit("/"))), lambda t: F.trim(F.split(t, "/")[0])))
    return {
        "n_chars": F.length(body),
        "n_h1": F.regexp_count(prose, F.lit(r"(?md)^\s{0,3}#\s+\S")),
        "n_h2": F.regexp_count(prose, F.lit(r"(?md)^\s{0,3}##\s+\S")),
        "n_links": F.size(links),
        "n_domains": F.size(domains),
    }


def title_flaws(body: Column, title: Column, path: Column) -> Column:
    """Names of title and slug flaws: no_heading, punctuation_only, title_drift, untitled_slug."""
    prose = F.regexp_replace(body, FENCE, "")
    h1 = strip(F.regexp_extract(prose, r"(?md)^\s{0,3}#\s+(.*)$", 1))
    known = strip(F.coalesce(title, F.lit("")))
    drift = (known != "") & (h1 != "") & (known != h1)
    bare = (stem(path) == "untitled") & ~F.when(known != "", known).otherwise(h1).rlike("[A-Za-z0-9]")
    return F.array_compact(F.array(F.when(h1 == "", "no_heading"), F.when((h1 != "") & ~h1.rlike(r"[\p{L}\p{N}]"), "punctuation_only"), F.when(drift, "title_drift"), F.when(bare, "untitled_slug")))
