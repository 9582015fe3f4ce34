"""The library's expressions as functions for SQL, and the link parser as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# Patterns as in ``functions.pages``; a backslash is doubled once for SQL.
_FUNCTIONS = {
    "path_key(p STRING) RETURNS STRING": r"reflect('com.ibm.icu.lang.UCharacter', 'foldCase', reflect('com.ibm.icu.text.Normalizer', 'compose', translate(coalesce(p, ''), '\\', '/'), false), true)",
    "page_slug(t STRING) RETURNS STRING": r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^\\x00-\\x7f]', ''), '[^a-z0-9]+', '-'), '^-+|-+$', ''), ''), if(t IS NULL, NULL, 'untitled'))",
    "text_language(t STRING) RETURNS STRING": "CASE WHEN regexp_count(left(t, 200), '[一-鿿぀-ゟ゠-ヿ가-힯A-Za-z]') = 0 THEN 'other' WHEN regexp_count(left(t, 200), '[一-鿿぀-ゟ゠-ヿ가-힯]') / regexp_count(left(t, 200), '[一-鿿぀-ゟ゠-ヿ가-힯A-Za-z]') > 0.3 THEN 'cjk' ELSE 'en' END",
    "vector_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v), sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)))",
}


class ParseLinks:
    """All links of a text: kind, target, anchor and line."""

    def eval(self, body: str):
        from scriptoria.operators.parsing import find_links

        for start, kind, target, anchor, line in find_links(body or ""):
            yield start, kind, target, anchor, line


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names are returned."""
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("parse_links", udtf(ParseLinks, returnType="start int, kind string, target string, anchor string, line int"))
    return [h.split("(")[0] for h in _FUNCTIONS] + ["parse_links"]
