"""Text expressions that stay in the JVM.

Unicode composition and full case folding have no SQL built-in; Spark ships ICU for its collations, so
``java_method`` reaches the two static ICU functions without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Any character that is not Unicode white space.
INK = r"[^\p{IsWhite_Space}]"


def nfc(c: Column) -> Column:
    """Canonical composition; null stays null."""
    return F.when(c.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False)))


def nfkc(c: Column) -> Column:
    """Compatibility composition; null stays null."""
    return F.when(c.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True)))


def casefold(c: Column) -> Column:
    """Full case folding (``ß`` becomes ``ss``); null stays null."""
    return F.when(c.isNotNull(), F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.coalesce(c, F.lit("")), F.lit(True)))


def path_key(c: Column) -> Column:
    """Backslash read as slash, composed, case folded."""
    return casefold(nfc(F.translate(c, "\\", "/")))


def doc_id(layer: Column, path: Column) -> Column:
    return F.concat_ws(":", layer, path_key(path))


def has_ink(c: Column) -> Column:
    """True unless null, empty or white space only."""
    return F.coalesce(c.rlike(INK), F.lit(False))


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
