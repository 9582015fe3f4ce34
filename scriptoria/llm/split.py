"""Cut oversized texts into pieces under a limit, at the strongest natural boundary, with exact overlap.

One regular expression does the cutting. Its alternatives are ordered by boundary strength and each consumes a
bounded number of characters, greedily, so the first that matches yields the longest piece that ends at the
strongest boundary: end of text, blank line, heading, line end, sentence end, clause, blank, character cluster,
code point. Strong boundaries are first tried in the upper half of the window, then anywhere, so that a piece is
cut mid-word only where the whole window has no break at all. Pieces after the first take ``limit - overlap`` new
characters; array functions look back ``overlap`` characters over the previous cuts and put them in front.

All of it runs in the JVM, row by row, without a shuffle. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of a piece, strongest first (zero-width assertions).
BOUNDARIES = (
    r"(?<=\n\n|\r\n\r\n|\n\r\n)",
    r"(?<=\n)(?=#{1,6}\s)",
    r"(?<=[\n\r])(?!(?<=\r)\n)",
    r"(?<=[.!?…]['\"”’)\]]{0,2}\s)|(?<=[。！？；])(?![”’」）])",
    r"(?<=[,;:]\s)|(?<=[，、：])",
    r"(?<=\s)(?!\s)",
)


def _alternatives(size: int) -> str:
    half = max(1, size // 2)
    some = [r".{1,%d}\z" % size]
    some += [r".{%d,%d}(?:%s)" % (half, size, b) for b in BOUNDARIES]
    some += [r".{1,%d}(?:%s)" % (half, b) for b in BOUNDARIES]
    some += [r".{1,%d}\b{g}" % size, r".{1,%d}" % size]
    return "|".join(some)


def cut_pattern(limit: int, overlap: int) -> str:
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    return rf"(?s)\A(?:{_alternatives(limit)})|(?:{_alternatives(limit - overlap)})"


def cuts(text: Column, limit: int, overlap: int) -> Column:
    """New characters of each piece, in order; their concatenation is the text. Null gives null, '' gives [].

    A text within the limit is one piece without running the expression.
    """
    found = F.regexp_extract_all(text, F.lit(cut_pattern(limit, overlap)), F.lit(0))
    return F.when(text.isNull(), None).when(text == "", F.array().cast("array<string>")).when(F.length(text) <= limit, F.array(text)).otherwise(found)


def pieces(text: Column, limit: int, overlap: int) -> Column:
    """array<struct<start_pos int, piece string>>: pieces of at most ``limit`` code points.

    Each piece but the first starts exactly ``overlap`` code points (fewer only near the start of the text) before
    the end of the piece before it. Null text gives null, empty text an empty array.
    """
    start = F.expr("named_struct('pos', 0, 'tail', '', 'made', cast(array() as array<struct<start_pos:int,piece:string>>))")

    def step(a: Column, c: Column) -> Column:
        whole = F.concat(a["tail"], c)
        made = F.concat(a["made"], F.array(F.struct((a["pos"] - F.length(a["tail"])).alias("start_pos"), whole.alias("piece"))))
        tail = F.right(whole, F.lit(overlap)) if overlap else F.lit("")
        return F.struct((a["pos"] + F.length(c)).alias("pos"), tail.alias("tail"), made.alias("made"))

    return F.aggregate(cuts(text, limit, overlap), start, step, lambda a: a["made"])


def split(items: DataFrame, text: str, limit: int, overlap: int) -> DataFrame:
    """One row per piece: the columns of ``items`` but the text, then piece_no (from 0), start_pos, n_chars, piece.

    Columns of ``items`` with those names are replaced. Rows with null or empty text have no piece.
    """
    own = ("piece_no", "start_pos", "n_chars", "piece")
    keep = [c for c in items.columns if c != text and c not in own]
    out = items.select(*[items[c] for c in keep], F.posexplode(pieces(items[text], limit, overlap)).alias("piece_no", "_p"))
    return out.select(*keep, "piece_no", F.col("_p.start_pos").alias("start_pos"), F.length("_p.piece").alias("n_chars"), F.col("_p.piece").alias("piece"))
