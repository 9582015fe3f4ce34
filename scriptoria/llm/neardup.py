"""Near-duplicate texts: many universal hash minima, banding, signature verification, alternating stars.

1. Words are runs of letters and digits in lower case (each Han or kana character is one word); a text is the set of
   64-bit hashes of its runs of ``words`` consecutive words. Texts with equal sets form one class, so groups of
   copies of any size enter the search once.
2. Every class gets ``bands * rows`` minima under random functions of a universal family (multiply-add-shift).
3. Classes that share a band meet in an equi-join on the band's hash. The join condition compares 1-bit signatures
   (four longs, population count of their difference), so pairs that merely share boilerplate are never emitted. The
   bound lies five standard deviations below what a pair at ``sure`` shows.
4. Surviving pairs are verified on the full sets.
5. Groups are connected components of the verified pairs by alternating large-star and small-star.

A hot band is a hot join key: adaptive execution splits it by map output, and no list of a band's members is built.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.session import cut, store

#: One word: a Han or kana character, or a run of other letters and digits.
SOLO = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
WORD = rf"[{SOLO}]|[\p{{L}}\p{{N}}&&[^{SOLO}]]+"


def shingles(text: Column, words: int) -> Column:
    """Sorted distinct hashes of the runs of ``words`` words; null for null text, [] for texts of fewer words."""

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(F.size(w) >= words, F.sort_array(F.array_distinct(made))).otherwise(F.array().cast("array<bigint>"))

    # The words are bound as a lambda variable: as a column they would be worked out anew for every run. Each is hashed once.
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return F.element_at(F.transform(F.array(found), runs), 1)


def classes(texts: DataFrame, key: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(rep, shingles) of texts that have any, and (rep, member) for all of their keys; repeated rows count once."""
    rows = texts.select(texts[key].alias("member"), texts[text].alias("text")).where("member IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("member", shingles(F.col("text"), words).alias("shingles"))
    # 128 bits name a set: that two different ones share them needs some 10**19 sets to become likely.
    prints = [F.xxhash64("shingles").alias("p1"), F.xxhash64(F.lit("low half"), "shingles").alias("p2")]
    rows = store(rows.where(F.size("shingles") > 0).select("member", "shingles", *prints))
    reps = store(rows.groupBy("p1", "p2").agg(F.min("member").alias("rep"), F.any_value("shingles").alias("shingles")))
    members = rows.select("member", "p1", "p2").distinct().join(reps.select("rep", "p1", "p2"), ["p1", "p2"]).select("rep", "member")
    return reps.select("rep", "shingles"), members


def sketches(reps: DataFrame, bands: int, rows: int, seed: int) -> DataFrame:
    """(rep, bits array<bigint>, bands array<bigint>)."""
    n = bands * rows
    kind = reps.schema["rep"].dataType.simpleString()

    def run(batches):
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        mix = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sets = batch.column(1)
            offsets = sets.offsets.to_numpy()
            flat = sets.values.to_numpy().view(np.uint64)
            minima = np.empty((batch.num_rows, n), dtype=np.uint64)
            for i in range(batch.num_rows):
                x = flat[offsets[i] : offsets[i + 1]]
                low = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(x), 4096):
                    low = np.minimum(low, ((a[:, None] * x[None, at : at + 4096] + b[:, None]) >> np.uint64(24)).min(axis=1))
                minima[i] = low
            # One bit of a second hash of every minimum: equal minima agree, others agree by chance in half the cases.
            noise = minima * np.uint64(0x9E3779B97F4A7C15)
            bit = ((noise ^ (noise >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)
            packed = np.packbits(bit.astype(np.uint8), axis=1).view(np.int64)
            keys = (minima.reshape(-1, bands, rows) * mix).sum(axis=2, dtype=np.uint64)
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(np.arange(0, packed.size + 1, packed.shape[1], dtype=np.int32), packed.ravel()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.view(np.int64).ravel()),
                ],
                ["rep", "bits", "bands"],
            )

    if n % 64:
        raise ValueError("bands * rows must be a multiple of 64")
    return reps.select("rep", "shingles").mapInArrow(run, f"rep {kind}, bits array<bigint>, bands array<bigint>")


def agreement_bound(n: int, sure: float, deviations: float = 5.0) -> int:
    """Fewest equal bits of ``n`` that a pair of Jaccard similarity ``sure`` or more shows, but for 3 in 10 million."""
    p = (1 + sure) / 2
    return math.floor(n * p - deviations * math.sqrt(n * p * (1 - p)))


def similar_pairs(reps: DataFrame, *, threshold: float, sure: float, bands: int = 64, rows: int = 4, seed: int = 5) -> DataFrame:
    """(a, b, jaccard) with a < b: class representatives of Jaccard similarity ``threshold`` or more.

    A pair at similarity s meets in some band with probability 1 - (1 - s**rows)**bands: 0.9999 at 0.6 as set here.
    """
    n = bands * rows
    drawn = sketches(reps, bands, rows, seed)
    banded = store(drawn.select("rep", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(n // 64)], F.posexplode("bands").alias("band", "band_key")))
    left, right = banded.alias("l"), banded.alias("r")
    unequal = sum((F.bit_count(F.col(f"l.b{i}").bitwiseXOR(F.col(f"r.b{i}"))) for i in range(1, n // 64)), F.bit_count(F.col("l.b0").bitwiseXOR(F.col("r.b0"))))
    same_band = (F.col("l.band_key") == F.col("r.band_key")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.rep") < F.col("r.rep"))
    met = left.join(right, same_band & (unequal <= n - agreement_bound(n, sure))).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()
    sets_a, sets_b = reps.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = met.join(sets_a, "a").join(sets_b, "b").select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard"))
    return pairs.where(F.col("jaccard") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node. Alternating large-star and small-star.

    It goes on until no edge moves. Every round halves the depth of the trees at least, so rounds grow with the logarithm of the longest path. A
    node's neighbours are never collected: minima come from map-side combined aggregates, links from joins.
    """
    e = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        e = cut(small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(small.select(F.col("m").alias("u"), "v")).where("u < v").distinct())
        # A star forest in which nothing moved any more: same edges, counted and summed.
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: pairs of classes and pairs within a class, for all their members."""
    ma, mb = members.select(F.col("rep").alias("a"), F.col("member").alias("x")), members.select(F.col("rep").alias("b"), F.col("member").alias("y"))
    across = pairs.select("a", "b").join(ma, "a").join(mb, "b").select("x", "y")
    within = ma.join(mb, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(texts: DataFrame, key: str, text: str, *, words: int, threshold: float, sure: float) -> DataFrame:
    """(member, rep, component, links): one row per text with at least one shingle.

    ``rep`` is the least key with the same shingle set, ``component`` the least key reachable over similar pairs,
    ``links`` the number of other classes it is similar to. Null, blank and very short texts have no row.
    """
    reps, members = classes(texts, key, text, words)
    pairs = cut(similar_pairs(reps, threshold=threshold, sure=sure))
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    joined = components(pairs).withColumnRenamed("node", "rep")
    out = members.join(joined, "rep", "left").join(links, "rep", "left")
    return out.select("member", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
