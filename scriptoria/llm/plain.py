"""One plain form for texts that look the same: width, composition, invisible characters, blanks, look-alikes.

Distinct values are exploded to positioned characters. A broadcast join with the character table (built by rule from
the Unicode database, so its size is bounded by Unicode) gives each character's compatibility decomposition, with
invisible characters gone and blanks and hyphens made ordinary. Combining marks are ordered by class within their
segment. Words that mix alphabets are moved into one of them through the look-alike table. Segments are recomposed
with a second broadcast table (composites reachable from each base character) and strings rebuilt.

Printable ASCII is its own plain form and is not exploded. Of the other values only a 128-bit hash goes along with
the characters, so a value of any length costs what its characters cost. Values are partitioned by that hash before
the explode and everything after it, windows included, keeps that partitioning: no character is ever shuffled.
"""

from __future__ import annotations

import unicodedata as U
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.functions.text import casefold, nfc

# Letters of other alphabets and the Latin letters they look like.
LOOK_ALIKES = {
    "CYRILLIC": dict(zip("аеорсхуіѕјһԛԝкѵАВЕКМНОРСТХУЅІЈԚԜ", "aeopcxyisjhqwkvABEKMHOPCTXYSIJQW")),
    "GREEK": dict(zip("ονιυρακχγητΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oviupakxyntABEZHIKMNOPTYX")),
}
# Characters drawn like the hyphen.
HYPHENS = "‐‑‒–⁃−֊᠆⸗"
# Characters that draw nothing although their category does not say so.
BLIND = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10)]))
#: Above every combining class: nothing composes past a starter that stayed.
BLOCKED = 256
ALPHABETS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "GEORGIAN", "CHEROKEE")


def _kind(c: str) -> str:
    """'' (drop), a blank, a hyphen, or the character itself."""
    cat = U.category(c)
    if c in "\t\n\v\f\r\x85" or cat in ("Zs", "Zl", "Zp"):
        return " "
    if c in HYPHENS:
        return "-"
    if cat in ("Cf", "Cc", "Cs") or c in BLIND or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    return c


def _alphabet(c: str) -> str:
    name = U.name(c, "")
    return next((a for a in ALPHABETS if name.startswith(a + " ")), "") if U.category(c)[0] == "L" else ""


@lru_cache(1)
def _tables() -> tuple[list, list]:
    """Rows of the character table and of the composition table."""
    joiners, composed = set(), {}
    for n in range(0x110000):
        c = chr(n)
        if 0xD800 <= n < 0xE000:
            continue
        d = U.decomposition(c)
        if 0xAC00 <= n < 0xD7A4:
            whole = U.normalize("NFD", c)
            pair = whole[:2] if len(whole) == 2 else U.normalize("NFC", whole[:2]) + whole[2]
        elif d and d[0] != "<" and " " in d:
            pair = "".join(chr(int(x, 16)) for x in d.split())
        else:
            continue
        if U.normalize("NFC", pair) == c:
            composed.setdefault(U.normalize("NFD", pair[0])[0], {})[pair] = c
            if not U.combining(pair[1]):
                joiners.add(pair[1])
    latin = {a: m for a, m in LOOK_ALIKES.items()}
    back = {a: {v: k for k, v in reversed(m.items())} for a, m in LOOK_ALIKES.items()}

    def out(c: str) -> tuple:
        alphabet = _alphabet(c)
        skeleton = c if alphabet == "LATIN" else latin.get(alphabet, {}).get(c)
        other = {a: (c if a == alphabet else back[a].get(skeleton)) for a in back}
        word = bool(alphabet) or U.category(c)[0] == "M" or U.category(c) == "Nd"
        return (c, U.combining(c), c in joiners, word, alphabet, skeleton if alphabet else None, other["GREEK"] if alphabet else None, other["CYRILLIC"] if alphabet else None)

    chars = []
    for n in range(0x110000):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        if U.category(c) in ("Cn", "Co"):
            continue
        to = "".join(_kind(x) for x in U.normalize("NFKD", _kind(c)))
        row = [out(x) for x in to]
        if to != c or row[0][1] or row[0][2] or row[0][3]:
            chars.append((c, row))
    return chars, [(base, pairs) for base, pairs in composed.items()]


OUT = "array<struct<ch:string,ccc:int,joins:boolean,word:boolean,alphabet:string,latin:string,greek:string,cyrillic:string>>"


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    chars, composed = _tables()
    return spark.createDataFrame(chars, f"ch string, outs {OUT}"), spark.createDataFrame(composed, "base string, pairs map<string,string>")


def plain_forms(values: DataFrame, value: str = "value") -> DataFrame:
    """(value, plain, skeleton) of every distinct non-null value.

    ``skeleton`` is what remains when every letter is read as its Latin look-alike, case folded, blanks collapsed;
    equal skeletons read alike. The empty string is plain. Values of any length are handled whole.
    """
    spark = values.sparkSession
    chars, composed = tables(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(values[value].alias("value")).where("value IS NOT NULL").distinct()
    simple = distinct.where(ascii_only(F.col("value"))).select("value", F.col("value").alias("plain"), folded(F.col("value")).alias("skeleton"))
    # A number of partitions said outright: by size alone these few bytes would be one task, for all the work they hold.
    keyed = distinct.where(~ascii_only(F.col("value"))).select(F.xxhash64("value").alias("k1"), F.xxhash64(F.lit("low half"), "value").alias("k2"), "value").repartition(n, "k1", "k2")
    one = keyed.select("k1", "k2", F.posexplode(F.split("value", "")).alias("pos", "ch")).where("ch <> ''")
    itself = F.array(
        F.struct(F.col("ch"), F.lit(0).alias("ccc"), F.lit(False).alias("joins"), F.lit(False).alias("word"), F.lit("").alias("alphabet"), *[F.lit(None).cast("string").alias(x) for x in ("latin", "greek", "cyrillic")])
    ).cast(OUT)
    outs = one.join(F.broadcast(chars), "ch", "left").select("k1", "k2", "pos", F.posexplode(F.coalesce("outs", itself)).alias("sub", "o")).select("k1", "k2", "pos", "sub", "o.*")
    in_value = Window.partitionBy("k1", "k2").orderBy("pos", "sub")
    running = in_value.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when((F.col("ccc") == 0) & ~F.col("joins"), 1).otherwise(0)
    marked = outs.withColumn("seg", F.sum(starts).over(running)).withColumn("stop", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(running))
    segs = marked.groupBy("k1", "k2", "seg").agg(
        F.array_sort(F.collect_list(F.struct("stop", "ccc", "pos", "sub", "ch"))).alias("run"),
        F.min_by(F.struct("word", "alphabet", "latin", "greek", "cyrillic"), F.struct("stop", "ccc", "pos", "sub")).alias("b"),
    )
    segs = segs.select("k1", "k2", "seg", "b.*", F.col("run")[0]["ch"].alias("base"), F.slice("run", 2, F.greatest(F.size("run"), F.lit(1))).alias("marks"))
    by_seg = Window.partitionBy("k1", "k2").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    segs = segs.withColumn("word_no", F.sum(F.when(F.col("word"), 0).otherwise(1)).over(by_seg))
    in_word = Window.partitionBy("k1", "k2", "word_no")
    letter = F.col("word") & (F.col("alphabet") != "")

    def count(c: Column) -> Column:
        return F.sum(F.when(letter & c, 1).otherwise(0)).over(in_word)

    total = count(F.lit(True))
    ways = []
    for rank, name in enumerate(("latin", "greek", "cyrillic")):
        own = count(F.col("alphabet") == name.upper())
        ways.append(F.struct((count(F.col(name).isNotNull()) == total).alias("all"), own.alias("own"), F.lit(-rank).alias("rank"), F.lit(name).alias("to")))
    largest = F.greatest(*[count(F.col("alphabet") == a) for a in ALPHABETS])
    segs = segs.withColumn("mixed", letter & (largest < total)).withColumn("to", F.array_max(F.filter(F.array(*ways), lambda w: w["own"] > 0))["to"])
    moved = F.when(F.col("mixed"), F.coalesce(F.when(F.col("to") == "latin", F.col("latin")).when(F.col("to") == "greek", F.col("greek")).when(F.col("to") == "cyrillic", F.col("cyrillic")), F.col("base"))).otherwise(F.col("base"))
    segs = segs.withColumn("base2", moved).join(F.broadcast(composed.withColumnRenamed("base", "base2")), "base2", "left")

    def step(a: Column, m: Column) -> Column:
        made = F.when((a["rest"] == "") | (a["ccc"] < m["ccc"]), F.try_element_at("pairs", F.concat(a["cur"], m["ch"])))
        return F.struct(F.coalesce(made, a["cur"]).alias("cur"), F.when(made.isNull(), F.when(m["ccc"] == 0, BLOCKED).otherwise(m["ccc"])).otherwise(a["ccc"]).alias("ccc"), F.when(made.isNull(), F.concat(a["rest"], m["ch"])).otherwise(a["rest"]).alias("rest"))

    whole = F.aggregate("marks", F.struct(F.col("base2").alias("cur"), F.lit(0).alias("ccc"), F.lit("").alias("rest")), step, lambda a: F.concat(a["cur"], a["rest"]))
    bare = F.concat(F.coalesce("latin", "base"), F.array_join(F.transform("marks", lambda m: m["ch"]), ""))
    built = segs.select("k1", "k2", "seg", whole.alias("text"), bare.alias("bare")).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("seg", "text", "bare"))).alias("all"))
    built = built.select("k1", "k2", F.array_join(F.transform("all", lambda s: s["text"]), "").alias("plain"), F.array_join(F.transform("all", lambda s: s["bare"]), "").alias("bare"))
    # A value of which nothing is drawn has no segment left.
    others = keyed.join(built, ["k1", "k2"], "left").select("value", F.coalesce("plain", F.lit("")).alias("plain"), folded(F.coalesce("bare", F.lit(""))).alias("skeleton"))
    return simple.unionByName(others)


def folded(c: Column) -> Column:
    """Case folded, composed, runs of blanks collapsed: what does not make a difference."""
    return F.trim(F.regexp_replace(nfc(casefold(c)), " +", " "))


def ascii_only(c: Column) -> Column:
    """Printable ASCII is plain as it stands."""
    return c.rlike(r"\A[\x20-\x7e]*\z")
