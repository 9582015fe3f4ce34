from datetime import datetime as D

from pyspark.sql import functions as F

from scriptoria.functions import text
from scriptoria.operators import orphans as op


def test_runs_merge_when_they_touch(spark, rows):
    df = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 2, 2), (0, 3, 5), (0, 7, 7), (1, 8, 8), (0, None, 4)], "bucket int, lo long, hi long")
    assert rows(op.compress_runs(df)) == [(0, 1, 5), (0, 7, 7), (1, 8, 8)]


def test_runs_are_few_and_reach_over_ranges(spark):
    """A thousand parents with three missing keys between them leave four runs at most per range; one hot key spans ranges."""
    parents = spark.range(1000).selectExpr("format_string('k%06d', id * 2) AS key", "timestamp'2024-01-01' AS since")
    some = spark.range(1000).selectExpr("format_string('k%06d', id * 2) AS key", "timestamp'2024-02-01' AS at", "id")
    missing = spark.createDataFrame([("k000101", D(2024, 2, 1), -1), ("k000901", D(2024, 2, 1), -2), ("zz", D(2024, 2, 1), -3)], "key string, at timestamp, id long")
    hot = spark.range(3000).selectExpr("'k000500' AS key", "timestamp_seconds(1700000000 + id * 1000) AS at", "1000000 + id AS id")
    refs = some.unionByName(missing).unionByName(hot)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    points = op.dictionary(refs.select("key", op.micros(F.col("at")).alias("t")), parents.select("key", F.unix_micros("since").alias("t")))
    n = points.select("bucket").distinct().count()
    assert n > 1 and op.runs_of(points).count() <= 4 + n
    got = {r["id"] for r in op.orphans(refs, parents).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {-1, -2, -3} | {1000000 + i for i in range(3000) if 1700000000 + i * 1000 < 1704067200}


def test_integer_orphans_against_brute_force(spark):
    parents = [i for i in range(-50, 3_000_000, 7919)] + list(range(100, 400)) + [2**40]
    refs = list(range(-60, 500, 3)) + [2**40, 2**40 + 1, 1048576, 2_999_000] + parents[::13]
    p = spark.createDataFrame([(i,) for i in parents + parents[:5]] + [(None,)], "k long")
    r = spark.createDataFrame([(i, "x") for i in refs] + [(None, "n")], "k long, lo string")
    got = sorted(x[0] for x in op.integer_orphans(r, p, "k").collect())
    assert got == sorted(i for i in refs if i not in set(parents))


def test_late_missing_null_and_ties(spark):
    parents = spark.createDataFrame([("a", D(2024, 1, 5)), ("a", D(2024, 1, 3)), ("b", None), (None, D(2024, 1, 1))], "key string, since timestamp")
    refs = spark.createDataFrame(
        [("a", D(2024, 1, 2), 1), ("a", D(2024, 1, 3), 2), ("a", D(2024, 1, 9), 3), ("b", D(2024, 1, 9), 4), ("c", D(2024, 1, 9), 5), ("a", None, 6), ("a", D(2024, 1, 2), 1)], "key string, at timestamp, lo int"
    )
    got = op.orphans(refs, parents)
    assert sorted(r["lo"] for r in got.collect()) == [1, 1, 4, 5, 6]
    assert op.orphans(refs.limit(0), parents).count() == 0
    assert op.orphans(refs, parents.limit(0)).count() == 7


def test_path_keys(spark):
    paths = ["Sources\\Straße.MD", "re\u0301seau/x", "o\uFB03ce", "ΣΑΣ", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.path_key(F.col("p")), text.has_ink(F.col("p")))
    import unicodedata as U

    for p, key, ink in df.collect():
        assert key == (None if p is None else U.normalize("NFC", p.replace("\\", "/")).casefold())
        assert ink == bool(p and p.strip())
