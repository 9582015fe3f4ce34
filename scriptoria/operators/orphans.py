"""References to records that do not exist: missing, deleted, or arriving only later.

Keys become integers. The keys and instants of parents and references form one sorted dictionary, and a point's
integer is its place there; a native integer key is its own integer. A parent that exists from ``since`` on owns all
integers from its start, (key, since), to its end, (key, end of time). Owned spans that touch merge into contiguous
runs, so whatever lies between two runs is a point that no parent owns, and there are no more runs than such points,
but for one more per range. Every distinct reference is as-of matched to the last run that starts at or before it and
is an orphan when it lies beyond that run's end. Missing, deleted and late parents are thus one and the same comparison.

Skew: points are distinct (key, instant), folded on the map side, and sorted by range; a range boundary may fall
within a key, so a key that holds a third of all references is spread over ranges. A run that reaches into later
ranges is carried over to them by a table of one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.operators.ordering import RANGE_SHIFT
from scriptoria.session import store

FOREVER = (1 << 63) - 1
START, REF, END = 0, 1, 2


def micros(at: Column) -> Column:
    """An instant as an integer; an unknown one lies before all others."""
    return F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(-FOREVER))


def dictionary(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(key, t, side, pos, bucket) of all points. ``refs``: key, t; ``parents``: key, t (several starts: the first counts).

    Integers ascend over the whole dictionary and are contiguous within a range.
    """
    first = parents.where("key IS NOT NULL AND t IS NOT NULL").groupBy("key").agg(F.min("t").alias("t"))
    points = first.select("key", "t", F.lit(START).alias("side")).unionByName(first.select("key", F.lit(FOREVER).alias("t"), F.lit(END).alias("side")))
    points = points.unionByName(refs.select("key", "t").distinct().withColumn("side", F.lit(REF)))
    ordered = points.repartitionByRange("key", "t", "side").sortWithinPartitions("key", "t", "side")
    return store(ordered.withColumn("pos", F.monotonically_increasing_id())).withColumn("bucket", F.shiftright("pos", RANGE_SHIFT).cast("int"))


def compress_runs(spans: DataFrame) -> DataFrame:
    """(bucket, lo, hi) spans of owned integers -> maximal contiguous runs (bucket, lo, hi).

    Overlapping and touching spans merge (``lo <= previous hi + 1``); rows with a null bound are left out.
    """
    folded = spans.where("lo IS NOT NULL AND hi IS NOT NULL").groupBy("bucket", "lo").agg(F.max("hi").alias("hi"))
    w = Window.partitionBy("bucket").orderBy("lo")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | ((before < FOREVER) & (F.col("lo") > before + 1)), 1).otherwise(0)
    numbered = folded.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("bucket", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def beyond(runs: DataFrame, points: DataFrame) -> DataFrame:
    """The rows of ``points`` (bucket, pos, ...) that lie beyond the end of the last run that starts at or before them."""
    extra = [c for c in points.columns if c not in ("bucket", "pos")]
    run = F.struct("lo", "hi")
    starts = runs.select("bucket", F.col("lo").alias("pos"), F.lit(START).alias("_side"), run.alias("_run"))
    asked = points.select("bucket", "pos", F.lit(REF).alias("_side"), *extra)
    w = Window.partitionBy("bucket").orderBy("pos", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = starts.unionByName(asked, allowMissingColumns=True).withColumn("_run", F.last("_run", ignorenulls=True).over(w)).where(F.col("_side") == REF)
    # One row per range: the last run of the ranges before it.
    last = points.select("bucket").distinct().join(runs.groupBy("bucket").agg(F.max(run).alias("last")), "bucket", "full")
    earlier = F.last("last", ignorenulls=True).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("bucket", earlier.alias("carried"))
    matched = seen.join(F.broadcast(carried), "bucket").withColumn("_run", F.coalesce("_run", "carried"))
    return matched.where(F.col("_run").isNull() | (F.col("pos") > F.col("_run.hi"))).select("bucket", "pos", *extra)


def runs_of(points: DataFrame) -> DataFrame:
    """The runs of a dictionary."""
    spans = points.where(F.col("side") != REF).groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return compress_runs(spans.withColumn("bucket", F.shiftright("lo", RANGE_SHIFT).cast("int")))


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs`` (key, at, ...) whose key no parent (key, since, ...) has at that instant.

    Rows of ``refs`` with a null key are no references and give no row. A reference without an instant has no target
    at its time, hence is an orphan; a parent without a key or a start exists at no time. Repeated rows come out as
    often as they went in; ties in time count as present. Empty inputs give empty output, or all references when there are
    no parents. Other columns of ``refs`` pass through untouched, whatever their names.
    """
    keyed = refs.where(refs["key"].isNotNull()).select(F.struct("*").alias("row"), refs["key"].alias("key"), micros(refs["at"]).alias("t"))
    points = dictionary(keyed, parents.select(parents["key"], F.unix_micros(parents["since"].cast("timestamp")).alias("t")))
    lost = beyond(runs_of(points), points.where(F.col("side") == REF)).select("key", "t")
    return keyed.join(lost, ["key", "t"], "left_semi").select("row.*")


def integer_orphans(refs: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows of ``refs`` whose integer ``key`` no row of ``parents`` has: sorted parent keys collapse to runs.

    Null references are no cases. Repeated rows come out as often as they went in.
    """
    side = lambda df, n: df.select(df[key].cast("long").alias("pos")).where("pos IS NOT NULL").distinct().withColumn("side", F.lit(n))
    both = side(parents, START).unionByName(side(refs, REF)).repartitionByRange("pos", "side")
    points = store(both.withColumn("bucket", F.spark_partition_id()))
    runs = compress_runs(points.where(F.col("side") == START).select("bucket", F.col("pos").alias("lo"), F.col("pos").alias("hi")))
    missing = beyond(runs, points.where(F.col("side") == REF)).select(F.col("pos").alias("missing_key"))
    return refs.join(missing, refs[key].cast("long") == missing["missing_key"], "left_semi")
