"""Dense numbers over a whole table in one order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.session import store

#: ``monotonically_increasing_id`` holds the number of the range above this bit, the row's number within it below.
RANGE_SHIFT = 33


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their place (from 0) in the order of the columns ``order``, which must tell them apart.

    Rows are sorted by range; what lies before a range is the sum of the counts of the ranges before it, one row each.
    """
    placed = store(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_pos", RANGE_SHIFT))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    within = F.col("_pos") - F.shiftleft(F.col("_range"), RANGE_SHIFT)
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + within).drop("_pos", "_range", "_before")


def numbered_within(rows: DataFrame, owner: str, order: list[str], name: str) -> DataFrame:
    """The place (from 0) of every row among those of its owner. An owner that holds a third of all rows is spread over ranges."""
    every = numbered(rows, [owner, *order], "_number")
    first = every.groupBy(owner).agg(F.min("_number").alias("_first"))
    return every.join(first, owner).withColumn(name, F.col("_number") - F.col("_first")).drop("_number", "_first")
