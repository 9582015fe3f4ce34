"""The append-only event tape of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.ordering import numbered_within


def event_type(body: Column) -> Column:
    """The type in a JSON body; null for null, cut-off or foreign bodies."""
    return F.try_variant_get(F.try_parse_json(body), "$.type", "string")


def admitted(events: DataFrame) -> DataFrame:
    """Events of the tape with ``new_seq``: once a task is final, only what happened up to its first final event stays.

    A row delivered twice counts once. Unreadable bodies stay as events of no type. Tasks without key have no tape. The
    first final event of a task is a map-side minimum, and numbers are places in a sort by range, so the busiest
    task is in no single window.
    """
    once = events.where("task_id IS NOT NULL").distinct().withColumn("type", event_type(F.col("body")))
    at = F.struct("seq", "event_id")
    end = once.where("type = 'final'").groupBy("task_id").agg(F.min(at).alias("_end"))
    kept = once.join(end, "task_id", "left").where(F.col("_end").isNull() | (at <= F.col("_end"))).drop("_end")
    return numbered_within(kept, "task_id", ["seq", "event_id"], "new_seq")


def cancelled(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tasks that are asked to stop (task_id) and have not ended become cancelled; an end is never replaced."""
    stop = tasks.join(wanted.select("task_id", F.lit(True).alias("_stop")).distinct(), "task_id", "left")
    return stop.withColumn("status", F.when(F.col("_stop") & F.col("status").isin("pending", "running"), "cancelled").otherwise(F.col("status"))).drop("_stop")


def marker_state(markers: DataFrame, key: str, action: str, order: list[str]) -> DataFrame:
    """Per source the last of its markers (done, failed, ...) in the order given."""
    return markers.groupBy(key).agg(F.max_by(F.struct(action), F.struct(*order)).alias("_m")).select(key, F.col(f"_m.{action}").alias(action))


def replay(tape: DataFrame, start: int) -> DataFrame:
    """Per task the events from ``start`` on: how many, and the last sequence number."""
    return tape.where(F.col("seq") >= start).groupBy("task_id").agg(F.count("*").alias("n_events"), F.max("seq").alias("last_seq"))


def restart_cleanup(tasks: DataFrame) -> DataFrame:
    """Orphaned running rows become failed after a restart."""
    return tasks.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


STATUS_ORDER = ("pending", "running", "failed", "cancelled", "succeeded")


def latest_status(tasks: DataFrame) -> DataFrame:
    """One row per task: the last of its states; a terminal status is never replaced by an earlier one."""
    stage = F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status")), F.lit(0))
    pick = F.struct(stage.alias("stage"), "finished_at", "started_at", "status", "created_at", "op")
    return tasks.groupBy("task_id").agg(F.max(pick).alias("r")).select("task_id", "r.status", "r.op", "r.created_at", "r.started_at", "r.finished_at")
