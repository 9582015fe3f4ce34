"""Incremental ingest and the live event tape."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptoria.operators.base import last_wins


def changed(incoming: DataFrame, register: DataFrame) -> DataFrame:
    """Documents to persist: new, changed, inactive so far, without a time, or with images (whose files may have changed)."""
    same = register.where("active AND mtime > 0").select("doc_id", "body_hash")
    fresh = incoming.join(same, ["doc_id", "body_hash"], "left_anti")
    if "n_images" in incoming.columns:
        fresh = fresh.unionByName(incoming.where("n_images > 0").join(same, ["doc_id", "body_hash"], "left_semi"))
    return fresh


def merge_batch(path: str, key: str = "doc_id", order: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: every batch is one delta below ``path``, with the last row per key by ``order`` (equal ones: the larger row).

    A batch that is run again writes the same delta again, so the sink is idempotent; nothing stored is rewritten.
    ``path`` must be shared by all executors. ``merged`` reads the state, ``compact`` folds it.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        last_wins(batch, [key], list(order)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def merged(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The last row of every key over all deltas."""
    rows = spark.read.parquet(path)
    return last_wins(rows, [key], ["batch"]).drop("batch")


def compact(spark: SparkSession, path: str, to: str, key: str = "doc_id") -> None:
    """Write the state as one delta (the latest batch's) below a new path; later batches may go on there."""
    latest = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    merged(spark, path, key).write.mode("overwrite").parquet(f"{to}/batch={latest}")


def final_event(body: str | None) -> bool:
    try:
        return json.loads(body or "").get("type") == "final"
    except (ValueError, AttributeError):
        return False


class Tape(StatefulProcessor):
    """Per task: next sequence number and whether it is closed. Events after the final one are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tape", "next long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        nxt, closed = self.state.get() if self.state.exists() else (0, False)
        # All rows of the key in this micro-batch: Arrow hands them over in pieces that are in no order.
        held = [p for p in rows if len(p)]
        out = []
        for r in pd.concat(held).sort_values(["seq", "event_id"]).itertuples() if held else ():
            if closed:
                break
            out.append((key[0], int(r.event_id), nxt))
            nxt, closed = nxt + 1, final_event(r.body)
        if out:
            yield pd.DataFrame(out, columns=["task_id", "event_id", "new_seq"])
        self.state.update((nxt, closed))

    def close(self) -> None:
        pass


def tape_stream(events: DataFrame) -> DataFrame:
    """(task_id, event_id, new_seq) of a stream of events; the batch twin is ``operators.tape.admitted``.

    State is two values per task. Needs the RocksDB state store provider.
    """
    return events.where("task_id IS NOT NULL").groupBy("task_id").transformWithStateInPandas(statefulProcessor=Tape(), outputStructType="task_id string, event_id long, new_seq long", outputMode="Append", timeMode="None")


def embed_batches(texts: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[list[float]]], batch: int = 16, retries: int = 3) -> DataFrame:
    """(key, embedding, error): fixed batches through a provider; a transient failure is tried again, then skipped.

    ``TimeoutError`` and ``ConnectionError`` are transient; anything else ends the job.
    """
    import time

    import pyarrow as pa

    def run(batches):
        for b in batches:
            keys, values = b.column(0), b.column(1).to_pylist()
            out: list = [None] * len(values)
            errors: list = [None] * len(values)
            for at in range(0, len(values), batch):
                part = [v or "" for v in values[at : at + batch]]
                for attempt in range(retries):
                    try:
                        out[at : at + batch] = provider(part)
                        break
                    except (TimeoutError, ConnectionError) as e:
                        time.sleep(0.01 * attempt)
                        errors[at : at + batch] = [str(e)] * len(part)
                else:
                    continue
                errors[at : at + batch] = [None] * len(part)
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.list_(pa.float32())), pa.array(errors, pa.string())], [key, "embedding", "error"])

    return texts.select(texts[key], texts[text]).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, embedding array<float>, error string")


def arrivals(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """Events per hour of a stream whose rows may come late by ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select("window.start", "n")
