"""Storage semantics as table transformations: last write wins, insert if absent, cascades, versions, paging."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order`` (ties: the larger of the whole row). Nulls sort first."""
    rest = [c for c in rows.columns if c not in key]
    pick = F.struct(*order, *[c for c in rest if c not in order]) if rest else F.struct(F.lit(0))
    return rows.groupBy(*key).agg(F.max(pick).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Replace the stored rows of incoming keys; ``incoming`` has one row per key."""
    return stored.join(incoming, key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The incoming rows whose key is not stored; never overwrites."""
    return incoming.dropDuplicates(key).join(stored, key, "left_anti")


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Delete by parent, then insert: chunks of a document, links of a source, references of a chunk."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming, allowMissingColumns=True)


def cascade_delete(gone: DataFrame, key: str, **dependents: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """What remains of every dependent table when the keys in ``gone`` go; references from outside are left alone."""
    return {name: df.join(gone.select(F.col(key).alias(col)).distinct(), col, "left_anti") for name, (df, col) in dependents.items()}


def first_spelling(rows: DataFrame, owner: str, key: Column, pos: str) -> DataFrame:
    """Of references alike by ``key`` the first by ``pos`` stays."""
    w = Window.partitionBy(owner, "_k").orderBy(pos)
    return rows.withColumn("_k", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k")


def active_version(versions: DataFrame, per: str, version: str = "version_id") -> DataFrame:
    return versions.groupBy(per).agg(F.max(version).alias(version))


def register_version(versions: DataFrame, identity: dict, at) -> DataFrame:
    """Slowly changing registry: a known identity is activated again, a new one added; siblings of its modality step down."""
    same = F.lit(True)
    for k, v in identity.items():
        same = same & F.col(k).eqNullSafe(F.lit(v))
    sibling = F.col("modality").eqNullSafe(F.lit(identity.get("modality")))
    known = versions.where(same).limit(1).count() > 0
    out = versions.withColumn("is_active", F.when(same, True).when(sibling, False).otherwise(F.col("is_active")))
    if known:
        return out
    new = versions.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in identity.items()], F.lit(at).alias("created_ts"), F.lit(True).alias("is_active"))
    top = versions.agg(F.coalesce(F.max("version_id"), F.lit(0)).alias("top"))
    return out.unionByName(new.join(F.broadcast(top)).withColumn("version_id", F.col("top") + 1).drop("top"), allowMissingColumns=True)


def encode_cursor(created_at: str, key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([created_at, key]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    a, b = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return a, b


def keyset_page(rows: DataFrame, newest: str, key: str, limit: int, cursor: str | None = None) -> DataFrame:
    """The rows strictly after the cursor in (newest DESC, key ASC), one more than ``limit`` to tell whether more follow."""
    if cursor:
        at, last = decode_cursor(cursor)
        rows = rows.where((F.col(newest) < F.lit(at).cast("timestamp")) | ((F.col(newest) == F.lit(at).cast("timestamp")) & (F.col(key) > last)))
    return rows.orderBy(F.col(newest).desc_nulls_last(), key).limit(limit + 1)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; a null key has none."""
    return rows.where(F.col(key) == F.lit(value))


def lookup_batch(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among the first column of ``wanted``; unknown keys are passed over."""
    return rows.join(wanted.select(F.col(wanted.columns[0]).alias(key)), key, "left_semi")


def string_list(document: Column, name: str) -> Column:
    """A list in a JSON document with its strings only; [] where the field is absent or no list."""
    items = F.try_variant_get(F.try_parse_json(document), f"$.{name}", "array<variant>")
    held = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(held, F.array().cast("array<string>"))
