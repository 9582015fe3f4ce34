"""The k most similar vectors of every vector: a forest of random-projection trees, one shared priority queue.

* Exact copies become one class, told by a 128-bit hash. A class keeps its k+1 smallest ids, which is all that can ever
  be among anybody's k nearest (ties go to the smaller id), so groups of copies of any size cost nothing.
* The trees are fitted on a bounded sample (``sample_rows`` per collection, a documented parameter; chosen by a hash
  of the id, hence repeatable): each node splits by the hyperplane halfway between two sampled points.
  Every row of the collection is indexed. The broadcast forest is bounded by ``sample_rows * trees``.
* A query walks all trees through one priority queue ordered by the margin to the splits taken, and stops after
  ``probes`` leaves; rows are stored in one leaf per tree. A row that asks in a leaf it is stored in goes there once.
* What travels to a leaf is a code of one byte per dimension, packed by leaf. Within a leaf, codes are compared by
  blocked matrix products; a leaf of more than ``2 * leaf_rows`` rows, as there are once the sample is too small for
  the collection, is split again by a tree of its own and searched in ``inner_probes`` of its leaves. So the work of
  an asking row is bounded by ``probes * inner_probes * leaf_rows``, whatever the collection's size. A leaf beyond
  ``block`` rows (above ``block * sample_rows / 8`` rows, 225 million as set) is cut into salted parts that askers visit.
* Each asker keeps its ``k + spare`` best codes; their exact cosines rank them in the end. A code differs from its
  vector by at most 4 / |code|, which is allowed for where ``min_cos`` is asked.
* ``exact`` leaves the forest out: every asking row meets every stored row of its collection, block by block. The
  forest's budget is fixed, so for neighbours at any cosine its recall falls as the collection grows; a query that
  asks few rows can afford the whole scan. Its work is asking rows times stored rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.sampling import hash_sample
from scriptoria.session import store

STORED, ASKS = 1, 2


def usable(v: Column, dim: int) -> Column:
    """``dim`` finite numbers, not all zero; null is not usable."""
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """List column -> unit rows in float64 (scaled by the largest entry first, so extreme sizes keep their direction)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    m = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Forest:
    """Flat arrays per tree: plane and offset of inner nodes, children (negative: leaf -1 - child)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int) -> None:
        self.trees = []
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            planes, offsets, kids = [], [], []
            self.leaves = 0

            def grow(rows: np.ndarray) -> int:
                if len(rows) <= leaf:
                    self.leaves += 1
                    return -self.leaves
                x = sample[rows]
                best = None
                for _ in range(5):
                    a, b = rng.choice(len(rows), 2, replace=False)
                    plane = x[a] - x[b]
                    size = np.linalg.norm(plane)
                    if size < 1e-9:
                        continue
                    plane /= size
                    side = x @ plane - plane @ (x[a] + x[b]) / 2
                    skew = abs(np.mean(side > 0) - 0.5)
                    if best is None or skew < best[0]:
                        best = (skew, plane, plane @ (x[a] + x[b]) / 2, side > 0)
                    if skew < 0.2:
                        break
                if best is None or best[3].all() or not best[3].any():
                    self.leaves += 1
                    return -self.leaves
                at = len(planes)
                planes.append(best[1]), offsets.append(best[2]), kids.append([0, 0])
                kids[at][0] = grow(rows[~best[3]])
                kids[at][1] = grow(rows[best[3]])
                return at

            root = grow(np.arange(len(sample)))
            dim = sample.shape[1] if sample.ndim == 2 else 0
            self.trees.append((root, np.array(planes).reshape(-1, dim), np.array(offsets), np.array(kids, dtype=np.int64).reshape(-1, 2)))

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree: (rows, trees)."""
        out = np.zeros((len(x), len(self.trees)), dtype=np.int32)
        for t, (root, planes, offsets, kids) in enumerate(self.trees):
            at = np.full(len(x), root, dtype=np.int64)
            while (inner := at >= 0).any():
                i = np.flatnonzero(inner)
                n = at[i]
                at[i] = kids[n, (np.einsum("ij,ij->i", x[i], planes[n]) - offsets[n] > 0).astype(np.int64)]
            out[:, t] = -1 - at
        return out

    def search(self, x: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
        """The first ``probes`` leaves (tree, leaf) of each row, by a priority queue shared by all trees."""
        margins = [x @ planes.T - offsets if len(planes) else np.zeros((len(x), 0)) for _, planes, offsets, _ in self.trees]
        kids = [k.tolist() for _, _, _, k in self.trees]
        roots = [r for r, _, _, _ in self.trees]
        out = []
        for r in range(len(x)):
            rows = [m[r] for m in margins]
            queue = [(-math.inf, t, root) for t, root in enumerate(roots)]
            found: list[tuple[int, int]] = []
            while queue and len(found) < probes:
                lost, t, node = heapq.heappop(queue)
                while node >= 0:
                    m = rows[t][node]
                    near, far = (kids[t][node][1], kids[t][node][0]) if m > 0 else (kids[t][node][0], kids[t][node][1])
                    heapq.heappush(queue, (max(lost, abs(m)), t, far))
                    node = near
                found.append((t, -1 - node))
            out.append(found)
        return out


def _ranked(stored_ids: np.ndarray, stored: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, min_cos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact top k stored rows of each asked row (itself left out), ties to the smaller id."""
    order = np.argsort(stored_ids, kind="stable")
    stored_ids, stored = stored_ids[order], stored[order]
    a, b, c = [], [], []
    for at in range(0, len(ids), 2048):
        q = ids[at : at + 2048]
        cos = np.round(asked[at : at + 2048] @ stored.T, 12)
        cos[q[:, None] == stored_ids[None, :]] = -9
        cos[cos < min_cos] = -9
        n = min(k, cos.shape[1])
        if n < cos.shape[1]:
            # The k-th value bounds the answer; equal values beyond it are settled by id below.
            kth = np.partition(cos, cos.shape[1] - n, axis=1)[:, cos.shape[1] - n][:, None]
            hit = (cos >= kth) & (cos > -9)
        else:
            hit = cos > -9
        r, s = np.nonzero(hit)
        v = cos[r, s]
        o = np.lexsort((stored_ids[s], -v, r))
        r, s, v = r[o], s[o], v[o]
        first = np.r_[0, np.flatnonzero(np.diff(r)) + 1] if len(r) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        keep = rank < k
        a.append(q[r[keep]]), b.append(stored_ids[s[keep]]), c.append(v[keep])
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def encoded(x: np.ndarray) -> np.ndarray:
    """Unit rows as one signed byte per dimension, the largest entry at 127."""
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of codes in float32, and how far each may lie from its vector."""
    x = codes.astype(np.float32)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / size, math.sqrt(codes.shape[1]) / 2 / size[:, 0]


def _candidates(stored_ids: np.ndarray, stored: np.ndarray, ids: np.ndarray, asked: np.ndarray, keep: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """About the ``keep`` best stored rows of each asked row by their codes, at ``floor`` at least, itself left out."""
    order = np.argsort(stored_ids, kind="stable")
    stored_ids, stored = stored_ids[order], stored[order]
    own = np.minimum(np.searchsorted(stored_ids, ids), len(stored_ids) - 1)
    there = stored_ids[own] == ids
    a, b, c = [], [], []
    for at in range(0, len(ids), 1024):
        cos = asked[at : at + 1024] @ stored.T
        mine = np.flatnonzero(there[at : at + 1024])
        cos[mine, own[at : at + 1024][mine]] = -9
        hit = cos >= floor
        many = np.flatnonzero(hit.sum(axis=1) > keep)
        if len(many):
            part = cos[many]
            kth = np.partition(part, part.shape[1] - keep, axis=1)[:, part.shape[1] - keep]
            hit[many] = part >= kth[:, None]
        r, s = np.nonzero(hit)
        a.append(ids[at + r]), b.append(stored_ids[s]), c.append(cos[r, s])
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def _leaf_search(ids: np.ndarray, codes: np.ndarray, role: np.ndarray, keep: int, min_cos: float, leaf_rows: int, inner_probes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of the asking rows of one leaf; a large leaf is searched through a tree of its own."""
    x, off = decoded(codes)
    s, q = np.flatnonzero(role & STORED), np.flatnonzero(role & ASKS)
    if not len(s) or not len(q):
        return ids[:0], ids[:0], np.zeros(0, np.float32)
    floor = min_cos - off[s].max() - off[q].max() if min_cos > -1 else -8.0
    if len(s) <= 2 * leaf_rows:
        return _candidates(ids[s], x[s], ids[q], x[q], keep, floor)
    tree = Forest(x[s].astype(np.float64), 1, leaf_rows, seed)
    place = tree.place(x[s].astype(np.float64))[:, 0]
    asked: dict[int, list[int]] = {}
    for i, leaves in zip(q.tolist(), tree.search(x[q].astype(np.float64), inner_probes)):
        for _, leaf in leaves:
            asked.setdefault(leaf, []).append(i)
    out = []
    for leaf, who in asked.items():
        inside = s[place == leaf]
        if len(inside):
            out.append(_candidates(ids[inside], x[inside], ids[who], x[who], keep, floor))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (ids[:0], ids[:0], np.zeros(0, np.float32))


def identified(vectors: DataFrame, id_col: str, vec_col: str, group: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(grp, id, vec, h1, h2) of usable rows, and (grp, id, h1, h2) with one row per id, of several vectors that of the least hash."""
    rows = vectors.select(vectors[group].alias("grp"), vectors[id_col].alias("id"), vectors[vec_col].alias("vec")).where(usable(F.col("vec"), dim) & F.col("id").isNotNull())
    rows = rows.select("grp", "id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("low half"), "vec").alias("h2"))
    ids = store(rows.groupBy("grp", "id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("grp", "id", "h.h1", "h.h2"))
    return rows, ids


def classes(rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(grp, h1, h2, rep, members, vec): one row per distinct vector; members are the k+1 smallest ids."""
    few = ids.withColumn("at", F.row_number().over(Window.partitionBy("grp", "h1", "h2").orderBy("id"))).where(F.col("at") <= k + 1)
    folded = few.groupBy("grp", "h1", "h2").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("members"))
    own = rows.select(F.col("grp").alias("g"), F.col("id").alias("rep"), "h1", "h2", "vec")
    same = [folded["grp"].eqNullSafe(own["g"]), *[folded[c] == own[c] for c in ("rep", "h1", "h2")]]
    return store(folded.join(own, same).select(folded["grp"], folded["h1"], folded["h2"], folded["rep"], "members", "vec").dropDuplicates(["grp", "rep", "h1", "h2"]))


def fit(reps: DataFrame, dim: int, trees: int, leaf_rows: int, sample_rows: int, seed: int) -> dict:
    """A forest per collection, fitted on about ``sample_rows`` rows by hash of the id. Collections must be few (versions)."""
    forests = {}
    sizes = {r["grp"]: r["n"] for r in reps.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    for grp, n in sizes.items():
        own = reps.where(F.col("grp").eqNullSafe(F.lit(grp)))
        sample = hash_sample(own, ["rep"], sample_rows, n, f"trees {seed}").select("rep", "vec").toArrow().sort_by("rep")
        x = matrix(sample.column("vec"), dim)
        leaf = max(8, int(leaf_rows * len(x) / max(1, n)))
        forests[grp] = Forest(x, trees, leaf, seed)
    return forests


def leaf_parts(reps: DataFrame, forests, dim: int, block: int) -> dict:
    """{(grp, cell): parts} of leaves with more than ``block`` stored rows; at most trees * rows / block entries."""
    kind = reps.schema["grp"].dataType.simpleString()

    def count(batches):
        for b in batches:
            if b.num_rows:
                grp, x = np.array(b.column(0).to_pylist(), dtype=object), matrix(b.column(1), dim)
                for g in set(grp.tolist()):
                    place = forests.value[g].place(x[grp == g])
                    for t in range(place.shape[1]):
                        leaf, n = np.unique(place[:, t], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([g] * len(leaf), b.schema.field(0).type), pa.array(leaf.astype(np.int64) + (t << 32)), pa.array(n, pa.int64())], ["grp", "cell", "n"])

    sizes = reps.select("grp", "vec").mapInArrow(count, f"grp {kind}, cell bigint, n bigint").groupBy("grp", "cell").agg(F.sum("n").alias("n"))
    return {(r["grp"], r["cell"]): math.ceil(r["n"] / block) for r in sizes.where(F.col("n") > block).collect()}


def packed_leaves(asked: DataFrame, forests, parts: dict, dim: int, probes: int) -> DataFrame:
    """(grp, cell, part, reps, roles, codes): the rows of a batch that go to one leaf, packed into one row.

    ``cell`` is tree and leaf. Stored rows go to one part of their leaf in every tree, asking rows to all parts of
    the leaves they probe.
    """
    grp_type, id_type = (asked.schema[c].dataType.simpleString() for c in ("grp", "rep"))

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, grp = matrix(b.column(2), dim), np.array(b.column(0).to_pylist(), dtype=object)
            ask, codes, salt = b.column(3).to_numpy(zero_copy_only=False).astype(bool), encoded(x), b.column(4).to_numpy()
            for g in set(grp.tolist()):
                at, forest = np.flatnonzero(grp == g), forests.value[g]
                place = forest.place(x[at]).astype(np.int64) + (np.arange(len(forest.trees), dtype=np.int64) << 32)
                row, cell, role = [np.repeat(at, place.shape[1])], [place.ravel()], [np.full(place.size, STORED)]
                wanted = at[ask[at]]
                found = forest.search(x[wanted], probes)
                row.append(np.repeat(wanted, [len(f) for f in found]))
                cell.append(np.array([(t << 32) + n for f in found for t, n in f], dtype=np.int64))
                role.append(np.full(len(cell[1]), ASKS))
                row, cell, role = np.concatenate(row), np.concatenate(cell), np.concatenate(role)
                part = np.zeros(len(row), dtype=np.int64)
                split = np.flatnonzero(np.isin(cell, [c for k, c in parts if k == g]))
                if len(split):
                    n = np.array([parts[g, c] for c in cell[split].tolist()])
                    own = split[role[split] == STORED]
                    part[own] = salt[row[own]] % n[role[split] == STORED]
                    asks, n = split[role[split] == ASKS], n[role[split] == ASKS]
                    every = np.concatenate([np.arange(m) for m in n.tolist()]) if len(n) else n
                    rest = np.setdiff1d(np.arange(len(row)), asks)
                    again = np.repeat(asks, n)
                    part = np.concatenate([part[rest], every])
                    row, cell, role = (np.concatenate([v[rest], v[again]]) for v in (row, cell, role))
                # A row that is stored and asks in the same place goes there once.
                key = np.lexsort((row, part, cell))
                row, cell, part, role = row[key], cell[key], part[key], role[key]
                first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0)])
                role = np.bitwise_or.reduceat(role, first).astype(np.uint8)
                row, cell, part = row[first], cell[first], part[first]
                edge = np.r_[0, np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1, len(row)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g] * (len(edge) - 1), b.schema.field(0).type),
                        pa.array(cell[edge[:-1]]),
                        pa.array(part[edge[:-1]], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(edge, pa.int32()), b.column(1).take(pa.array(row))),
                        pa.array([role[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary()),
                        pa.array([codes[row[i:j]].tobytes() for i, j in zip(edge, edge[1:])], pa.binary()),
                    ],
                    ["grp", "cell", "part", "reps", "roles", "codes"],
                )

    rows = asked.select("grp", "rep", "vec", "ask", F.pmod(F.xxhash64("rep"), F.lit(1 << 31)).alias("salt"))
    return rows.mapInArrow(route, f"grp {grp_type}, cell bigint, part int, reps array<{id_type}>, roles binary, codes binary")


def searched(asked: DataFrame, dim: int, k: int, min_cos: float, trees: int, probes: int, leaf_rows: int, sample_rows: int, block: int, inner_probes: int, spare: int, seed: int) -> DataFrame:
    """(grp, rep, other, cos): exact cosines of what the forest finds, in both directions."""
    spark: SparkSession = asked.sparkSession
    grp_type, id_type = (asked.schema[c].dataType.simpleString() for c in ("grp", "rep"))
    forests = spark.sparkContext.broadcast(fit(asked.select("grp", "rep", "vec"), dim, trees, leaf_rows, sample_rows, seed))
    packed = packed_leaves(asked, forests, leaf_parts(asked, forests, dim, block), dim, probes)
    keep = k + spare

    def look(table: pa.Table) -> pa.Table:
        kind = table.schema.field("reps").type.value_type
        ids = np.asarray(pa.concat_arrays([c.flatten() for c in table.column("reps").chunks]).to_pylist())
        role = np.frombuffer(b"".join(table.column("roles").to_pylist()), np.uint8)
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(-1, dim)
        a, b, c = _leaf_search(ids, codes, role, keep, min_cos, leaf_rows, inner_probes, seed)
        grp = table.column("grp")[0].as_py()
        return pa.table({"grp": pa.array([grp] * len(a), table.schema.field("grp").type), "rep": pa.array(a.tolist(), kind), "other": pa.array(b.tolist(), kind), "near": pa.array(c, pa.float32())})

    found = packed.groupBy("grp", "cell", "part").applyInArrow(look, f"grp {grp_type}, rep {id_type}, other {id_type}, near float")
    near = found.groupBy("grp", "rep", "other").agg(F.max("near").alias("near"))
    best = near.withColumn("at", F.row_number().over(Window.partitionBy("grp", "rep").orderBy(F.desc("near"), "other"))).where(F.col("at") <= keep)
    pairs = best.select("grp", F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    left = asked.select(F.col("grp").alias("ga"), F.col("rep").alias("a"), F.col("vec").alias("va"))
    right = asked.select(F.col("grp").alias("gb"), F.col("rep").alias("b"), F.col("vec").alias("vb"))
    met = pairs.join(left, (pairs["grp"].eqNullSafe(left["ga"])) & (pairs["a"] == left["a"])).select("grp", left["a"], "b", "va")
    met = met.join(right, (met["grp"].eqNullSafe(right["gb"])) & (met["b"] == right["b"])).select("grp", "a", right["b"], "va", "vb")

    def exact(batches):
        for b in batches:
            cos = np.round(np.einsum("ij,ij->i", matrix(b.column(3), dim), matrix(b.column(4), dim)), 12) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cos, pa.float64())], ["grp", "a", "b", "cos"])

    cos = met.mapInArrow(exact, f"grp {grp_type}, a {id_type}, b {id_type}, cos double").where(F.col("cos") >= min_cos)
    way = lambda x, y: F.struct(F.col(x).alias("rep"), F.col(y).alias("other"))
    return cos.select("grp", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p"), "cos").select("grp", "p.rep", "p.other", "cos")


def scanned(asked: DataFrame, dim: int, k: int, min_cos: float, block: int) -> DataFrame:
    """(grp, rep, other, cos) of the whole scan: stored and asking rows are both cut into blocks, and every two blocks meet."""
    grp_type, id_type = (asked.schema[c].dataType.simpleString() for c in ("grp", "rep"))
    n = asked.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("stored"), F.greatest(F.ceil(F.count_if("ask") / block), F.lit(1)).cast("int").alias("asking"))
    few = n.select(F.col("grp").alias("g"), "stored", "asking")
    rows = asked.join(F.broadcast(few), asked["grp"].eqNullSafe(few["g"]))
    mine = lambda parts: F.array(F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int"))
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    kept = rows.select("grp", F.explode(every("asking")).alias("leaf"), mine("stored")[0].alias("part"), F.lit(0).alias("role"), "rep", "vec")
    ask = rows.where("ask").withColumn("leaf", mine("asking")[0]).select("grp", "leaf", F.explode(every("stored")).alias("part"), F.lit(1).alias("role"), "rep", "vec")

    def rank(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        ids = np.asarray(table.column("rep").to_pylist())
        x = matrix(table.column("vec"), dim)
        s, q = role == 0, role == 1
        if s.any() and q.any():
            a, b, c = _ranked(ids[s], x[s], ids[q], x[q], k, min_cos)
        else:
            a, b, c = ids[:0], ids[:0], np.zeros(0)
        grp, kind = table.column("grp")[0].as_py(), table.schema.field("rep").type
        return pa.table({"grp": pa.array([grp] * len(a), table.schema.field("grp").type), "rep": pa.array(a.tolist(), kind), "other": pa.array(b.tolist(), kind), "cos": pa.array(c, pa.float64())})

    return kept.unionByName(ask).groupBy("grp", "leaf", "part").applyInArrow(rank, f"grp {grp_type}, rep {id_type}, other {id_type}, cos double")


def neighbours(
    vectors: DataFrame, id_col: str, vec_col: str, group: str, *, dim: int = 64, k: int = 5, min_cos: float = -2.0, queries=None, trees: int = 6, probes: int = 12,
    leaf_rows: int = 1500, sample_rows: int = 30_000, block: int = 60_000, inner_probes: int = 3, spare: int = 11, seed: int = 17, exact: bool = False,
) -> DataFrame:
    """(grp, id, neighbour, cosine): at most k most similar vectors of each query vector within its collection.

    Vectors that are null, of another length, not finite or all zero neither ask nor answer. Ties go to the
    smaller id; copies of a vector come first with cosine 1. ``queries`` (a condition on ``id``) restricts the asking
    rows, ``min_cos`` the answers; ``exact`` misses none, whatever the collection's size. A null group is a collection of
    its own. A collection of one vector gives no row; an empty table gives none.
    """
    rows, ids = identified(vectors, id_col, vec_col, group, dim)
    reps = classes(rows, ids, k)
    # A class asks when it may hold a query; ids beyond the members kept cannot be told here, so large classes always ask.
    asking = (F.exists("members", lambda i: queries(i)) | (F.size("members") > k)) if queries is not None else F.lit(True)
    asked = reps.select("grp", "rep", "vec", asking.alias("ask"))
    if exact:
        found = scanned(asked, dim, k, min_cos, min(block, 6000))
    else:
        found = searched(asked, dim, k, min_cos, trees, probes, leaf_rows, sample_rows, block, inner_probes, spare, seed)
    top = found.withColumn("at", F.row_number().over(Window.partitionBy("grp", "rep").orderBy(F.desc("cos"), "other"))).where(F.col("at") <= k).drop("at")
    return expand(ids, reps.drop("vec"), top, k, queries, min_cos)


def expand(ids: DataFrame, reps: DataFrame, top: DataFrame, k: int, queries, min_cos: float) -> DataFrame:
    """From classes back to ids: every asking id gets the k best of its own copies and of its neighbours' members."""
    members = reps.select(F.col("grp").alias("g"), F.col("rep").alias("r"), F.col("members").alias("others"))
    near = top.join(members, top["grp"].eqNullSafe(members["g"]) & (top["other"] == members["r"])).groupBy("grp", "rep").agg(F.collect_list(F.struct("cos", "others")).alias("near"))
    near = near.select(F.col("grp").alias("g"), F.col("rep").alias("r"), "near")
    asked = reps.join(near, reps["grp"].eqNullSafe(near["g"]) & (reps["rep"] == near["r"]), "left")
    own = F.transform("members", lambda m: F.struct(F.lit(-1.0).alias("minus"), m.alias("id")))
    rest = F.flatten(F.transform(F.coalesce("near", F.array()), lambda n: F.transform(n["others"], lambda m: F.struct((-n["cos"]).alias("minus"), m.alias("id")))))
    best = F.slice(F.array_sort(F.concat(own, rest)), 1, k + 1)
    per_class = asked.select(F.col("grp").alias("g"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), best.alias("best"))
    # All ids of a class share one list; an id that is not among the k+1 smallest of its class simply keeps the first k.
    wanted = ids if queries is None else ids.where(queries(F.col("id")))
    mine = wanted.join(per_class, wanted["grp"].eqNullSafe(per_class["g"]) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    mine = mine.select("grp", "id", F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    out = mine.select("grp", "id", F.explode("best").alias("b")).select("grp", "id", F.col("b.id").alias("neighbour"), (-F.col("b.minus")).alias("cosine"))
    return out.where(F.col("cosine") >= min_cos)
