"""Batch retrieval: BM25 and vector legs, rank and score fusion, diversity, page references, ranking metrics.

Everything works on a table of queries at once; one query is a table of one row. Scores are rounded to six places
before ranking, so that sums in another order rank alike; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.text import word_tokens
from scriptoria.session import store

K1, B = 1.2, 0.75
OPERATORS = ("AND", "OR", "NOT", "NEAR")


def query_terms(q: Column) -> Column:
    """Distinct lower-case words of a free text query, without the search language's own operators."""
    words = F.filter(F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: ~F.upper(w).isin(*OPERATORS))
    return F.array_distinct(F.transform(words, F.lower))


def top(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per ``by`` with their 1-based ``rank``."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries that one pass over the chunks holds; more of them take further passes.
QUERY_BLOCK = 10_000
TILE = 1000
#: Queries whose scores over a tile of chunks are held at once, few enough to stay in the cache.
QUERY_TILE = 500
#: Tasks of all passes together, per core: every task sends k rows per query of its block.
TASKS_PER_CORE = 3
#: A term is a column of the matrix product, not a list of places, if so large a share of pairs of query and chunk holds it.
COMMON = 0.006


def _sorted(q: np.ndarray, number: np.ndarray, score: np.ndarray, by_score: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By query, then by falling score and number, or by number and falling score. ``score`` is rounded to six places.

    The three go into one integer where they fit, as plain integers sort many times faster.
    """
    micro = np.rint(score * 1e6)
    most = micro.max()
    span, ids = most - micro.min(), int(number.max()) + 1
    bits = [int(x).bit_length() for x in (q.max(), span, ids)]
    if not np.isfinite(span) or sum(bits) > 62:
        order = np.lexsort((number, -score, q) if by_score else (-score, number, q))
        return q[order], number[order], score[order]
    down = (most - micro).astype(np.int64)
    high, low, wide = (down, number, bits[2]) if by_score else (number, down, bits[1])
    key = np.sort((q << (bits[1] + bits[2])) | (high << wide) | low)
    high, low = (key >> wide) & ((1 << (bits[1] + bits[2] - wide)) - 1), key & ((1 << wide) - 1)
    down, number = (high, low) if by_score else (low, high)
    return key >> (bits[1] + bits[2]), number, (most - down) / 1e6


class Best:
    """The ``k`` best (key, score) of every query seen so far, ties to the smaller key; a key counts once, at its best."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.names: list[np.ndarray] = []
        self.fresh = np.ones(queries, dtype=bool)
        self.size, self.seen, self.cuts, self.most = 0, 0, 0, max(1 << 18, 2 * queries * k)

    def tile(self, keys: np.ndarray) -> list:
        """What ``add`` wants to know of the next columns: their keys, how equal ones go together, and (set there) where the keys are kept."""
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        return [keys, None if len(starts) == len(keys) else (order, starts), 0, -1]

    def add(self, scores: np.ndarray, tile: list, first: int, floor: float, exact=None, slack: float = 5.1e-7) -> None:
        """``scores``: rows are queries from ``first`` on, columns the keys of ``tile``; nothing below ``floor`` is taken.

        What may count is rounded; where ``scores`` are only right to ``slack``, ``exact`` gives those of (rows, columns).
        """
        keys, twice, at, cuts = tile
        if cuts != self.cuts:
            at = self.seen
            self.names.append(keys)
            self.seen += len(keys)
            tile[2:] = at, self.cuts
        mine = slice(first, first + len(scores))
        least = np.maximum(self.least[mine], floor)
        once = scores if twice is None else np.maximum.reduceat(scores[:, twice[0]], twice[1], axis=1)

        def tighten(rows):
            # No more than the k best of a tile, and their ties, can be among the k best of all.
            for i in range(0, len(rows), TILE):
                some = rows[i : i + TILE]
                found = np.partition(once[some], once.shape[1] - self.k, axis=1)[:, once.shape[1] - self.k]
                least[some] = np.maximum(least[some], found - slack)

        if once.shape[1] > self.k:
            tighten(np.flatnonzero(self.fresh[mine]))
            self.fresh[mine] = False
        # What is below the floor by more than rounding mends is no answer, whatever the slack.
        bound = np.maximum(least - slack, floor - 7e-7).astype(scores.dtype)
        hit = np.flatnonzero((scores >= bound[:, None]).ravel())
        if len(hit) > 8 * self.k * len(scores) and once.shape[1] > self.k:
            tighten(np.flatnonzero(np.bincount(hit // scores.shape[1], minlength=len(scores)) > 8 * self.k))
            bound = np.maximum(least - slack, floor - 7e-7).astype(scores.dtype)
            hit = np.flatnonzero((scores >= bound[:, None]).ravel())
        if not len(hit):
            return
        q, c = np.divmod(hit, scores.shape[1])
        value = np.round(scores.ravel()[hit] if exact is None else exact(q, c), 6)
        self.least[mine] = np.where(least > floor, least, self.least[mine])
        good = value >= floor
        self.parts.append((q[good] + first, c[good] + at, value[good]))
        self.size += int(good.sum())
        if self.size > self.most:
            self._cut()

    def _cut(self) -> None:
        q, key, score = (np.concatenate(x) for x in zip(*self.parts))
        held, place = np.unique(key, return_inverse=True)
        names, number = np.unique(np.concatenate(self.names)[held], return_inverse=True)
        number = number[place]
        if len(names) < len(held):
            q, number, score = _sorted(q, number, score, by_score=False)
            new = np.r_[True, (np.diff(q) != 0) | (np.diff(number) != 0)]
            q, number, score = q[new], number[new], score[new]
        q, number, score = _sorted(q, number, score)
        starts = np.flatnonzero(np.r_[True, np.diff(q) != 0])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        full = rank == self.k - 1
        self.least[q[full]] = score[full]
        kept = rank < self.k
        self.parts, self.size = [(q[kept], number[kept], score[kept])], int(kept.sum())
        self.names, self.seen, self.cuts = [names], len(names), self.cuts + 1

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of (query, key, score)."""
        if not self.size:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0)
        self._cut()
        q, number, score = self.parts[0]
        return q, self.names[0][number], score


def _blocks(asked: DataFrame, column: str, block: int) -> list[pa.Table]:
    """The rows of ``asked`` as Arrow tables, by hash of the query, of about ``block`` queries each."""
    n = max(1, -(-asked.select("query_id").distinct().count() // block))
    return [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).select("query_id", column).toArrow() for i in range(n)]


def spread(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` as a table, so that every block's pass only reads it, in as many parts as give each core a few tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return store(rows.repartition(max(1, -(-TASKS_PER_CORE * cores // max(1, blocks)))))


def _sent(ids: list, best: Best):
    q, key, value = best.settle()
    if len(q):
        yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(q)), pa.array(key.tolist()), pa.array(value)], ["query_id", "chunk_id", "score"])


def ranked_by(rows: DataFrame, by: str, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def _weight(tf, dl, avgdl, df, n):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)), (n - df + 0.5) / (df + 0.5)


def bm25(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank). ``queries``: query_id, q; ``chunks``: chunk_id, text, and perhaps ``live``.

    Statistics cover every chunk; where ``live`` is given, only such chunks are answers. Texts are read once: what is kept of
    a chunk is how often it holds each word that any query asks for. A block of queries is broadcast and scored where the
    chunks are, over tiles of chunks; a task sends k rows per query. The distinct words of all queries are held at once.
    """
    spark = queries.sparkSession
    asked = store(queries.select("query_id", F.explode(query_terms(F.col("q"))).alias("term")).distinct())
    live = F.coalesce(F.col("live"), F.lit(False)) if "live" in chunks.columns else F.lit(True)
    sized = chunks.select("chunk_id", live.alias("live"), word_tokens(F.col("text")).alias("tokens")).where("tokens IS NOT NULL")
    q, c = (df.schema[n].dataType.simpleString() for df, n in ((queries, "query_id"), (chunks, "chunk_id")))
    kind = f"query_id {q}, chunk_id {c}, score double"
    blocks = _blocks(asked, "term", QUERY_BLOCK)
    words = pa.concat_arrays([x.column("term").combine_chunks().cast(pa.string()) for x in blocks]).unique()
    known = spark.sparkContext.broadcast(words)
    counted = spread(sized.mapInArrow(lambda batches: (_counted(b, known.value) for b in batches), f"chunk_id {c}, live boolean, dl int, terms array<int>, tf array<int>"), len(blocks))
    n, avgdl = counted.agg(F.count("*"), F.avg("dl")).first()

    def holders(batches):
        df = np.zeros(len(known.value), dtype=np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    df = np.zeros(len(words))
    if len(words):
        for r in counted.select("terms").mapInArrow(holders, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
    out = spark.createDataFrame([], kind)
    for part in blocks:
        if part.num_rows and n:
            out = out.unionByName(_bm25_block(counted, part, words, df, n, avgdl, k, kind))
    return top(out, "query_id", "score", "chunk_id", k)


def _counted(b: pa.RecordBatch, words: pa.Array) -> pa.RecordBatch:
    """(chunk_id, live, tokens) to (chunk_id, live, dl, terms, tf): places of its words among ``words``, ascending, and their numbers."""
    tokens = b.column(2)
    dl = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    place = pc.index_in(tokens.flatten().cast(pa.string()), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(dl)), dl)[place >= 0]
    pair, tf = np.unique(row * max(1, len(words)) + place[place >= 0], return_counts=True)
    row, term = np.divmod(pair, max(1, len(words)))
    offsets = pa.array(np.searchsorted(row, np.arange(len(dl) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dl.astype(np.int32)), *lists], ["chunk_id", "live", "dl", "terms", "tf"])


def _bm25_block(counted: DataFrame, part: pa.Table, words: pa.Array, df: np.ndarray, n: int, avgdl: float, k: int, kind: str) -> DataFrame:
    ids, q = np.unique(np.asarray(part.column("query_id").to_pylist()), return_inverse=True)
    term = pc.index_in(part.column("term").combine_chunks().cast(pa.string()), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
    idf = np.log(_weight(1, 1, 1, df, n)[1] + 1)
    order = np.lexsort((term, q))
    shared = counted.sparkSession.sparkContext.broadcast((ids.tolist(), q[order], term[order], idf, df / n))

    def score(batches):
        ids, q, term, idf, share = shared.value
        asking = np.bincount(term, minlength=len(idf))
        common = np.flatnonzero(asking / len(ids) * share > COMMON)
        column = np.full(len(idf), -1)
        column[common] = np.arange(len(common))
        often = column[term] >= 0
        of = np.zeros((len(ids), len(common)))
        of[q[often], column[term[often]]] = 1.0
        rough, q_rare, t_rare = of.astype(np.float32), q[~often], term[~often]
        # Weights are not negative, so sums of float32 are right to so many of its last places of the largest sum there can be.
        slack = 5.1e-7 + 2.0**-24 * (len(common) + np.bincount(q).max() + 8) * (K1 + 1) * np.bincount(q, weights=idf[term]).max()
        best, held = Best(len(ids), k), np.zeros(QUERY_TILE * 2 * TILE, dtype=np.float32)
        for whole in batches:
            for first in range(0, whole.num_rows, 2 * TILE):
                b = whole.slice(first, 2 * TILE)
                dl = b.column(1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(dl)), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
                t, tf = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                w = idf[t] * _weight(tf.astype(float), dl[row], avgdl, 1, 1)[0]
                often = column[t] >= 0
                dense = np.zeros((len(dl), len(common)))
                dense[row[often], column[t[often]]] = w[often]
                short, tile = np.ascontiguousarray(dense.astype(np.float32).T), best.tile(np.asarray(b.column(0).to_pylist()))
                rest = np.flatnonzero(~often & (asking[t] > 0))
                rest = rest[np.argsort(t[rest], kind="stable")]
                ends = np.r_[0, np.cumsum(np.bincount(t[rest], minlength=len(idf)))]
                row, w = row[rest], w[rest]
                rough_w = w.astype(np.float32)
                for low in range(0, len(ids), QUERY_TILE):
                    size = min(QUERY_TILE, len(ids) - low), len(dl)
                    scores = held[: size[0] * size[1]].reshape(size)
                    np.matmul(rough[low : low + QUERY_TILE], short, out=scores)
                    some = slice(*np.searchsorted(q_rare, (low, low + QUERY_TILE)))
                    start = ends[t_rare[some]]
                    many = ends[t_rare[some] + 1] - start
                    place = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
                    cell = np.repeat((q_rare[some] - low) * len(dl), many) + row[place]
                    np.add.at(scores.ravel(), cell, rough_w[place])

                    def exact(i, j, low=low, cell=cell, place=place, dense=dense, w=w, size=size):
                        value = np.concatenate([np.einsum("ij,ij->i", of[i[n : n + 50_000] + low], dense[j[n : n + 50_000]]) for n in range(0, len(i), 50_000)])
                        hit, wanted = i * size[1] + j, np.zeros(size[0] * size[1], dtype=bool)
                        wanted[hit] = True
                        mine = np.flatnonzero(wanted[cell])
                        return value + np.bincount(np.searchsorted(hit, cell[mine]), weights=w[place[mine]], minlength=len(hit))

                    best.add(scores, tile, low, 1e-6, exact, slack)
        yield from _sent(ids, best)

    return counted.where("live").select("chunk_id", "dl", "terms", "tf").mapInArrow(score, kind)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    m = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable_vector(v: Column, dim: int) -> Column:
    """``dim`` finite numbers that are not all zero; the rest never reaches a ranking."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))


def knn(queries: DataFrame, vectors: DataFrame, k: int, dim: int = 64) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine, exactly: every query against every vector.

    ``queries``: query_id, vec; ``vectors``: chunk_id, vec. A chunk of several vectors counts once, at its best. A block
    of queries is broadcast per pass; tiles of queries and vectors are multiplied, and every task keeps its own k best
    chunks per query, so what is shuffled is k rows per query and task.
    """
    spark = vectors.sparkSession
    asked = store(queries.where(usable_vector(F.col("vec"), dim)).select("query_id", "vec"))
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double"
    out = spark.createDataFrame([], kind)
    blocks = _blocks(asked, "vec", QUERY_BLOCK)
    stored = spread(vectors.where(usable_vector(F.col("vec"), dim)).select("chunk_id", "vec"), len(blocks))
    for part in blocks:
        if not part.num_rows:
            continue
        ids = part.column("query_id").to_pylist()
        shared = spark.sparkContext.broadcast((ids, _rows(part.column("vec").combine_chunks(), dim)))

        def search(batches, shared=shared):
            ids, q = shared.value
            best, rough = Best(len(ids), k), q.astype(np.float32)
            for whole in batches:
                for first in range(0, whole.num_rows, 4 * TILE):
                    b = whole.slice(first, 4 * TILE)
                    x = _rows(b.column(1), dim)
                    tile, short = best.tile(np.asarray(b.column(0).to_pylist())), np.ascontiguousarray(x.astype(np.float32).T)
                    for low in range(0, len(ids), TILE):
                        exact = lambda i, j, low=low: np.concatenate([np.einsum("ij,ij->i", q[i[n : n + 50_000] + low], x[j[n : n + 50_000]]) for n in range(0, len(i), 50_000)])
                        best.add(rough[low : low + TILE] @ short, tile, low, -2.0, exact, 1e-5)
            yield from _sent(ids, best)

        out = out.unionByName(stored.mapInArrow(search, kind))
    folded = out.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top(folded, "query_id", "score", "chunk_id", k)


def legs(**parts: tuple[DataFrame, float]) -> DataFrame:
    """Union of named legs (query_id, chunk_id, score, rank) with their weights, in the given order."""
    out = None
    for i, (name, (df, weight)) in enumerate(parts.items()):
        one = df.select("query_id", "chunk_id", "score", "rank", F.lit(name).alias("leg"), F.lit(i).alias("leg_no"), F.lit(float(weight)).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


def _ranked(fused: DataFrame) -> DataFrame:
    """Rank by score, then by the leg and rank that saw the key first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w))


def rrf(legs_df: DataFrame, k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion."""
    fused = legs_df.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("leg_no", "rank")).alias("seen"))
    return _ranked(fused)


def normalised(legs_df: DataFrame) -> DataFrame:
    """Min-max per query and leg; a leg without spread counts 1. A repeated key keeps its best score."""
    best = legs_df.groupBy("query_id", "leg", "leg_no", "weight", "chunk_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id", "leg")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return best.withColumn("norm", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def comb(legs_df: DataFrame, mnz: bool = False) -> DataFrame:
    """CombSUM, or CombMNZ: times the number of legs with a weight that hold the key (0 for a key of none)."""
    score = F.sum(F.col("weight") * F.col("norm"))
    if mnz:
        score = score * F.count_if(F.col("weight") != 0)
    fused = normalised(legs_df).groupBy("query_id", "chunk_id").agg(F.round(score, 6).alias("score"), F.min(F.struct("leg_no", "rank")).alias("seen"))
    return _ranked(fused)


def diversify(fused: DataFrame, docs: DataFrame, alpha: float = 0.3) -> DataFrame:
    """The n-th chunk of a document divides its score by 1 + alpha * (n - 1); ``docs``: chunk_id, doc_id. Unknown documents are spared."""
    known = fused.join(docs, "chunk_id", "left")
    w = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    share = F.when(F.col("doc_id").isNull(), F.col("score")).otherwise(F.round(F.col("score") / (1 + alpha * (F.row_number().over(w) - 1)), 6))
    return known.withColumn("score", share).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))


def page_refs(hits: DataFrame) -> DataFrame:
    """(query_id, path, score, chunk_ids, rank): hits of one path together, its chunks in ranked order; no path, no row."""
    by_path = hits.where("path IS NOT NULL").groupBy("query_id", "path").agg(F.max("score").alias("score"), F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    return by_path.select("query_id", "path", "score", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"), F.row_number().over(w).alias("rank"))


def interleave(**parts: DataFrame) -> DataFrame:
    """Round-robin over legs: rank by rank, leg by leg, first appearance wins; (query_id, chunk_id, rank)."""
    first = legs(**{n: (df, 1.0) for n, df in parts.items()}).groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "leg_no")).alias("at"))
    return first.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id")).alias("rank"))


def rank_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """(query_id, n_rel, hit3, hit, rr, ndcg, recall) per query with at least one relevant key; misses count 0.

    ``ranked``: query_id, key, rank (unique keys); ``relevant``: query_id, key. Reciprocal rank is not cut off.
    """
    n = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    found = ranked.join(relevant.distinct(), ["query_id", "key"]).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") <= 3, 1).otherwise(0)).alias("hit3"),
        F.max(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("hit"),
        (1 / F.min("rank")).alias("rr"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.count_if(F.col("rank") <= deep).alias("n_found"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.join(found, "query_id", "left").select("query_id", "n_rel", zero("hit3").alias("hit3"), zero("hit").alias("hit"), zero("rr").alias("rr"), (zero("dcg") / ideal).alias("ndcg"), (zero("n_found") / F.col("n_rel")).alias("recall"))


def hashed_embedding(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, bucket, weight): letters-only words, lower case, counted in ``dim`` buckets of their SHA-1, length 1."""
    words = F.explode(F.regexp_extract_all(docs[text], F.lit("[A-Za-z]+"), F.lit(0)))
    counted = docs.select(docs[key].alias("key"), words.alias("w")).select("key", (F.conv(F.substring(F.sha1(F.lower("w")), 1, 8), 16, 10).cast("long") % dim).cast("int").alias("bucket")).groupBy("key", "bucket").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("key")))
    return counted.select("key", "bucket", (F.col("n") / norm).alias("weight"))


def rerank(fused: DataFrame, texts: DataFrame, queries: DataFrame, score, limit: int, window: int = 40) -> DataFrame:
    """Second stage: the best ``max(window, limit)`` hits of each query are re-scored by ``score(q, texts) -> list``.

    ``texts``: chunk_id, text; ``queries``: query_id, q. Membership never grows; a scorer that fails on a query
    leaves its fused order. One query's window is one small group, bounded by the window.
    """
    head = fused.where(F.col("rank") <= max(window, limit)).join(texts, "chunk_id").join(queries, "query_id").select("query_id", "chunk_id", "rank", "q", "text")

    def run(pdf):
        pdf = pdf.sort_values("rank")
        try:
            pdf["score"] = [float(x) for x in score(pdf["q"].iloc[0], pdf["text"].tolist())]
        except Exception:  # noqa: BLE001
            pdf["score"] = -pdf["rank"].astype(float)
        pdf = pdf.sort_values(["score", "rank"], ascending=[False, True]).head(limit)
        pdf["rank"] = range(1, len(pdf) + 1)
        return pdf[["query_id", "chunk_id", "score", "rank"]]

    q, c = fused.schema["query_id"].dataType.simpleString(), fused.schema["chunk_id"].dataType.simpleString()
    return head.groupBy("query_id").applyInPandas(run, f"query_id {q}, chunk_id {c}, score double, rank int")
