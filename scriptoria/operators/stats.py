"""Evaluation figures: means, Welch's test, gates, baselines, resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_std(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def welch(rows: DataFrame, by: str, value: str, control: str) -> DataFrame:
    """t, degrees of freedom, pooled effect size d and two-sided p of every group against ``control``."""
    a = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    b = a.where(F.col(by) == control).select(F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("v").alias("v0"))
    x = a.where((F.col(by) != control) & (F.col("n") > 1)).join(F.broadcast(b))
    sa, sb = F.col("v") / F.col("n"), F.col("v0") / F.col("n0")
    pooled = F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n") + F.col("n0") - 2))
    out = x.select(by, ((F.col("m") - F.col("m0")) / F.sqrt(sa + sb)).alias("t"), ((sa + sb) ** 2 / (sa**2 / (F.col("n") - 1) + sb**2 / (F.col("n0") - 1))).alias("df"), ((F.col("m") - F.col("m0")) / pooled).alias("d"))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + k * d or 1e-30)
        c = 1 + k / c or 1e-30
        f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * (f - 1)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > t); few rows (one per group), hence a pandas function."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([_beta_fraction(n / 2, 0.5, n / (n + x * x)) if n and n == n else None for x, n in zip(t, df)])

    return p(t, df)


def gate(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """(metric, value, bound, passed): a name ending in _max must not exceed its bound; an absent metric fails."""
    x = bounds.join(values, "metric", "left")
    ok = F.when(F.col("value").isNull(), False).when(F.col("metric").endswith("_max"), F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return x.withColumn("passed", ok)


def against_baseline(pinned: DataFrame, seen: DataFrame, tolerance: float) -> DataFrame:
    """(metric, verdict): missing, extra, regressed or ok."""
    p, o = pinned.select("metric", F.col("value").alias("pinned")), seen.select("metric", F.col("value").alias("seen"))
    verdict = F.when(F.col("seen").isNull(), "missing").when(F.col("pinned").isNull(), "extra").when(F.col("seen") < F.col("pinned") - tolerance, "regressed").otherwise("ok")
    return p.join(o, "metric", "full").withColumn("verdict", verdict)


def bootstrap(rows: DataFrame, value: str, rounds: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(mean, low, high) of a mean, by Poisson resampling: every row weighs in every round by itself, in one pass.

    Tasks return sums per round, so no row is moved. A row's weights are drawn by its place (partition and position), so
    equal rows weigh independently. Nulls are left out; no rows give nulls.
    """
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total, weight = np.zeros(rounds), np.zeros(rounds)
        for b in batches:
            x = b.column(0).drop_null().to_numpy()
            for at in range(0, len(x), 512):
                w = rng.poisson(1.0, (len(x[at : at + 512]), rounds))
                total += x[at : at + 512] @ w
                weight += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), pa.array(total), pa.array(weight)], ["round", "total", "weight"])

    means = rows.select(rows[value].cast("double").alias("x")).mapInArrow(run, "round int, total double, weight double").groupBy("round").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("m"))
    edge = (1 - level) / 2
    ci = means.agg(F.percentile("m", edge).alias("low"), F.percentile("m", 1 - edge).alias("high"))
    return rows.agg(F.avg(value).alias("mean")).join(F.broadcast(ci))


# When a change counts.
P_MOST, EFFECT_LEAST = 0.05, 0.10


def ab_verdict(p: Column, change: Column, higher_is_better: Column) -> Column:
    """ships, regressed or inconclusive: significant and of an effect that matters, in the better or the worse direction."""
    gain = F.when(higher_is_better, change).otherwise(-change)
    return F.when((p < P_MOST) & (gain > EFFECT_LEAST), "ships").when((p < P_MOST) & (gain < -EFFECT_LEAST), "regressed").otherwise("inconclusive")


def model_matrix(runs: DataFrame, baseline: str) -> DataFrame:
    """(metric, arm, n, mean, std, p, best): every arm of every metric against the baseline arm; ``runs``: arm, metric, value.

    A metric ending in _max is better when lower. Ties for the best go to the first arm by name.
    """
    a = runs.where("value IS NOT NULL").groupBy("metric", "arm").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    b = a.where(F.col("arm") == baseline).select("metric", F.col("n").alias("n0"), F.col("mean").alias("m0"), F.col("std").alias("s0"))
    x = a.join(b, "metric", "left")
    sa, sb = F.col("std") ** 2 / F.col("n"), F.col("s0") ** 2 / F.col("n0")
    tested = (F.col("arm") != baseline) & (F.col("n") > 1) & (F.col("n0") > 1) & (sa + sb > 0)
    t = F.when(tested, (F.col("mean") - F.col("m0")) / F.sqrt(sa + sb))
    df = F.when(tested, (sa + sb) ** 2 / (sa**2 / (F.col("n") - 1) + sb**2 / (F.col("n0") - 1)))
    from pyspark.sql import Window

    good = F.when(F.col("metric").endswith("_max"), -F.col("mean")).otherwise(F.col("mean"))
    w = Window.partitionBy("metric").orderBy(F.desc(good), "arm")
    out = x.withColumn("p", t_two_sided(t, df)).withColumn("best", F.row_number().over(w) == 1)
    return out.select("metric", "arm", "n", "mean", "std", "p", "best")


def judge_summary(verdicts: DataFrame, by: str) -> DataFrame:
    """(by, n, n_errors, score, low, high, trustworthy): yes counts 1, partial 0.5, no 0; a null verdict is an error.

    Bounds are those of the mean at 95 % by its standard error; a summary with errors in more than a tenth is not to be trusted.
    """
    v = F.when(F.col("verdict") == "yes", 1.0).when(F.col("verdict") == "partial", 0.5).when(F.col("verdict") == "no", 0.0)
    a = verdicts.groupBy(by).agg(F.count("*").alias("rows"), F.count(v).alias("n"), F.avg(v).alias("score"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("s"))
    half = 1.96 * F.col("s") / F.sqrt("n")
    errors = F.col("rows") - F.col("n")
    return a.select(by, "n", errors.alias("n_errors"), "score", F.greatest(F.col("score") - half, F.lit(0.0)).alias("low"), F.least(F.col("score") + half, F.lit(1.0)).alias("high"), ((F.col("n") > 0) & (errors <= 0.1 * F.col("rows"))).alias("trustworthy"))


def sweep(legs: DataFrame, relevant: DataFrame, grid: DataFrame, k: int = 10) -> DataFrame:
    """Mean nDCG of weighted reciprocal rank fusion over a grid (rrf_k, w_bm25, w_vector), every point in one job.

    ``legs``: query_id, chunk_id, rank, leg; ``relevant``: query_id, chunk_id. The grid is a small literal table.
    """
    from pyspark.sql import Window

    weight = F.when(F.col("leg") == "bm25", F.col("w_bm25")).otherwise(F.col("w_vector"))
    point = ["rrf_k", "w_bm25", "w_vector"]
    fused = legs.join(F.broadcast(grid)).groupBy(*point, "query_id", "chunk_id").agg(F.round(F.sum(weight / (F.col("rrf_k") + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy(*point, "query_id").orderBy(F.desc("score"), "chunk_id")
    gain = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(relevant.distinct(), ["query_id", "chunk_id"]).groupBy(*point, "query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    n = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    every = n.join(F.broadcast(grid)).join(gain, [*point, "query_id"], "left")
    return every.groupBy(*point).agg(F.avg(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal).alias("ndcg"))
