"""Tests and resampling. Replicates are rows: ``range(n)`` is dealt over tasks, each replicate draws from a
stream seeded by (seed, replicate id), and the data (one series, a few hundred kilobytes at most) are broadcast
after a check of their size. Results do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.functions.scalars import normal_cdf, t_sf2

#: Rows of a series that may be broadcast to the replicates.
BROADCAST_ROWS = 2_000_000


def collected(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> np.ndarray:
    """A bounded series as an array; raises beyond BROADCAST_ROWS."""
    rows = df.select(*columns, *[c for c in order if c not in columns]).na.drop("any", subset=list(columns)).limit(BROADCAST_ROWS + 1).toPandas()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("the series is too long to be sent to every replicate; aggregate it first")
    return rows.sort_values(list(order))[list(columns)].to_numpy(float)


def replicate(spark: SparkSession, n: int, seed: int, data, statistic: Callable, columns: Sequence[str]) -> DataFrame:
    """rep and the named results of ``statistic(rng, data)`` for n replicates."""
    sent = spark.sparkContext.broadcast(data)
    k = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [statistic(np.random.default_rng(np.random.SeedSequence([seed, int(r)])), sent.value) for r in b["id"]]
            a = np.array(rows, float).reshape(len(b), k)
            yield pd.DataFrame({"rep": b["id"].to_numpy(), **{c: a[:, i] for i, c in enumerate(columns)}})

    parts = max(1, min(n // 50, 2 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, parts).mapInPandas(run, "rep long, " + ", ".join(f"{c} double" for c in columns))


def interval(reps: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    x = F.when(~F.isnan(column), F.col(column))
    return reps.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(alpha / 2)).alias("lo"), F.percentile(x, F.lit(1 - alpha / 2)).alias("hi"))


def diebold_mariano(df: DataFrame, keys: Sequence[str], a: str, b: str, h: int = 1, order: str = "d") -> DataFrame:
    """Equal-accuracy test of two loss columns with Bartlett weights over h - 1 lags: stat, p_value, mean_diff, n."""
    w = Window.partitionBy(*keys)
    rows = df.select(*keys, order, (F.col(a) - F.col(b)).alias("d_")).filter("d_ is not null")
    rows = rows.withColumn("c", F.col("d_") - F.avg("d_").over(w))
    o = w.orderBy(order)
    lags = [F.sum(F.col("c") * F.lag("c", k).over(o)) for k in range(1, h)]
    rows = rows.select(*keys, "d_", "c", *[(F.col("c") * F.lag("c", k).over(o)).alias(f"g{k}") for k in range(1, h)])
    del lags
    var = F.sum(F.col("c") * F.col("c"))
    for k in range(1, h):
        var = var + F.lit(2 * (1 - k / h)) * F.coalesce(F.sum(f"g{k}"), F.lit(0.0))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d_").alias("mean_diff"), (var / F.count("*")).alias("v"))
    stat = F.when((F.col("n") >= 2) & (F.col("v") > 0), F.col("mean_diff") / F.sqrt(F.col("v") / F.col("n")))
    return g.withColumn("stat", stat).withColumn("p_value", 2 * (1 - normal_cdf(F.abs("stat")))).drop("v")


def sortino(r: np.ndarray, target: float = 0.0, per_year: int = 252) -> float:
    ex = r - target / per_year
    down = ex[ex < 0]
    if len(r) < 30 or len(down) < 5 or down.std() == 0:
        return math.nan
    return float(ex.mean() * math.sqrt(per_year) / down.std())


def block_rows(rng: np.random.Generator, n: int, block: int) -> np.ndarray:
    """Positions of n rows in moving blocks (which may overlap each other)."""
    starts = rng.integers(0, n - block + 1, -(-n // block))
    return (starts[:, None] + np.arange(block)).ravel()[:n]


def stationary_rows(rng: np.random.Generator, n: int, mean_block: float) -> np.ndarray:
    """Positions of n rows in circular blocks of geometric length."""
    fresh = rng.random(n) < 1 / mean_block
    fresh[0] = True
    starts = rng.integers(0, n, n)
    at = np.flatnonzero(fresh)
    age = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return (np.repeat(starts[at], np.diff(np.append(at, n))) + age) % n


def _summary(spark: SparkSession, reps: DataFrame, observed: float, alpha: float) -> DataFrame:
    ok = reps.filter(~F.isnan("diff"))
    m = ok.agg(F.avg("diff").alias("m"))
    rows = ok.crossJoin(F.broadcast(m))
    return rows.agg(F.lit(observed).alias("observed"), F.percentile("diff", F.lit(alpha / 2)).alias("lo"), F.percentile("diff", F.lit(1 - alpha / 2)).alias("hi"), F.avg((F.abs(F.col("diff") - F.col("m")) >= abs(observed)).cast("double")).alias("p_value"), F.count("*").alias("n_resamples"))


def bootstrap_difference(df: DataFrame, a: str, b: str, statistic: Callable = sortino, block: int = 21, n: int = 2000, seed: int = 0, alpha: float = 0.05, method: str = "block") -> DataFrame:
    """Difference of a statistic of two series: ``block`` draws the same moving blocks for both, ``stationary``
    draws circular geometric blocks for each alone, ``stationary-paired`` the same for both."""
    spark = df.sparkSession
    x = collected(df, [a, b], ["d"])
    if len(x) < 2 * block:
        return spark.createDataFrame([(None, None, None, None, 0)], "observed double, lo double, hi double, p_value double, n_resamples long")

    def one(rng, data):
        m = len(data)
        if method == "block":
            i = j = block_rows(rng, m, block)
        else:
            i = stationary_rows(rng, m, block)
            j = i if method == "stationary-paired" else stationary_rows(rng, m, block)
        return (statistic(data[i, 0]) - statistic(data[j, 1]),)

    return _summary(spark, replicate(spark, n, seed, x, one, ["diff"]), statistic(x[:, 0]) - statistic(x[:, 1]), alpha)


def bootstrap_mean_difference(df: DataFrame, value: str, flag: str, block: int = 21, n: int = 2000, seed: int = 0) -> DataFrame:
    """Difference of means between flagged and other rows under moving blocks."""

    def gap(data):
        f = data[:, 1] > 0.5
        return data[f, 0].mean() - data[~f, 0].mean() if f.any() and not f.all() else math.nan

    x = collected(df.withColumn(flag, F.col(flag).cast("double")), [value, flag], ["d"])
    reps = replicate(df.sparkSession, n, seed, x, lambda rng, data: (gap(data[block_rows(rng, len(data), block)]),), ["diff"])
    return _summary(df.sparkSession, reps, gap(x), 0.05)


def bootstrap_basket(panel: DataFrame, strategy: str, asset: str, block: int = 21, n: int = 2000, seed: int = 0) -> DataFrame:
    """Lift of an equal-weight basket of strategies over the basket of assets; blocks of dates are drawn, so all
    universes of a date stay together."""
    daily = panel.groupBy("d").agg(F.avg(strategy).alias("s"), F.avg(asset).alias("a"))
    return bootstrap_difference(daily, "s", "a", block=block, n=n, seed=seed)


def bootstrap_spearman(df: DataFrame, a: str, b: str, block: int = 21, n: int = 2000, seed: int = 0) -> DataFrame:
    x = collected(df, [a, b], ["d"])

    def rho(data):
        r = np.stack([pd.Series(data[:, i]).rank().to_numpy() for i in (0, 1)])
        return float(np.corrcoef(r)[0, 1])

    reps = replicate(df.sparkSession, n, seed, x, lambda rng, data: (rho(data[block_rows(rng, len(data), block)]),), ["diff"])
    return _summary(df.sparkSession, reps, rho(x), 0.05)


def permutation_cosine(pairs: DataFrame, pre: str, real: str, n: int = 10_000, seed: int = 0, plus_one: bool = False) -> DataFrame:
    """Mean cosine of pre-vectors with their own compositions against shuffled ones: observed, null_mean, p_value."""
    spark = pairs.sparkSession
    rows = pairs.select(pre, real).limit(20_001).collect()  # episodes, so few
    if len(rows) > 20_000:
        raise ValueError("too many episodes for a permutation of all of them")
    p, r = np.array([x[0] for x in rows], float), np.array([x[1] for x in rows], float)
    if not len(rows):
        return spark.createDataFrame([(None, None, None, 0)], "observed double, null_mean double, p_value double, n_episodes long")
    unit = lambda m: m / np.where((k := np.linalg.norm(m, axis=1, keepdims=True)) == 0, np.nan, k)
    p, r = unit(p), unit(r)
    seen = float(np.nanmean((p * r).sum(1)))
    reps = replicate(spark, n, seed, (p, r), lambda rng, d: (float(np.nanmean((d[0] * d[1][rng.permutation(len(d[1]))]).sum(1))),), ["c"])
    add = 1 if plus_one else 0
    return reps.agg(F.lit(seen).alias("observed"), F.avg("c").alias("null_mean"), ((F.count_if(F.col("c") >= seen) + add) / (F.count("*") + add)).alias("p_value"), F.lit(len(rows)).cast("long").alias("n_episodes"))


def null_mean_cosine(pairs: DataFrame, pre: str, real: str) -> DataFrame:
    """The permutation null's exact mean: the mean cosine of all pairs, which is the dot product of the mean unit
    vectors, so no pair is ever made."""
    unit = lambda c: F.transform(c, lambda v: v / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)))
    rows = pairs.select(unit(F.col(pre)).alias("p"), unit(F.col(real)).alias("r"))
    parts = rows.select(F.posexplode(F.arrays_zip("p", "r")).alias("i", "v")).groupBy("i").agg(F.avg("v.p").alias("p"), F.avg("v.r").alias("r"))
    return parts.agg(F.sum(F.col("p") * F.col("r")).alias("null_mean"))


def sign_flip(df: DataFrame, value: str, n: int = 10_000, seed: int = 0, exact_up_to: int = 20) -> DataFrame:
    """One-sided test of a positive mean by random signs; every sign pattern is listed up to ``exact_up_to`` values."""
    spark = df.sparkSession
    x = collected(df, [value], [value])[:, 0]
    m, seen = len(x), float(x.mean()) if len(x) else math.nan
    if 0 < m <= exact_up_to:
        sent = [float(v) for v in x]
        total = sum((F.when(F.shiftright("id", i).bitwiseAND(F.lit(1)) == 1, v).otherwise(-v) for i, v in enumerate(sent)), F.lit(0.0))
        reps = spark.range(0, 1 << m).select((total / m).alias("c"))
    else:
        reps = replicate(spark, n, seed, x, lambda rng, d: (float((d * rng.choice([-1.0, 1.0], len(d))).mean()),), ["c"])
    return reps.agg(F.lit(seen).alias("mean"), F.avg((F.col("c") >= seen - 1e-12).cast("double")).alias("p_value"), F.lit(m).alias("n"))


def episode_interval(df: DataFrame, value: str, n: int = 5000, seed: int = 0) -> DataFrame:
    """Bootstrap interval of a mean over episodes."""
    x = collected(df, [value], [value])[:, 0]
    return interval(replicate(df.sparkSession, n, seed, x, lambda rng, d: (float(d[rng.integers(0, len(d), len(d))].mean()),), ["m"]), "m")


def cluster_sign_flip(df: DataFrame, value: str, cluster: str, n: int = 10_000, seed: int = 0) -> DataFrame:
    """The same on cluster means."""
    return sign_flip(df.groupBy(cluster).agg(F.avg(value).alias(value)), value, n, seed)


def cluster_interval(df: DataFrame, value: str, cluster: str, n: int = 5000, seed: int = 0) -> DataFrame:
    """Bootstrap interval of the mean, drawing whole clusters."""
    g = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).cast("double").alias("k"))
    x = collected(g, ["s", "k"], ["s", "k"])

    def one(rng, d):
        s = d[rng.integers(0, len(d), len(d))].sum(0)
        return (float(s[0] / s[1]),)

    return interval(replicate(df.sparkSession, n, seed, x, one, ["m"]), "m")


def t_test(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One-sample t test of a zero mean, two-sided: n, mean, t, p_value."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s"))
    g = g.withColumn("t", F.when(F.col("s") > 0, F.col("mean") / (F.col("s") / F.sqrt("n"))))

    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or b < 2 else t_sf2(float(a), float(b - 1)) for a, b in zip(t, n)], dtype="float64")

    return g.withColumn("p_value", F.pandas_udf(tail, "double")("t", "n")).drop("s")


def wilcoxon(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Signed-rank test, normal approximation with tie correction, two-sided: w_plus, z, p_value."""
    from gustline.functions.windows import average_rank

    rows = df.filter(F.col(value) != 0).withColumn("__a", F.abs(value))
    rows = rows.withColumn("__r", average_rank(F.col("__a"), list(keys)))
    ties = rows.groupBy(*keys, "__a").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col(value) > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"))
    g = g.join(ties, list(keys)) if keys else g.crossJoin(ties)
    n = F.col("n")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return g.withColumn("z", z).withColumn("p_value", 2 * (1 - normal_cdf(F.abs("z")))).drop("ties")


def label_permutation(df: DataFrame, value: str, group: str, n: int = 5000, seed: int = 0) -> DataFrame:
    """One-sided two-sample test: mean(group 1) - mean(group 0) at most the observed one under shuffled labels."""
    x = collected(df.withColumn(group, F.col(group).cast("double")), [value, group], [group, value])
    gap = lambda v, g: float(v[g > 0.5].mean() - v[g <= 0.5].mean())
    seen = gap(x[:, 0], x[:, 1])
    reps = replicate(df.sparkSession, n, seed, x, lambda rng, d: (gap(d[:, 0], rng.permutation(d[:, 1])),), ["c"])
    return reps.agg(F.lit(seen).alias("difference"), F.avg((F.col("c") <= seen).cast("double")).alias("p_value"))


def r_squared(gram: np.ndarray, target: int, inputs: Sequence[int]) -> float:
    """R^2 of a least-squares fit from a matrix of cross products that includes a constant at 0."""
    use = [0, *inputs]
    beta = np.linalg.lstsq(gram[np.ix_(use, use)], gram[use, target], rcond=None)[0]
    tss = gram[target, target] - gram[0, target] ** 2 / gram[0, 0]
    rss = gram[target, target] - 2 * beta @ gram[use, target] + beta @ gram[np.ix_(use, use)] @ beta
    return float(1 - rss / tss) if tss > 0 else math.nan


def incremental_r2(df: DataFrame, y: str, base: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """R^2 without and with the extra inputs, from one distributed pass over cross products."""
    names = [*base, *extra, y]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    centre = rows.agg(*[F.avg(c).alias(c) for c in names])
    cols = [F.lit(1.0), *[F.col(f"x.{c}") - F.col(f"m.{c}") for c in names]]
    rows = rows.alias("x").crossJoin(F.broadcast(centre).alias("m"))
    k = len(cols)
    got = rows.agg(*[F.sum(cols[i] * cols[j]).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = got[f"g_{i}_{j}"] or 0.0
    b, e = list(range(1, 1 + len(base))), list(range(1 + len(base), k - 1))
    r0, r1 = r_squared(gram, k - 1, b), r_squared(gram, k - 1, b + e)
    return df.sparkSession.createDataFrame([(r0, r1, r1 - r0)], "r2_base double, r2_full double, r2_gain double")
