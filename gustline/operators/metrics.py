"""Aggregates: moments, forecast scores, confusion tables, return statistics and strategies.

Every function takes grouping keys and gives one row per group, so that a sweep over models, cut-offs or
universes is one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import windows as W
from gustline.functions.scalars import normal_cdf


def describe(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std, min, max and exact quantiles."""
    c = F.col(value)
    stats = [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]
    return df.groupBy(*keys).agg(*stats, *[F.percentile(c, F.lit(q)).alias(f"q{round(q * 100):02d}") for q in qs])


def by_year(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("universe", F.year("d").alias("year")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def monthly_shares(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Monthly mean contributions over their sum; months without rows are absent."""
    m = df.groupBy("universe", F.last_day("d").alias("month")).agg(*[F.avg(f).alias(f) for f in factors])
    total = sum((F.col(f) for f in factors[1:]), F.col(factors[0]))
    return m.select("universe", "month", *[F.when(total != 0, F.col(f) / total).alias(f) for f in factors])


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, population skewness and excess kurtosis, Jarque-Bera."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    return g.withColumn("jarque_bera", F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """Counts of equal bins between the group's least and largest value; the last bin is closed."""
    edge = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    rows = df.filter(F.col(value).isNotNull()).join(edge, list(keys))
    b = F.least(F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1))
    return rows.withColumn("bin", F.when(F.col("__hi") > F.col("__lo"), b).otherwise(0).cast("int")).groupBy(*keys, "bin", "__lo", "__hi").agg(F.count("*").alias("n")).withColumnsRenamed({"__lo": "lo", "__hi": "hi"})


def kl_to_normal(df: DataFrame, keys: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """Kullback-Leibler divergence of the standardised histogram from a normal law."""
    z = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    rows = df.join(z, list(keys)).withColumn("z", (F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)))
    h = histogram(rows, keys, "z", bins)
    width = (F.col("hi") - F.col("lo")) / bins
    left = F.col("lo") + F.col("bin") * width
    h = h.withColumn("q", normal_cdf(left + width) - normal_cdf(left)).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return h.groupBy(*keys).agg(F.sum(F.col("p") * F.log(F.col("p") / F.greatest("q", F.lit(1e-12)))).alias("kl"))


def correlations(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman over complete pairs."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.withColumn("__ra", W.average_rank(F.col(a), list(keys))).withColumn("__rb", W.average_rank(F.col(b), list(keys)))
    return rows.groupBy(*keys).agg(F.corr(a, b).alias("pearson"), F.corr("__ra", "__rb").alias("spearman"))


def inversions(r: np.ndarray) -> int:
    """Pairs i < j with r[i] > r[j] of whole numbers from 0 on, a bit at a time from the highest."""
    total, r = 0, np.asarray(r, np.int64)
    for k in reversed(range(int(r.max(initial=0)).bit_length())):
        r = r[np.argsort(r >> (k + 1), kind="stable")]
        bit = (r >> k) & 1
        ones = np.cumsum(bit)
        fresh = np.flatnonzero(np.diff(r >> (k + 1), prepend=-1))
        before = np.repeat((ones - bit)[fresh], np.diff(np.append(fresh, len(r))))
        total += int((ones - before)[bit == 0].sum())
    return total


def kendall(df: DataFrame, keys: Sequence[str], item: str, a: str, b: str) -> DataFrame:
    """Kendall's tau-b over items of a group, by sorting and inversion counts; a pair with a missing value counts only
    for the ties of the other column."""
    pairs = lambda n: int((n * (n - 1) // 2).sum())
    differ = lambda x: pairs(np.array([len(x)])) - pairs(np.unique(x, return_counts=True)[1])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        na, nb = differ(x[~np.isnan(x)]), differ(y[~np.isnan(y)])
        ok = ~np.isnan(x) & ~np.isnan(y)
        x, y = (np.unique(z[ok], return_inverse=True)[1].astype(np.int64) for z in (x, y))
        both = differ(x) + differ(y) - differ(x * (len(y) + 1) + y)
        tau = (both - 2 * inversions(y[np.lexsort((y, x))])) / math.sqrt(na * nb) if na and nb else None
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "tau": pd.Series([tau], dtype="float64")})[: len(pdf) - 1]

    kinds = dict(df.dtypes)
    rows = df.filter(F.col(item).isNotNull()).select(*keys, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    return rows.groupBy(*keys).applyInPandas(one, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "tau double"]))


# forecasts: columns y (0/1) and p


def confusion(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", cut: Column | float = 0.5) -> DataFrame:
    hit, real = F.col(p) >= cut, F.col(y) == 1
    g = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    return g.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))).withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))))


def top_decile(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", decile: float = 0.1) -> DataFrame:
    """Confusion table of the scores at or above their own (1 - decile) quantile."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    cut = rows.groupBy(*keys).agg(F.percentile(p, F.lit(1 - decile)).alias("threshold"))
    rows = rows.join(cut, list(keys))
    return confusion(rows, [*keys, "threshold"], y, p, F.col("threshold"))


def roc_auc(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Exact area under the curve by average ranks; NULL without both classes."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("__r", W.average_rank(F.col(p), list(keys)))
    g = rows.groupBy(*keys).agg(F.sum(F.when(F.col(y) == 1, F.col("__r"))).alias("s"), F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) == 0).alias("n0"))
    return g.select(*keys, F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"), (F.col("n1") + F.col("n0")).alias("n"))


def average_precision(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Sum of precision times gain in recall over distinct scores from the top; NaN without a positive row, where recall is 0 / 0."""
    at = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, p).agg(F.sum(F.col(y)).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("tp", F.sum("pos").over(w)).withColumn("seen", F.sum("n").over(w))
    whole = F.sum("pos")
    return at.groupBy(*keys).agg(F.when(whole != 0, F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / whole).otherwise(float("nan")).alias("average_precision"))


def probability_scores(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", eps: float = 1e-12) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    return rows.groupBy(*keys).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), (-F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"))


def reliability(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    b = F.least(F.greatest(F.floor(F.col(p) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("bin", b)
    return rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def auc_by_regime(df: DataFrame, keys: Sequence[str], regime: str, min_rows: int = 30) -> DataFrame:
    """AUC per regime; NULL for regimes with too few rows or one class."""
    a = roc_auc(df, [*keys, regime])
    return a.withColumn("auc", F.when(F.col("n") >= min_rows, F.col("auc")))


def jaccard(df: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    return df.groupBy(*keys).agg((F.count_if(a & b) / F.nullif(F.count_if(a | b), F.lit(0))).alias("jaccard"))


def centroids(df: DataFrame, cluster: str, factors: Sequence[str]) -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(f).alias(f) for f in factors], F.count("*").alias("n"))


def out_degree(edges: DataFrame, src: str = "causing") -> DataFrame:
    return edges.groupBy(src).agg(F.count("*").alias("out_degree"))


# returns


def return_stats(df: DataFrame, keys: Sequence[str], r: str, order: str = "d", target: float = 0.0, per_year: int = 252) -> DataFrame:
    """Annual return and volatility, Sharpe, Sortino (deviation of the negative excess returns) and the largest
    drawdown of the summed log returns."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.filter(F.col(r).isNotNull()).withColumn("__c", W.cumulative(F.col(r), w))
    rows = rows.withColumn("__dd", F.col("__c") - W.cumulative_max(F.col("__c"), w))
    ex = F.col(r) - target / per_year
    root = math.sqrt(per_year)
    g = rows.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_pop(r).alias("s"), F.count_if(ex < 0).alias("nd"), F.stddev_pop(F.when(ex < 0, ex)).alias("sd"), F.min("__dd").alias("max_drawdown"))
    m, s, sd = F.col("m"), F.col("s"), F.col("sd")
    return g.select(
        *keys,
        (m * per_year).alias("ann_return"),
        F.when(F.col("n") >= 2, s * root).alias("ann_vol"),
        F.when((F.col("n") >= 30) & (s > 0), (m - target / per_year) / s * root).alias("sharpe"),
        F.when((F.col("n") >= 30) & (F.col("nd") >= 5) & (sd > 0), (m - target / per_year) * per_year / (sd * root)).alias("sortino"),
        "max_drawdown",
    )


def performance(df: DataFrame, keys: Sequence[str], r: str, order: str = "d", per_year: int = 252) -> DataFrame:
    """CAGR, and moments of simple returns with sample deviations; the drawdown in simple units."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.filter(F.col(r).isNotNull()).withColumn("__c", W.cumulative(F.col(r), w))
    rows = rows.withColumn("__dd", F.col("__c") - W.cumulative_max(F.col("__c"), w)).withColumn("__x", F.expm1(F.col(r)))
    x, root = F.col("__x"), math.sqrt(per_year)
    g = rows.groupBy(*keys).agg(F.sum(r).alias("t"), F.count(r).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.stddev_samp(F.when(x < 0, x)).alias("sd"), F.min("__dd").alias("dd"))
    m = F.col("m") * per_year
    return g.select(*keys, F.expm1(F.col("t") * per_year / F.col("n")).alias("cagr"), (F.col("s") * root).alias("vol"), F.when(F.col("s") > 0, m / (F.col("s") * root)).alias("sharpe"), F.when(F.col("sd") > 0, m / (F.col("sd") * root)).alias("sortino"), F.expm1("dd").alias("max_drawdown"), F.expm1("t").alias("total_return"))


# strategies: rows (universe, d, pos)


def overlay(df: DataFrame, r: str, signal: str, decile: float = 0.1, out: str = "strategy") -> DataFrame:
    """Holds the asset the row after a signal below its own top-decile threshold, else nothing. The threshold is
    the whole sample's; pass a frozen one through ``frozen_overlay`` for a causal test."""
    cut = df.groupBy("universe").agg(F.percentile(signal, F.lit(1 - decile)).alias("__cut"))
    return frozen_overlay(df.join(cut, "universe"), r, signal, F.col("__cut"), out=out).drop("__cut")


def frozen_overlay(df: DataFrame, r: str, signal: str, cut, cost: float = 0.0, out: str = "strategy") -> DataFrame:
    """The same with a given threshold and a cost for each switch; the strategy starts invested for costs."""
    w = Window.partitionBy("universe").orderBy("pos")
    df = df.withColumn("__in", F.coalesce((F.col(signal) < cut).cast("double"), F.lit(0.0)))
    held = F.coalesce(F.lag("__in").over(w), F.lit(0.0))
    df = df.withColumn("__held", held)
    paid = cost * F.abs(F.col("__held") - F.lag("__held", 1, 1.0).over(w))
    return df.withColumn(out, F.col(r) * F.col("__held") - (paid if cost else F.lit(0.0))).drop("__in", "__held")


def derisk(df: DataFrame, p: str, asset: str, cash: str, taus: Sequence[float], cost: float = 0.0) -> DataFrame:
    """Every threshold of a grid in one pass: in the asset while p <= tau, else in cash, acting on the next
    row's returns. Adds tau, position and r."""
    grid = df.sparkSession.createDataFrame([(float(t),) for t in taus], "tau double")
    w = Window.partitionBy("universe", "tau").orderBy("pos")
    u = Window.partitionBy("universe").orderBy("pos")
    rows = df.withColumn("__a", F.lead(asset).over(u)).withColumn("__c", F.lead(cash).over(u)).filter(F.col("__a").isNotNull() & F.col("__c").isNotNull() & F.col(p).isNotNull())
    rows = rows.crossJoin(F.broadcast(grid)).withColumn("position", (F.col(p) <= F.col("tau")).cast("double"))
    turn = F.abs(F.col("position") - F.lag("position", 1, 1.0).over(w))
    return rows.withColumn("r", F.col("position") * F.col("__a") + (1 - F.col("position")) * F.col("__c") - cost * turn).drop("__c").withColumnRenamed("__a", "asset_next")


def label_strategy(df: DataFrame, label: str, assets: dict[str, str], cost_bps: float = 5.0, out: str = "strategy") -> DataFrame:
    """Return of the held label's asset (label to return column; cash without a column earns nothing), less the
    cost of a change of label."""
    w = Window.partitionBy("universe").orderBy("pos")
    pick = F.lit(None).cast("double")
    for name, c in {**({} if "cash" in assets else {"cash": None}), **assets}.items():
        pick = F.when(F.col(label) == name, F.lit(0.0) if c is None else F.col(c)).otherwise(pick)
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1)
    return df.withColumn(out, pick - changed.cast("double") * (cost_bps / 1e4))


def route(gate: Column, shock: Column, defensive: str = "bonds", inflationary: str = "gold", risk_on: str = "equity") -> Column:
    """Risk asset unless gated; then by the shock flag (NULL counts as no shock)."""
    return F.when(~F.coalesce(gate, F.lit(False)), risk_on).when(F.coalesce(shock, F.lit(False)), inflationary).otherwise(defensive)


def matched_exposure(df: DataFrame, keys: Sequence[str], position: str, asset: str, cash: str) -> DataFrame:
    """Static benchmark with the strategy's mean exposure: column ``static``."""
    mean = df.groupBy(*keys).agg(F.avg(position).alias("__w"))
    return df.join(mean, list(keys)).withColumn("static", F.col("__w") * F.col(asset) + (1 - F.col("__w")) * F.col(cash)).drop("__w")


def matched_volatility(df: DataFrame, keys: Sequence[str], strategy: str, asset: str) -> DataFrame:
    """The asset scaled to the strategy's volatility: column ``matched``."""
    s = df.groupBy(*keys).agg((F.stddev_pop(strategy) / F.nullif(F.stddev_pop(asset), F.lit(0.0))).alias("__k"))
    return df.join(s, list(keys)).withColumn("matched", F.col("__k") * F.col(asset)).drop("__k")


def basket(df: DataFrame, value: str, out: str = "basket") -> DataFrame:
    """Equal-weight mean over universes by date."""
    return df.groupBy("d").agg(F.avg(value).alias(out), F.count(value).alias("n"))
