"""Lead-lag tests and connectedness. Each pair (or scope) is one task over its rows; within-scope corrections
are windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.scalars import chi2_sf, chi2_sf_even, f_sf, null_if_zero, series
from gustline.functions.windows import percentile_rank
from gustline.operators.regimes import gap_groups


def _design(y: np.ndarray, x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(y)
    own = np.column_stack([np.ones(n - lag), *[y[lag - j : n - j] for j in range(1, lag + 1)]])
    other = np.column_stack([x[lag - j : n - j] for j in range(1, lag + 1)])
    return y[lag:], own, other


def _ssr(a: np.ndarray, y: np.ndarray) -> float:
    r = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    return float(r @ r)


def granger_stats(y: np.ndarray, x: np.ndarray, max_lag: int) -> tuple[float, float]:
    """(least chi-squared p-value, largest F) over lags 1..max_lag that x helps to predict y; NaN if a fit is
    not possible."""
    best_p, best_f = np.inf, -np.inf
    for lag in range(1, max_lag + 1):
        if len(y) - lag <= 3 * lag + 1:
            return np.nan, np.nan
        t, own, other = _design(y, x, lag)
        r, u = _ssr(own, t), _ssr(np.hstack([own, other]), t)
        if u <= 0 or r <= 0:
            return np.nan, np.nan
        best_p = min(best_p, chi2_sf(len(t) * max(r - u, 0.0) / u, lag))
        best_f = max(best_f, ((r - u) / lag) / (u / (len(t) - 2 * lag - 1)))
    return best_p, best_f


def granger_matrix(wide: DataFrame, factors: Sequence[str], max_lag: int = 3, scope: Sequence[str] = ("universe",), order: str = "pos") -> DataFrame:
    """scope, causing, caused, p_value, max_f of every ordered pair in every scope with 5 * max_lag rows or more.
    A scope's rows (a universe, or one of its episodes) are one task, which fits all its pairs."""
    names = list(factors)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[names].dropna().to_numpy(float)
        out = []
        if len(x) >= 5 * max_lag:
            for i, a in enumerate(names):
                for j, b in enumerate(names):
                    if i != j:
                        out.append((*key, a, b, *granger_stats(x[:, j], x[:, i], max_lag), len(x)))
        return pd.DataFrame(out, columns=[*scope, "causing", "caused", "p_value", "max_f", "n"])

    kinds = dict(wide.dtypes)
    schema = ", ".join(f"{s} {kinds[s]}" for s in scope) + ", causing string, caused string, p_value double, max_f double, n long"
    got = wide.select(*scope, order, *names).groupBy(*scope).applyInPandas(fit, schema)
    return got.withColumn("p_value", F.when(~F.isnan("p_value"), F.col("p_value"))).withColumn("max_f", F.when(~F.isnan("max_f"), F.col("max_f")))


def fisher(df: DataFrame, keys: Sequence[str], p: str = "p_value") -> DataFrame:
    """Fisher's combination over the rows of a group: a finite sum, as the degrees of freedom are even."""
    q = F.greatest(F.col(p), F.lit(1e-300))
    g = df.filter(F.col(p).isNotNull()).groupBy(*keys).agg((-2 * F.sum(F.log(q))).alias("x"), F.count("*").cast("int").alias("n_episodes"), F.min(p).alias("one"))
    return g.select(*keys, F.when(F.col("n_episodes") == 1, F.col("one")).otherwise(chi2_sf_even(F.col("x"), F.col("n_episodes"), 100_000)).alias("p_value_raw"), "n_episodes")


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str, level: float = 0.05, adjusted: str = "p_value_adj") -> DataFrame:
    """Adjusted p-values within each group, and whether they reach the level."""
    by = Window.partitionBy(*keys)
    rank = F.row_number().over(by.orderBy(F.col(p).asc()))
    m = F.count(p).over(by)
    df = df.withColumn("__raw", F.col(p) * m / rank)
    df = df.withColumn(adjusted, F.least(F.lit(1.0), F.min("__raw").over(by.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0))))
    # equal p-values share the value of the last of them
    df = df.withColumn(adjusted, F.min(adjusted).over(Window.partitionBy(*keys, p)))
    return df.drop("__raw").withColumn("significant", F.col(adjusted) <= level)


def regime_granger(wide: DataFrame, factors: Sequence[str], regime: str, max_lag: int = 3, gap_days: int = 5, level: float = 0.05) -> DataFrame:
    """Granger pairs within each regime: contiguous runs of days, Fisher over the runs, Benjamini-Hochberg."""
    w = Window.partitionBy("universe", regime).orderBy("d")
    rows = wide.filter(F.col(regime).isNotNull()).withColumn("__gap", F.datediff("d", F.lag("d").over(w)))
    rows = rows.withColumn("__new", F.when(F.col("__gap") <= gap_days, 0).otherwise(1)).withColumn("episode", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = granger_matrix(rows, factors, max_lag, ("universe", regime, "episode"))
    return benjamini_hochberg(fisher(pairs, ["universe", regime, "causing", "caused"]), ["universe", regime], "p_value_raw", level)


def escalation(df: DataFrame, turb: str, out: str = "dlog_turb") -> DataFrame:
    """Change of the log index."""
    w = series(order=("pos",))
    t = null_if_zero(F.col(turb))
    return df.withColumn(out, F.log(t) - F.log(F.lag(t).over(w)))


def drivers(wide: DataFrame, factors: Sequence[str], turb: str, max_lag: int = 5, regime: str | None = None, level: float = 0.05) -> DataFrame:
    """universe, scope, factor, p_value_raw, p_value_adj, significant: which factors lead escalation, over the
    whole sample and, if asked, over the rows of each regime."""
    rows = escalation(wide, turb)
    scoped = rows.withColumn("scope", F.lit("full_sample"))
    if regime:
        scoped = scoped.unionByName(rows.filter(F.col(regime).isNotNull()).withColumn("scope", F.concat(F.lit("regime_"), F.col(regime).cast("string"))))
    names = list(factors)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")[["dlog_turb", *names]].dropna().to_numpy(float)
        out = [(*key, f, granger_stats(x[:, 0], x[:, i + 1], max_lag)[0]) for i, f in enumerate(names)] if len(x) >= 5 * max_lag else []
        return pd.DataFrame(out, columns=["universe", "scope", "factor", "p_value_raw"]).dropna()

    got = scoped.select("universe", "scope", "pos", "dlog_turb", *names).groupBy("universe", "scope").applyInPandas(fit, "universe string, scope string, factor string, p_value_raw double")
    return benjamini_hochberg(got, ["universe", "scope"], "p_value_raw", level)


def max_f(df: DataFrame, y: str, x: str, max_lag: int = 5) -> DataFrame:
    """Largest F over lags and its tail: universe, max_f, p_value at the full lag's degrees of freedom."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values("pos")[["y", "x"]].dropna().to_numpy(float)
        f = granger_stats(a[:, 0], a[:, 1], max_lag)[1] if len(a) >= 5 * max_lag else np.nan
        p = f_sf(f, max_lag, len(a) - 3 * max_lag - 1) if np.isfinite(f) else np.nan
        return pd.DataFrame({"universe": [key[0]], "max_f": [f], "p_value": [p]})

    return df.select("universe", "pos", F.col(y).alias("y"), F.col(x).alias("x")).groupBy("universe").applyInPandas(fit, "universe string, max_f double, p_value double")


def rewiring(edges: DataFrame, regime: str, high, low, p: str = "p_value_raw") -> DataFrame:
    """Change of a pair's percentile rank of strength between two regimes."""
    s = edges.withColumn("__s", -F.log10(F.greatest(F.col(p), F.lit(1e-300))))
    s = s.withColumn("rank", percentile_rank(F.col("__s"), ["universe", regime]))
    pick = lambda v, n: s.filter(F.col(regime) == v).select("universe", "causing", "caused", F.col("rank").alias(n))
    return pick(high, "rank_high").join(pick(low, "rank_low"), ["universe", "causing", "caused"]).withColumn("change", F.col("rank_high") - F.col("rank_low"))


def partial_r2(wide: DataFrame, factors: Sequence[str], turb: str, lags: int = 5) -> DataFrame:
    """Gain in R^2 of escalation from a factor's lags over its own lags: universe, factor, partial_r2."""
    names = list(factors)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")[["dlog_turb", *names]].dropna().to_numpy(float)
        out = []
        if len(x) > 4 * lags:
            for i, f in enumerate(names):
                y, own, other = _design(x[:, 0], x[:, i + 1], lags)
                tss = float(((y - y.mean()) ** 2).sum())
                out.append((key[0], f, max(0.0, (_ssr(own, y) - _ssr(np.hstack([own, other]), y)) / tss)))
        return pd.DataFrame(out, columns=["universe", "factor", "partial_r2"])

    return escalation(wide, turb).select("universe", "pos", "dlog_turb", *names).groupBy("universe").applyInPandas(fit, "universe string, factor string, partial_r2 double")


def gfevd(x: np.ndarray, lag: int = 2, horizon: int = 10) -> np.ndarray:
    """Generalised forecast-error variance shares (rows sum to 1) of a vector autoregression."""
    n, k = x.shape
    z = np.column_stack([np.ones(n - lag), *[x[lag - j : n - j] for j in range(1, lag + 1)]])
    y = x[lag:]
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ b
    sigma = e.T @ e / (len(y) - z.shape[1])
    a = [b[1 + j * k : 1 + (j + 1) * k].T for j in range(lag)]
    psi = [np.eye(k)]
    for h in range(1, horizon + 1):
        psi.append(sum(a[j] @ psi[h - 1 - j] for j in range(min(lag, h))))
    p = np.stack(psi)
    num = ((p @ sigma) ** 2).sum(axis=0) / np.diag(sigma)
    den = np.einsum("hij,jk,hik->i", p, sigma, p)
    theta = num / den[:, None]
    return theta / theta.sum(axis=1, keepdims=True)


def connectedness(wide: DataFrame, factors: Sequence[str], scope: Sequence[str] = ("universe",), lag: int = 2, horizon: int = 10) -> DataFrame:
    """scope, factor, shares (array by source), from_others, to_others, net, total."""
    names = list(factors)

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")[names].dropna().to_numpy(float)
        out = []
        if len(x) > 3 * (lag * len(names) + 1):
            t = gfevd(x, lag, horizon)
            off = t - np.diag(np.diag(t))
            for i, f in enumerate(names):
                got, sent = float(off[i].sum()), float(off[:, i].sum())
                out.append((*key, f, t[i], got, sent, sent - got, float(off.sum() / len(names))))
        return pd.DataFrame(out, columns=[*scope, "factor", "shares", "from_others", "to_others", "net", "total"])

    kinds = dict(wide.dtypes)
    schema = ", ".join(f"{s} {kinds[s]}" for s in scope) + ", factor string, shares array<double>, from_others double, to_others double, net double, total double"
    return wide.select(*scope, "pos", *names).groupBy(*scope).applyInPandas(fit, schema)


__all__ = ["granger_stats", "granger_matrix", "fisher", "benjamini_hochberg", "regime_granger", "escalation", "drivers", "max_f", "rewiring", "partial_r2", "gfevd", "connectedness", "gap_groups"]
