"""Walk-forward fits: turbulence, its decomposition and signed split, absorption, rolling standardiser, PCA,
covariance, surprise measures, and a walk-forward Gaussian mixture.

A fit at refit row r uses rows [r - lookback, r), drops rows with a missing cell and needs ``min_periods`` of
the rest. Fits that depend on moments only never gather a window: running sums of the row's first, second and
(for the shrinkage) fourth-order terms are kept over the series, and a window's moments are a difference of
two of them. Rows are first centred on their universe's mean, which changes no result and keeps the
differences exact. Fits that need the rows themselves go through blocks (``panel.windows_exploded``).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import windows as W
from gustline.functions import scalars as S
from gustline.functions.scalars import finite, series
from gustline.plans import panel


def _moment_columns(x: Column, k: int) -> list[Column]:
    """n, s_i, S_ij (i <= j), q^2, q x_i of a row vector; zeros where it is NULL. q is the squared norm."""
    v = [F.coalesce(F.get(x, F.lit(i)), F.lit(0.0)) for i in range(k)]
    q = sum((a * a for a in v[1:]), v[0] * v[0])
    return [x.isNotNull().cast("double"), *v, *[v[i] * v[j] for i, j in itertools.combinations_with_replacement(range(k), 2)], q * q, *[q * a for a in v]]


def window_moments(vectors: DataFrame, k: int, lookback: int, refit_every: int = 1) -> DataFrame:
    """``vectors`` (universe, d, pos, x) with ``xc`` (x less the universe's mean) and ``m``, the moments of the
    window before the row's refit."""
    every = Window.partitionBy("universe")
    centre = F.array(*[F.avg(F.get("x", F.lit(i))).over(every) for i in range(k)])
    df = vectors.withColumn("centre", centre).withColumn("xc", F.zip_with("x", "centre", lambda a, b: a - b))
    w = Window.partitionBy("universe").orderBy("pos")
    before, out = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, -lookback - 1)
    columns = _moment_columns(F.col("xc"), k)
    df = df.select("*", *[c.alias(f"__m{i}") for i, c in enumerate(columns)])
    diffs = [F.coalesce(F.sum(f"__m{i}").over(before), F.lit(0.0)) - F.coalesce(F.sum(f"__m{i}").over(out), F.lit(0.0)) for i in range(len(columns))]
    m = F.array(*diffs)
    if refit_every > 1:
        m = F.when(F.col("pos") % refit_every == 0, m)
    df = df.withColumn("m", m).drop(*[f"__m{i}" for i in range(len(columns))])
    if refit_every > 1:
        df = df.withColumn("m", F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df


def unpack(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, s, S, sum q^2, sum q x of stacked moment vectors."""
    n, s = m[:, 0], m[:, 1 : 1 + k]
    p = k * (k + 1) // 2
    full = np.empty((len(m), k, k))
    for at, (i, j) in enumerate(itertools.combinations_with_replacement(range(k), 2)):
        full[:, i, j] = full[:, j, i] = m[:, 1 + k + at]
    return n, s, full, m[:, 1 + k + p], m[:, 2 + k + p :]


def covariances(m: np.ndarray, k: int, shrinkage: str | float | None = "ledoit-wolf") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, covariances and shrinkage intensities of stacked moments. ``shrinkage``: Ledoit-Wolf, a constant
    towards the scaled identity, or None for the sample covariance (divided by n)."""
    n, s, raw, q2, qx = unpack(m, k)
    mean = s / n[:, None]
    cov = raw / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    tr = np.trace(cov, axis1=1, axis2=2)
    mu = tr / k
    if shrinkage is None:
        return mean, cov, np.zeros(len(m))
    if shrinkage == "ledoit-wolf":
        sq = (cov * cov).sum(axis=(1, 2))
        mm = (mean * mean).sum(axis=1)
        # sum of |x - mean|^4 from moments about zero
        fourth = q2 + 4 * np.einsum("bi,bij,bj->b", mean, raw, mean) + n * mm**2 - 4 * (mean * qx).sum(1) + 2 * mm * np.trace(raw, axis1=1, axis2=2) - 4 * mm * (mean * s).sum(1)
        beta = (fourth / n - sq) / (k * n)
        delta = (sq - 2 * mu * tr + k * mu**2) / k
        beta = np.minimum(beta, delta)
        alpha = np.where(beta <= 0, 0.0, np.where(delta > 0, beta / np.where(delta > 0, delta, 1), 0.0))
    else:
        alpha = np.full(len(m), float(shrinkage))
    cov = (1 - alpha)[:, None, None] * cov + (alpha * mu)[:, None, None] * np.eye(k)
    return mean, cov, alpha


def _solve(cov: np.ndarray, delta: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(cov, delta[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.einsum("bij,bj->bi", np.linalg.pinv(cov), delta)


def turbulence(vectors: DataFrame, factors: list[str], lookback: int = 2520, min_periods: int = 504, shrinkage: str | float | None = "ledoit-wolf", refit_every: int = 1, flip: tuple[str, ...] = ("vix",)) -> DataFrame:
    """One pass for the index and all that derives from it: turbulence, contributions (array, summing to it),
    turb_loss and turb_gain (by the stress side of each factor; exactly at the mean counts as gain) and the
    shrinkage intensity."""
    k = len(factors)
    sign = np.array([-1.0 if f in flip else 1.0 for f in factors])
    df = window_moments(vectors, k, lookback, refit_every)
    clean = F.get("m", F.lit(0)) >= min_periods - 0.5
    ready = F.col("xc").isNotNull() & clean

    def run(x: pd.Series, m: pd.Series) -> pd.DataFrame:
        n = len(x)
        out = {"turbulence": np.full(n, np.nan), "turb_loss": np.full(n, np.nan), "turb_gain": np.full(n, np.nan), "shrinkage": np.full(n, np.nan), "contributions": [None] * n}
        at = [i for i in range(n) if x.iloc[i] is not None]
        for lo in range(0, len(at), 4096):
            some = at[lo : lo + 4096]
            xs, ms = np.stack([x.iloc[i] for i in some]), np.stack([m.iloc[i] for i in some])
            mean, cov, alpha = covariances(ms, k, shrinkage)
            delta = xs - mean
            c = delta * _solve(cov, delta)
            loss = np.where(delta * sign < 0, c, 0).sum(axis=1)
            total = c.sum(axis=1)
            out["turbulence"][some], out["turb_loss"][some], out["turb_gain"][some], out["shrinkage"][some] = total, loss, total - loss, alpha
            for i, row in zip(some, c, strict=True):
                out["contributions"][i] = row
        return pd.DataFrame(out)

    udf = F.pandas_udf(run, "turbulence double, turb_loss double, turb_gain double, shrinkage double, contributions array<double>")
    df = df.withColumn("t", udf(F.when(ready, F.col("xc")), F.when(ready, F.col("m"))))
    return df.select("universe", "d", "pos", *[finite(F.col(f"t.{c}")).alias(c) for c in ("turbulence", "turb_loss", "turb_gain", "shrinkage")], "t.contributions")


def contributions_wide(index: DataFrame, factors: list[str]) -> DataFrame:
    return index.select("universe", "d", "pos", "turbulence", *[F.get("contributions", F.lit(i)).alias(f) for i, f in enumerate(factors)])


def covariance_history(vectors: DataFrame, factors: list[str], lookback: int = 252, min_periods: int = 63, shrinkage: str | float | None = "ledoit-wolf", step: int = 21) -> DataFrame:
    """universe, refit_pos, refit_d, mu, cov (row by row), shrinkage at every refit row with enough data."""
    k = len(factors)
    df = window_moments(vectors, k, lookback, step).filter((F.col("pos") % step == 0) & (F.get("m", F.lit(0)) >= min_periods - 0.5))

    def run(m: pd.Series, centre: pd.Series) -> pd.DataFrame:
        if not len(m):
            return pd.DataFrame({"mu": [], "cov": [], "shrinkage": []})
        mean, cov, alpha = covariances(np.stack(m.to_list()), k, shrinkage)
        return pd.DataFrame({"mu": list(mean + np.stack(centre.to_list())), "cov": list(cov.reshape(len(m), -1)), "shrinkage": alpha})

    udf = F.pandas_udf(run, "mu array<double>, cov array<double>, shrinkage double")
    return df.withColumn("f", udf("m", "centre")).select("universe", F.col("pos").alias("refit_pos"), F.col("d").alias("refit_d"), "f.*")


def rolling_standardise(wide: DataFrame, factors: list[str], window: int | None = 252, min_periods: int = 63, ddof: int = 0, step: int = 1) -> DataFrame:
    """Each value against the window before it (``window=None``: everything before); with ``step`` the window of
    the block's first row serves the whole block."""
    w = series(order=("pos",))
    f = W.Frame(window, min_periods, 1)
    out = []
    for c in factors:
        mean, std = W.mean(F.col(c), f, w), W.std(F.col(c), f, w, ddof)
        out += [mean.alias(f"__mean_{c}"), std.alias(f"__std_{c}")]
    df = wide.select("*", *out)
    if step > 1:
        held = Window.partitionBy("universe", F.expr(f"pos div {step}")).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        df = df.select(*wide.columns, *[F.first(f"__{s}_{c}").over(held).alias(f"__{s}_{c}") for c in factors for s in ("mean", "std")])
    z = {c: F.when(F.col(f"__std_{c}") > 0, (F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__std_{c}")) for c in factors}
    return df.select(*[z[c].alias(c) if c in factors else F.col(c) for c in wide.columns])


def magnitude_surprise(wide: DataFrame, factors: list[str], index: DataFrame, window: int = 2520, min_periods: int = 504) -> DataFrame:
    """magnitude (sum of squared trailing z-scores) and correlation surprise (turbulence over magnitude)."""
    z = rolling_standardise(wide, factors, window, min_periods, ddof=1)
    mag = sum((F.col(f) * F.col(f) for f in factors[1:]), F.col(factors[0]) * F.col(factors[0]))
    both = z.select("universe", "d", mag.alias("magnitude")).join(index.select("universe", "d", "turbulence"), ["universe", "d"])
    return both.withColumn("correlation_surprise", F.when(F.col("magnitude") > 0, F.col("turbulence") / F.col("magnitude")))


def univariate_turbulence(df: DataFrame, ret: str, window: int = 252, min_periods: int = 60, out: str = "uni_turbulence") -> DataFrame:
    w = series(order=("pos",))
    f = W.Frame(window, min_periods, 1)
    z = W.standardise(F.col(ret), f, w, ddof=1)
    return df.withColumn(out, z * z)


def fixed_contributions(vectors: DataFrame, factors: list[str], shrinkage: str | float | None = "ledoit-wolf") -> DataFrame:
    """Contributions under one covariance of the whole series of each universe."""
    k = len(factors)
    columns = _moment_columns(F.col("x"), k)
    fit = vectors.groupBy("universe").agg(F.array(*[F.sum(c) for c in columns]).alias("m"))

    def run(x: pd.Series, m: pd.Series) -> pd.Series:
        out = [None] * len(x)
        at = [i for i in range(len(x)) if x.iloc[i] is not None]
        if at:
            mean, cov, _ = covariances(np.stack([m.iloc[i] for i in at]), k, shrinkage)
            delta = np.stack([x.iloc[i] for i in at]) - mean
            for i, row in zip(at, delta * _solve(cov, delta), strict=True):
                out[i] = row
        return pd.Series(out)

    udf = F.pandas_udf(run, "array<double>")
    return vectors.join(fit, "universe").withColumn("contributions", udf("x", "m")).drop("m")


# fits that need the window's rows


def refit_table(vectors: DataFrame, lookback: int | None, step: int, first: int = 0) -> DataFrame:
    """universe, refit_pos, lo, hi: windows [lo, hi) of refits at multiples of ``step``."""
    rows = vectors.filter((F.col("pos") % step == 0) & (F.col("pos") >= max(first, 1)))
    lo = F.lit(0) if lookback is None else F.greatest(F.lit(0), F.col("pos") - lookback)
    return rows.select("universe", F.col("pos").alias("refit_pos"), lo.cast("int").alias("lo"), F.col("pos").alias("hi"))


def per_refit(vectors: DataFrame, refits: DataFrame, block: int, fit, schema: str) -> DataFrame:
    """``fit(key, rows)`` on the rows of every refit's window: a task a refit."""
    inside = panel.windows_exploded(vectors.select("universe", "pos", "x"), refits, block)
    return inside.groupBy("universe", "refit_pos").applyInPandas(fit, schema)


def absorption_ratio(vectors: DataFrame, factors: list[str], n_components: int | None = None, lookback: int = 504, min_periods: int = 252, step: int = 1) -> DataFrame:
    """Share of the top eigenvalues of the shrunk covariance of the window's standardised rows, at each refit."""
    k = len(factors)
    top = n_components or max(1, round(k / 5))

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = [v for v in pdf.sort_values("pos")["x"] if v is not None]
        ar = np.nan
        if len(x) >= min_periods:
            x = np.stack(x)
            sd = x.std(axis=0)
            if (sd > 0).all():
                z = (x - x.mean(axis=0)) / sd
                ev = np.linalg.eigvalsh(covariances(row_moments(z), k)[1][0])
                ar = float(ev[-top:].sum() / ev.sum())
        return pd.DataFrame({"universe": [key[0]], "refit_pos": [key[1]], "absorption": [ar]})

    out = per_refit(vectors, refit_table(vectors, lookback, step), max(step, 64), fit, "universe string, refit_pos long, absorption double")
    return out.withColumn("absorption", F.when(~F.isnan("absorption"), F.col("absorption")))


def row_moments(z: np.ndarray) -> np.ndarray:
    """The moment vector of given rows, as ``window_moments`` keeps it."""
    k = z.shape[1]
    q = (z * z).sum(axis=1)
    s = z.T @ z
    return np.array([[len(z), *z.sum(axis=0), *[s[i, j] for i, j in itertools.combinations_with_replacement(range(k), 2)], (q * q).sum(), *(q[:, None] * z).sum(axis=0)]])


def absorption_shift(ar: DataFrame, value: str = "absorption", fast: int = 15, slow: int = 252, out: str = "absorption_shift") -> DataFrame:
    """(fast EWMA - slow mean) / slow deviation, one row late."""
    w = series(order=("pos",))
    f = W.Frame(slow, slow, 0)
    now = (W.ewma(F.col(value), fast, w) - W.mean(F.col(value), f, w)) / S.null_if_zero(W.std(F.col(value), f, w, ddof=1))
    return ar.withColumn("__now", now).withColumn(out, F.lag("__now").over(w)).drop("__now")


def _empty(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype="object") for c in columns})


def rolling_pca(vectors: DataFrame, factors: list[str], n: int, lookback: int = 252, min_periods: int = 63, step: int = 21) -> DataFrame:
    """universe, refit_pos, mean, components (each with its largest entry positive), explained."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = [v for v in pdf.sort_values("pos")["x"] if v is not None]
        if len(x) < min_periods:
            return _empty("universe", "refit_pos", "mean", "components", "explained")
        x = np.stack(x)
        mean = x.mean(axis=0)
        _, s, v = np.linalg.svd(x - mean, full_matrices=False)
        v = v[:n] * np.sign(v[np.arange(min(n, len(v))), np.abs(v[:n]).argmax(axis=1)])[:, None]
        share = s**2 / (s**2).sum()
        return pd.DataFrame({"universe": [key[0]], "refit_pos": [key[1]], "mean": [mean], "components": [v.tolist()], "explained": [share[:n]]})

    return per_refit(vectors, refit_table(vectors, lookback, step), max(step, 64), fit, "universe string, refit_pos long, mean array<double>, components array<array<double>>, explained array<double>")


def pca_scores(vectors: DataFrame, history: DataFrame, step: int = 21) -> DataFrame:
    """Scores of each row in the basis of its block."""
    rows = panel.asof_refit(vectors, history, step)
    centred = F.zip_with("x", "mean", lambda a, b: a - b)
    score = F.transform("components", lambda c: F.aggregate(F.zip_with(c, centred, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return rows.select("universe", "d", "pos", "refit_pos", score.alias("scores"))


# Gaussian mixture


def fit_gmm(x: np.ndarray, k: int, seed: int, n_init: int = 3, reg: float = 1e-3, steps: int = 200, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means, covariances and log-likelihood of a full-covariance mixture by expectation-maximisation,
    the best of ``n_init`` starts."""
    best = None
    n, p = x.shape
    for start in range(n_init):
        rng = np.random.default_rng(np.random.SeedSequence([seed, start]))
        mu = x[rng.choice(n, k, replace=False)].copy()
        resp = np.eye(k)[((x[:, None] - mu) ** 2).sum(-1).argmin(1)]
        last = -np.inf
        for _ in range(steps):
            nk = resp.sum(0) + 1e-10
            mu = (resp.T @ x) / nk[:, None]
            cov = np.stack([((resp[:, j, None] * (x - mu[j])).T @ (x - mu[j])) / nk[j] + reg * np.eye(p) for j in range(k)])
            logp = _log_densities(x, nk / n, mu, cov)
            top = logp.max(1, keepdims=True)
            ll = float((np.log(np.exp(logp - top).sum(1)) + top[:, 0]).mean())
            resp = np.exp(logp - top)
            resp /= resp.sum(1, keepdims=True)
            if ll - last < tol:
                break
            last = ll
        if best is None or ll > best[3]:
            best = (nk / n, mu, cov, ll)
    return best


def _log_densities(x: np.ndarray, weights: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(mu)))
    for j in range(len(mu)):
        low = np.linalg.cholesky(cov[j])
        z = np.linalg.solve(low, (x - mu[j]).T)
        out[:, j] = np.log(weights[j]) - 0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def best_permutation(before: np.ndarray, after: np.ndarray) -> list[int]:
    """perm[new label] = old label with the least total distance of means: a search over subsets, exact for the
    few components a mixture has."""
    k = len(after)
    cost = np.sqrt(((after[:, None] - before[None]) ** 2).sum(-1))
    best = {0: (0.0, [])}
    for i in range(k):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for j in range(k):
                if not used >> j & 1:
                    cand = c + cost[i, j]
                    if (u := used | 1 << j) not in nxt or cand < nxt[u][0]:
                        nxt[u] = (cand, [*chosen, j])
        best = nxt
    return best[(1 << k) - 1][1]


def walk_forward_gmm(vectors: DataFrame, factors: list[str], k: int = 5, step: int = 252, min_train: int = 756, variance: float = 0.95, n_init: int = 5, reg: float = 1e-3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Labels with probabilities (universe, pos, label, probs) and permutations by refit. Every refit fits
    scaler, principal components and mixture on all rows before it, a task each, and labels its block; labels
    are then aligned from refit to refit by the means in factor space."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["x"].notna()].sort_values("pos")
        r = key[1]
        train, block = pdf[pdf["pos"] < r], pdf[pdf["pos"] >= r]
        if len(train) < min_train or not len(block):
            return _empty("universe", "refit_pos", "pos", "label", "probs", "means")
        x = np.stack(train["x"])
        mu, sd = x.mean(0), x.std(0)
        sd[sd == 0] = 1
        z = (x - mu) / sd
        _, s, v = np.linalg.svd(z, full_matrices=False)
        share = np.cumsum(s**2) / (s**2).sum()
        v = v[: int(np.searchsorted(share, variance)) + 1]
        w, m, c, _ = fit_gmm(z @ v.T, k, seed + int(r), n_init, reg)
        logp = _log_densities(((np.stack(block["x"]) - mu) / sd) @ v.T, w, m, c)
        p = np.exp(logp - logp.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        means = ((m @ v) * sd + mu).ravel()
        return pd.DataFrame({"universe": key[0], "refit_pos": r, "pos": block["pos"].to_numpy(), "label": p.argmax(1), "probs": list(p), "means": [means] * len(block)})

    refits = refit_table(vectors, None, step, min_train).withColumn("hi", F.col("refit_pos") + step)
    raw = panel.windows_exploded(vectors.select("universe", "pos", "x"), refits, step).groupBy("universe", "refit_pos").applyInPandas(fit, "universe string, refit_pos long, pos long, label long, probs array<double>, means array<double>")

    def align(key, pdf: pd.DataFrame) -> pd.DataFrame:
        prev, out = None, []
        for r, means in sorted(zip(pdf["refit_pos"], pdf["means"])):
            m = np.asarray(means).reshape(k, -1)
            perm = list(range(k)) if prev is None else best_permutation(prev, m)
            aligned = np.empty_like(m)
            aligned[perm] = m
            prev = aligned
            out.append((key[0], r, perm))
        return pd.DataFrame(out, columns=["universe", "refit_pos", "perm"])

    perms = raw.groupBy("universe", "refit_pos").agg(F.first("means").alias("means")).groupBy("universe").applyInPandas(align, "universe string, refit_pos long, perm array<long>")
    labelled = raw.join(perms, ["universe", "refit_pos"])
    slots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.get("probs", (F.array_position("perm", j) - 1).cast("int")))
    return labelled.select("universe", "refit_pos", "pos", F.get("perm", F.col("label").cast("int")).alias("label"), slots.alias("probs")), perms


# splicing


def splice(primary: DataFrame, proxies: list[DataFrame], dates: list | None = None) -> DataFrame:
    """Returns coalesced over ordered sources; with ``dates`` source i counts only before dates[i-1]."""
    if dates is None:
        return panel.coalesce_join(primary, proxies)
    cut = [primary.filter(F.col("d") >= F.lit(dates[0]))]
    for i, p in enumerate(proxies):
        rows = p.filter(F.col("d") < F.lit(dates[i]))
        cut.append(rows.filter(F.col("d") >= F.lit(dates[i + 1])) if i + 1 < len(dates) else rows)
    return panel.coalesce_join(cut[0], cut[1:])


def spliced_panel(prices: DataFrame, definitions: DataFrame, fallbacks: DataFrame, start: float = 100.0) -> DataFrame:
    """d, factor, level: each ticker's log returns over its own dates, the first source of each factor that has
    one on a date (definitions: factor, primary; fallbacks: factor, priority, ticker), rebased to ``start``."""
    w = Window.partitionBy("ticker").orderBy("d")
    own = prices.filter("close > 0").withColumn("r", F.log("close") - F.log(F.lag("close").over(w))).filter("r is not null")
    source = definitions.select("factor", F.lit(0).alias("priority"), F.col("primary").alias("ticker")).unionByName(fallbacks.select("factor", "priority", "ticker"))
    chosen = own.join(source, "ticker").groupBy("factor", "d").agg(F.min_by("r", "priority").alias("r"))
    by = Window.partitionBy("factor").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum("r").over(by)
    return chosen.select("factor", "d", (F.exp(cum - F.first("r").over(by)) * start).alias("level"))


def valid_dates(long: DataFrame, name: str = "factor", value: str = "value") -> DataFrame:
    """First and last date with a value, and the number of values."""
    ok = long.filter(F.col(value).isNotNull())
    return ok.groupBy(name).agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count("*").alias("n"))
