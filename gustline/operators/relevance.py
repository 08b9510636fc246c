"""Relevance-based prediction and importance.

A training matrix is bounded (a window of rows by a few dozen columns); it is sent to the tasks after a check
of its size. Queries, and cells of the prediction grid, are what is dealt out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a training matrix that may be sent.
MOST_CELLS = 20_000_000


class Training:
    def __init__(self, x: np.ndarray, y: np.ndarray, columns: Sequence[str]):
        self.x, self.y, self.columns = x, y, list(columns)
        self.mean, self.cov = x.mean(axis=0), np.atleast_2d(np.cov(x.T))
        self.inv = np.linalg.pinv(self.cov)

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str], y: str, order: Sequence[str] = ()) -> Training:
        """The complete rows by ``order``, and by their values within it."""
        rows = df.select(*columns, y, *[c for c in order if c not in (*columns, y)]).na.drop("any", subset=[*columns, y]).limit(MOST_CELLS // max(len(columns), 1) + 1).toPandas()
        if rows.shape[0] * len(columns) > MOST_CELLS:
            raise ValueError("the training matrix is too large to be sent")
        rows = rows.sort_values([*order, *[c for c in (*columns, y) if c not in order]])
        return cls(rows[list(columns)].to_numpy(float), rows[y].to_numpy(float), columns)

    def subset(self, names: Sequence[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        idx = list(range(len(self.columns))) if names is None else [self.columns.index(n) for n in names]
        inv = self.inv if names is None else np.linalg.pinv(self.cov[np.ix_(idx, idx)])
        return self.x[:, idx], self.mean[idx], inv, idx


def quadratic(diff: np.ndarray, inv: np.ndarray) -> np.ndarray:
    return ((diff @ inv) * diff).sum(axis=-1)


def similarity(xi: np.ndarray, xt: np.ndarray, inv: np.ndarray) -> float:
    return float(-0.5 * quadratic(xi - xt, inv))


def informativeness(xi: np.ndarray, mean: np.ndarray, inv: np.ndarray) -> float:
    return float(0.5 * quadratic(xi - mean, inv))


def relevance(t: Training, xt: np.ndarray, names: Sequence[str] | None = None, censor: float = 0.0) -> np.ndarray:
    """Relevance of every training row for one query; NaN below the censoring quantile."""
    x, mean, inv, _ = t.subset(names)
    r = 0.5 * quadratic(x - mean, inv) - 0.5 * quadratic(x - xt, inv)
    return np.where(r >= np.quantile(r, censor), r, np.nan) if censor > 0 else r


def weighted(r: np.ndarray, y: np.ndarray, weighting: str = "linear") -> float:
    """Prediction from relevances: weights max(r, 0), or softmax; the plain mean where all weights are zero."""
    ok = np.isfinite(r)
    if not ok.any():
        return np.nan
    w = np.clip(r[ok], 0, None) if weighting == "linear" else np.exp(r[ok] - r[ok].max())
    return float(w @ y[ok] / w.sum()) if w.sum() > 0 else float(y[ok].mean())


def predict(queries: DataFrame, training: Training, id_col: str, names: Sequence[str] | None = None, censor: float = 0.0, weighting: str = "linear") -> DataFrame:
    """id and prediction of every query row."""
    if weighting not in ("linear", "exp"):
        raise ValueError("weighting is 'linear' or 'exp'")
    use = list(names) if names is not None else training.columns
    sent = queries.sparkSession.sparkContext.broadcast(training)
    kind = dict(queries.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = sent.value
        for b in batches:
            q = b[use].to_numpy(float)
            yield pd.DataFrame({id_col: b[id_col], "prediction": [weighted(relevance(t, row, names, censor), t.y, weighting) for row in q]})

    return queries.select(id_col, *use).mapInPandas(run, f"{id_col} {kind}, prediction double")


def scores(queries: DataFrame, training: Training, keep: Sequence[str], xt: np.ndarray) -> DataFrame:
    """The columns ``keep`` of every row, with sim (similarity to ``xt``) and inf (informativeness)."""
    sent = queries.sparkSession.sparkContext.broadcast(training)
    kinds = dict(queries.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = sent.value
        for b in batches:
            x = b[t.columns].to_numpy(float)
            yield b[list(keep)].assign(sim=-0.5 * quadratic(x - xt, t.inv), inf=0.5 * quadratic(x - t.mean, t.inv))

    rows = queries.select(*keep, *[c for c in training.columns if c not in keep])
    return rows.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "sim double", "inf double"]))


def subsets(columns: Sequence[str], n: int, seed: int | None = 0) -> list[tuple[str, ...]]:
    """Singletons, n random (or, without a seed, the first n in listing order) larger subsets, and the full set."""
    cols = list(columns)
    out = [(c,) for c in cols]
    if seed is None:
        out += list(itertools.islice((s for k in range(2, len(cols)) for s in itertools.combinations(cols, k)), n))
    else:
        rng = np.random.default_rng(np.random.SeedSequence([seed]))
        for _ in range(n):
            k = int(rng.integers(2, max(3, len(cols))))
            out.append(tuple(cols[i] for i in sorted(rng.choice(len(cols), min(k, len(cols)), replace=False))))
    return list(dict.fromkeys([*out, tuple(cols)]))


def grid_cells(df: DataFrame, columns: Sequence[str], y: str, chosen: Sequence[tuple[str, ...]], censors: Sequence[float] = (0.0, 0.2, 0.5, 0.8), n_eval: int = 128, seed: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """One row per subset and censor: subset, censor, adjusted_fit (squared correlation of leave-one-out
    predictions with outcomes; NULL below five or without variance), mean_prediction, n_eval. A subset is a task;
    its evaluation rows are one matrix product."""
    spark = df.sparkSession
    t = Training.of(df, columns, y, order)
    n = len(t.x)
    rng = np.random.default_rng(np.random.SeedSequence([seed, 1]))
    at = np.arange(n) if n_eval >= n else np.sort(rng.choice(n, n_eval, replace=False))
    sent = spark.sparkContext.broadcast((t, at))
    table = spark.createDataFrame([(i, list(s)) for i, s in enumerate(chosen)], "subset_id int, subset array<string>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tr, ev = sent.value
        for b in batches:
            out = []
            for sid, names in zip(b["subset_id"], b["subset"]):
                x, mean, inv, _ = tr.subset(list(names))
                inf = 0.5 * quadratic(x - mean, inv)
                own = quadratic(x, inv)
                rel = inf - 0.5 * (own + own[ev][:, None] - 2 * (x[ev] @ inv) @ x.T)
                rel[np.arange(len(ev)), ev] = -np.inf  # a row never sees its own outcome
                for c in censors:
                    pred = np.full(len(ev), np.nan)
                    for e in range(len(ev)):
                        r = rel[e]
                        keep = np.isfinite(r)
                        if c > 0:
                            keep &= r >= np.quantile(r[keep], c)
                        w = np.clip(r[keep], 0, None)
                        if keep.any():
                            pred[e] = w @ tr.y[keep] / w.sum() if w.sum() > 0 else tr.y[keep].mean()
                    ok = np.isfinite(pred)
                    good = ok.sum() >= 5 and pred[ok].std() >= 1e-12 and tr.y[ev][ok].std() >= 1e-12
                    fit = float(np.corrcoef(pred[ok], tr.y[ev][ok])[0, 1] ** 2) if good else None
                    out.append((sid, list(names), float(c), fit, float(np.nanmean(pred)) if ok.any() else None, 1.0 - c, int(ok.sum())))
            yield pd.DataFrame(out, columns=["subset_id", "subset", "censor", "adjusted_fit", "mean_prediction", "mean_weight_share", "n_eval"])

    parts = max(1, min(len(chosen), 4 * spark.sparkContext.defaultParallelism))
    return table.repartition(parts).mapInPandas(run, "subset_id int, subset array<string>, censor double, adjusted_fit double, mean_prediction double, mean_weight_share double, n_eval int")


def importance(cells: DataFrame, columns: Sequence[str], scale: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """variable, rbi (mean fit of cells with the variable less without), tau (Welch t, times the root of
    ``scale`` if given), from the most important down."""
    names = cells.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    rows = cells.filter("adjusted_fit is not null").crossJoin(F.broadcast(names)).withColumn("has", F.array_contains("subset", F.col("variable")))
    a, b = F.when(F.col("has"), F.col("adjusted_fit")), F.when(~F.col("has"), F.col("adjusted_fit"))
    g = rows.groupBy(*keys, "variable").agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    se = F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))
    tau = F.when((F.col("na") >= 2) & (F.col("nb") >= 2) & (se > 0), (F.col("ma") - F.col("mb")) / se)
    if scale is not None and scale > 0:
        tau = tau * (scale**0.5)
    return g.select(*keys, "variable", (F.col("ma") - F.col("mb")).alias("rbi"), tau.alias("tau"), F.col("na").alias("cells_with"), F.col("nb").alias("cells_without")).orderBy(F.col("rbi").desc_nulls_last(), "variable")


def stability(tables: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Kendall's tau-b of importance ranks between successive windows (``key`` orders them), over variables in
    the top of either."""
    from pyspark.sql import Window

    from gustline.operators.metrics import kendall

    r = tables.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("rbi").desc_nulls_last(), "variable")))
    order = tables.select(key).distinct().withColumn("__i", F.row_number().over(Window.orderBy(key)))
    x = r.join(F.broadcast(order), key)
    a = x.select(F.col("__i").alias("i"), "variable", F.col("rbi").alias("a"), F.col("rank").alias("ra"))
    b = x.select((F.col("__i") - 1).alias("i"), "variable", F.col("rbi").alias("b"), F.col("rank").alias("rb"))
    both = a.join(b, ["i", "variable"]).filter((F.col("ra") <= top) | (F.col("rb") <= top))
    return kendall(both, ["i"], "variable", "a", "b")
