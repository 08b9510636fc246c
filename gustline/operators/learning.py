"""Supervised learning under walk-forward rules.

Models are Spark ML pipelines where one fit sees much data (``train_one``), and small numpy fits inside tasks
where many fits see little (quarterly refits, cut-off sweeps): there a scope (a universe, or a pooled panel) is one task, which loops
over refits and models on one sorted array, and the whole sweep is one job; no row is copied before the shuffle. Probabilities differ in detail from other libraries' solvers; orderings and shapes
are what carries over. Tree importances are impurity-based, which is another measure than Shapley values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.operators import metrics
from gustline.sources.io import stash, unstash

# --- Spark ML models ------------------------------------------------------------------------------------------------


def registry(n_rows: int, seed: int = 0, trees: int = 400) -> dict[str, Callable]:
    """Estimators by name; weights balance the classes. regParam is 1 / (C n), as the loss is a mean."""
    reg = 1.0 / max(n_rows, 1)
    common = dict(featuresCol="z", labelCol="y", weightCol="weight")
    return {
        "random_forest": lambda: RandomForestClassifier(numTrees=trees, maxDepth=8, minInstancesPerNode=20, seed=seed, **common),
        "logistic_l1": lambda: LogisticRegression(elasticNetParam=1.0, regParam=reg, maxIter=200, **common),
        "linear_svm": lambda: LinearSVC(regParam=reg, maxIter=100, **common),
        "elastic_net": lambda: LogisticRegression(elasticNetParam=0.5, regParam=reg, maxIter=200, **common),
    }


def balanced(df: DataFrame, y: str = "y") -> DataFrame:
    """Adds ``weight``: n / (2 n_class)."""
    n = df.groupBy(F.col(y).alias("__y")).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__t"))
    w = n.crossJoin(total).select("__y", (F.col("__t") / (2 * F.col("__n"))).alias("weight"))
    return df.join(F.broadcast(w), df[y] == w["__y"]).drop("__y")


def pipeline(features: Sequence[str], estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="x"), StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True), estimator])


def probability(scored: DataFrame) -> DataFrame:
    """Adds ``p``: the model's probability, or the sigmoid of its margin where it has none."""
    if "probability" in scored.columns:
        return scored.withColumn("p", vector_to_array("probability")[1])
    return scored.withColumn("p", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def train_one(df: DataFrame, features: Sequence[str], name: str, folds: DataFrame | None, dev_end: str, seed: int = 0, trees: int = 400) -> dict:
    """Aligned rows, purged cross-validation on the development part (scaler inside each fold), a final fit and one
    pass over later rows. Returns model, cv (fold, auc), oos (predictions). On a development part of one class every model is
    the constant one: that class for all rows, zero weights, no folds."""
    from gustline.operators.splits import dev_oos, in_folds

    # every action of every fit plans its input anew: on a written table that is a scan, on ``df`` itself all that made it
    rows = stash(df.select("universe", "d", "pos", *features, F.col("y").cast("double").alias("y")).na.drop())
    dev, oos = dev_oos(rows, dev_end)
    n, kinds = dev.agg(F.count("*"), F.countDistinct("y")).first()
    if not n:
        unstash(rows)
        raise ValueError("the development part has no rows")
    # of one class Spark's forest has no second probability and its machine a margin of its own; its logistic fit is the constant
    make = registry(n, seed, trees)[name if kinds > 1 else "logistic_l1"]
    scores = []
    if folds is not None and kinds > 1:
        folds = stash(folds)
        parts = in_folds(dev, folds)
        for r in folds.select("fold").distinct().orderBy("fold").collect():
            train = parts.filter((F.col("fold") == r["fold"]) & (F.col("part") == "train")).drop("fold", "part")
            test = parts.filter((F.col("fold") == r["fold"]) & (F.col("part") == "test")).drop("fold", "part")
            if train.select("y").distinct().count() < 2:
                continue
            scored = probability(pipeline(features, make()).fit(balanced(train)).transform(test))
            scores.append(metrics.roc_auc(scored, []).withColumn("fold", F.lit(r["fold"])))
    model = pipeline(features, make()).fit(balanced(dev))
    out = probability(model.transform(oos)).select("universe", "d", "pos", "y", "p")
    cv = None
    for s in scores:
        cv = s if cv is None else cv.unionByName(s)
    return {"model": model, "cv": cv, "oos": out, "features": list(features), "name": name, "dev_end": dev_end}


def train_all(df: DataFrame, features: Sequence[str], folds: DataFrame | None, dev_end: str, names: Sequence[str] = ("random_forest", "logistic_l1", "linear_svm", "elastic_net"), trees: int = 400) -> dict[str, dict]:
    """All models, submitted side by side."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(len(names)) as pool:
        jobs = {n: pool.submit(train_one, df, features, n, folds, dev_end, 0, trees) for n in names}
        return {n: j.result() for n, j in jobs.items()}


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def coefficients(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """feature, coefficient (linear models, on standardised inputs) or impurity importance (forests)."""
    last = model.stages[-1]
    values = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, weight double")


def calibrate_isotonic(dev: DataFrame, later: DataFrame, p: str = "p", y: str = "y", out: str = "calibrated") -> DataFrame:
    """Isotonic map fitted on development predictions, frozen and applied to later ones."""
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=p, labelCol=y).fit(dev.select(F.col(p).cast("double").alias(p), F.col(y).cast("double").alias(y)).na.drop())
    return model.setPredictionCol(out).transform(later)


# --- small fits inside tasks ----------------------------------------------------------------------------------------


def fit_logistic(x: np.ndarray, y: np.ndarray, l1: float = 0.0, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Class-balanced logistic regression by accelerated proximal gradient; the last weight is the intercept."""
    n, p = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    k1 = max(y.sum(), 1)
    wt = np.where(y > 0.5, n / (2 * k1), n / (2 * max(n - k1, 1))) / n
    step = 1 / (0.25 * np.linalg.norm(a * np.sqrt(wt)[:, None], 2) ** 2 + l2)
    w = v = np.zeros(p + 1)
    t = 1.0
    for _ in range(steps):
        g = a.T @ (wt * (1 / (1 + np.exp(-np.clip(a @ v, -40, 40))) - y))
        g[:-1] += l2 * v[:-1]
        new = v - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-9:
            w = new
            break
        w, t = new, t2
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 400) -> np.ndarray:
    """Class-balanced linear machine with squared hinge loss by gradient steps."""
    n, p = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    s = np.where(y > 0.5, 1.0, -1.0)
    k1 = max(y.sum(), 1)
    wt = np.where(y > 0.5, n / (2 * k1), n / (2 * max(n - k1, 1))) * c / n
    step = 1 / (2 * np.linalg.norm(a * np.sqrt(wt)[:, None], 2) ** 2 + 1e-3)
    w = np.zeros(p + 1)
    for _ in range(steps):
        gap = np.maximum(0, 1 - s * (a @ w))
        w -= step * (-2 * a.T @ (wt * s * gap) + 1e-3 * np.append(w[:-1], 0))
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Pool-adjacent-violators fit; between its knots it interpolates."""
    order = np.argsort(score, kind="stable")
    xs, ys = score[order], y[order].astype(float)
    value, weight, right = [], [], []
    for i in range(len(xs)):
        value.append(ys[i])
        weight.append(1.0)
        right.append(i)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, k = value.pop(), weight.pop()
            right.pop(-2)
            value[-1] = (value[-1] * weight[-1] + v * k) / (weight[-1] + k)
            weight[-1] += k
    fitted = np.repeat(value, np.diff([-1, *right]))
    return lambda s: np.interp(s, xs, fitted)


class Forest:
    """Random forest on binned inputs: all trees of a block grow together, a level at a time, from one histogram.

    Bootstrapped rows, square-root-many inputs tried at each node, Gini gain with balanced class weights, ``leaf`` rows at least in each
    child; a probability is the mean of the leaves' weighted shares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0, trees: int = 400, depth: int = 8, leaf: int = 20, bins: int = 64):
        n, p = x.shape
        self.depth = depth
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(p)]
        codes, width = self._codes(x), bins
        k1 = max(y.sum(), 1)
        weight = np.where(y > 0.5, n / (2 * k1), n / (2 * max(n - k1, 1)))
        rng = np.random.default_rng(np.random.SeedSequence([seed, n]))
        block = max(1, 2_000_000 // max(n * p, 1))
        parts = [self._grow(codes, y, weight, rng, min(block, trees - at), leaf, width) for at in range(0, trees, block)]
        self.feature, self.cut, self.value = (np.concatenate(z) for z in zip(*parts))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1)

    def _grow(self, codes, y, weight, rng, trees, leaf, width):
        n, p = codes.shape
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full((trees, size), -1, np.int32), np.zeros((trees, size), np.int32), np.zeros((trees, size))
        drawn = rng.multinomial(n, np.full(n, 1 / n), size=trees)
        tree, row = np.nonzero(drawn)
        count = drawn[tree, row].astype(float)
        node = np.zeros(len(tree), np.int64)
        tries = max(1, int(p**0.5))
        for level in range(self.depth + 1):
            if not len(tree):
                break
            keys, at = np.unique(tree * size + node, return_inverse=True)
            m = len(keys)
            w = count * weight[row]
            total, pos = np.bincount(at, w, m), np.bincount(at, w * y[row], m)
            value[keys // size, keys % size] = pos / total
            if level == self.depth:
                break
            here = np.bincount(at, count, m)
            best, best_f, best_c = np.full(m, -np.inf), np.full(m, -1), np.zeros(m, np.int64)
            tried = np.argsort(rng.random((m, p)), axis=1) < tries
            for f in range(p):
                cell = at * width + codes[row, f]
                c, t, q = (np.cumsum(np.bincount(cell, z, m * width).reshape(m, width), axis=1) for z in (count, w, w * y[row]))
                right, rest = total[:, None] - t, pos[:, None] - q
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = (q**2 + (t - q) ** 2) / t + (rest**2 + (right - rest) ** 2) / right
                gain = np.where((c >= leaf) & (here[:, None] - c >= leaf) & tried[:, f : f + 1], gain, -np.inf)
                k = gain.argmax(axis=1)
                g = gain[np.arange(m), k]
                better = g > best
                best[better], best_f[better], best_c[better] = g[better], f, k[better]
            split = best > (pos**2 + (total - pos) ** 2) / total + 1e-9
            feature[keys // size, keys % size], cut[keys // size, keys % size] = np.where(split, best_f, -1), best_c
            go = split[at]
            tree, row, count, at = tree[go], row[go], count[go], at[go]
            node = 2 * node[go] + 1 + (codes[row, best_f[at]] > best_c[at])
        return feature, cut, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes, each = self._codes(x), np.arange(len(self.feature))[:, None]
        node = np.zeros((len(self.feature), len(x)), np.int64)
        for _ in range(self.depth):
            f = self.feature[each, node]
            right = np.take_along_axis(codes.T, np.maximum(f, 0), axis=0) > self.cut[each, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return self.value[each, node].mean(axis=0)


def fit_sigmoid(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the sigmoid from margins to probabilities, with the targets drawn in by one row of each class."""
    k1, k0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0.5, (k1 + 1) / (k1 + 2), 1 / (k0 + 2))
    a = np.stack([raw, np.ones(len(raw))], 1)
    w = np.array([0.0, np.log((k1 + 1) / (k0 + 1))])
    loss = lambda w: float((np.logaddexp(0, a @ w) - goal * (a @ w)).sum())
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + 1e-10 * np.eye(2), a.T @ (q - goal))
        scale = 1.0
        while loss(w - scale * step) > loss(w) and scale > 1e-9:
            scale /= 2
        w = w - scale * step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def calibrated_svm(x: np.ndarray, y: np.ndarray, new: np.ndarray, folds: int = 3) -> np.ndarray:
    """Mean of ``folds`` machines, each fitted without one fold (an equal, connected share of each class) and mapped to probabilities by a sigmoid
    fitted on it; with fewer rows of a class than folds, one machine with its sigmoid on the same rows."""
    fold = np.empty(len(y), int)
    for k in (0.0, 1.0):
        of = np.flatnonzero((y > 0.5) == (k > 0.5))
        fold[of] = np.arange(len(of)) * folds // max(len(of), 1)
    if min(y.sum(), len(y) - y.sum()) < folds:
        fold[:], folds = 0, 1
    out = np.zeros(len(new))
    for k in range(folds):
        fit, held = (fold != k, fold == k) if folds > 1 else (fold == 0, fold == 0)
        w = fit_svm(x[fit], y[fit])
        a, b = fit_sigmoid(x[held] @ w[:-1] + w[-1], y[held])
        out += 1 / (1 + np.exp(-np.clip(a * (new @ w[:-1] + w[-1]) + b, -40, 40)))
    return out / folds


def _standard(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = train.std(axis=0)
    return train.mean(axis=0), np.where(sd > 0, sd, 1.0)


def predict_small(model: str, train_x: np.ndarray, train_y: np.ndarray, x: np.ndarray, trees: int = 400) -> np.ndarray:
    """Standardise on the training rows, fit by name, probabilities of ``x``."""
    m, s = _standard(train_x)
    zt, z = (train_x - m) / s, (x - m) / s
    if model == "random_forest":
        return Forest(zt, train_y, trees=trees).predict(z)
    if model == "linear_svm":
        return calibrated_svm(zt, train_y, z)
    c = 1.0 / len(zt)
    w = fit_logistic(zt, train_y, *{"logistic_l1": (c, 0.0), "elastic_net": (c / 2, c / 2), "logistic": (0.0, 1e-3)}[model])
    p = lambda a: 1 / (1 + np.exp(-np.clip(a @ w[:-1] + w[-1], -40, 40)))
    return p(z)


class _Refitter:
    """Fits on the rows of one scope that a refit date may see, and their predictions; rows are sorted by date."""

    def __init__(self, d: np.ndarray, x: np.ndarray, y: np.ndarray, purge: int, min_train: int, min_class: int, calendar: bool):
        self.d, self.x, self.y = d, x, y
        self.purge, self.min_train, self.min_class, self.calendar = purge, min_train, min_class, calendar
        self.dates = np.unique(d)

    def train(self, asof) -> np.ndarray:
        """Which rows a fit at ``asof`` sees: those with an outcome, ``purge`` dates (or calendar days) or more before it."""
        if self.calendar:
            seen = self.d < asof - np.timedelta64(self.purge, "D")
        else:
            past = self.dates[self.dates <= asof]
            seen = self.d <= past[-self.purge - 1] if len(past) > self.purge else np.zeros(len(self.d), bool)
        seen &= ~np.isnan(self.y)
        k = self.y[seen].sum()
        return seen if seen.sum() >= self.min_train and min(k, seen.sum() - k) >= max(self.min_class, 1) else np.zeros(len(self.d), bool)

    def predict(self, model: str, seen: np.ndarray, rows: np.ndarray, isotonic_map: bool = False) -> np.ndarray:
        x, y = self.x[seen], self.y[seen]
        if not isotonic_map:
            return predict_small(model, x, y, self.x[rows])
        both = predict_small(model, x, y, np.vstack([x, self.x[rows]]))
        return isotonic(both[: len(x)], y)(both[len(x) :])


#: Refit dates and cut-offs that may be sent to the tasks.
MOST_DATES = 10_000


def _dates(df: DataFrame, name: str) -> np.ndarray:
    got = [r[0] for r in df.select(name).distinct().limit(MOST_DATES + 1).collect()]
    if len(got) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} dates")
    return np.sort(np.array(got, "datetime64[D]"))


def _arrays(pdf: pd.DataFrame, names: Sequence[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(["d", "universe"])
    return pdf, pdf["d"].to_numpy("datetime64[D]"), pdf[list(names)].to_numpy(float), pdf["y"].to_numpy(float)


def walk_forward(df: DataFrame, features: Sequence[str], refits: DataFrame, models: Sequence[str] = ("logistic_l1",), purge: int = 21, min_train: int = 504, min_class: int = 1, scope: str = "universe", calendar_compat: bool = False, isotonic_map: bool = False) -> tuple[DataFrame, DataFrame]:
    """Quarterly refits: each refit (column asof) fits on rows at least ``purge`` dates before it and predicts the
    rows after it up to the next one. ``scope``: the column within which rows are pooled and purged (a universe,
    or a constant for a pooled panel). Returns predictions (model, scope, universe, d, y, p) and the refit log. A scope is one task."""
    names, models = list(features), list(models)
    asofs = _dates(refits, "asof")
    key = F.col(scope).alias("__scope") if scope in df.columns else F.lit(scope).alias("__scope")
    rows = df.select(key, "universe", "d", *names, F.col("y").cast("double").alias("y")).na.drop(subset=names)
    cols = ["scope", "model", "asof", "universe", "d", "y", "p", "train_end", "train_n", "train_rate"]

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, d, x, y = _arrays(pdf, names)
        cell = _Refitter(d, x, y, purge, min_train, min_class, calendar_compat)
        out = []
        for k, asof in enumerate(asofs):
            block = (d > asof) & (d <= asofs[k + 1] if k + 1 < len(asofs) else True)
            seen = cell.train(asof)
            if not seen.any() or not block.any():
                continue
            for model in models:
                p = cell.predict(model, seen, block, isotonic_map)
                out.append(pd.DataFrame({"scope": key[0], "model": model, "asof": pd.Timestamp(asof).date(), "universe": pdf["universe"][block], "d": pdf["d"][block], "y": y[block], "p": p, "train_end": pd.Timestamp(d[seen].max()).date(), "train_n": int(seen.sum()), "train_rate": float(y[seen].mean())}, columns=cols))
        return pd.concat(out) if out else pd.DataFrame([], columns=cols)

    got = rows.groupBy("__scope").applyInPandas(fit, "scope string, model string, asof date, universe string, d date, y double, p double, train_end date, train_n long, train_rate double")
    log = got.groupBy("scope", "model", "asof").agg(F.first("train_end").alias("train_end"), F.first("train_n").alias("train_n"), F.first("train_rate").alias("train_positive_rate"), F.min("d").alias("pred_start"), F.max("d").alias("pred_end"), F.count("*").alias("pred_n"), F.avg(F.when(~F.isnan("y"), F.col("y"))).alias("pred_positive_rate"))
    return got.select("scope", "model", "universe", "d", F.when(~F.isnan("y"), F.col("y")).alias("y"), "p"), log


def _auc(y: np.ndarray, p: np.ndarray) -> float | None:
    k1, k0 = int(y.sum()), int(len(y) - y.sum())
    if not k1 or not k0:
        return None
    kinds, at, n = np.unique(p, return_inverse=True, return_counts=True)
    rank = np.cumsum(n) - (n - 1) / 2
    return float((rank[at][y > 0.5].sum() - k1 * (k1 + 1) / 2) / (k1 * k0))


def cutoff_sweep(df: DataFrame, features: Sequence[str], cutoffs: DataFrame, refits: DataFrame | None = None, models: Sequence[str] = ("logistic_l1",), purge: int = 21, min_train: int = 252, min_rows: int = 50, min_days: int = 4 * 91) -> DataFrame:
    """model, universe, cutoff, auc, brier, n, n_refits: for every cut-off the walk-forward that starts there, refitted at each later
    date of ``refits`` (column asof), scored on all rows with an outcome after the cut-off. AUC is NULL below ``min_rows`` or with one class. A cut-off with
    fewer than ``min_days`` days of rows after it is left out. A fit at a refit date is the same for all cut-offs before it and is
    made once; a universe is one task."""
    names, models = list(features), list(models)
    starts = _dates(cutoffs, "cutoff")
    asofs = _dates(refits, "asof") if refits is not None else np.array([], "datetime64[D]")
    rows = df.select("universe", "d", *names, F.col("y").cast("double").alias("y")).na.drop(subset=names)
    cols = ["universe", "model", "cutoff", "auc", "brier", "n", "n_refits"]

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, d, x, y = _arrays(pdf, names)
        cell = _Refitter(d, x, y, purge, min_train, 1, False)
        out = []
        for model in models:
            shared = np.full(len(d), np.nan)  # predictions of the refits
            fitted = np.zeros(len(asofs), bool)
            for k, asof in enumerate(asofs):
                block = (d > asof) & (d <= asofs[k + 1] if k + 1 < len(asofs) else True)
                seen = cell.train(asof)
                if seen.any() and block.any():
                    shared[block], fitted[k] = cell.predict(model, seen, block), True
            for cutoff in starts:
                if not len(d) or (d[-1] - cutoff).astype(int) < min_days:
                    continue
                later = np.flatnonzero(asofs > cutoff)
                first = (d > cutoff) & (d <= asofs[later[0]] if len(later) else True)
                p = np.where(d > cutoff, shared, np.nan)
                p[first] = np.nan
                seen, n_refits = cell.train(cutoff), int(fitted[later].sum())
                if seen.any() and first.any():
                    p[first], n_refits = cell.predict(model, seen, first), n_refits + 1
                ok = ~np.isnan(p) & ~np.isnan(y)
                if ok.any():
                    out.append((key[0], model, pd.Timestamp(cutoff).date(), _auc(y[ok], p[ok]) if ok.sum() >= min_rows else None, float(((p[ok] - y[ok]) ** 2).mean()), int(ok.sum()), n_refits))
        return pd.DataFrame(out, columns=cols)

    return rows.groupBy("universe").applyInPandas(fit, "universe string, model string, cutoff date, auc double, brier double, n long, n_refits int")


def cached_sweep(path: str, params: dict, make: Callable[[], DataFrame], spark) -> DataFrame:
    """Results of a sweep kept as Parquet under a key of all its parameters."""
    import hashlib
    import json

    at = f"{path}/{hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:24]}"
    try:
        return spark.read.parquet(at)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(at)
    return spark.read.parquet(at)


def ablation(run: Callable[..., DataFrame], base: dict, knobs: dict[str, Sequence]) -> DataFrame:
    """``run`` once with the base parameters and once for each other value of each knob: adds knob and value."""
    out = run(**base).withColumn("knob", F.lit("base")).withColumn("value", F.lit(""))
    for name, values in knobs.items():
        for v in values:
            if v != base.get(name):
                out = out.unionByName(run(**{**base, name: v}).withColumn("knob", F.lit(name)).withColumn("value", F.lit(str(v))))
    return out


def leave_one_out(run: Callable[[Sequence[str]], DataFrame], features: Sequence[str]) -> DataFrame:
    """``run`` with all features and without each of them: adds ``dropped``."""
    out = run(list(features)).withColumn("dropped", F.lit(""))
    for f in features:
        out = out.unionByName(run([x for x in features if x != f]).withColumn("dropped", F.lit(f)))
    return out


def naive_baseline(df: DataFrame, keys: Sequence[str], value: str, y: str = "y") -> DataFrame:
    """AUC of today's level as the forecast."""
    return metrics.roc_auc(df, list(keys), y, value)
