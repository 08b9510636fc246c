"""Episodes: composition, run-up vectors, ladders, clustering and placebo dates.

Factors are columns; an episode is keyed by (universe, start). Vectors are arrays in factor order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import windows as W
from gustline.functions.scalars import cosine, series, shares
from gustline.operators.eventclock import absorb  # noqa: F401  re-exported for callers that time run-ups


def _means(factors: Sequence[str]) -> Column:
    return F.array(*[F.avg(f) for f in factors])


def _inside(rows: DataFrame, spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows of each span, both ends included; spans of one universe may overlap. Spans are spread over months and
    met by an equi-join, then filtered."""
    month = lambda c: F.trunc(c, "month")
    spread = spans.withColumn("__m", F.explode(F.sequence(month(F.col(start)), month(F.col(end)), F.expr("interval 1 month"))))
    return rows.withColumn("__m", month(F.col("d"))).join(spread, ["universe", "__m"]).filter((F.col("d") >= F.col(start)) & (F.col("d") <= F.col(end))).drop("__m")


def composition(contributions: DataFrame, episodes: DataFrame, factors: Sequence[str]) -> DataFrame:
    """universe, start, composition: mean contributions over their sum; episodes with a sum of zero or less are left out."""
    rows = _inside(contributions.select("universe", "d", *factors), episodes.select("universe", "start", "end"))
    return rows.groupBy("universe", "start").agg(shares(_means(factors)).alias("composition")).filter("composition is not null")


def driver_shares(contributions: DataFrame, windows: DataFrame, factors: Sequence[str], total: str = "turbulence") -> DataFrame:
    """Percent of the mean index by factor within named windows (name, start, end)."""
    universes = contributions.select("universe").distinct()
    spans = universes.crossJoin(F.broadcast(windows))
    rows = _inside(contributions.select("universe", "d", total, *factors), spans)
    return rows.groupBy("universe", "name").agg(*[(F.avg(f) / F.avg(total) * 100).alias(f) for f in factors], F.count("*").alias("n_days"))


def annotate(episodes: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``event``: the first named window (name, ord, start, end) that overlaps the episode, or NULL."""
    w = windows.select(F.col("name"), F.col("ord"), F.col("start").alias("ws"), F.col("end").alias("we"))
    hit = episodes.join(F.broadcast(w), (F.col("start") <= F.col("we")) & (F.col("end") >= F.col("ws")), "left")
    keys = episodes.columns
    return hit.groupBy(*keys).agg(F.min_by("name", "ord").alias("event"))


def runup(contributions: DataFrame, factors: Sequence[str], lead: int = 21, back: int = 0, min_rows: int = 1) -> DataFrame:
    """For every row: the normalised mean contributions of the ``lead`` rows that end 1 + back * lead rows before
    (NULL if their sum is not positive or too few rows are there). Join with episode starts to use it."""
    w = series(order=("pos",))
    frame = w.rowsBetween(-lead * (back + 1), -1 - lead * back)
    any_value = F.coalesce(*[F.col(f) for f in factors]).isNotNull()
    n = F.sum(any_value.cast("int")).over(frame)
    v = F.array(*[F.avg(f).over(frame) for f in factors])
    return contributions.select("universe", "d", "pos", F.when(n >= min_rows, shares(v)).alias("pre"))


def at_starts(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """The rows at episode starts."""
    return rows.join(episodes.select("universe", F.col("start").alias("d")), ["universe", "d"])


def runup_event_clock(contributions: DataFrame, episodes: DataFrame, factors: Sequence[str], total: str, threshold: float, units: float = 1.0) -> DataFrame:
    """universe, start, pre, n_rows: contributions of the rows before each start that hold ``units`` events of
    intensity (fewer where the series begins), by bisection in running sums."""
    names = list(factors)
    marked = contributions.join(episodes.select("universe", F.col("start").alias("d"), F.lit(True).alias("is_start")), ["universe", "d"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v = pdf[total].fillna(0).to_numpy(float)
        cum = np.concatenate([[0.0], np.cumsum(v)])
        c = pdf[names].to_numpy(float)
        ok = np.isfinite(c)
        csum = np.vstack([np.zeros(len(names)), np.cumsum(np.where(ok, c, 0), axis=0)])
        cnt = np.vstack([np.zeros(len(names)), np.cumsum(ok, axis=0)])
        out = []
        for at in np.flatnonzero(pdf["is_start"].fillna(False).to_numpy(bool)):
            lo = max(0, int(np.searchsorted(cum, cum[at] - units * threshold, side="right")) - 1)
            n = cnt[at] - cnt[lo]
            mean = (csum[at] - csum[lo]) / np.where(n > 0, n, np.nan)
            if at > lo and np.nansum(mean) > 0:
                out.append((pdf["universe"].iloc[0], pdf["d"].iloc[at], np.nan_to_num(mean) / np.nansum(mean), at - lo))
        return pd.DataFrame(out, columns=["universe", "start", "pre", "n_rows"])

    return marked.select("universe", "d", "pos", total, "is_start", *names).groupBy("universe").applyInPandas(run, "universe string, start date, pre array<double>, n_rows long")


def ladder(contributions: DataFrame, comp: DataFrame, factors: Sequence[str], lead: int = 21, rungs: int = 4, min_rows: int = 5) -> DataFrame:
    """universe, start, c0..c(rungs-1): cosine of each earlier month's vector with the realised composition, for
    starts where every rung has a vector; ``uncond`` is the cosine with the mean composition of the universe."""
    w = series(order=("pos",))
    cols = []
    any_value = F.coalesce(*[F.col(f) for f in factors]).isNotNull()
    for k in range(rungs):
        frame = w.rowsBetween(-lead * (k + 1), -1 - lead * k)
        cols.append(F.when(F.sum(any_value.cast("int")).over(frame) >= min_rows, shares(F.array(*[F.avg(f).over(frame) for f in factors]))).alias(f"v{k}"))
    rows = contributions.select("universe", F.col("d").alias("start"), *cols).join(comp, ["universe", "start"])
    for k in range(rungs):
        rows = rows.filter(F.col(f"v{k}").isNotNull())
    by = Window.partitionBy("universe")
    mean = F.array(*[F.avg(F.get("composition", F.lit(i))).over(by) for i in range(len(factors))])
    rows = rows.withColumn("__u", mean)
    return rows.select("universe", "start", *[cosine(F.col(f"v{k}"), F.col("composition")).alias(f"c{k}") for k in range(rungs)], cosine(F.col("__u"), F.col("composition")).alias("uncond"))


def convergence_slopes(steps: DataFrame, rungs: int = 4) -> DataFrame:
    """Least-squares slope of similarity on months before the start: below zero where they converge."""
    mean = (rungs - 1) / 2
    sxx = sum((k - mean) ** 2 for k in range(rungs))
    slope = sum((F.lit((k - mean) / sxx) * F.col(f"c{k}") for k in range(rungs)), F.lit(0.0))
    return steps.withColumn("slope", slope)


def placebo_dates(rows: DataFrame, episodes: DataFrame, n: int, lead: int = 84, seed: int = 0) -> DataFrame:
    """n dates of each universe that are ``lead`` rows or more from any episode start, in seeded hash order."""
    starts = at_starts(rows.select("universe", "d", "pos"), episodes).select("universe", F.col("pos").alias("sp"))
    near = starts.select("universe", F.explode(F.sequence(F.col("sp") - lead + 1, F.col("sp") + lead - 1)).alias("pos")).distinct()
    free = rows.select("universe", "d", "pos").filter(F.col("pos") >= lead).join(near, ["universe", "pos"], "left_anti")
    w = Window.partitionBy("universe").orderBy(F.xxhash64("universe", "pos", F.lit(seed)))
    return free.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


# clustering of a few hundred composition vectors, on the driver


def ward(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (i, j, height) of Ward's method by the Lance-Williams recurrence; new clusters count on from n."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    size, name, alive = np.ones(n), list(range(n)), np.ones(n, bool)
    out = []
    for step in range(n - 1):
        sub = np.where(alive[:, None] & alive[None], d, np.inf)
        i, j = divmod(int(sub.argmin()), n)
        i, j = min(i, j), max(i, j)
        out.append((*sorted((name[i], name[j])), float(np.sqrt(d[i, j]))))
        a, b = size[i], size[j]
        new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        d[i] = d[:, i] = new
        d[i, i] = np.inf
        alive[j] = False
        size[i], name[i] = a + b, n + step
    return out


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels 1..k after the first n - k merges, numbered by first member."""
    group = {i: [i] for i in range(n)}
    for step, (a, b, _) in enumerate(merges[: n - k]):
        group[n + step] = group.pop(a) + group.pop(b)
    labels = np.zeros(n, int)
    for c, members in enumerate(sorted(group.values(), key=min), 1):
        labels[members] = c
    return labels


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = np.zeros(len(x))
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() < 2:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in np.unique(labels) if c != labels[i])
        s[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return float(s.mean())


def cluster_episodes(comp: DataFrame, factors: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5, 6), most: int = 5000) -> DataFrame:
    """universe, start, cluster, name, k, silhouette: Ward's tree per universe, cut where the silhouette is best;
    names join the leading factor and a second one above 0.6 of it. A universe's episodes (at most ``most``)
    are one task."""
    names = np.array(list(factors))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["universe", "start", "cluster", "name", "k", "silhouette"]
        pdf = pdf.sort_values("start")
        if len(pdf) > most:
            raise ValueError("too many episodes for a full tree")
        if len(pdf) < 3:
            return pd.DataFrame([], columns=columns)
        x = np.stack(pdf["composition"])
        tree = ward(x)
        best = max(((silhouette(x, lab := cut_tree(tree, len(x), k)), -k, lab) for k in ks if k < len(x)), key=lambda t: t[:2])
        score, k, labels = best[0], -best[1], best[2]
        title = {}
        for c in np.unique(labels):
            centre = x[labels == c].mean(0)
            order = np.argsort(-centre, kind="stable")
            top = [names[order[0]]] + ([names[order[1]]] if len(order) > 1 and centre[order[1]] > 0.6 * centre[order[0]] else [])
            title[c] = "+".join(top) + "-led"
        return pd.DataFrame({"universe": key[0], "start": pdf["start"], "cluster": labels, "name": [title[c] for c in labels], "k": k, "silhouette": score}, columns=columns)

    return comp.groupBy("universe").applyInPandas(run, "universe string, start date, cluster long, name string, k long, silhouette double")


__all__ = ["composition", "driver_shares", "annotate", "runup", "at_starts", "runup_event_clock", "ladder", "convergence_slopes", "placebo_dates", "ward", "cut_tree", "silhouette", "cluster_episodes", "W"]
