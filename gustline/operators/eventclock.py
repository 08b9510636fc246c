"""The event clock: time paced by accumulated intensity.

An event closes when the running sum since the last close reaches the threshold; what exceeds it is dropped.
A scan with a reset is no prefix sum, so each universe is one stateful pass; universes run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = "universe string, event_id int, start_date date, end_date date, calendar_days_in_event int, trading_days_in_event int, cumulative_intensity double"


def check_intensity(df: DataFrame, value: str) -> None:
    """Raises on a negative intensity."""
    if df.filter(F.col(value) < 0).limit(1).count():
        raise ValueError(f"{value} holds negative values")


def absorb(values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of every closed event. Blocks are searched by bisection in their running sums, so
    the pass is linear in the rows and not in Python steps."""
    starts, ends, at, n = [], [], 0, len(values)
    width = 64
    while at < n:
        lo, acc, end = at, 0.0, -1
        while lo < n:
            cum = acc + np.cumsum(values[lo : lo + width])
            k = int(np.searchsorted(cum, threshold, side="left"))
            if k < len(cum):
                end = lo + k
                break
            acc = float(cum[-1])
            lo += width
        if end < 0:
            break
        starts.append(at)
        ends.append(end)
        at = end + 1
    return np.array(starts, int), np.array(ends, int)


def _by_universe(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("universe", *columns)


def events(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """One row per closed event; rows with a NULL value are left out, an open event at the end is dropped."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["v"]).sort_values("d")
        v, d = pdf["v"].to_numpy(float), pdf["d"].to_numpy()
        s, e = absorb(v, threshold)
        return pd.DataFrame(
            {
                "universe": pdf["universe"].iloc[0] if len(pdf) else None,
                "event_id": np.arange(len(s), dtype=np.int32),
                "start_date": d[s],  # without an event still dates: an empty list would be doubles to Arrow
                "end_date": d[e],
                "calendar_days_in_event": np.array([(b - a).days for a, b in zip(d[s], d[e])], np.int32),
                "trading_days_in_event": (e - s + 1).astype(np.int32),
                "cumulative_intensity": np.array([v[a : b + 1].sum() for a, b in zip(s, e)], float),
            }
        )

    return _by_universe(df, ["d", F.col(value).alias("v")]).groupBy("universe").applyInPandas(run, EVENT_SCHEMA)


def event_positions(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """universe, event_id, lo, hi (row positions); a NULL value counts as zero."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        s, e = absorb(pdf["v"].fillna(0).to_numpy(float), threshold)
        p = pdf["pos"].to_numpy()
        return pd.DataFrame({"universe": pdf["universe"].iloc[0], "event_id": np.arange(len(s)), "lo": p[s] if len(s) else [], "hi": p[e] if len(s) else []})

    return _by_universe(df, ["pos", F.col(value).alias("v")]).groupBy("universe").applyInPandas(run, "universe string, event_id long, lo long, hi long")


def calibrate(df: DataFrame, value: str, target: float, tolerance: float = 0.25, brackets: int = 20, steps: int = 60) -> DataFrame:
    """universe, threshold, mean_length, n_events: the threshold whose events have ``target`` rows on average,
    by bisection; the whole search of a universe is one task."""

    def length(v: np.ndarray, thr: float) -> tuple[float, int]:
        s, e = absorb(v, thr)
        return (float((e - s + 1).mean()), len(s)) if len(s) else (float("inf"), 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.dropna(subset=["v"]).sort_values("d")["v"].to_numpy(float)
        lo = hi = max(float(v.mean()) * target, 1e-12)
        for _ in range(brackets):
            if length(v, lo)[0] <= target:
                break
            lo *= 0.5
        for _ in range(brackets):
            if length(v, hi)[0] >= target:
                break
            hi *= 2
        mid = (lo + hi) / 2
        for _ in range(steps):
            mid = (lo + hi) / 2
            m, _n = length(v, mid)
            if abs(m - target) <= tolerance:
                break
            lo, hi = (mid, hi) if m < target else (lo, mid)
        m, n = length(v, mid)
        return pd.DataFrame({"universe": [pdf["universe"].iloc[0]], "threshold": [mid], "mean_length": [m], "n_events": [n]})

    return _by_universe(df, ["d", F.col(value).alias("v")]).groupBy("universe").applyInPandas(run, "universe string, threshold double, mean_length double, n_events long")


def first_crossing(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """``df`` with ``cross_pos``: the first later row at which the intensity added since this row reaches the
    threshold, or NULL. Running sums are monotone, so one bisection per universe finds all."""
    columns = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        cum = pdf[value].fillna(0).cumsum().to_numpy()
        j = np.searchsorted(cum, cum + threshold, side="left")
        p = pdf["pos"].to_numpy()
        pdf["cross_pos"] = pd.array([int(p[k]) if k < len(p) else None for k in j], dtype="Int64")
        return pdf[[*columns, "cross_pos"]]

    return df.groupBy("universe").applyInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, cross_pos long")


def event_returns(df: DataFrame, value: str, price: str, threshold: float) -> DataFrame:
    """Overlapping event returns: ln of the price at the crossing over the price now."""
    crossed = first_crossing(df.select("universe", "d", "pos", value, price), value, threshold)
    ahead = df.select("universe", F.col("pos").alias("cross_pos"), F.col(price).alias("ahead"))
    out = crossed.filter("cross_pos is not null").join(ahead, ["universe", "cross_pos"])
    return out.select("universe", "d", "pos", "cross_pos", F.log(F.col("ahead") / F.col(price)).alias("event_return"))


def event_drawdown(df: DataFrame, value: str, price: str, threshold: float) -> DataFrame:
    """Lowest ln price from the row after to the crossing, less today's; NULL without a crossing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        cum = pdf["v"].fillna(0).cumsum().to_numpy()
        j = np.searchsorted(cum, cum + threshold, side="left")
        lp = np.log(pdf["p"].to_numpy(float))
        n = len(lp)
        # minima over ranges by doubling
        table = [lp]
        while (1 << len(table)) <= n:
            prev, half = table[-1], 1 << (len(table) - 1)
            table.append(np.minimum(prev[:-half], prev[half:]))
        out = np.full(n, np.nan)
        for i in range(n):
            a, b = i + 1, int(j[i])
            if a <= b < n:
                k = (b - a + 1).bit_length() - 1
                out[i] = min(table[k][a], table[k][b - (1 << k) + 1]) - lp[i]
        return pd.DataFrame({"universe": pdf["universe"], "d": pdf["d"], "pos": pdf["pos"], "event_drawdown": out})

    got = _by_universe(df, ["d", "pos", F.col(value).alias("v"), F.col(price).alias("p")]).groupBy("universe").applyInPandas(run, "universe string, d date, pos long, event_drawdown double")
    return got.withColumn("event_drawdown", F.when(~F.isnan("event_drawdown"), F.col("event_drawdown")))


def on_event_grid(df: DataFrame, value: str, threshold: float, sums: list[str]) -> DataFrame:
    """One row per event: sums of the named columns, the mean intensity and the event's last row."""
    spans = event_positions(df, value, threshold)
    spread = spans.select("universe", "event_id", F.explode(F.sequence("lo", "hi")).alias("pos"))
    rows = df.join(spread, ["universe", "pos"])
    return rows.groupBy("universe", "event_id").agg(*[F.sum(c).alias(c) for c in sums], F.avg(value).alias("mean_intensity"), F.max("pos").alias("last_pos"), F.count("*").alias("n_rows"))


def event_features(df: DataFrame, value: str, ret: str, threshold: float, tempo: int = 21) -> DataFrame:
    """fill, age, velocity, tempo and event momentum of every row."""
    spans = event_positions(df, value, threshold)
    ends = spans.select("universe", F.col("hi").alias("pos"), F.lit(1).alias("closes"))
    w = Window.partitionBy("universe").orderBy("pos")
    x = df.join(ends, ["universe", "pos"], "left").withColumn("closes", F.coalesce("closes", F.lit(0)))
    done_before = F.coalesce(F.sum("closes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("event_no", done_before)
    inside = Window.partitionBy("universe", "event_no").orderBy("pos")
    x = x.withColumn("et_intensity_to_date", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(inside.rowsBetween(Window.unboundedPreceding, 0)) / threshold)
    x = x.withColumn("et_days_since_start", (F.row_number().over(inside) - 1).cast("double"))
    full = w.rowsBetween(-(tempo - 1), 0)
    x = x.withColumn("et_velocity", F.when(F.count("closes").over(full) == tempo, F.sum("closes").over(full).cast("double")))
    five = w.rowsBetween(-4, 0)
    x = x.withColumn("et_turb_per_day", F.when(F.count(value).over(five) == 5, F.avg(value).over(five) / threshold))
    return x.join(trailing_return(df, value, ret, threshold), ["universe", "pos"], "left").drop("closes", "event_no")


def trailing_return(df: DataFrame, value: str, ret: str, threshold: float, out: str = "et_momentum") -> DataFrame:
    """Sum of returns over the trailing rows that first hold ``threshold`` of intensity: a bisection in running sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v = pdf["v"].fillna(0).to_numpy(float)
        cum = np.concatenate([[0.0], np.cumsum(v)])
        r = np.concatenate([[0.0], np.cumsum(pdf["r"].fillna(0).to_numpy(float))])
        # the latest start j with cum[i+1] - cum[j] >= threshold
        j = np.searchsorted(cum, cum[1:] - threshold, side="right") - 1
        res = np.where(j >= 0, r[1:] - r[np.maximum(j, 0)], np.nan)
        return pd.DataFrame({"universe": pdf["universe"], "pos": pdf["pos"], out: res})

    got = _by_universe(df, ["pos", F.col(value).alias("v"), F.col(ret).alias("r")]).groupBy("universe").applyInPandas(run, f"universe string, pos long, {out} double")
    return got.withColumn(out, F.when(~F.isnan(out), F.col(out)))
