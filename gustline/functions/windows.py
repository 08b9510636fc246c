"""Row-framed window functions of one ordered series.

A frame is (window, min_periods, shift): the last ``window`` rows up to ``shift`` rows back, with at least
``min_periods`` values that are not NULL, else NULL. All functions take the same window specification, so one
sort serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frame:
    window: int | None  # None: everything before
    min_periods: int = 1
    shift: int = 0

    def over(self, w):
        start = Window.unboundedPreceding if self.window is None else -(self.window - 1 + self.shift)
        return w.rowsBetween(start, -self.shift)

    def gated(self, value: Column, counted: Column, w) -> Column:
        return F.when(F.count(counted).over(self.over(w)) >= self.min_periods, value)


def trailing(window: int, min_periods: int | None = None, shift: int = 1) -> Frame:
    """The shifted frame of causal features: yesterday and before; half a window suffices by default."""
    return Frame(window, max(2, window // 2) if min_periods is None else min_periods, shift)


def mean(c: Column, f: Frame, w) -> Column:
    return f.gated(F.avg(c).over(f.over(w)), c, w)


def std(c: Column, f: Frame, w, ddof: int = 0) -> Column:
    return f.gated((F.stddev_pop if ddof == 0 else F.stddev_samp)(c).over(f.over(w)), c, w)


def total(c: Column, f: Frame, w) -> Column:
    return f.gated(F.sum(c).over(f.over(w)), c, w)


def highest(c: Column, f: Frame, w) -> Column:
    return f.gated(F.max(c).over(f.over(w)), c, w)


def lowest(c: Column, f: Frame, w) -> Column:
    return f.gated(F.min(c).over(f.over(w)), c, w)


def correlation(a: Column, b: Column, f: Frame, w) -> Column:
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return f.gated(F.corr(x, y).over(f.over(w)), x, w)


def quantile(c: Column, q: float | list[float], f: Frame, w) -> Column:
    """Exact, linearly interpolated; a list of ``q`` gives an array from one pass."""
    at = F.array(*[F.lit(x) for x in q]) if isinstance(q, list) else F.lit(q)
    return f.gated(F.percentile(c, at).over(f.over(w)), c, w)


def zscore(c: Column, f: Frame, w, lagged: int = 1) -> Column:
    """z of the value ``lagged`` rows back against the frame."""
    s = std(c, f, w)
    return F.when(s > 0, (F.lag(c, lagged).over(w) - mean(c, f, w)) / s)


def standardise(c: Column, f: Frame, w, ddof: int = 0) -> Column:
    """Today's value against the frame before it; NULL for a constant frame."""
    s = std(c, f, w, ddof)
    return F.when(s > 0, (c - mean(c, f, w)) / s)


def expanding(min_periods: int, shift: int = 1) -> Frame:
    return Frame(None, min_periods, shift)


def drawdown_from_high(c: Column, f: Frame, w) -> Column:
    """ln of the last value of the frame over the frame's high."""
    return F.when(F.lag(c, f.shift).over(w) > 0, F.log(F.lag(c, f.shift).over(w) / highest(c, f, w)))


def cumulative(c: Column, w) -> Column:
    return F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cumulative_max(c: Column, w) -> Column:
    return F.max(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cumulative_growth(simple: Column, w) -> Column:
    """Product of 1 + r."""
    return F.exp(F.sum(F.log1p(simple)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def forward_fill(c: Column, w, limit: int | None = None) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def average_rank(c: Column, partition: list[str], descending: bool = False) -> Column:
    """Rank with ties at their mean; NULL values have none."""
    order = c.desc() if descending else c.asc()
    has = c.isNotNull()
    keys = [*partition, has]
    r = F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, c)) - 1) / 2.0
    return F.when(has, r)


def percentile_rank(c: Column, partition: list[str]) -> Column:
    """Average rank over the number of values."""
    return average_rank(c, partition) / F.count(c).over(Window.partitionBy(*partition))


def rolling_percentile_rank(c: Column, f: Frame, w) -> Column:
    """Average rank of the current value within its frame, over the frame's number of values."""
    xs = F.collect_list(c).over(f.over(w))  # at most a frame's values
    less = F.size(F.filter(xs, lambda x: x < c))
    same = F.size(F.filter(xs, lambda x: x == c))
    return f.gated((less + (same + 1) / 2.0) / F.size(xs), c, w)


def ewma(c: Column, span: int, w, reach: int | None = None) -> Column:
    """Exponentially weighted mean of a frame (adjusted weights), NULL before ``span`` values. The frame of
    ``reach`` rows (default 12 spans) holds all but 4e-11 of the weight."""
    keep = 1 - 2.0 / (span + 1)
    reach = 12 * span if reach is None else reach
    xs = F.collect_list(c).over(w.rowsBetween(-(reach - 1), 0))
    acc = F.aggregate(xs, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n")), lambda a, x: F.struct((a["s"] * keep + x).alias("s"), (a["n"] * keep + 1).alias("n")), lambda a: a["s"] / a["n"])
    return F.when(F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) >= span, acc)


# forward frames


def forward(c: Column, h: int, w, how: str = "max", whole: bool = False) -> Column:
    """max, min, sum, avg, or std over the next ``h`` rows; ``whole``: NULL unless all ``h`` are there."""
    frame = w.rowsBetween(1, h)
    fn = {"max": F.max, "min": F.min, "sum": F.sum, "avg": F.avg, "std": F.stddev_samp}[how]
    return F.when(F.count(c).over(frame) >= (h if whole else 1), fn(c).over(frame))


def forward_any(flag: Column, h: int, w) -> Column:
    """1 if the flag is set on any of the next ``h`` rows, NULL without any value there."""
    return F.max(flag.cast("int")).over(w.rowsBetween(1, h))


def forward_drawdown(simple: Column, h: int, w) -> Column:
    """Lowest compounded value of the next ``h`` simple returns, less 1; NULL unless all are there."""
    xs = F.collect_list(simple).over(w.rowsBetween(1, h))
    low = F.aggregate(xs, F.struct(F.lit(1.0).alias("v"), F.lit(1e300).alias("low")), lambda a, x: F.struct((a["v"] * (1 + x)).alias("v"), F.least(a["low"], a["v"] * (1 + x)).alias("low")), lambda a: a["low"] - 1)
    return F.when(F.size(xs) == h, low)
