"""Regime labels, smoothing and the other sequential operators, as windows over gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import windows as W
from gustline.functions.scalars import series


def threshold_regime(df: DataFrame, value: str, q: float = 0.75, window: int = 2520, min_periods: int = 504, out: str = "regime", digits: int | None = None) -> DataFrame:
    """1 where today's value exceeds the quantile of the ``window`` values before it, else 0; NULL in warm-up.
    ``digits`` rounds both sides before they are compared."""
    w = series()
    cut = W.quantile(F.col(value), q, W.Frame(window, min_periods, 1), w)
    fix = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return df.withColumn(out, (fix(F.col(value)) > fix(cut)).cast("int"))


def ordinal_bucket(df: DataFrame, value: str, n: int = 5, window: int = 2520, min_periods: int = 504, out: str = "bucket", digits: int | None = None) -> DataFrame:
    """How many of the trailing quantiles 1/n .. (n-1)/n yesterday's value exceeds; the frame ends yesterday too."""
    w = series()
    qs = W.quantile(F.col(value), [k / n for k in range(1, n)], W.Frame(window, min_periods, 1), w)
    fix = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    y = fix(F.lag(value).over(w))
    above = F.aggregate(qs, F.lit(0), lambda s, q: s + (y > fix(q)).cast("int"))
    return df.withColumn(out, F.when(y.isNotNull() & qs.isNotNull(), above))


def runs(df: DataFrame, label: Column, out: str = "run", order: str = "pos") -> DataFrame:
    """Numbers the runs of equal consecutive labels (NULL is a label of its own)."""
    w = Window.partitionBy("universe").orderBy(order)
    change = F.when(label.eqNullSafe(F.lag(label).over(w)), 0).otherwise(1)
    return df.withColumn(out, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def smooth_min_duration(df: DataFrame, label: str, m: int, out: str = "smoothed") -> DataFrame:
    """A new label is accepted once ``m`` consecutive rows show it; the first label at once. NULL stays NULL,
    breaks a run and keeps the accepted label."""
    w = Window.partitionBy("universe").orderBy("pos")
    x = F.col(label)
    df = runs(df, x, "__run")
    in_run = Window.partitionBy("universe", "__run").orderBy("pos")
    df = df.withColumn("__k", F.row_number().over(in_run))
    first = F.row_number().over(Window.partitionBy("universe", x.isNull()).orderBy("pos")) == 1
    accepted = F.when(x.isNotNull() & ((F.col("__k") >= m) | first), x)
    held = F.last(accepted, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(x.isNotNull(), held)).drop("__run", "__k")


def weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays in [a, b), for a <= b."""

    def before(c: Column) -> Column:  # weekdays from a fixed Monday up to the date, exclusive
        days = F.datediff(c, F.lit("1900-01-01").cast("date"))
        return F.floor(days / 7) * 5 + F.least(days % 7, F.lit(5))

    return before(b) - before(a)


def gap_groups(df: DataFrame, gap: Column, most: int, out: str = "grp") -> DataFrame:
    """Numbers the groups of rows whose gap to the row before is at most ``most``."""
    w = Window.partitionBy("universe").orderBy("d")
    return df.withColumn("__new", F.when(gap <= most, 0).otherwise(1)).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def hot_days(df: DataFrame, value: str, q: float = 0.9, window: int = 2520, min_periods: int = 504, digits: int | None = None) -> DataFrame:
    """Rows where yesterday's value exceeds the trailing quantile up to yesterday (``hot``)."""
    w = series()
    fix = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    cut = W.quantile(F.col(value), q, W.Frame(window, min_periods, 1), w)
    return df.withColumn("hot", F.coalesce(fix(F.lag(value).over(w)) > fix(cut), F.lit(False)))


def episodes(df: DataFrame, value: str, q: float = 0.9, window: int = 2520, min_periods: int = 504, min_len: int = 5, max_gap: int = 5, digits: int | None = None) -> DataFrame:
    """universe, start, end, n_days, peak_turb, mean_turb: hot days with at most ``max_gap`` weekdays between
    merge; spans of fewer than ``min_len`` days with a value are dropped. All days of a span count."""
    flagged = hot_days(df.select("universe", "d", value), value, q, window, min_periods, digits)
    w = series()
    hot = flagged.filter("hot").select("universe", "d")
    grouped = gap_groups(hot.withColumn("__gap", weekdays_between(F.lag("d").over(w), F.col("d"))), F.col("__gap"), max_gap)
    spans = grouped.groupBy("universe", "grp").agg(F.min("d").alias("start"), F.max("d").alias("end"))
    # days between hot days belong to the span: carry the span's end forward instead of a range join
    marks = spans.select("universe", F.col("start").alias("d"), F.col("start"), F.col("end"))
    tagged = flagged.select("universe", "d", F.col(value).alias("v")).join(marks, ["universe", "d"], "left")
    last = F.last(F.when(F.col("start").isNotNull(), F.struct("start", "end")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = tagged.withColumn("s", last).filter("d <= s.end and v is not null")
    out = inside.groupBy("universe", F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(F.count("*").cast("int").alias("n_days"), F.max("v").alias("peak_turb"), F.avg("v").alias("mean_turb"))
    return out.filter(F.col("n_days") >= min_len)


def calendar_runs(df: DataFrame, flag: Column, max_gap: int, min_len: int) -> DataFrame:
    """Runs of flagged rows at most ``max_gap`` calendar days apart: universe, start, end, n."""
    w = series()
    rows = df.filter(flag).select("universe", "d")
    g = gap_groups(rows.withColumn("__gap", F.datediff("d", F.lag("d").over(w))), F.col("__gap"), max_gap)
    return g.groupBy("universe", "grp").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.count("*").alias("n")).filter(F.col("n") >= min_len).drop("grp")


def clusters(starts: DataFrame, max_gap_days: int = 90) -> DataFrame:
    """Episodes whose starts are at most so many days apart share a cluster: column ``cluster``."""
    w = Window.partitionBy("universe").orderBy("start")
    rows = starts.withColumn("d", F.col("start")).withColumn("__gap", F.datediff("start", F.lag("start").over(w)))
    return gap_groups(rows, F.col("__gap"), max_gap_days, "cluster").drop("d", "__gap")


def independent_count(df: DataFrame, flag: Column, gap_days: int = 21) -> DataFrame:
    """Flagged rows more than ``gap_days`` after the last counted neighbour open a new event: universe, n."""
    return calendar_runs(df, flag, gap_days, 1).groupBy("universe").agg(F.count("*").alias("n"))


def hysteresis(df: DataFrame, p: str, tau: float, back: float, out: str = "pos_flag") -> DataFrame:
    """In the market (1) until p >= tau; back in once p < ``back`` (below tau)."""
    w = Window.partitionBy("universe").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col(p) >= tau, 0).when(F.col(p) < back, 1)
    return df.withColumn(out, F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(1)))


def capped_spell(df: DataFrame, p: str, tau: float, cap: int = 21, out: str = "pos_flag") -> DataFrame:
    """Out of the market while p >= tau, but after ``cap`` rows out one row in is forced."""
    hot = F.coalesce(F.col(p) >= tau, F.lit(False))
    df = runs(df, hot, "__run")
    k = F.row_number().over(Window.partitionBy("universe", "__run").orderBy("pos"))
    return df.withColumn(out, F.when(~hot, 1).otherwise((k % (cap + 1) == 0).cast("int"))).drop("__run")


def switching_cost(label: Column, w, bps: float) -> Column:
    """Cost of a change of label since the row before; the first row is free."""
    before = F.lag(label).over(w)
    return F.when(F.row_number().over(w) == 1, 0.0).when(label.eqNullSafe(before), 0.0).otherwise(bps / 1e4)


def shading(df: DataFrame, flag: str) -> DataFrame:
    """Intervals in which a 0/1 series is 1: universe, start, end."""
    g = runs(df, F.col(flag), "__run").filter(F.col(flag) == 1)
    return g.groupBy("universe", "__run").agg(F.min("d").alias("start"), F.max("d").alias("end")).drop("__run")
