"""Panels: dated factor values as long rows, wide columns, or row vectors.

A panel is keyed by (universe, d); ``pos`` numbers the rows of a universe from zero. All windows are row frames
over ``pos`` order within a universe, so universes run in parallel and none meets another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.scalars import finite, log_return, series


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(series()) - 1)


def to_wide(long: DataFrame, factors: Sequence[str], factor: str = "factor", value: str = "value") -> DataFrame:
    """One row per (universe, d), one column per factor of an explicit list; an absent value is NULL."""
    picks = [F.max(F.when(F.col(factor) == f, F.col(value))).alias(f) for f in factors]
    return long.groupBy("universe", "d").agg(*picks)


def to_long(wide: DataFrame, factors: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors])
    keys = [c for c in wide.columns if c not in factors]
    return wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.factor", "p.value")


def to_vectors(wide: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Columns universe, d, pos, x (array of double); ``x`` is NULL where any factor is."""
    ok = F.lit(True)
    for f in factors:
        ok = ok & finite(F.col(f)).isNotNull()
    return wide.select("universe", "d", "pos", F.when(ok, F.array(*[F.col(f).cast("double") for f in factors])).alias("x"))


def complete(wide: DataFrame, factors: Sequence[str], how: str = "any") -> DataFrame:
    """Rows without ('any') a NULL, or with ('all') one value at least."""
    return wide.na.drop(how, subset=list(factors))


def returns(prices: DataFrame, factors: Sequence[str], digits: int | None = None) -> DataFrame:
    """Log returns of every factor; the first row of a universe is NULL."""
    w = series()
    r = {f: log_return(finite(F.col(f)), w) for f in factors}
    return prices.select("universe", "d", "pos", *[(F.round(c, digits) if digits is not None else c).alias(f) for f, c in r.items()])


def outer_align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every key of either side."""
    return left.join(right, ["universe", "d"], "full_outer")


def inner_align(left: DataFrame, right: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Keys of both sides without a NULL."""
    return left.join(right, ["universe", "d"]).na.drop("any", subset=list(subset) if subset else None)


def on_spine(spine: DataFrame, other: DataFrame) -> DataFrame:
    return spine.join(other, ["universe", "d"], "left")


def coalesce_join(primary: DataFrame, fallbacks: Sequence[DataFrame], value: str = "value") -> DataFrame:
    """Union of all dates; the first source in order that has a value gives it."""
    out = primary.select("universe", "d", F.col(value).alias("v0"))
    for i, other in enumerate(fallbacks, 1):
        out = out.join(other.select("universe", "d", F.col(value).alias(f"v{i}")), ["universe", "d"], "full_outer")
    return out.select("universe", "d", F.coalesce(*[f"v{i}" for i in range(len(fallbacks) + 1)]).alias(value))


def asof_refit(rows: DataFrame, refits: DataFrame, step: int) -> DataFrame:
    """Each row with the latest refit at or before it, where refits happen at multiples of ``step``: an
    equi-join on the block, not a range join."""
    return rows.withColumn("refit_pos", F.col("pos") - F.col("pos") % step).join(refits, ["universe", "refit_pos"], "left")


def asof_last(rows: DataFrame, history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row with the last earlier or equal state of an irregular history: one union, one sort, no range join."""
    tagged = rows.withColumn("__own", F.lit(1)).unionByName(history.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("universe").orderBy("d", "__own").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("__own") == 0, F.struct(*columns)), ignorenulls=True).over(w)
    out = tagged.withColumn("__s", state).filter("__own = 1")
    return out.select(*[c for c in rows.columns if c not in columns], *[F.col(f"__s.{c}").alias(c) for c in columns])


def grid_join(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows times a small table of parameters (broadcast: the caller makes the grid)."""
    return rows.crossJoin(F.broadcast(grid))


def ordered_pairs(names: DataFrame, column: str = "factor") -> DataFrame:
    """Ordered pairs of different names; names are the columns of a panel, so few."""
    a, b = names.select(F.col(column).alias("causing")), names.select(F.col(column).alias("caused"))
    return a.join(F.broadcast(b), F.col("causing") != F.col("caused"))


def windows_exploded(rows: DataFrame, refits: DataFrame, block: int) -> DataFrame:
    """Rows inside each refit's window [lo, hi): an equi-join on row blocks, then a filter."""
    wanted = refits.withColumn("b", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    return rows.withColumn("b", F.expr(f"pos div {block}")).join(wanted, ["universe", "b"]).filter("pos >= lo and pos < hi").drop("b")


# the driver's tables as panels


def flag_weeks(lineitem: DataFrame, supplier: DataFrame | None = None, nation: DataFrame | None = None, region: DataFrame | None = None, flags: Sequence[str] = ("A", "N", "R"), digits: int = 9, unit: str = "week", universe: Column | None = None) -> DataFrame:
    """Mean extended price by return flag and ``unit`` of time, per supplier region if the dimension tables are given, or per ``universe``
    (an expression over lineitem): columns universe, d, pos and one per flag; weeks that lack a flag are left out."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = lineitem.select("l_suppkey", "l_returnflag", F.trunc("l_shipdate", unit).alias("d"), cents.alias("cents"), *([universe.alias("universe")] if universe is not None else []))
    if universe is not None:
        pass
    elif supplier is None:
        rows = rows.withColumn("universe", F.lit("all"))
    else:
        where = supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"]).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = rows.join(where.select("s_suppkey", F.col("r_name").alias("universe")), F.col("l_suppkey") == F.col("s_suppkey"))
    picks = []
    for f in flags:
        own = F.when(F.col("l_returnflag") == f, F.col("cents"))
        picks.append((F.sum(own) / F.count(own) / 100.0).alias(f))
    wide = rows.groupBy("universe", "d").agg(*picks)
    return numbered(complete(wide, flags))


def event_hours(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """Hourly mean event value by event type; hours that lack a type are left out."""
    rows = events.select(F.lit("all").alias("universe"), F.date_trunc("hour", "ts").alias("d"), "event_type", F.round(F.col("value") * 10000).cast("long").alias("v"))
    picks = []
    for t in types:
        own = F.when(F.col("event_type") == t, F.col("v"))
        picks.append((F.sum(own) / F.count(own) / 10000.0).alias(t))
    return numbered(complete(rows.groupBy("universe", "d").agg(*picks), types))
