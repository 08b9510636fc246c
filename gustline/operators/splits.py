"""Time splits: development and out-of-sample, purged folds, refit and cut-off calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dev_oos(df: DataFrame, dev_end: str, oos_start: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows up to ``dev_end``, and rows from ``oos_start`` (the day after by default)."""
    after = F.lit(oos_start).cast("date") if oos_start else F.date_add(F.lit(dev_end).cast("date"), 1)
    return df.filter(F.col("d") <= F.lit(dev_end).cast("date")), df.filter(F.col("d") >= after)


def guard(df: DataFrame, cutoff: str) -> None:
    """Raises if a row lies after the cut-off."""
    last = df.agg(F.max("d")).first()[0]
    if last is not None and str(last)[:10] > cutoff:
        raise ValueError(f"rows up to {last} lie after {cutoff}")


def purged_folds(sizes: DataFrame, k: int = 5, horizon: int = 21, embargo: int = 21, min_train: int = 252) -> DataFrame:
    """Fold table from (universe, n): train rows [0, train_hi), test rows [test_lo, test_hi). The last fold takes
    what is left over; folds with too few training rows are left out."""
    fold = F.expr(f"n div {k + 1}")
    rows = sizes.select("universe", "n", fold.alias("size"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    lo = F.col("fold") * F.col("size")
    hi = F.when(F.col("fold") == k, F.col("n")).otherwise(lo + F.col("size"))
    out = rows.select("universe", "fold", (lo - horizon - embargo).alias("train_hi"), lo.alias("test_lo"), hi.alias("test_hi"))
    return out.filter((F.col("train_hi") >= min_train) & (F.col("test_hi") > F.col("test_lo")))


def in_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold with ``part`` train or test; folds are few, so they are broadcast."""
    part = F.when(F.col("pos") < F.col("train_hi"), "train").when((F.col("pos") >= F.col("test_lo")) & (F.col("pos") < F.col("test_hi")), "test")
    return df.join(folds, "universe").withColumn("part", part).filter("part is not null").drop("train_hi", "test_lo", "test_hi")


def quarter_ends(spark: SparkSession, dev_end: str, oos_start: str, end: str) -> DataFrame:
    """asof: dev_end and every quarter end from ``oos_start`` to ``end``."""
    first = f"last_day(add_months(trunc(date'{oos_start}', 'quarter'), 2))"
    return spark.sql(f"select date'{dev_end}' as asof union select asof from (select explode(transform(sequence(0, 400), i -> last_day(add_months({first}, 3 * i)))) as asof) where asof between date'{oos_start}' and date'{end}'").orderBy("asof")


def month_ends(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.sql(f"select cutoff from (select last_day(m) as cutoff from (select explode(sequence(trunc(date'{start}', 'month'), date'{end}', interval 1 month)) as m)) where cutoff between date'{start}' and date'{end}'")


def rolling_windows(spark: SparkSession, start: str, end: str, years: int = 5, stride: int = 1) -> DataFrame:
    """lo, hi of windows of ``years`` times 365 days, ``stride`` years apart."""
    return spark.sql(f"select lo, date_add(lo, {365 * years}) as hi from (select explode(transform(sequence(0, 200), i -> date_add(date'{start}', i * {365 * stride}))) as lo) where date_add(lo, {365 * years}) <= date'{end}'")


def train_rows(df: DataFrame, refits: DataFrame, purge: int, calendar_compat: bool = False) -> DataFrame:
    """Rows usable for a fit as of each refit date. The purge counts rows, so that no label horizon reaches past
    the refit; ``calendar_compat`` counts calendar days instead."""
    if calendar_compat:
        return df.join(F.broadcast(refits), F.col("d") < F.date_sub("asof", purge))
    last = df.join(F.broadcast(refits), F.col("d") <= F.col("asof")).groupBy("universe", "asof").agg(F.max("pos").alias("__last"))
    return df.join(last, "universe").filter(F.col("pos") <= F.col("__last") - purge).drop("__last")
