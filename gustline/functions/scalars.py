"""Scalar expressions: returns, guards, shares, vector algebra on arrays, distribution tails.

Missing values are NULL everywhere; NaN and infinities are turned into NULL where data enter (``finite``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """``c``, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def series(partition: Sequence[str] = ("universe",), order: Sequence[str] = ("d",)):
    """The one window specification that all trailing and forward frames of a series share."""
    return Window.partitionBy(*partition).orderBy(*order)


def log_return(p: Column, w) -> Column:
    """ln(p_t / p_(t-1)); NULL unless both prices are positive."""
    before = F.lag(p).over(w)
    return F.when((p > 0) & (before > 0), F.log(p / before))


def simple_return(p: Column, w) -> Column:
    before = F.lag(p).over(w)
    return F.when(before != 0, p / before - 1)


def to_simple(log_r: Column) -> Column:
    return F.expm1(log_r)


def to_log(simple_r: Column) -> Column:
    return F.when(simple_r > -1, F.log1p(simple_r))


def forward_return(p: Column, h: int, w) -> Column:
    """ln p_(t+h) - ln p_t."""
    ahead = F.lead(p, h).over(w)
    return F.when((p > 0) & (ahead > 0), F.log(ahead) - F.log(p))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds on ``c``; a NULL stays NULL."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def null_if_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def rebase(returns: Column, w, start: float = 100.0) -> Column:
    """A level from returns: ``start`` at the first return of the series that is not NULL."""
    cum = F.sum(returns).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(returns, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.exp(cum - first) * start


def one_hot(df: DataFrame, col: str, levels: Sequence, prefix: str, drop_first: bool = True) -> DataFrame:
    """Indicator columns for an explicit list of levels; the first is the reference and dropped."""
    for level in list(levels)[1 if drop_first else 0 :]:
        df = df.withColumn(f"{prefix}{level}", (F.col(col) == F.lit(level)).cast("double"))
    return df


def map_values(c: Column, mapping: dict) -> Column:
    """``mapping[c]``; NULL for what the mapping lacks."""
    out = F.lit(None)
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def strength(p: Column) -> Column:
    """-log10 of a probability, at most 300."""
    return -F.log10(F.greatest(p, F.lit(1e-300)))


# vectors as arrays of double


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def shares(a: Column) -> Column:
    """``a`` over its sum; NULL where the sum is not positive."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(a, lambda x: x / total))


def total_variation_similarity(a: Column, b: Column) -> Column:
    """1 - half the absolute difference of two compositions clipped at zero and renormalised."""
    pos = lambda v: shares(F.transform(v, lambda x: F.greatest(x, F.lit(0.0))))
    gap = F.aggregate(F.zip_with(pos(a), pos(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return 1 - gap / 2


def clr(a: Column, floor: float = 1e-6) -> Column:
    """Centred log-ratio of a composition; parts below ``floor`` count as ``floor``."""
    logs = F.transform(a, lambda x: F.log(F.greatest(x, F.lit(floor))))
    mean = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(logs)
    return F.transform(logs, lambda x: x - mean)


# tails; vectorised over Arrow batches where SQL has no function


def normal_cdf_value(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_cdf(c: Column) -> Column:
    """The normal distribution function in the JVM: the complementary error function by its series near zero and by its continued
    fraction beyond, each with as many terms as double precision asks for."""
    z = F.abs(c) / math.sqrt(2)
    near = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1.0 + s * (2.0 * z * z) / (2.0 * k + 1.0))
    upper_near = 1.0 - 2.0 / math.sqrt(math.pi) * z * F.exp(-z * z) * near
    far = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda s, k: z + (k / 2.0) / s)
    tail = F.when(z < 2.5, upper_near).otherwise(F.exp(-z * z) / math.sqrt(math.pi) / far) / 2
    return F.when(c.isNull(), F.lit(None).cast("double")).when(F.isnan(c), c).when(c > 0, 1 - tail).otherwise(tail)


def chi2_sf_even(x: Column, half_df: Column, most: int = 64) -> Column:
    """Upper tail of chi-squared with 2 * ``half_df`` degrees of freedom (up to 2 * ``most``): a finite sum."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.least(half_df, F.lit(most)).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda a, j: F.struct((a["term"] * F.when(j > 1, (x / 2) / (j - 1)).otherwise(F.lit(1.0))).alias("term"), (a["total"] + a["term"] * F.when(j > 1, (x / 2) / (j - 1)).otherwise(F.lit(1.0))).alias("total")),
        lambda a: a["total"],
    )
    return F.least(F.exp(-x / 2) * terms, F.lit(1.0))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (tiny if abs(d) < tiny else d)
    h = d
    for m in range(1, 500):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + an * d
            d = 1 / (tiny if abs(d) < tiny else d)
            c = 1 + an / c
            c = tiny if abs(c) < tiny else c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0
