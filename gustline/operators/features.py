"""Causal features, targets and labels, each one select over a shared window specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.functions import windows as W
from gustline.functions.scalars import series


def _lags(c: str, ks, w) -> dict[str, Column]:
    return {f"{c}_lag{k}": F.lag(c, k).over(w) for k in ks}


def feature_matrix(df: DataFrame, turb: str, equity: str, rates: str, credit: str | None = None, vix: str | None = None, regime: str | None = None) -> DataFrame:
    """universe, d, pos and the causal features in name order. ``equity``, ``rates``, ``credit`` and ``vix`` name
    price columns; optional blocks are left out with their column. Everything is known the row before."""
    w = series(order=("pos",))
    f = lambda n, mp: W.Frame(n, mp, 1)
    names = {"eq": equity, "rates": rates} | ({"credit": credit} if credit else {})
    df = df.select("*", *[F.when((F.col(c) > 0) & (F.lag(c).over(w) > 0), F.log(c) - F.log(F.lag(c).over(w))).alias(f"__r_{n}") for n, c in names.items()], F.log(equity).alias("__lp"), *([F.log(vix).alias("__lv")] if vix else []))
    out = {f"turb_lag{k}": F.lag(turb, k).over(w) for k in (1, 5, 21)}
    for n in (5, 21, 63):
        out[f"turb_ma{n}"] = W.mean(F.col(turb), W.trailing(n), w)
        out[f"turb_std{n}"] = W.std(F.col(turb), W.trailing(n), w)
    out["turb_zscore_252"] = W.zscore(F.col(turb), f(252, 63), w)
    eq, ra = F.col("__r_eq"), F.col("__r_rates")
    out |= {"eq_ret_lag1": F.lag("__r_eq").over(w), "eq_ret_ma5": W.total(eq, f(5, 3), w), "eq_ret_ma21": W.total(eq, f(21, 10), w), "eq_vol_21": W.std(eq, f(21, 10), w), "eq_vol_63": W.std(eq, f(63, 30), w)}
    out["eq_drawdown_63"] = F.lag("__lp").over(w) - W.highest(F.col("__lp"), f(63, 20), w)
    out |= {"rates_ret_ma21": W.total(ra, f(21, 10), w), "rates_vol_63": W.std(ra, f(63, 30), w), "eq_rates_corr_63": W.correlation(eq, ra, W.Frame(63, max(5, 63 // 2), 1), w)}
    if credit:
        out |= {"credit_ret_ma21": W.total(F.col("__r_credit"), f(21, 10), w), "eq_credit_corr_63": W.correlation(eq, F.col("__r_credit"), W.Frame(63, max(5, 63 // 2), 1), w)}
    if vix:
        out |= {"vix_log_lag1": F.lag("__lv").over(w), "vix_ma21": W.mean(F.col("__lv"), f(21, 10), w)}
    if regime:
        out |= {"regime_lag1": F.lag(regime).over(w).cast("double"), "regime_ma21": W.mean(F.col(regime), f(21, 10), w)}
    return df.select("universe", "d", "pos", *[out[n].alias(n) for n in sorted(out)])


def bucket_features(df: DataFrame, bucket: str, n: int = 5) -> DataFrame:
    """Ordinal replacement of the regime block: lag, mean (not shifted again: a bucket is known the row before)
    and indicators of the levels above the lowest."""
    w = series(order=("pos",))
    out = {"turbbucket_lag1": F.lag(bucket).over(w).cast("double"), "turbbucket_ma21": W.mean(F.col(bucket), W.Frame(21, 10, 0), w)}
    out |= {f"tb_{k}": (F.col(bucket) == k).cast("double") for k in range(1, n)}
    return df.select("universe", "d", "pos", *[c.alias(k) for k, c in sorted(out.items())])


def decomposition_features(df: DataFrame, factors: list[str], total: str = "turbulence", sizes=(21, 63)) -> DataFrame:
    """Trailing shares of each factor's contribution and their concentration, a row late."""
    w = series(order=("pos",))
    share, out = {}, {}
    for n in sizes:
        f = W.Frame(n, max(5, n // 2), 0)
        for c in factors:
            share[f"decshare_{c}_{n}"] = W.total(F.col(c), f, w) / F.when(W.total(F.col(total), f, w) != 0, W.total(F.col(total), f, w))
    df = df.select("*", *[c.alias(k) for k, c in share.items()])
    for n in sizes:
        own = [F.col(f"decshare_{c}_{n}") for c in factors]
        conc = sum((F.coalesce(x * x, F.lit(0.0)) for x in own[1:]), F.coalesce(own[0] * own[0], F.lit(0.0)))
        out[f"decconc_{n}"] = F.lag(F.when(F.coalesce(*own).isNotNull(), conc)).over(w)
        out |= {f"decshare_{c}_{n}": F.lag(f"decshare_{c}_{n}").over(w) for c in factors}
    return df.select("universe", "d", "pos", *[c.alias(k) for k, c in sorted(out.items())])


def rates_pressure(df: DataFrame, factors: list[str], rates: tuple[str, ...] = ("rates", "inflation"), out: str = "rates_pressure") -> DataFrame:
    """Share of the named factors in the positive contributions; NULL where there is none."""
    pos = lambda c: F.greatest(F.col(c), F.lit(0.0))
    whole = sum((pos(c) for c in factors[1:]), pos(factors[0]))
    own = [c for c in factors if c in rates]
    part = sum((pos(c) for c in own[1:]), pos(own[0]))
    return df.withColumn(out, F.when(whole > 0, part / whole))


def duration_trend(df: DataFrame, ret: str, window: int = 63, out: str = "duration_trend") -> DataFrame:
    return df.withColumn(out, W.total(F.col(ret), W.Frame(window, window, 0), series(order=("pos",))))


# targets


def turbulence_entry(df: DataFrame, value: str, threshold, h: int = 21, out: str = "y") -> DataFrame:
    """1 if the value reaches the threshold within the next ``h`` rows; NULL where none of them has a value.
    ``threshold``: a number or a Column."""
    top = W.forward(F.col(value), h, series(order=("pos",)), "max")
    return df.withColumn(out, (top >= threshold).cast("int"))


def gmm_features(matrix: DataFrame, labels: DataFrame, label: str, k: int) -> DataFrame:
    """The feature matrix with a mixture's regimes in place of turbulence and threshold regime: columns turb_* and regime_* go;
    gmm_regime_lag1, gmm_regime_ma21 and gmm_k_1 to gmm_k_(k-1), all of rows before, come. ``labels``: universe, d, pos and the label (0 to k - 1) of every row of the panel."""
    w = series(order=("pos",))
    c = F.col(label).cast("double")
    block = labels.select(
        "universe",
        "d",
        F.lag(c).over(w).alias("gmm_regime_lag1"),
        W.mean(c, W.Frame(21, 10, 1), w).alias("gmm_regime_ma21"),
        *[F.lag((c == j).cast("double")).over(w).alias(f"gmm_k_{j}") for j in range(1, k)],
    )
    kept = [x for x in matrix.columns if not x.startswith(("turb_", "regime_"))]
    return matrix.select(*kept).join(block, ["universe", "d"], "left")


def absorption_features(matrix: DataFrame, ratio: DataFrame, shift: DataFrame) -> DataFrame:
    """The feature matrix with absorption and absorption_shift joined on: both are made from rows before theirs. ``ratio``: universe, refit_pos,
    absorption; ``shift``: universe, pos, absorption_shift."""
    own = ratio.select("universe", F.col("refit_pos").alias("pos"), "absorption").join(shift.select("universe", "pos", "absorption_shift"), ["universe", "pos"], "left")
    return matrix.join(own, ["universe", "pos"], "left")


def event_block(matrix: DataFrame, events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The feature matrix with the event-clock columns joined on; rows that lack a column of either part go."""
    names = [*[c for c in matrix.columns if c not in ("universe", "d", "pos")], *columns]
    return matrix.join(events.select("universe", "d", *columns), ["universe", "d"], "inner").na.drop("any", subset=names)


def forward_drawdown(df: DataFrame, price: str, h: int = 21, out: str = "fdd") -> DataFrame:
    """Lowest ln price of the next ``h`` rows less today's; a partial tail counts."""
    low = W.forward(F.log(price), h, series(order=("pos",)), "min")
    return df.withColumn(out, low - F.log(price))


def correction_label(fdd: Column, loss: float = 0.05) -> Column:
    if not 0 < loss < 1:
        raise ValueError("loss is a share between 0 and 1")
    return (fdd <= -loss).cast("int")


def dev_quantile(df: DataFrame, value: str, dev_end, q: float = 0.9, out: str = "threshold") -> DataFrame:
    """universe, threshold: the quantile over rows up to ``dev_end``."""
    return df.filter(F.col("d") <= F.lit(dev_end)).groupBy("universe").agg(F.percentile(F.col(value), F.lit(q)).alias(out))


def persistence_table(df: DataFrame, value: str, horizons=(1, 5, 10, 20), q: float = 0.9) -> DataFrame:
    """Mean of the next h rows after rows in the top decile, and over all rows: universe, h, after_top, base."""
    w = series(order=("pos",))
    cut = df.groupBy("universe").agg(F.percentile(F.col(value), F.lit(q)).alias("__cut"))
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), W.forward(F.col(value), h, w, "avg", whole=True).alias("m")) for h in horizons])
    rows = df.withColumn("__a", ahead).join(cut, "universe").select("universe", (F.col(value) >= F.col("__cut")).alias("top"), F.explode("__a").alias("a"))
    return rows.groupBy("universe", F.col("a.h").alias("h")).agg(F.avg(F.when(F.col("top"), F.col("a.m"))).alias("after_top"), F.avg("a.m").alias("base"))
