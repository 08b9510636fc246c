"""Registered queries: each operator applied to panels of the star-schema tables, and SQL stating the same rows.

The panel is the weekly mean extended price by return flag in each supplier region (universe = region), with log
returns xa, xn, xr and a non-negative intensity v. Floating results are rounded on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.functions import windows as W
from gustline.operators import causality, eventclock, features, inference, learning, metrics, regimes, relevance, splits, typology, walkforward
from gustline.plans import panel
from gustline.sources import io
from gustline.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

X = ["xa", "xn", "xr"]
TEXT_KEYS = {"universe", "name", "event", "op", "factor", "causing", "caused", "perm", "kind", "scope", "model", "label", "variable"}
DEV_END = "1999-12-31"


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return io.read_parquet(spark, f"{sf}/{name}.parquet")


def prices(spark: SparkSession, sf: str, by_region: bool = True) -> DataFrame:
    dims = [load(spark, sf, t) for t in ("supplier", "nation", "region")] if by_region else []
    return panel.flag_weeks(load(spark, sf, "lineitem"), *dims).withColumnsRenamed({"A": "fa", "N": "fn", "R": "fr"})


def prices_by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    """The panel that grows with the tables: a universe is a supplier, a row a month."""
    own = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return panel.flag_weeks(load(spark, sf, "lineitem"), unit="month", universe=own).withColumnsRenamed({"A": "fa", "N": "fn", "R": "fr"})


def base(spark: SparkSession, sf: str, by_region: bool = True, by_supplier: bool = False) -> DataFrame:
    """universe, d, pos, fa, fn, fr, xa, xn, xr, v."""
    w = S.series()
    p = prices_by_supplier(spark, sf) if by_supplier else prices(spark, sf, by_region)
    p = p.select("*", *[F.round(S.log_return(F.col("f" + c), w), 12).alias("x" + c) for c in "anr"])
    return p.withColumn("v", F.round(F.col("xa") * F.col("xa") + F.col("xn") * F.col("xn") + F.col("xr") * F.col("xr"), 12))


def vectors(b: DataFrame) -> DataFrame:
    return panel.to_vectors(b, X)


def forecasts(b: DataFrame) -> DataFrame:
    """y: intensity of 0.3 or more within four weeks; p from last week's intensity."""
    w = S.series()
    y = (W.forward(F.col("v"), 4, w, "max") >= 0.3).cast("int")
    p = F.round(F.lag("v").over(w) / (1 + F.lag("v").over(w)), 6)
    return b.select("universe", "d", "pos", "xa", "xn", "v", y.alias("y"), p.alias("p"))


def _base_sql(region: bool | str) -> str:
    u, unit = ("'s' || l_suppkey", "month") if region == "supplier" else ("r_name" if region else "'all'", "week")
    dims = " join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey" if region is True else ""
    pick = ", ".join(f"sum(case when l_returnflag = '{c.upper()}' then cents end) / count(case when l_returnflag = '{c.upper()}' then cents end) / 100.0 as f{c}" for c in "anr")
    ret = ", ".join(f"round(ln(f{c} / lag(f{c}) over w), 12) as x{c}" for c in "anr")
    return f"""px as (select {u} as universe, cast(date_trunc('{unit}', l_shipdate) as date) as d, {pick}
 from (select *, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem){dims} group by 1, 2),
p as (select *, row_number() over (partition by universe order by d) - 1 as pos from px where fa is not null and fn is not null and fr is not null),
b as (select *, round(xa * xa + xn * xn + xr * xr, 12) as v from (select *, {ret} from p window w as (partition by universe order by d)) t)"""


FC = """fc as (select *, case when t is null then null when t >= 0.3 then 1 else 0 end as y from (select universe, d, pos, xa, xn, v,
 max(v) over (partition by universe order by d rows between 1 following and 4 following) as t,
 round(lag(v) over w / (1 + lag(v) over w), 6) as p from b window w as (partition by universe order by d)) t0)"""


def add(name: str, fn, sql: str | None = None, keys: str = "universe,d", ints: str = "", doubles: str = "", digits: int = 6, ctes: str = "", region: bool | str = True, recursive: bool = False) -> None:
    """``fn`` gives a DataFrame with the named columns and ``sql`` a select with the same; keys are returned as
    they are, ints as bigint, doubles rounded."""
    ks, ns, ds = ([c for c in x.replace(" ", "").split(",") if c] for x in (keys, ints, doubles))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = fn(spark, sf)
        text = [F.date_format(k, "yyyy-MM-dd").alias(k) if k not in TEXT_KEYS else F.col(k) for k in ks]
        return df.select(*text, *[F.col(c).cast("long").alias(c) for c in ns], *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in ds])

    QUERIES[name] = run
    if sql is not None:
        out = ", ".join([*[k if k in TEXT_KEYS else f"strftime({k}, '%Y-%m-%d') as {k}" for k in ks], *[f"cast({c} as bigint) as {c}" for c in ns], *[f"round(cast({c} as double), {digits}) + 0.0 as {c}" for c in ds]])
        ORACLES[name] = f"with {'recursive ' if recursive else ''}{_base_sql(region)}{', ' + ctes if ctes else ''}, q as ({sql}) select {out} from q"


def on_base(f):
    return lambda spark, sf: f(base(spark, sf))


def on_suppliers(f):
    return lambda spark, sf: f(base(spark, sf, by_supplier=True))


def each_universe(f):
    """``f(own, others)`` of the panel of every universe and of the rows of all others, with the universe on its rows;
    for operators of one series or one training matrix."""

    def run(spark, sf):
        b = base(spark, sf)
        names = sorted(r[0] for r in b.select("universe").distinct().collect())
        parts = [f(b.filter(F.col("universe") == u), b.filter(F.col("universe") != u)).withColumn("universe", F.lit(u)) for u in names]
        return functools.reduce(DataFrame.unionByName, parts)

    return run


O = "over (partition by universe order by d"  # noqa: E741

# --- projections and filters ----------------------------------------------------------------------------------------


def _prj(b):
    w = S.series()
    return b.select("universe", "d", S.log_return(F.col("fa"), w).alias("log_r"), S.simple_return(F.col("fa"), w).alias("simple_r"), S.to_log(S.simple_return(F.col("fa"), w)).alias("back"), S.forward_return(F.col("fa"), 4, w).alias("ahead"), S.clip(F.col("xa"), -0.1, 0.1).alias("clipped"), S.null_if_zero(F.col("xa")).alias("nonzero"), S.rebase(F.col("xa"), w).alias("level"), S.strength(F.col("v") / 100).alias("strength"))


add("prj01_returns_and_guards", on_base(_prj), f"""select universe, d, ln(fa / lag(fa) {O})) as log_r, fa / lag(fa) {O}) - 1 as simple_r, ln(fa / lag(fa) {O})) as back,
 ln(lead(fa, 4) {O}) / fa) as ahead, case when xa is not null then greatest(least(xa, 0.1), -0.1) end as clipped, nullif(xa, 0) as nonzero,
 exp(sum(xa) {O} rows unbounded preceding) - first_value(xa ignore nulls) {O} rows unbounded preceding)) * 100 as level, -log10(greatest(v / 100, 1e-300)) as strength from b""", doubles="log_r,simple_r,back,ahead,clipped,nonzero,level,strength")


def _prj7(b):
    q = b.withColumn("season", F.quarter("d"))
    q = S.one_hot(q, "season", [1, 2, 3, 4], "q")
    return q.withColumn("name", S.map_values(F.col("season"), {1: "cold", 2: "mild", 3: "hot", 4: "wet"}))


add("prj07_one_hot_and_map", on_base(_prj7), "select universe, d, (quarter(d) = 2)::int as q2, (quarter(d) = 3)::int as q3, (quarter(d) = 4)::int as q4, case quarter(d) when 1 then 'cold' when 2 then 'mild' when 3 then 'hot' else 'wet' end as name from b", keys="universe,d,name", doubles="q2,q3,q4")


def _prj10(b):
    a, c = F.array("fa", "fn", "fr"), F.array("xa", "xn", "xr")
    b = b.filter("xa is not null")
    return b.select("universe", "d", S.dot(a, c).alias("dot"), S.norm(c).alias("norm"), S.cosine(a, c).alias("cosine"), S.shares(a)[0].alias("share"), S.total_variation_similarity(a, F.reverse(a)).alias("tv"), S.clr(a)[0].alias("clr"))


add("prj10_vectors", on_base(_prj10), """select universe, d, fa * xa + fn * xn + fr * xr as dot, sqrt(xa * xa + xn * xn + xr * xr) as norm,
 (fa * xa + fn * xn + fr * xr) / (sqrt(xa * xa + xn * xn + xr * xr) * sqrt(fa * fa + fn * fn + fr * fr)) as cosine, fa / (fa + fn + fr) as share,
 1 - (abs(fa - fr) + abs(fr - fa)) / (fa + fn + fr) / 2 as tv, ln(fa / (fa + fn + fr)) - (ln(fa / (fa + fn + fr)) + ln(fn / (fa + fn + fr)) + ln(fr / (fa + fn + fr))) / 3 as clr from b where xa is not null""", doubles="dot,norm,cosine,share,tv,clr")


def _prj10b(b):
    a = F.array("fa", "fn", "fr")
    return b.select("universe", "d", S.clr(S.shares(a))[1].alias("clr_n"))


add("prj10_log_ratio", on_base(_prj10b), "select universe, d, ln(fn) - (ln(fa) + ln(fn) + ln(fr)) / 3 as clr_n from b", doubles="clr_n")
add("flt01_complete_rows", on_base(lambda b: panel.complete(b, ["xa", "xn"], "any").groupBy("universe").agg(F.count("*").alias("n"))), "select universe, count(*) as n from b where xa is not null and xn is not null group by 1", keys="universe", ints="n")
add("flt02_date_slice", on_base(lambda b: b.filter(F.col("d").between("1998-01-05", "1998-12-28"))), "select * from b where d between date '1998-01-05' and date '1998-12-28'", ints="pos", doubles="v")


def _named(spark):
    return spark.sql("select * from values ('early', 0, date'1996-01-01', date'1996-12-31'), ('mid', 1, date'1996-10-01', date'1999-03-31'), ('late', 2, date'2000-01-01', date'2001-06-30') as t(name, ord, start, end)")


NAMED = "nm(name, ord, start_, end_) as (values ('early', 0, date '1996-01-01', date '1996-12-31'), ('mid', 1, date '1996-10-01', date '1999-03-31'), ('late', 2, date '2000-01-01', date '2001-06-30'))"
EPI = f"""hot as (select universe, d, v, coalesce(round(lag(v) {O}), 9) > round(case when count(v) {O} rows between 104 preceding and 1 preceding) >= 26 then quantile_cont(v, 0.8) {O} rows between 104 preceding and 1 preceding) end, 9), false) as hot from b),
hd as (select universe, d, case when d - lag(d) {O}) <= 14 then 0 else 1 end as fresh from hot where hot),
hg as (select *, sum(fresh) {O} rows unbounded preceding) as grp from hd), sp as (select universe, grp, min(d) as start_, max(d) as end_ from hg group by 1, 2),
ep as (select s.universe, s.start_, s.end_, count(*) as n_days, max(v) as peak_turb, avg(v) as mean_turb from sp s join b on b.universe = s.universe and b.d between s.start_ and s.end_ and b.v is not null group by 1, 2, 3 having count(*) >= 2)"""


def _episodes(b):  # weekly rows: gaps of up to ten weekdays join
    return regimes.episodes(b, "v", 0.8, 104, 26, 2, 10, 9)


add("flt03_named_windows", lambda spark, sf: typology.annotate(_episodes(base(spark, sf)), _named(spark)).withColumnRenamed("start", "start_d"), "select e.universe, e.start_ as start_d, arg_min(name, ord) as event from ep e left join nm on e.start_ <= nm.end_ and e.end_ >= nm.start_ group by 1, 2, e.end_", keys="universe,start_d,event", ctes=EPI + ", " + NAMED)
add("flt04_membership", on_base(lambda b: b.join(typology.at_starts(b.select("universe", "d"), _episodes(b)), ["universe", "d"], "left_semi")), "select b.* from b where exists (select 1 from ep where ep.universe = b.universe and ep.start_ = b.d)", ints="pos", doubles="v", ctes=EPI)

add("prj03_simple_returns", on_base(lambda b: b.select("universe", "d", S.to_simple(F.col("xa")).alias("simple"), S.to_log(S.to_simple(F.col("xa"))).alias("back"))), "select universe, d, exp(xa) - 1 as simple, xa as back from b", doubles="simple,back")
add("flt01_any_value", on_base(lambda b: panel.complete(b.withColumn("hot", F.when(F.col("v") > 0.3, F.col("v"))).withColumn("up", F.when(F.col("xa") > 0, F.col("xa"))), ["hot", "up"], "all").groupBy("universe").agg(F.count("*").alias("n"))), "select universe, count(*) as n from b where v > 0.3 or xa > 0 group by 1", keys="universe", ints="n")
QUERIES["src02_pruned_read"] = lambda spark, sf: io.read_any(spark, f"{sf}/lineitem.parquet", ["l_returnflag", "l_quantity"]).groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count("*").alias("n"))
ORACLES["src02_pruned_read"] = "select l_returnflag, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, count(*) as n from lineitem group by 1"

# --- joins and sets -------------------------------------------------------------------------------------------------


def _sources(b):
    return b.filter("v > 0.2").select("universe", "d", F.col("xa").alias("l")), b.filter("xa > 0").select("universe", "d", F.col("xn").alias("r"))


# two sources that differ by content, over all rows
HS = "l as (select universe, d, xa as l from b where v > 0.2), r as (select universe, d, xn as r from b where xa > 0)"
add("jn01_inner_align", on_base(lambda b: panel.inner_align(*_sources(b))), "select l.universe, l.d, l, r from l join r on l.universe = r.universe and l.d = r.d where l is not null and r is not null", doubles="l,r", ctes=HS)
add("jn03_outer_align", on_base(lambda b: panel.outer_align(*_sources(b))), "select coalesce(l.universe, r.universe) as universe, coalesce(l.d, r.d) as d, l, r from l full join r on l.universe = r.universe and l.d = r.d", doubles="l,r", ctes=HS)
add("jn04_left_on_spine", on_base(lambda b: panel.on_spine(b.select("universe", "d"), _sources(b)[1])), "select b.universe, b.d, r from b left join r on b.universe = r.universe and b.d = r.d", doubles="r", ctes=HS)
add("jn05_coalesce_sources", on_base(lambda b: panel.coalesce_join(_sources(b)[0].withColumnRenamed("l", "value"), [_sources(b)[1].withColumnRenamed("r", "value")])), "select coalesce(l.universe, r.universe) as universe, coalesce(l.d, r.d) as d, coalesce(l, r) as value from l full join r on l.universe = r.universe and l.d = r.d", doubles="value", ctes=HS)


def _asof(b):
    fits = b.filter("pos % 21 = 0").select("universe", F.col("pos").alias("refit_pos"), F.col("fa").alias("fitted"))
    return panel.asof_refit(b, fits, 21)


add("jn06_asof_refit", on_base(_asof), "select b.universe, b.d, f.pos as refit_pos, f.fa as fitted from b asof join (select * from b where pos % 21 = 0) f on b.universe = f.universe and b.pos >= f.pos", ints="refit_pos", doubles="fitted")
add("jn06_asof_irregular", on_base(lambda b: panel.asof_last(b.select("universe", "d", "pos"), b.filter("v > 0.3").select("universe", "d", F.col("v").alias("state")), ["state"])), f"select universe, d, last_value(case when v > 0.3 then v end ignore nulls) {O} rows unbounded preceding) as state from b", doubles="state")
add("jn07_first_crossing", on_base(lambda b: eventclock.first_crossing(b.select("universe", "d", "pos", "v"), "v", 1.0)), "select c.universe, c.d, (select min(e.pos) from c e where e.universe = c.universe and e.cum >= c.cum + 1.0) as cross_pos from c", ints="cross_pos", ctes=f"c as (select universe, d, pos, sum(coalesce(v, 0)) {O} rows unbounded preceding) as cum from b)")
add("jn08_grid", lambda spark, sf: panel.grid_join(base(spark, sf), spark.createDataFrame([(0.1,), (0.3,), (1.0,)], "tau double")).groupBy("universe", "tau").agg(F.count_if(F.col("v") >= F.col("tau")).alias("n")), "select universe, tau, count(*) filter (v >= tau) as n from b, (values (0.1::double), (0.3), (1.0)) t(tau) group by 1, 2", keys="universe", doubles="tau", ints="n")


def _exploded(b):
    fits = walkforward.refit_table(vectors(b), 104, 26)
    return panel.windows_exploded(b.select("universe", "pos", "xa"), fits, 64).groupBy("universe", "refit_pos").agg(F.count("xa").alias("n"), F.avg("xa").alias("mean"))


add("jn09_refit_windows", on_base(_exploded), "select f.universe, f.pos as refit_pos, count(b.xa) as n, avg(b.xa) as mean from b f join b on b.universe = f.universe and b.pos >= greatest(0, f.pos - 104) and b.pos < f.pos where f.pos % 26 = 0 and f.pos >= 1 group by 1, 2", keys="universe", ints="refit_pos,n", doubles="mean")
add("jn10_ordered_pairs", lambda spark, sf: panel.ordered_pairs(panel.to_long(base(spark, sf), X).select("factor").distinct()), "select a.f as causing, c.f as caused from (values ('xa'), ('xn'), ('xr')) a(f), (values ('xa'), ('xn'), ('xr')) c(f) where a.f <> c.f", keys="causing,caused")


def _sets(b):
    a, c = b.filter("v > 0.2").select("universe", "d"), b.filter("xa > 0").select("universe", "d")
    tag = lambda df, s: df.withColumn("op", F.lit(s))
    return tag(a.union(c).groupBy("universe", "d").agg(F.count("*").alias("k")).select("universe", "d"), "union").unionByName(tag(a.intersect(c), "intersect")).unionByName(tag(a.exceptAll(c), "except"))


add("set01_union_intersect_except", on_base(_sets), "select universe, d, 'union' as op from (select universe, d from s1 union select universe, d from s2) union all select universe, d, 'intersect' from (select * from s1 intersect select * from s2) union all select universe, d, 'except' from (select * from s1 except select * from s2)", keys="universe,d,op", ctes="s1 as (select universe, d from b where v > 0.2), s2 as (select universe, d from b where xa > 0)")

# --- aggregates -----------------------------------------------------------------------------------------------------

add("agg01_describe", on_base(lambda b: metrics.describe(b, ["universe"], "xa", (0.25, 0.5, 0.9))), "select universe, count(xa) as n, avg(xa) as mean, stddev_samp(xa) as std, min(xa) as min, max(xa) as max, quantile_cont(xa, 0.25) as q25, quantile_cont(xa, 0.5) as q50, quantile_cont(xa, 0.9) as q90 from b group by 1", keys="universe", ints="n", doubles="mean,std,min,max,q25,q50,q90")
add("agg02_by_year", on_base(lambda b: metrics.by_year(b, "v")), "select universe, year(d) as year, avg(v) as mean, count(v) as n from b group by 1, 2", keys="universe", ints="year,n", doubles="mean")
add("agg03_monthly_shares", on_base(lambda b: metrics.monthly_shares(b, ["fa", "fn", "fr"])), "select universe, last_day(d) as month, avg(fa) / (avg(fa) + avg(fn) + avg(fr)) as fa, avg(fn) / (avg(fa) + avg(fn) + avg(fr)) as fn, avg(fr) / (avg(fa) + avg(fn) + avg(fr)) as fr from b group by 1, 2", keys="universe,month", doubles="fa,fn,fr")
add("agg06_moments", on_base(lambda b: metrics.moments(b, ["universe"], "xa")), "select universe, n, skew, kurt, n / 6.0 * (skew ** 2 + kurt ** 2 / 4) as jarque_bera from (select universe, count(*) as n, avg((xa - m) ** 3) / avg((xa - m) ** 2) ** 1.5 as skew, avg((xa - m) ** 4) / avg((xa - m) ** 2) ** 2 - 3 as kurt from (select *, avg(xa) over (partition by universe) as m from b where xa is not null) t group by 1) u", keys="universe", ints="n", doubles="skew,kurt,jarque_bera", digits=5)
add("agg06_kl_to_normal", on_base(lambda b: metrics.kl_to_normal(b, ["universe"], "xa")), None, keys="universe", doubles="kl")
add("agg07_correlations", on_base(lambda b: metrics.correlations(b, ["universe"], "xa", "xn")), "select universe, corr(xa, xn) as pearson, corr(ra, rn) as spearman from (select *, rank() over (partition by universe order by xa) + (count(*) over (partition by universe, xa) - 1) / 2.0 as ra, rank() over (partition by universe order by xn) + (count(*) over (partition by universe, xn) - 1) / 2.0 as rn from b where xa is not null and xn is not null) t group by 1", keys="universe", doubles="pearson,spearman")
add("agg07_kendall", on_base(lambda b: metrics.kendall(b, ["universe"], "pos", "xa", "xn")), "select x.universe, sum(sign(x.xa - y.xa) * sign(x.xn - y.xn)) / sqrt(sum(abs(sign(x.xa - y.xa))) * sum(abs(sign(x.xn - y.xn)))) as tau from b x join b y on x.universe = y.universe and x.pos < y.pos group by 1", keys="universe", doubles="tau")
add("agg08_confusion", on_base(lambda b: metrics.confusion(forecasts(b), ["universe"], cut=0.2)), "select universe, count(*) filter (p >= 0.2 and y = 1) as tp, count(*) filter (p >= 0.2 and y = 0) as fp, count(*) filter (p < 0.2 and y = 1) as fn, count(*) filter (p < 0.2 and y = 0) as tn from fc where y is not null and p is not null group by 1", keys="universe", ints="tp,fp,fn,tn", ctes=FC)
add("agg08_top_decile", on_base(lambda b: metrics.top_decile(forecasts(b), ["universe"])), "select f.universe, t.threshold, count(*) filter (p >= threshold and y = 1) as tp, count(*) filter (p >= threshold and y = 0) as fp, count(*) filter (p < threshold and y = 1) as fn from fc f join (select universe, quantile_cont(p, 0.9) as threshold from fc where y is not null and p is not null group by 1) t on t.universe = f.universe where y is not null and p is not null group by 1, 2", keys="universe", ints="tp,fp,fn", doubles="threshold", ctes=FC)
add("agg09_roc_auc", on_base(lambda b: metrics.roc_auc(forecasts(b), ["universe"])), "select universe, (sum(r) filter (y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)) as auc, n from (select *, rank() over (partition by universe order by p) + (count(*) over (partition by universe, p) - 1) / 2.0 as r, sum(y) over (partition by universe) as n1, count(*) over (partition by universe) as n from fc where y is not null and p is not null) t group by universe, n1, n", keys="universe", ints="n", doubles="auc", ctes=FC)
add("agg10_average_precision", on_base(lambda b: metrics.average_precision(forecasts(b), ["universe"])), "select universe, sum(ps * tp / seen) / sum(ps) as average_precision from (select *, sum(ps) over z as tp, sum(n) over z as seen from (select universe, p, sum(y) as ps, count(*) as n from fc where y is not null and p is not null group by 1, 2) t window z as (partition by universe order by p desc rows unbounded preceding)) u group by 1", keys="universe", doubles="average_precision", ctes=FC)
add("agg11_probability_scores", on_base(lambda b: metrics.probability_scores(forecasts(b), ["universe"])), "select universe, avg((p - y) ** 2) as brier, -avg(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12))) as log_loss from fc where y is not null and p is not null group by 1", keys="universe", doubles="brier,log_loss", ctes=FC)
add("agg12_reliability", on_base(lambda b: metrics.reliability(forecasts(b), ["universe"])), "select universe, least(greatest(floor(p * 10), 0), 9) as bin, count(*) as n, avg(p) as mean_p, avg(y) as rate from fc where y is not null and p is not null group by 1, 2", keys="universe", ints="bin,n", doubles="mean_p,rate", ctes=FC)
add("agg04_auc_by_regime", on_base(lambda b: metrics.auc_by_regime(forecasts(b).withColumn("regime", (F.col("xa") > 0).cast("int")).filter("regime is not null"), ["universe"], "regime")), "select universe, regime, case when n >= 30 then (sum(r) filter (y = 1) - n1 * (n1 + 1) / 2.0) / nullif(n1 * (n - n1), 0) end as auc, n from (select *, rank() over (partition by universe, regime order by p) + (count(*) over (partition by universe, regime, p) - 1) / 2.0 as r, sum(y) over (partition by universe, regime) as n1, count(*) over (partition by universe, regime) as n from (select *, (xa > 0)::int as regime from fc where xa is not null) z where y is not null and p is not null) t group by universe, regime, n1, n", keys="universe", ints="regime,n", doubles="auc", ctes=FC)
add("agg13_jaccard", on_base(lambda b: metrics.jaccard(b, ["universe"], F.col("v") > 0.3, F.col("xa") > 0.03)), "select universe, count(*) filter (v > 0.3 and xa > 0.03) / nullif(count(*) filter (v > 0.3 or xa > 0.03), 0)::double as jaccard from b group by 1", keys="universe", doubles="jaccard")
add("agg14_histogram", on_base(lambda b: metrics.histogram(b, ["universe"], "xa", 12)), "select universe, case when hi > lo then least(floor((xa - lo) / (hi - lo) * 12), 11) else 0 end as bin, lo, hi, count(*) as n from (select *, min(xa) over (partition by universe) as lo, max(xa) over (partition by universe) as hi from b where xa is not null) t group by 1, 2, 3, 4", keys="universe", ints="bin,n", doubles="lo,hi")
add("agg15_top_k", on_base(lambda b: b.orderBy(F.col("v").desc_nulls_last(), "universe", "d").limit(10)), "select * from b order by v desc nulls last, universe, d limit 10", doubles="v")
add("agg16_arg_max", on_base(lambda b: b.groupBy("universe").agg(F.max_by("d", "v").alias("peak_d"), F.min_by("d", "xa").alias("trough_d"))), "select universe, arg_max(d, v) as peak_d, arg_min(d, xa) as trough_d from b group by 1", keys="universe,peak_d,trough_d")
add("agg17_value_counts", on_base(lambda b: b.withColumn("s", F.signum("xa")).groupBy("s").agg(F.count("*").alias("n"), F.countDistinct("universe").alias("u"))), "select sign(xa) as s, count(*) as n, count(distinct universe) as u from b group by 1", keys="", ints="n,u", doubles="s")

# --- windows --------------------------------------------------------------------------------------------------------


def _win(*cols):
    def f(b):
        w = S.series()
        return b.select("universe", "d", *[c(w).alias(n) for n, c in cols])

    return on_base(f)


def fr(n, s=1):
    return f"rows between {n - 1 + s} preceding and {s} preceding)"


add("win01_lags", _win(("l1", lambda w: F.lag("v").over(w)), ("l5", lambda w: F.lag("v", 5).over(w))), f"select universe, d, lag(v) {O}) as l1, lag(v, 5) {O}) as l5 from b", doubles="l1,l5")
add("win02_mean_std", _win(("m", lambda w: W.mean(F.col("v"), W.trailing(21), w)), ("s", lambda w: W.std(F.col("v"), W.trailing(21), w))), f"select universe, d, case when count(v) {O} {fr(21)} >= 10 then avg(v) {O} {fr(21)} end as m, case when count(v) {O} {fr(21)} >= 10 then stddev_pop(v) {O} {fr(21)} end as s from b", doubles="m,s")
add("win03_sum", _win(("t", lambda w: W.total(F.col("xa"), W.Frame(13, 13, 0), w))), f"select universe, d, case when count(xa) {O} {fr(13, 0)} >= 13 then sum(xa) {O} {fr(13, 0)} end as t from b", doubles="t")
add("win04_high_and_drawdown", _win(("h", lambda w: W.highest(F.col("fa"), W.Frame(26, 10, 1), w)), ("dd", lambda w: W.drawdown_from_high(F.col("fa"), W.Frame(26, 10, 1), w))), f"select universe, d, case when count(fa) {O} {fr(26)} >= 10 then max(fa) {O} {fr(26)} end as h, case when count(fa) {O} {fr(26)} >= 10 then ln(lag(fa) {O}) / max(fa) {O} {fr(26)}) end as dd from b", doubles="h,dd")
add("win05_correlation", _win(("c", lambda w: W.correlation(F.col("xa"), F.col("xn"), W.Frame(52, 26, 1), w))), f"select universe, d, case when count(xa) {O} {fr(52)} >= 26 then corr(xa, xn) {O} {fr(52)} end as c from b", doubles="c")
add("win06_quantile", _win(("q", lambda w: W.quantile(F.col("v"), 0.75, W.Frame(104, 26, 1), w))), f"select universe, d, case when count(v) {O} {fr(104)} >= 26 then quantile_cont(v, 0.75) {O} {fr(104)} end as q from b", doubles="q")
add("win07_expanding", _win(("m", lambda w: W.mean(F.col("v"), W.expanding(20), w)), ("s", lambda w: W.std(F.col("v"), W.expanding(20), w))), f"select universe, d, case when count(v) {O} rows between unbounded preceding and 1 preceding) >= 20 then avg(v) {O} rows between unbounded preceding and 1 preceding) end as m, case when count(v) {O} rows between unbounded preceding and 1 preceding) >= 20 then stddev_pop(v) {O} rows between unbounded preceding and 1 preceding) end as s from b", doubles="m,s")
add("win08_zscore", _win(("z", lambda w: W.zscore(F.col("v"), W.Frame(52, 13, 1), w))), f"select universe, d, case when count(v) {O} {fr(52)} >= 13 and stddev_pop(v) {O} {fr(52)} > 0 then (lag(v) {O}) - avg(v) {O} {fr(52)}) / stddev_pop(v) {O} {fr(52)} end as z from b", doubles="z")
add("win09_ewma", _win(("e", lambda w: W.ewma(F.col("v"), 8, w))), f"select a.universe, a.d, case when count(c.v) >= 8 then sum(c.v * power(1 - 2.0 / 9, a.k - c.k)) / sum(power(1 - 2.0 / 9, a.k - c.k)) end as e from k a left join k c on a.universe = c.universe and c.v is not null and c.pos <= a.pos group by 1, 2", doubles="e", ctes=f"k as (select universe, d, pos, v, count(v) {O} rows unbounded preceding) as k from b)")
add("win10_cumulative", _win(("s", lambda w: W.cumulative(F.col("xa"), w)), ("m", lambda w: W.cumulative_max(F.col("fa"), w)), ("g", lambda w: W.cumulative_growth(F.expm1(F.col("xa")), w))), f"select universe, d, sum(xa) {O} rows unbounded preceding) as s, max(fa) {O} rows unbounded preceding) as m, exp(sum(xa) {O} rows unbounded preceding)) as g from b", doubles="s,m,g")
add("win11_forward_fill", _win(("f", lambda w: W.forward_fill(F.when(F.col("v") > 0.3, F.col("v")), w, 5)), ("g", lambda w: W.forward_fill(F.when(F.col("v") > 0.3, F.col("v")), w))), f"select universe, d, last_value(case when v > 0.3 then v end ignore nulls) {O} rows between 5 preceding and current row) as f, last_value(case when v > 0.3 then v end ignore nulls) {O} rows unbounded preceding) as g from b", doubles="f,g")
add("win12_percentile_rank", on_base(lambda b: b.select("universe", "d", W.percentile_rank(F.col("v"), ["universe"]).alias("r"), W.average_rank(F.col("v"), ["universe"], True).alias("k"))), "select universe, d, case when v is not null then (rank() over (partition by universe, v is null order by v) + (count(*) over (partition by universe, v) - 1) / 2.0) / count(v) over (partition by universe) end as r, case when v is not null then rank() over (partition by universe, v is null order by v desc) + (count(*) over (partition by universe, v) - 1) / 2.0 end as k from b", doubles="r,k")
add("win13_rolling_percentile_rank", _win(("r", lambda w: W.rolling_percentile_rank(F.col("v"), W.Frame(52, 20, 0), w))), "select a.universe, a.d, case when count(c.v) >= 20 then (count(*) filter (c.v < a.v) + (count(*) filter (c.v = a.v) + 1) / 2.0) / count(c.v) end as r from b a left join b c on a.universe = c.universe and c.pos between a.pos - 51 and a.pos group by a.universe, a.d", doubles="r")
add("win15_forward", _win(("mx", lambda w: W.forward(F.col("v"), 4, w, "max")), ("mn", lambda w: W.forward(F.col("fa"), 4, w, "min")), ("sd", lambda w: W.forward(F.col("xa"), 4, w, "std", True)), ("sm", lambda w: W.forward(F.col("xa"), 4, w, "sum", True))), f"select universe, d, max(v) {O} rows between 1 following and 4 following) as mx, min(fa) {O} rows between 1 following and 4 following) as mn, case when count(xa) {O} rows between 1 following and 4 following) = 4 then stddev_samp(xa) {O} rows between 1 following and 4 following) end as sd, case when count(xa) {O} rows between 1 following and 4 following) = 4 then sum(xa) {O} rows between 1 following and 4 following) end as sm from b", doubles="mx,mn,sd,sm")
add("win18_forward_drawdown", _win(("fd", lambda w: W.forward_drawdown(F.expm1("xa"), 3, w))), f"select universe, d, case when r3 is not null and r2 is not null and r1 is not null then least(exp(r1), exp(r1 + r2), exp(r1 + r2 + r3)) - 1 end as fd from (select universe, d, lead(xa, 1) {O}) as r1, lead(xa, 2) {O}) as r2, lead(xa, 3) {O}) as r3 from b) t", doubles="fd")
add("win19_persistence", on_base(lambda b: features.persistence_table(b.filter("v is not null"), "v", (1, 5), 0.9)), "select z.universe, h, avg(m) filter (v >= cut) as after_top, avg(m) as base from z join (select universe, quantile_cont(v, 0.9) as cut from b group by 1) c on c.universe = z.universe group by 1, 2", keys="universe", ints="h", doubles="after_top,base", ctes=f"z as (select universe, v, 1 as h, lead(v) {O}) as m from b where v is not null union all select universe, v, 5, case when count(v) {O} rows between 1 following and 5 following) = 5 then avg(v) {O} rows between 1 following and 5 following) end from b where v is not null)")

# --- walk-forward fits ----------------------------------------------------------------------------------------------

LB, MP = 104, 26


def _mom_sql(lookback: int, shrink: bool) -> str:
    """Closed form for three factors: window moments, shrunk covariance, inverse by cofactors."""
    f = f"(partition by universe order by pos rows between {lookback} preceding and 1 preceding)"
    sums = ["count(xa) over f as m"] + [f"avg({c}) over f as mu_{c}" for c in X] + [f"covar_pop({a}, {c}) over f as s_{a}{c}" for i, a in enumerate(X) for c in X[i:]]
    dev4 = "(select sum(((c.xa - t.mu_xa) ** 2 + (c.xn - t.mu_xn) ** 2 + (c.xr - t.mu_xr) ** 2) ** 2) from b c where c.universe = t.universe and c.xa is not null and c.pos between t.pos - %d and t.pos - 1)" % lookback
    lw = f"""lw as (select t.*, {dev4} as f4, (s_xaxa + s_xnxn + s_xrxr) as tr, s_xaxa ** 2 + s_xnxn ** 2 + s_xrxr ** 2 + 2 * (s_xaxn ** 2 + s_xaxr ** 2 + s_xnxr ** 2) as sq from mo t where m >= {MP}),
al as (select *, tr / 3 as mt, {"case when least((f4 / m - sq) / (3 * m), dl) <= 0 then 0 else least((f4 / m - sq) / (3 * m), dl) / dl end" if shrink else "0.0"} as alpha from (select *, (sq - tr * tr / 3) / 3 as dl from lw) u),"""
    return f"""mo as (select universe, d, pos, {", ".join(X)}, {", ".join(sums)} from b window f as {f}),
{lw}
cv as (select universe, d, pos, alpha, mu_xa, mu_xn, mu_xr, xa - mu_xa as da, xn - mu_xn as dn, xr - mu_xr as dr,
 (1 - alpha) * s_xaxa + alpha * mt as a, (1 - alpha) * s_xaxn as b_, (1 - alpha) * s_xaxr as c, (1 - alpha) * s_xnxn + alpha * mt as e, (1 - alpha) * s_xnxr as f, (1 - alpha) * s_xrxr + alpha * mt as i from al),
iv as (select *, a * (e * i - f * f) - b_ * (b_ * i - f * c) + c * (b_ * f - e * c) as det from cv),
tb as (select universe, d, pos, alpha as shrinkage, da, dn, dr, da * ((e * i - f * f) * da + (c * f - b_ * i) * dn + (b_ * f - c * e) * dr) / det as ca,
 dn * ((c * f - b_ * i) * da + (a * i - c * c) * dn + (b_ * c - a * f) * dr) / det as cn, dr * ((b_ * f - c * e) * da + (b_ * c - a * f) * dn + (a * e - b_ * b_) * dr) / det as cr from iv)"""


def _top_eigenvalue(a, b, c, e, f, i) -> str:
    """The largest eigenvalue of the symmetric matrix a b c, b e f, c f i, in closed form."""
    q = f"(({a}) + ({e}) + ({i})) / 3"
    p = f"sqrt((pow(({a}) - {q}, 2) + pow(({e}) - {q}, 2) + pow(({i}) - {q}, 2) + 2 * (pow({b}, 2) + pow({c}, 2) + pow({f}, 2))) / 6)"
    x, y, z = (f"(({v}) - {q})" for v in (a, e, i))
    det = f"({x} * ({y} * {z} - ({f}) * ({f})) - ({b}) * (({b}) * {z} - ({f}) * ({c})) + ({c}) * (({b}) * ({f}) - {y} * ({c})))"
    return f"({q} + 2 * {p} * cos(acos(greatest(-1.0, least(1.0, {det} / pow({p}, 3) / 2))) / 3))"


def _absorption_sql(step: int) -> str:
    """Correlations of the window, their shrinkage and the share of the largest eigenvalue."""
    four = f"(select sum(pow(pow((c.xa - t.mu_xa) / sqrt(t.s_xaxa), 2) + pow((c.xn - t.mu_xn) / sqrt(t.s_xnxn), 2) + pow((c.xr - t.mu_xr) / sqrt(t.s_xrxr), 2), 2)) from b c where c.universe = t.universe and c.xa is not null and c.pos between t.pos - {LB} and t.pos - 1)"
    return f"""co as (select universe, pos, m, case when m >= {MP} then s_xaxn / sqrt(s_xaxa * s_xnxn) end as p, case when m >= {MP} then s_xaxr / sqrt(s_xaxa * s_xrxr) end as q, case when m >= {MP} then s_xnxr / sqrt(s_xnxn * s_xrxr) end as r, case when m >= {MP} then {four} end as f4 from mo t where pos % {step} = 0 and pos >= 1),
sh as (select *, 3 + 2 * (p * p + q * q + r * r) as sq, 2 * (p * p + q * q + r * r) / 3 as dl from co),
ar as (select universe, pos, greatest(0, least((f4 / m - sq) / (3 * m), dl)) / dl as alpha, {_top_eigenvalue("1.0", "p", "q", "1.0", "r", "1.0")} as top from sh)"""


def _turb(b, shrink="ledoit-wolf", lookback=LB, refit=1):
    return walkforward.turbulence(vectors(b), X, lookback, MP, shrink, refit, flip=("xr",))


def _turb_wide(b, **k):
    return walkforward.contributions_wide(_turb(b, **k), X)


add("wf01_turbulence_top_weeks", lambda spark, sf: _turb(base(spark, sf, False), None).filter("turbulence is not null").orderBy(F.col("turbulence").desc(), "d").limit(20), "select universe, d, ca + cn + cr as turbulence from tb where ca is not null order by 3 desc, d limit 20", doubles="turbulence", ctes=_mom_sql(LB, False), region=False)
add("wf01_turbulence", on_base(_turb), "select universe, d, ca + cn + cr as turbulence, case when ca is not null then shrinkage end as shrinkage from tb where ca is not null", doubles="turbulence,shrinkage", ctes=_mom_sql(LB, True))
QUERIES["wf01_turbulence"] = (lambda f: lambda s, d: f(s, d).filter("turbulence is not null"))(QUERIES["wf01_turbulence"])
add("wf02_decomposition", on_base(lambda b: _turb_wide(b).filter("turbulence is not null")), "select universe, d, ca as xa, cn as xn, cr as xr from tb where ca is not null", doubles="xa,xn,xr", ctes=_mom_sql(LB, True))
add("wf03_signed_split", on_base(lambda b: _turb(b).filter("turbulence is not null")), "select universe, d, case when da < 0 then ca else 0 end + case when dn < 0 then cn else 0 end + case when dr > 0 then cr else 0 end as turb_loss, case when da >= 0 then ca else 0 end + case when dn >= 0 then cn else 0 end + case when dr <= 0 then cr else 0 end as turb_gain from tb where ca is not null", doubles="turb_loss,turb_gain", ctes=_mom_sql(LB, True))


def _cov(b):
    return walkforward.covariance_history(vectors(b), X, LB, MP, "ledoit-wolf", 21).select("universe", "refit_pos", F.get("mu", F.lit(0)).alias("mu_a"), (F.get("cov", F.lit(0)) * 1e4).alias("v_aa"), (F.get("cov", F.lit(1)) * 1e4).alias("v_an"), (F.get("cov", F.lit(8)) * 1e4).alias("v_rr"), "shrinkage")


add("wf08_covariance_history", on_base(_cov), "select universe, pos as refit_pos, mu_xa as mu_a, a * 1e4 as v_aa, b_ * 1e4 as v_an, i * 1e4 as v_rr, alpha as shrinkage from cv where pos % 21 = 0", keys="universe", ints="refit_pos", doubles="mu_a,v_aa,v_an,v_rr,shrinkage", ctes=_mom_sql(LB, True))
add("wf04_absorption_ratio", on_base(lambda b: walkforward.absorption_ratio(vectors(b), X, 1, LB, MP, 4)), "select universe, pos as refit_pos, ((1 - alpha) * top + alpha) / 3 as absorption from ar", keys="universe", ints="refit_pos", doubles="absorption", ctes=_mom_sql(LB, True) + ", " + _absorption_sql(4))
add("wf05_absorption_shift", on_base(lambda b: walkforward.absorption_shift(walkforward.absorption_ratio(vectors(b), X, 1, LB, MP, 4).withColumnRenamed("refit_pos", "pos").filter("absorption is not null"), fast=5, slow=20)), None, keys="universe", ints="pos", doubles="absorption_shift")
Z = "case when count({c}) over g >= 26 and stddev_{k}({c}) over g > 0 then ({c} - avg({c}) over g) / stddev_{k}({c}) over g end"
add("wf06_standardiser", on_base(lambda b: walkforward.rolling_standardise(b, ["xa", "xn"], 52, 26)), f"select universe, d, {Z.format(c='xa', k='pop')} as xa, {Z.format(c='xn', k='pop')} as xn from b window g as (partition by universe order by pos rows between 52 preceding and 1 preceding)", doubles="xa,xn")
add("wf07_rolling_pca", on_base(lambda b: walkforward.rolling_pca(vectors(b), X, 2, LB, MP, 26).select("universe", "refit_pos", F.get("explained", F.lit(0)).alias("share1"))), f"select universe, pos as refit_pos, {_top_eigenvalue('s_xaxa', 's_xaxn', 's_xaxr', 's_xnxn', 's_xnxr', 's_xrxr')} / (s_xaxa + s_xnxn + s_xrxr) as share1 from mo where pos % 26 = 0 and pos >= 1 and m >= {MP}", keys="universe", ints="refit_pos", doubles="share1", ctes=_mom_sql(LB, True))
add("wf07_pca_scores", on_base(lambda b: walkforward.pca_scores(vectors(b), walkforward.rolling_pca(vectors(b), X, 2, LB, MP, 26), 26).select("universe", "d", F.get("scores", F.lit(0)).alias("score1"))), None, doubles="score1")
add("wf09_surprise", on_base(lambda b: walkforward.magnitude_surprise(b, X, _turb(b), LB, MP).filter("turbulence is not null")), f"select tb.universe, tb.d, z.xa ** 2 + z.xn ** 2 + z.xr ** 2 as magnitude, (ca + cn + cr) / (z.xa ** 2 + z.xn ** 2 + z.xr ** 2) as correlation_surprise from tb join (select universe, d, {Z.format(c='xa', k='samp')} as xa, {Z.format(c='xn', k='samp')} as xn, {Z.format(c='xr', k='samp')} as xr from b window g as (partition by universe order by pos rows between {LB} preceding and 1 preceding)) z on z.universe = tb.universe and z.d = tb.d where ca is not null", doubles="magnitude,correlation_surprise", ctes=_mom_sql(LB, True))
add("wf10_univariate_turbulence", on_base(lambda b: walkforward.univariate_turbulence(b, "xa", 52, 26)), f"select universe, d, ({Z.format(c='xa', k='samp')}) ** 2 as uni_turbulence from b window g as (partition by universe order by pos rows between 52 preceding and 1 preceding)", doubles="uni_turbulence")
add("wf11_fixed_covariance", on_base(lambda b: walkforward.fixed_contributions(vectors(b), X, None).filter("contributions is not null").select("universe", "d", F.get("contributions", F.lit(0)).alias("c_a"), F.aggregate("contributions", F.lit(0.0), lambda s, v: s + v).alias("total"))), """select universe, d, da * ((e * i - f * f) * da + (c * f - g * i) * dn + (g * f - c * e) * dr) / det as c_a,
 (da * ((e * i - f * f) * da + (c * f - g * i) * dn + (g * f - c * e) * dr) + dn * ((c * f - g * i) * da + (a * i - c * c) * dn + (g * c - a * f) * dr) + dr * ((g * f - c * e) * da + (g * c - a * f) * dn + (a * e - g * g) * dr)) / det as total
 from (select b.universe, b.d, xa - ma as da, xn - mn as dn, xr - mr as dr, s.*, a * (e * i - f * f) - g * (g * i - f * c) + c * (g * f - e * c) as det from b join (select universe as u, avg(xa) as ma, avg(xn) as mn, avg(xr) as mr, var_pop(xa) as a, covar_pop(xa, xn) as g, covar_pop(xa, xr) as c, var_pop(xn) as e, covar_pop(xn, xr) as f, var_pop(xr) as i from b group by 1) s on s.u = b.universe where xa is not null) t""", doubles="c_a,total")
add("wf12_gmm", on_base(lambda b: walkforward.walk_forward_gmm(vectors(b).filter("x is not null"), X, 3, 104, 104, n_init=2)[0].select("universe", "pos", "label")), None, keys="universe", ints="pos,label")
add("wf13_label_alignment", on_base(lambda b: walkforward.walk_forward_gmm(vectors(b).filter("x is not null"), X, 3, 104, 104, n_init=2)[1].select("universe", "refit_pos", F.concat_ws(",", "perm").alias("perm"))), None, keys="universe,perm", ints="refit_pos")
def _regime_sql(q: float, window: int) -> str:
    return f"case when v is null or count(v) {O} rows between {window} preceding and 1 preceding) < {MP} then null when round(v, 9) > round(quantile_cont(v, {q}) {O} rows between {window} preceding and 1 preceding), 9) then 1 else 0 end"


REG = f"case when v is null or count(v) {O} rows between {LB} preceding and 1 preceding) < {MP} then null when round(v, 9) > round(quantile_cont(v, 0.75) {O} rows between {LB} preceding and 1 preceding), 9) then 1 else 0 end"
add("wf14_regime", on_base(lambda b: regimes.threshold_regime(b, "v", 0.75, LB, MP, digits=9)), f"select universe, d, {REG} as regime from b", ints="regime")
BQ = " + ".join(f"(round(lag(v) {O}), 9) > round(quantile_cont(v, {k / 5}) {O} rows between {LB} preceding and 1 preceding), 9))::int" for k in range(1, 5))
add("wf15_bucket", on_base(lambda b: regimes.ordinal_bucket(b, "v", 5, LB, MP, digits=9)), f"select universe, d, case when lag(v) {O}) is not null and count(v) {O} rows between {LB} preceding and 1 preceding) >= {MP} then {BQ} end as bucket from b", ints="bucket")


def _spliced(spark, sf):
    b = base(spark, sf)
    px = b.filter("universe = 'ASIA'").select("d", F.lit("T1").alias("ticker"), F.col("fa").alias("close")).filter("d >= '1998-01-01'")
    px = px.unionByName(b.filter("universe = 'EUROPE'").select("d", F.lit("T2").alias("ticker"), F.col("fa").alias("close")))
    defs = spark.createDataFrame([("f1", "T1", "", "")], "factor string, primary string, description string, category string")
    return walkforward.spliced_panel(px, defs, spark.createDataFrame([("f1", 1, "T2")], "factor string, priority int, ticker string"))


add("wf17_spliced_panel", _spliced, "select 'f1' as factor, d, exp(sum(r) over (order by d) - first_value(r) over (order by d)) * 100 as level from (select coalesce(a.d, e.d) as d, coalesce(a.r, e.r) as r from (select d, ln(fa) - ln(lag(fa) over (order by d)) as r from b where universe = 'ASIA' and d >= date '1998-01-01') a full join (select d, ln(fa) - ln(lag(fa) over (order by d)) as r from b where universe = 'EUROPE') e on a.d = e.d) t where r is not null", keys="factor,d", doubles="level")
add("wf16_splice_dates", on_base(lambda b: walkforward.splice(*[b.filter(f"universe = '{u}'").select(F.lit("f").alias("universe"), "d", F.col("xa").alias("value")) for u in ("ASIA",)], [b.filter("universe = 'EUROPE'").select(F.lit("f").alias("universe"), "d", F.col("xa").alias("value"))], ["1998-06-01"])), "select 'f' as universe, d, xa as value from b where universe = 'ASIA' and d >= date '1998-06-01' union all select 'f', d, xa from b where universe = 'EUROPE' and d < date '1998-06-01'", doubles="value")
add("wf18_valid_dates", on_base(lambda b: walkforward.valid_dates(panel.to_long(b, X))), "select f as factor, min(d) as first_d, max(d) as last_d, count(*) as n from (select 'xa' as f, d, xa as x from b union all select 'xn', d, xn from b union all select 'xr', d, xr from b) t where x is not null group by 1", keys="factor,first_d,last_d", ints="n")

# --- sequential operators -------------------------------------------------------------------------------------------

LAB = "lb as (select universe, d, pos, case when pos % 17 = 5 then null when v > 0.3 then 1 else 0 end as x from b where v is not null)"


def _labels(b):
    return b.filter("v is not null").withColumn("x", F.when(F.col("pos") % 17 == 5, None).when(F.col("v") > 0.3, 1).otherwise(0))


add("seq01_smoother", on_base(lambda b: regimes.smooth_min_duration(_labels(b), "x", 3)), f"""select universe, d, case when x is not null then last_value(case when x is not null and (k >= 3 or first_) then x end ignore nulls) {O} rows unbounded preceding) end as smoothed from
 (select *, row_number() over (partition by universe, run order by d) as k, row_number() over (partition by universe, x is null order by d) = 1 as first_ from (select *, sum(ch) {O} rows unbounded preceding) as run from (select *, case when x is not distinct from lag(x) {O}) then 0 else 1 end as ch from lb) a) c) e""", ints="smoothed", ctes=LAB)
EV = """s as (select universe, d, v, row_number() over (partition by universe order by d) as i from b where v is not null),
ev as (select universe, i, d, v as acc, 0 as id, v >= 2.0 as done, d as st, 1 as n from s where i = 1
 union all select s.universe, s.i, s.d, case when ev.done then s.v else ev.acc + s.v end, case when ev.done then ev.id + 1 else ev.id end, (case when ev.done then s.v else ev.acc + s.v end) >= 2.0, case when ev.done then s.d else ev.st end, case when ev.done then 1 else ev.n + 1 end from ev join s on s.universe = ev.universe and s.i = ev.i + 1)"""
add("seq02_event_clock", on_base(lambda b: eventclock.events(b, "v", 2.0).withColumnsRenamed({"start_date": "start_d", "end_date": "end_d"})), "select universe, id as event_id, st as start_d, d as end_d, d - st as calendar_days_in_event, n as trading_days_in_event, acc as cumulative_intensity from ev where done", keys="universe,start_d,end_d", ints="event_id,calendar_days_in_event,trading_days_in_event", doubles="cumulative_intensity", ctes=EV, recursive=True)
add("seq03_calibration", on_base(lambda b: eventclock.calibrate(b, "v", 4.0, 0.1)), None, keys="universe", doubles="threshold,mean_length", ints="n_events")
CUM = f"c as (select universe, d, pos, fa, sum(coalesce(v, 0)) {O} rows unbounded preceding) as cum from b), cr as (select c.*, (select min(e.pos) from c e where e.universe = c.universe and e.cum >= c.cum + 2.0) as cross_pos from c)"
add("seq04_event_returns", on_base(lambda b: eventclock.event_returns(b, "v", "fa", 2.0)), "select a.universe, a.d, a.cross_pos, ln(e.fa / a.fa) as event_return from cr a join c e on e.universe = a.universe and e.pos = a.cross_pos", ints="cross_pos", doubles="event_return", ctes=CUM)
add("seq05_event_drawdown", on_base(lambda b: eventclock.event_drawdown(b, "v", "fa", 2.0)), "select a.universe, a.d, case when a.cross_pos is not null then min(ln(e.fa)) - ln(a.fa) end as event_drawdown from cr a left join c e on e.universe = a.universe and e.pos > a.pos and e.pos <= a.cross_pos group by a.universe, a.d, a.cross_pos, a.fa", doubles="event_drawdown", ctes=CUM)
add("seq06_event_grid", on_base(lambda b: eventclock.on_event_grid(b.filter("v is not null"), "v", 2.0, ["xa"])), "select t.universe, id as event_id, sum(b.xa) as xa, avg(b.v) as mean_intensity, count(*) as n_rows from (select universe, id, d from ev where (universe, id) in (select universe, id from ev where done)) t join b on b.universe = t.universe and b.d = t.d group by 1, 2", keys="universe", ints="event_id,n_rows", doubles="xa,mean_intensity", ctes=EV, recursive=True)
add("seq07_event_features", on_base(lambda b: eventclock.event_features(b.filter("v is not null"), "v", "xa", 2.0, 6)), f"""select ev.universe, ev.d, acc / 2.0 as et_intensity_to_date, n - 1 as et_days_since_start, case when count(*) over h = 6 then sum(done::int) over h end as et_velocity, case when count(*) over g = 5 then avg(s.v) over g / 2.0 end as et_turb_per_day,
 (select sum(r.xa) from s2 r where r.universe = ev.universe and r.i <= ev.i and r.i > (select max(q.i) from s2 q where q.universe = ev.universe and q.i < ev.i + 1 and q.cum0 <= (select z.cum from s2 z where z.universe = ev.universe and z.i = ev.i) - 2.0) - 1) as et_momentum
 from ev join s on s.universe = ev.universe and s.i = ev.i window h as (partition by ev.universe order by ev.d rows between 5 preceding and current row), g as (partition by ev.universe order by ev.d rows between 4 preceding and current row)""", doubles="et_intensity_to_date,et_days_since_start,et_velocity,et_turb_per_day,et_momentum", ctes=EV + ", s2 as (select s.universe, s.i, b.xa, sum(s.v) over (partition by s.universe order by s.i rows unbounded preceding) as cum, sum(s.v) over (partition by s.universe order by s.i rows unbounded preceding) - s.v as cum0 from s join b on b.universe = s.universe and b.d = s.d)", recursive=True)
add("seq08_episodes", on_base(lambda b: _episodes(b).withColumnsRenamed({"start": "start_d", "end": "end_d"})), "select universe, start_ as start_d, end_ as end_d, n_days, peak_turb, mean_turb from ep", keys="universe,start_d,end_d", ints="n_days", doubles="peak_turb,mean_turb", ctes=EPI)
RUN = f"hd2 as (select universe, d, case when d - lag(d) {O}) <= 14 then 0 else 1 end as fresh from b where v > 0.3), hg2 as (select *, sum(fresh) {O} rows unbounded preceding) as grp from hd2)"
add("seq09_calendar_runs", on_base(lambda b: regimes.calendar_runs(b, F.col("v") > 0.3, 14, 2).withColumnsRenamed({"start": "start_d", "end": "end_d"})), "select universe, min(d) as start_d, max(d) as end_d, count(*) as n from hg2 group by universe, grp having count(*) >= 2", keys="universe,start_d,end_d", ints="n", ctes=RUN)
add("seq10_clusters", on_base(lambda b: regimes.clusters(_episodes(b), 90).withColumnRenamed("start", "start_d")), "select universe, start_ as start_d, sum(f) over (partition by universe order by start_ rows unbounded preceding) as cluster from (select *, case when start_ - lag(start_) over (partition by universe order by start_) <= 90 then 0 else 1 end as f from ep) t", keys="universe,start_d", ints="cluster", ctes=EPI)
add("seq11_independent_events", on_base(lambda b: regimes.independent_count(b, F.col("v") > 0.3, 14)), "select universe, count(distinct grp) as n from hg2 group by 1", keys="universe", ints="n", ctes=RUN)
add("seq12_hysteresis", on_base(lambda b: regimes.hysteresis(forecasts(b), "p", 0.4, 0.1)), f"select universe, d, coalesce(last_value(case when p >= 0.4 then 0 when p < 0.1 then 1 end ignore nulls) {O} rows unbounded preceding), 1) as pos_flag from fc", ints="pos_flag", ctes=FC)
add("seq13_capped_spell", on_base(lambda b: regimes.capped_spell(forecasts(b), "p", 0.1, 2)), f"select universe, d, case when not hot then 1 when k % 3 = 0 then 1 else 0 end as pos_flag from (select *, row_number() over (partition by universe, run order by d) as k from (select *, sum(ch) {O} rows unbounded preceding) as run from (select universe, d, coalesce(p >= 0.1, false) as hot, case when coalesce(p >= 0.1, false) is not distinct from lag(coalesce(p >= 0.1, false)) {O}) then 0 else 1 end as ch from fc) a) c) e", ints="pos_flag", ctes=FC)
add("seq14_switching_cost", on_base(lambda b: b.select("universe", "d", regimes.switching_cost(F.when(F.col("v") > 0.3, "cash").otherwise("equity"), S.series(), 5.0).alias("cost"))), f"select universe, d, case when lag(l) {O}) is null or l = lag(l) {O}) then 0 else 0.0005 end as cost from (select *, case when v > 0.3 then 'cash' else 'equity' end as l from b) t", doubles="cost")
add("seq15_shading", on_base(lambda b: regimes.shading(b.withColumn("f", F.coalesce((F.col("v") > 0.3).cast("int"), F.lit(0))), "f").withColumnsRenamed({"start": "start_d", "end": "end_d"})), f"select universe, min(d) as start_d, max(d) as end_d from (select *, sum(ch) {O} rows unbounded preceding) as run from (select *, case when f is not distinct from lag(f) {O}) then 0 else 1 end as ch from (select *, coalesce((v > 0.3)::int, 0) as f from b) z) a) c where f = 1 group by universe, run", keys="universe,start_d,end_d")

# --- features, targets, splits --------------------------------------------------------------------------------------


def _g(n, mp, agg, c):
    return f"case when count({c}) {O} {fr(n)} >= {mp} then {agg}({c}) {O} {fr(n)} end"


FT_COLS = "eq_drawdown_63,eq_rates_corr_63,eq_ret_lag1,eq_ret_ma21,eq_ret_ma5,eq_vol_21,rates_ret_ma21,turb_lag5,turb_ma21,turb_std5,turb_zscore_252,vix_log_lag1,vix_ma21"
add("ft01_feature_matrix", on_base(lambda b: features.feature_matrix(b, "v", "fa", "fn", "fn", "fr")), f"""select universe, d, lag(ln(fa)) {O}) - {_g(63, 20, 'max', 'ln(fa)')} as eq_drawdown_63, case when count(xa) {O} {fr(63)} >= 31 then corr(xa, xn) {O} {fr(63)} end as eq_rates_corr_63, lag(xa) {O}) as eq_ret_lag1, {_g(21, 10, 'sum', 'xa')} as eq_ret_ma21, {_g(5, 3, 'sum', 'xa')} as eq_ret_ma5,
 {_g(21, 10, 'stddev_pop', 'xa')} as eq_vol_21, {_g(21, 10, 'sum', 'xn')} as rates_ret_ma21, lag(v, 5) {O}) as turb_lag5, {_g(21, 10, 'avg', 'v')} as turb_ma21, {_g(5, 2, 'stddev_pop', 'v')} as turb_std5, (lag(v) {O}) - ({_g(252, 63, 'avg', 'v')})) / ({_g(252, 63, 'stddev_pop', 'v')}) as turb_zscore_252, lag(ln(fr)) {O}) as vix_log_lag1, {_g(21, 10, 'avg', 'ln(fr)')} as vix_ma21 from b""", doubles=FT_COLS)
add("ft02_bucket_features", on_base(lambda b: features.bucket_features(b.withColumn("k", F.pmod("pos", F.lit(5)).cast("int")), "k")), f"select universe, d, lag(pos % 5) {O}) as turbbucket_lag1, case when count(pos) {O} {fr(21, 0)} >= 10 then avg(pos % 5) {O} {fr(21, 0)} end as turbbucket_ma21, (pos % 5 = 2)::int as tb_2 from b", doubles="turbbucket_lag1,turbbucket_ma21,tb_2")
add("ft03_decomposition_features", on_base(lambda b: features.decomposition_features(b.withColumn("turbulence", F.col("fa") + F.col("fn") + F.col("fr")), ["fa", "fn", "fr"], sizes=(21,))), f"select universe, d, lag(sa * sa + sn * sn + sr * sr) {O}) as decconc_21, lag(sa) {O}) as decshare_fa_21 from (select *, case when pos >= 9 then sum(fa) {O} {fr(21, 0)} / sum(fa + fn + fr) {O} {fr(21, 0)} end as sa, case when pos >= 9 then sum(fn) {O} {fr(21, 0)} / sum(fa + fn + fr) {O} {fr(21, 0)} end as sn, case when pos >= 9 then sum(fr) {O} {fr(21, 0)} / sum(fa + fn + fr) {O} {fr(21, 0)} end as sr from b) t", doubles="decconc_21,decshare_fa_21")
add("ft07_rates_pressure", on_base(lambda b: features.rates_pressure(b.filter("xa is not null"), X, ("xn",))), "select universe, d, greatest(xn, 0) / nullif(greatest(xa, 0) + greatest(xn, 0) + greatest(xr, 0), 0) as rates_pressure from b where xa is not null", doubles="rates_pressure")
add("ft08_duration_trend", on_base(lambda b: features.duration_trend(b, "xa", 13)), f"select universe, d, case when count(xa) {O} {fr(13, 0)} = 13 then sum(xa) {O} {fr(13, 0)} end as duration_trend from b", doubles="duration_trend")
add("tg01_entry_target", on_base(lambda b: features.turbulence_entry(b, "v", 0.3, 4)), f"select universe, d, case when max(v) {O} rows between 1 following and 4 following) >= 0.3 then 1 when max(v) {O} rows between 1 following and 4 following) is not null then 0 end as y from b", ints="y")
add("tg02_forward_drawdown", on_base(lambda b: features.forward_drawdown(b, "fa", 4).withColumn("correction", features.correction_label(F.col("fdd"), 0.05))), f"select universe, d, fdd, (fdd <= -0.05)::int as correction from (select universe, d, min(ln(fa)) {O} rows between 1 following and 4 following) - ln(fa) as fdd from b) t", ints="correction", doubles="fdd")
add("tg05_dev_threshold", on_base(lambda b: features.dev_quantile(b, "v", DEV_END, 0.9)), f"select universe, quantile_cont(v, 0.9) as threshold from b where d <= date '{DEV_END}' group by 1", keys="universe", doubles="threshold")


def _dev_oos(b):
    dev, oos = splits.dev_oos(b, DEV_END)
    splits.guard(dev, DEV_END)
    return dev.groupBy("universe").agg(F.count("*").alias("n_dev")).join(oos.groupBy("universe").agg(F.count("*").alias("n_oos")), "universe")


add("sp01_dev_oos", on_base(_dev_oos), f"select universe, count(*) filter (d <= date '{DEV_END}') as n_dev, count(*) filter (d > date '{DEV_END}') as n_oos from b group by 1", keys="universe", ints="n_dev,n_oos")


def _folds(b):
    return splits.purged_folds(b.groupBy("universe").agg(F.count("*").alias("n")), 5, 4, 4, 50)


add("sp03_purged_folds", on_base(lambda b: splits.in_folds(b, _folds(b)).groupBy("universe", "fold", F.col("part").alias("kind")).agg(F.count("*").alias("rows"), F.max("pos").alias("last"))), "select z.universe, fold, kind, count(*) as rows, max(pos) as last from (select universe, k as fold, n // 6 * k - 8 as hi, n // 6 * k as lo, case when k = 5 then n else n // 6 * (k + 1) end as te from (select universe, count(*) as n from b group by 1) c, generate_series(1, 5) g(k)) f join (select universe, pos, unnest(['train', 'test']) as kind from b) z on z.universe = f.universe and f.hi >= 50 and ((kind = 'train' and pos < hi) or (kind = 'test' and pos >= lo and pos < te)) group by 1, 2, 3", keys="universe,kind", ints="fold,rows,last")
add("sp04_quarter_ends", lambda spark, sf: splits.quarter_ends(spark, "1997-12-31", "1998-01-01", "2000-02-15").withColumnRenamed("asof", "d"), "select date '1997-12-31' as d union select last_day(date '1998-03-01' + to_months(3 * cast(i as integer))) from range(0, 8) r(i)", keys="d")
add("sp05_month_ends", lambda spark, sf: splits.month_ends(spark, "1998-01-15", "1998-12-31").withColumnRenamed("cutoff", "d"), "select last_day(date '1998-01-01' + to_months(cast(i as integer))) as d from range(0, 12) r(i)", keys="d")
add("sp06_rolling_windows", lambda spark, sf: splits.rolling_windows(spark, "1995-01-02", "2001-11-04", 3).withColumnsRenamed({"lo": "start_d", "hi": "end_d"}), "select date '1995-01-02' + cast(365 * i as integer) as start_d, date '1995-01-02' + cast(365 * (i + 3) as integer) as end_d from range(0, 10) r(i) where date '1995-01-02' + cast(365 * (i + 3) as integer) <= date '2001-11-04'", keys="start_d,end_d")

# --- strategies -----------------------------------------------------------------------------------------------------

RS = "rs as (select *, count(r) over (partition by universe) as n, avg(r) over (partition by universe) as m, stddev_pop(r) over (partition by universe) as s, sum(r) over (partition by universe order by d rows unbounded preceding) as c from ({src}) z where r is not null), rd as (select *, c - max(c) over (partition by universe order by d rows unbounded preceding) as dd from rs)"
add("st01_return_stats", on_base(lambda b: metrics.return_stats(b, ["universe"], "xa", per_year=52)), "select universe, any_value(m) * 52 as ann_return, any_value(s) * sqrt(52) as ann_vol, any_value(m) / any_value(s) * sqrt(52) as sharpe, any_value(m) * 52 / (stddev_pop(r) filter (r < 0) * sqrt(52)) as sortino, min(dd) as max_drawdown from rd group by 1", keys="universe", doubles="ann_return,ann_vol,sharpe,sortino,max_drawdown", ctes=RS.format(src="select universe, d, xa as r from b"))
OV = f"ov as (select universe, d, pos, xa, xn, p, coalesce(lag((p < cut)::int) {O}), 0) as held from (select f.*, cut from fc f join (select universe as u, quantile_cont(p, 0.9) as cut from fc group by 1) q on q.u = f.universe) t)"
add("st02_overlay", on_base(lambda b: metrics.overlay(forecasts(b), "xa", "p")), "select universe, d, xa * coalesce(held, 0) as strategy from ov", doubles="strategy", ctes=FC + ", " + OV)
add("st03_frozen_overlay", on_base(lambda b: metrics.frozen_overlay(forecasts(b), "xa", "p", 0.3, 0.001)), f"select universe, d, xa * held - 0.001 * abs(held - lag(held, 1, 1) {O}) ) as strategy from (select universe, d, xa, coalesce(lag(coalesce((p < 0.3)::int, 0)) {O}), 0) as held from fc) t", doubles="strategy", ctes=FC)
add("st03_threshold_grid", on_base(lambda b: metrics.derisk(forecasts(b), "p", "xa", "xn", (0.1, 0.3, 0.5), 0.001).groupBy("universe", "tau").agg(F.avg("r").alias("mean_r"), F.avg("position").alias("exposure"), F.count("*").alias("n"))), f"select universe, tau, avg(r) as mean_r, avg(position) as exposure, count(*) as n from (select universe, tau, position, position * a + (1 - position) * c - 0.001 * abs(position - lag(position, 1, 1.0) over (partition by universe, tau order by pos)) as r from (select *, (p <= tau)::int::double as position from (select universe, pos, p, lead(xa) {O}) as a, lead(xn) {O}) as c from fc) u, (values (0.1::double), (0.3), (0.5)) t(tau) where p is not null and a is not null and c is not null) z) y group by 1, 2", keys="universe", doubles="tau,mean_r,exposure", ints="n", ctes=FC)


def _routed(b):
    f = forecasts(b)
    lab = metrics.route(F.col("p") >= 0.2, F.col("xn") > 0)
    return metrics.label_strategy(f.withColumn("label", lab), "label", {"equity": "xa", "bonds": "xn", "gold": "v"}, 5.0)


add("st04_label_strategy", on_base(_routed), f"select universe, d, label, case label when 'equity' then xa when 'bonds' then xn else v end - case when pos > 0 and label is distinct from lag(label) {O}) then 0.0005 else 0 end as strategy from (select *, case when not coalesce(p >= 0.2, false) then 'equity' when coalesce(xn > 0, false) then 'gold' else 'bonds' end as label from fc) t", keys="universe,d,label", doubles="strategy", ctes=FC)
add("st05_performance", on_base(lambda b: metrics.performance(b, ["universe"], "xa", per_year=52)), "select universe, exp(sum(r) * 52 / count(r)) - 1 as cagr, stddev_samp(exp(r) - 1) * sqrt(52) as vol, avg(exp(r) - 1) * 52 / (stddev_samp(exp(r) - 1) * sqrt(52)) as sharpe, avg(exp(r) - 1) * 52 / (stddev_samp(exp(r) - 1) filter (exp(r) - 1 < 0) * sqrt(52)) as sortino, exp(min(dd)) - 1 as max_drawdown, exp(sum(r)) - 1 as total_return from rd group by 1", keys="universe", doubles="cagr,vol,sharpe,sortino,max_drawdown,total_return", ctes=RS.format(src="select universe, d, xa as r from b"))
add("st07_matched_benchmarks", on_base(lambda b: metrics.matched_volatility(metrics.matched_exposure(b.filter("xa is not null").withColumn("position", (F.col("v") < 0.3).cast("double")), ["universe"], "position", "xa", "xn"), ["universe"], "xr", "xa")), "select universe, d, w * xa + (1 - w) * xn as static, k * xa as matched from (select *, avg((v < 0.3)::int) over (partition by universe) as w, stddev_pop(xr) over (partition by universe) / stddev_pop(xa) over (partition by universe) as k from b where xa is not null) t", doubles="static,matched")
add("st08_basket", on_base(lambda b: metrics.basket(b, "xa")), "select d, avg(xa) as basket, count(xa) as n from b group by 1", keys="d", ints="n", doubles="basket")

# --- inference ------------------------------------------------------------------------------------------------------


def _losses(b):
    return b.filter("xa is not null").withColumn("la", F.col("xa") ** 2).withColumn("lb", F.col("xn") ** 2)


DM = f"dm as (select universe, d, dd - avg(dd) over (partition by universe) as c, dd from (select universe, d, xa * xa - xn * xn as dd from b where xa is not null) z), dg as (select *, lag(c) {O}) as c1, lag(c, 2) {O}) as c2 from dm)"
add("in01_diebold_mariano", on_base(lambda b: inference.diebold_mariano(_losses(b), ["universe"], "la", "lb", 3)), "select universe, count(*) as n, avg(dd) as mean_diff, avg(dd) / sqrt((sum(c * c) + 2 * (1 - 1 / 3.0) * sum(c * c1) + 2 * (1 - 2 / 3.0) * sum(c * c2)) / count(*) / count(*)) as stat from dg group by 1", keys="universe", ints="n", doubles="mean_diff,stat", ctes=DM)
add("in02_block_bootstrap", each_universe(lambda b, _: inference.bootstrap_difference(b, "xa", "xn", block=8)), None, keys="universe", ints="n_resamples", doubles="observed,lo,hi,p_value")
add("in03_stationary_bootstrap", each_universe(lambda b, _: inference.bootstrap_difference(b, "xa", "xn", block=8, method="stationary")), None, keys="universe", ints="n_resamples", doubles="observed,lo,hi,p_value")
add("in04_basket_bootstrap", on_base(lambda b: inference.bootstrap_basket(b, "xa", "xn", 8)), None, keys="", ints="n_resamples", doubles="observed,lo,hi")
add("in05_mean_difference", each_universe(lambda b, _: inference.bootstrap_mean_difference(b.filter("xa is not null").withColumn("flag", F.col("v") > 0.3), "xa", "flag", 8)), None, keys="universe", doubles="observed,lo,hi,p_value")


def _pairs(b):
    comp = typology.composition(_turb_wide(b), _episodes(b), X)
    return typology.at_starts(typology.runup(_turb_wide(b), X, 8), comp).join(comp.withColumnRenamed("start", "d"), ["universe", "d"]).filter("pre is not null")


add("in06_permutation_cosine", on_base(lambda b: inference.permutation_cosine(_pairs(b), "pre", "composition")), None, keys="", ints="n_episodes", doubles="observed,null_mean,p_value")
PRE = f"""tw as (select * from tb where ca is not null), cp as (select e.universe, e.start_, avg(ca) / (avg(ca) + avg(cn) + avg(cr)) as a, avg(cn) / (avg(ca) + avg(cn) + avg(cr)) as n, avg(cr) / (avg(ca) + avg(cn) + avg(cr)) as r from ep e join tw on tw.universe = e.universe and tw.d between e.start_ and e.end_ group by 1, 2 having avg(ca) + avg(cn) + avg(cr) > 0),
al_ as (select b.universe, b.d, b.pos, tw.ca, tw.cn, tw.cr from b left join tw on tw.universe = b.universe and tw.d = b.d),
pv as (select universe, d, avg(ca) over h / (avg(ca) over h + avg(cn) over h + avg(cr) over h) as pa, avg(cn) over h / (avg(ca) over h + avg(cn) over h + avg(cr) over h) as pn, avg(cr) over h / (avg(ca) over h + avg(cn) over h + avg(cr) over h) as pr from al_ window h as (partition by universe order by d rows between 8 preceding and 1 preceding))"""
CT = _mom_sql(LB, True) + ", " + EPI + ", " + PRE
add("in06_null_mean", on_base(lambda b: inference.null_mean_cosine(_pairs(b), "pre", "composition")), "select avg((x.pa * y.a + x.pn * y.n + x.pr * y.r) / (sqrt(x.pa ** 2 + x.pn ** 2 + x.pr ** 2) * sqrt(y.a ** 2 + y.n ** 2 + y.r ** 2))) as null_mean from (select pv.* from pv join cp on cp.universe = pv.universe and cp.start_ = pv.d where pa is not null) x, (select cp.* from pv join cp on cp.universe = pv.universe and cp.start_ = pv.d where pa is not null) y", keys="", doubles="null_mean", ctes=CT)
add("in07_sign_flip_exact", on_base(lambda b: inference.sign_flip(b.filter("xa is not null").groupBy(F.year("d").alias("yr")).agg(F.avg("xa").alias("xa")), "xa")), "select any_value(m) as mean, avg((s / n >= m - 1e-12)::int) as p_value, any_value(n) as n from (select k, sum(case when (k >> cast(i as integer)) & 1 = 1 then xa else -xa end) as s from (select cast(range as integer) as k from range(0, (select 1 << count(*) from yx))), (select xa, row_number() over (order by yr) - 1 as i from yx) group by 1) z, (select avg(xa) as m, count(*) as n from yx) a", keys="", ints="n", doubles="mean,p_value", ctes="yx as (select year(d) as yr, avg(xa) as xa from b where xa is not null group by 1)")
add("in07_sign_flip", on_base(lambda b: inference.sign_flip(b.filter("xa is not null"), "xa")), None, keys="", ints="n", doubles="mean,p_value")
add("in07_episode_interval", on_base(lambda b: inference.episode_interval(_episodes(b), "mean_turb")), None, keys="", ints="n", doubles="mean,lo,hi")
add("in08_cluster_tests", on_base(lambda b: inference.cluster_interval(regimes.clusters(_episodes(b)).withColumn("c", F.concat("universe", F.col("cluster").cast("string"))), "mean_turb", "c")), None, keys="", ints="n", doubles="mean,lo,hi")
add("in08_t_test", on_base(lambda b: inference.t_test(b, ["universe"], "xa")), "select universe, count(xa) as n, avg(xa) as mean, avg(xa) / (stddev_samp(xa) / sqrt(count(xa))) as t from b group by 1", keys="universe", ints="n", doubles="mean,t")
add("in08_wilcoxon", on_base(lambda b: inference.wilcoxon(b.filter("xa is not null"), ["universe"], "xa")), "select universe, sum(case when xa > 0 then r else 0 end) as w_plus, count(*) as n from (select *, rank() over (partition by universe order by abs(xa)) + (count(*) over (partition by universe, abs(xa)) - 1) / 2.0 as r from b where xa is not null and xa <> 0) t group by 1", keys="universe", ints="n", doubles="w_plus")
add("in09_label_permutation", each_universe(lambda b, _: inference.label_permutation(b.filter("xa is not null").withColumn("g", F.col("pos") % 2 == 0), "xa", "g")), None, keys="universe", doubles="difference,p_value")
add("in10_spearman_interval", each_universe(lambda b, _: inference.bootstrap_spearman(b.filter("xa is not null"), "xa", "xn", 8)), None, keys="universe", doubles="observed,lo,hi")
add("in11_incremental_r2", each_universe(lambda b, _: inference.incremental_r2(b, "xa", ["xn"], ["xr"])), "select universe, ay * ay as r2_base, (ay * ay + az * az - 2 * ay * az * yz) / (1 - yz * yz) as r2_full, (ay * ay + az * az - 2 * ay * az * yz) / (1 - yz * yz) - ay * ay as r2_gain from (select universe, corr(xa, xn) as ay, corr(xa, xr) as az, corr(xn, xr) as yz from b where xa is not null and xn is not null and xr is not null group by 1) t", keys="universe", doubles="r2_base,r2_full,r2_gain")

# --- causality ------------------------------------------------------------------------------------------------------

add("ca02_granger_matrix", on_base(lambda b: causality.granger_matrix(b, X, 3)), None, keys="universe,causing,caused", doubles="p_value,max_f")
PV = "pv0 as (select universe, year(d) as yr, avg(abs(xa)) / (1 + avg(abs(xa))) as p from b where xa is not null group by 1, 2)"


def _pvals(b):
    return b.filter("xa is not null").groupBy("universe", F.year("d").alias("yr")).agg((F.avg(F.abs("xa")) / (1 + F.avg(F.abs("xa")))).alias("p"))


add("ca03_fisher", on_base(lambda b: causality.fisher(_pvals(b), ["universe"], "p")), "select universe, exp(-x / 2) * list_sum(list_transform(range(0, n), lambda j: power(x / 2, j) / factorial(cast(j as integer)))) as p_value_raw, n as n_episodes from (select universe, -2 * sum(ln(p)) as x, count(*) as n from pv0 group by 1) t", keys="universe", ints="n_episodes", doubles="p_value_raw", ctes=PV)
add("ca06_benjamini_hochberg", on_base(lambda b: causality.benjamini_hochberg(_pvals(b), ["universe"], "p").withColumn("sig", F.col("significant").cast("int"))), "select universe, yr, least(1, min(raw) over (partition by universe order by p desc rows unbounded preceding)) as p_value_adj from (select *, p * count(*) over (partition by universe) / row_number() over (partition by universe order by p) as raw from pv0) t", keys="universe", ints="yr", doubles="p_value_adj", ctes=PV)
add("ca04_regime_granger", on_base(lambda b: causality.regime_granger(b.withColumn("regime", (F.quarter("d") <= 2).cast("int")), X, "regime", 2, 10)), None, keys="universe,causing,caused", ints="regime,n_episodes", doubles="p_value_raw,p_value_adj")
add("ca05_drivers", on_base(lambda b: causality.drivers(b.withColumn("regime", (F.col("xa") > 0).cast("int")), X, "v", 3, "regime")), None, keys="universe,scope,factor", doubles="p_value_raw,p_value_adj")
add("ca07_max_f", on_base(lambda b: causality.max_f(b, "xa", "xn", 3)), None, keys="universe", doubles="max_f,p_value")
add("ca08_rewiring", on_base(lambda b: causality.rewiring(causality.regime_granger(b.withColumn("regime", (F.quarter("d") <= 2).cast("int")), X, "regime", 2, 10), "regime", 1, 0)), None, keys="universe,causing,caused", doubles="rank_high,rank_low,change")
add("ca09_partial_r2", on_base(lambda b: causality.partial_r2(b, X, "v", 3)), None, keys="universe,factor", doubles="partial_r2")
add("ca10_connectedness", on_base(lambda b: causality.connectedness(b, X)), None, keys="universe,factor", doubles="from_others,to_others,net,total")
add("ca11_event_grid_drivers", on_base(lambda b: causality.drivers(eventclock.on_event_grid(b.filter("v is not null"), "v", 0.5, X).withColumn("pos", F.col("event_id")), X, "mean_intensity", 2)), None, keys="universe,scope,factor", doubles="p_value_raw")
add("agg18_out_degree", on_base(lambda b: metrics.out_degree(causality.granger_matrix(b, X, 3).filter("p_value < 0.5"))), None, keys="causing", ints="out_degree")

# --- typology -------------------------------------------------------------------------------------------------------

add("ty01_composition", on_base(lambda b: typology.composition(_turb_wide(b), _episodes(b), X).select("universe", F.col("start").alias("start_d"), F.get("composition", F.lit(0)).alias("a"), F.get("composition", F.lit(1)).alias("n"))), "select universe, start_ as start_d, a, n from cp", keys="universe,start_d", doubles="a,n", ctes=CT)
add("ty02_driver_shares", lambda spark, sf: (lambda t: typology.driver_shares(t, _named(spark).drop("ord"), X))(_turb_wide(base(spark, sf)).filter("turbulence is not null")), "select universe, name, avg(ca) / avg(ca + cn + cr) * 100 as xa, avg(cn) / avg(ca + cn + cr) * 100 as xn, count(*) as n_days from tb join nm on d between start_ and end_ where ca is not null group by 1, 2", keys="universe,name", ints="n_days", doubles="xa,xn", ctes=_mom_sql(LB, True) + ", " + NAMED)
add("ty05_runup", on_base(lambda b: typology.at_starts(typology.runup(_turb_wide(b), X, 8), typology.composition(_turb_wide(b), _episodes(b), X)).filter("pre is not null").select("universe", "d", F.get("pre", F.lit(0)).alias("pa"), F.get("pre", F.lit(2)).alias("pr"))), "select pv.universe, pv.d, pa, pr from pv join cp on cp.universe = pv.universe and cp.start_ = pv.d where pa is not null", doubles="pa,pr", ctes=CT)
add("ty06_runup_event_clock", on_base(lambda b: typology.runup_event_clock(_turb_wide(b), _episodes(b), X, "turbulence", 10.0).select("universe", F.col("start").alias("start_d"), F.get("pre", F.lit(0)).alias("pa"), "n_rows")), None, keys="universe,start_d", ints="n_rows", doubles="pa")


def _ladder(b):
    t = _turb_wide(b)
    return typology.convergence_slopes(typology.ladder(t, typology.composition(t, _episodes(b), X), X, 8, 4, 3))


add("ty07_ladder_and_slopes", on_base(lambda b: _ladder(b).withColumnRenamed("start", "start_d")), None, keys="universe,start_d", doubles="c0,c1,c2,c3,uncond,slope")
add("ty09_placebo_dates", on_base(lambda b: typology.placebo_dates(b, _episodes(b), 10, 3)), None, ints="pos")
add("ty10_similarities", on_base(lambda b: _pairs(b).select("universe", "d", S.total_variation_similarity(F.col("pre"), F.col("composition")).alias("tv"), S.cosine(S.clr(F.col("pre")), S.clr(F.col("composition"))).alias("aitchison"), S.cosine(F.col("pre"), F.col("composition")).alias("cosine"))), "select pv.universe, pv.d, (pa * a + pn * n + pr * r) / (sqrt(pa ** 2 + pn ** 2 + pr ** 2) * sqrt(a ** 2 + n ** 2 + r ** 2)) as cosine from pv join cp on cp.universe = pv.universe and cp.start_ = pv.d where pa is not null", doubles="cosine", ctes=CT)
add("ty04_clusters", on_base(lambda b: typology.cluster_episodes(typology.composition(_turb_wide(b), _episodes(b), X), X).withColumnRenamed("start", "start_d")), None, keys="universe,start_d,name", ints="cluster,k", doubles="silhouette")

# --- relevance and learning -----------------------------------------------------------------------------------------


def _train(b):
    return relevance.Training.of(b.select("universe", "pos", *X, F.lead("v").over(S.series()).alias("nxt")), X, "nxt", ["universe", "pos"])


def _scores(b):
    t = _train(b)
    return relevance.scores(b.filter("xa is not null").withColumn("i", F.col("pos")), t, ["i"], t.x[0])


add("rb01_relevance", each_universe(lambda b, _: _scores(b)), None, keys="universe", ints="i", doubles="sim,inf")
# a universe is predicted from all others, so that no row sees its own outcome
add("rb03_softmax_predictions", each_universe(lambda b, others: relevance.predict(b.filter("xa is not null"), _train(others), "pos", None, 0.0, "exp")), None, keys="universe", ints="pos", doubles="prediction")
add("rb04_predictions", each_universe(lambda b, others: relevance.predict(b.filter("xa is not null"), _train(others), "pos", None, 0.5)), None, keys="universe", ints="pos", doubles="prediction")


def _cells(b):
    rows = b.select("pos", *X, F.lead("v").over(S.series()).alias("nxt"))
    return relevance.grid_cells(rows, X, "nxt", relevance.subsets(X, 6), (0.0, 0.5), 64, order=["pos"])


add("rb06_prediction_grid", each_universe(lambda b, _: _cells(b).withColumn("name", F.concat_ws(",", "subset"))), None, keys="universe,name", ints="n_eval", doubles="censor,adjusted_fit,mean_prediction")
add("rb07_importance", each_universe(lambda b, _: relevance.importance(_cells(b), X)), None, keys="universe,variable", doubles="rbi,tau")
add("rb09_stability", each_universe(lambda b, _: relevance.stability(relevance.importance(_cells(b), X).withColumn("win", F.lit(0)).unionByName(relevance.importance(_cells(b.filter("pos < 200")), X).withColumn("win", F.lit(1))), "win")), None, keys="universe", ints="i", doubles="tau")


def _xy(b):
    f = features.feature_matrix(b, "v", "fa", "fn")
    return f.select("universe", "d", "pos", "turb_lag1", "turb_ma21", "eq_vol_21", "eq_ret_ma5").join(forecasts(b).select("universe", "d", "y"), ["universe", "d"]), ["turb_lag1", "turb_ma21", "eq_vol_21", "eq_ret_ma5"]


def _quarters(spark):
    return splits.quarter_ends(spark, "1996-12-31", "1997-01-01", "2001-06-30")


def _refits(spark):
    return splits.quarter_ends(spark, "1998-12-31", "1999-01-01", "2001-06-30")


add("ml03_train_one", lambda spark, sf: (lambda b: (lambda df, cols: learning.train_one(df, cols, "logistic_l1", _folds(b), DEV_END)["oos"])(*_xy(b)))(base(spark, sf)), None, doubles="p")
add("ml01_registry_forest", lambda spark, sf: (lambda b: (lambda df, cols: learning.train_one(df, cols, "random_forest", None, DEV_END)["oos"])(*_xy(b)))(base(spark, sf)), None, doubles="p")
add("ml05_walk_forward", lambda spark, sf: (lambda df, cols: learning.walk_forward(df, cols, _refits(spark), ("random_forest", "logistic_l1", "elastic_net", "linear_svm"), 4, 104)[0])(*_xy(base(spark, sf))), None, keys="universe,d,model", doubles="p")
add("ml05_refit_log", lambda spark, sf: (lambda df, cols: learning.walk_forward(df, cols, _refits(spark), ("logistic_l1",), 4, 104)[1].withColumn("universe", F.col("scope")).withColumn("d", F.col("asof")))(*_xy(base(spark, sf))), None, ints="train_n,pred_n", doubles="train_positive_rate")
add("ml06_pooled", lambda spark, sf: (lambda df, cols: learning.walk_forward(S.one_hot(df, "universe", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "mkt_").withColumnRenamed("mkt_MIDDLE EAST", "mkt_ME"), [*cols, "mkt_AMERICA", "mkt_ASIA", "mkt_EUROPE", "mkt_ME"], _refits(spark), ("logistic_l1",), 4, 300, scope="pooled")[0])(*_xy(base(spark, sf))), None, doubles="p")
add("ml07_calibrated", lambda spark, sf: (lambda df, cols: learning.walk_forward(df, cols, _refits(spark), ("logistic",), 4, 104, 10, isotonic_map=True)[0])(*_xy(base(spark, sf))), None, doubles="p")
add("ml08_isotonic", on_base(lambda b: learning.calibrate_isotonic(*splits.dev_oos(forecasts(b).filter("p is not null and y is not null"), DEV_END))), None, doubles="calibrated")
add("ml09_cutoff_sweep", lambda spark, sf: (lambda df, cols: learning.cutoff_sweep(df, cols, splits.month_ends(spark, "1996-12-01", "2000-12-31"), _quarters(spark), ("random_forest", "logistic_l1"), 4, 52))(*_xy(base(spark, sf))), None, keys="universe,model,cutoff", ints="n,n_refits", doubles="auc,brier")
add("ml12_naive_baseline", on_base(lambda b: learning.naive_baseline(forecasts(b), ["universe"], "v")), "select universe, (sum(r) filter (y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)) as auc, n from (select *, rank() over (partition by universe order by v) + (count(*) over (partition by universe, v) - 1) / 2.0 as r, sum(y) over (partition by universe) as n1, count(*) over (partition by universe) as n from fc where y is not null and v is not null) t group by universe, n1, n", keys="universe", ints="n", doubles="auc", ctes=FC)
add("ml13_ablation", on_base(lambda b: learning.ablation(lambda q, window: regimes.threshold_regime(b, "v", q, window, MP, digits=9).groupBy("universe").agg(F.sum("regime").alias("hot")), {"q": 0.75, "window": LB}, {"q": (0.75, 0.9), "window": (LB, 52)}).withColumn("name", F.concat_ws("=", "knob", "value"))), " union all ".join(f"select universe, '{name}' as name, sum(regime) as hot from (select universe, {_regime_sql(q, window)} as regime from b) t group by 1" for name, q, window in (("base=", 0.75, LB), ("q=0.9", 0.9, LB), ("window=52", 0.75, 52))), keys="universe,name", ints="hot")
add("ml14_leave_one_out", lambda spark, sf: (lambda df, cols: learning.leave_one_out(lambda cs: learning.cutoff_sweep(df, cs, splits.month_ends(spark, "1996-12-01", "2000-12-31"), _quarters(spark), ("logistic_l1",), 4, 52), cols).withColumnRenamed("dropped", "name"))(*_xy(base(spark, sf))), None, keys="universe,name,cutoff", doubles="auc")

add("ml15_coefficients", lambda spark, sf: (lambda df, cols: learning.coefficients(learning.train_one(df, cols, "logistic_l1", None, DEV_END)["model"], cols).withColumnRenamed("feature", "variable"))(*_xy(base(spark, sf))), None, keys="variable", doubles="weight")

# --- blocks joined on the feature matrix, centroids -----------------------------------------------------------------


def _gmm_block(b):
    m = features.feature_matrix(b, "v", "fa", "fn", "fn", "fr")
    return features.gmm_features(m, b.withColumn("k", F.pmod("pos", F.lit(3)).cast("int")), "k", 3)


add("ft04_gmm_features", on_base(_gmm_block), f"select universe, d, lag(xa) {O}) as eq_ret_lag1, lag(pos % 3) {O}) as gmm_regime_lag1, case when count(pos) {O} {fr(21)} >= 10 then avg(pos % 3) {O} {fr(21)} end as gmm_regime_ma21, lag((pos % 3 = 1)::int) {O}) as gmm_k_1, lag((pos % 3 = 2)::int) {O}) as gmm_k_2 from b", doubles="eq_ret_lag1,gmm_regime_lag1,gmm_regime_ma21,gmm_k_1,gmm_k_2")


def _absorption_block(b):
    ratio = walkforward.absorption_ratio(vectors(b), X, 1, LB, MP, 4)
    shift = walkforward.absorption_shift(ratio.withColumnRenamed("refit_pos", "pos").filter("absorption is not null"), fast=5, slow=20)
    return features.absorption_features(features.feature_matrix(b, "v", "fa", "fn"), ratio, shift).filter("absorption is not null")


add("ft05_absorption_features", on_base(_absorption_block), None, doubles="turb_lag1,absorption,absorption_shift")
ET = ["et_intensity_to_date", "et_days_since_start", "et_velocity"]
add("ft06_event_block", on_base(lambda b: features.event_block(features.feature_matrix(b, "v", "fa", "fn").select("universe", "d", "pos", "eq_ret_lag1"), eventclock.event_features(b.filter("v is not null"), "v", "xa", 2.0, 6), ET)), None, doubles=",".join(["eq_ret_lag1", *ET]))
ORACLES["ft06_event_block"] = f"with {_base_sql(True)}, m as (select universe, strftime(d, '%Y-%m-%d') as d, round(lag(xa) {O}), 6) + 0.0 as eq_ret_lag1 from b) select m.universe, m.d, eq_ret_lag1, {', '.join(ET)} from m join ({ORACLES['seq07_event_features']}) e on e.universe = m.universe and e.d = m.d where eq_ret_lag1 is not null and {' and '.join(c + ' is not null' for c in ET)}"
QUERIES["agg05_centroids"] = lambda spark, sf: metrics.centroids(load(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")), ["label", "dim"], "x").select(F.col("label").cast("long").alias("label"), F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("centroid"), "n")
ORACLES["agg05_centroids"] = "select cast(label as bigint) as label, cast(dim as bigint) as dim, round(avg(x), 6) as centroid, count(*) as n from (select label, unnest(range(0, len(embedding))) as dim, cast(unnest(embedding) as double) as x from embeddings) t group by 1, 2"

# --- the panel that grows with the tables: a universe is a supplier, a row a month -----------------------------------

add("gp01_windows", on_suppliers(lambda b: (lambda w: b.select("universe", "d", W.mean(F.col("v"), W.Frame(12, 10, 1), w).alias("m"), W.zscore(F.col("v"), W.Frame(24, 12, 1), w).alias("z"), W.drawdown_from_high(F.col("fa"), W.Frame(24, 10, 1), w).alias("dd")))(S.series())), f"select universe, d, case when count(v) {O} {fr(12)} >= 10 then avg(v) {O} {fr(12)} end as m, case when count(v) {O} {fr(24)} >= 12 and stddev_pop(v) {O} {fr(24)} > 0 then (lag(v) {O}) - avg(v) {O} {fr(24)}) / stddev_pop(v) {O} {fr(24)} end as z, case when count(fa) {O} {fr(24)} >= 10 then ln(lag(fa) {O}) / max(fa) {O} {fr(24)}) end as dd from b", doubles="m,z,dd", region="supplier")
add("gp02_turbulence", on_suppliers(lambda b: walkforward.turbulence(vectors(b), X, 48, MP, "ledoit-wolf", 1, flip=("xr",)).filter("turbulence is not null")), "select universe, d, ca + cn + cr as turbulence, shrinkage from tb where ca is not null", doubles="turbulence,shrinkage", digits=5, ctes=_mom_sql(48, True), region="supplier")
add("gp03_auc", on_suppliers(lambda b: metrics.roc_auc(forecasts(b), ["universe"])), "select universe, (sum(r) filter (y = 1) - n1 * (n1 + 1) / 2.0) / nullif(n1 * (n - n1), 0) as auc, n from (select *, rank() over (partition by universe order by p) + (count(*) over (partition by universe, p) - 1) / 2.0 as r, sum(y) over (partition by universe) as n1, count(*) over (partition by universe) as n from fc where y is not null and p is not null) t group by universe, n1, n", keys="universe", ints="n", doubles="auc", ctes=FC, region="supplier")
def _rising(b):
    """Whether the next month's intensity is higher."""
    df, cols = _xy(b)
    up = b.select("universe", "d", (F.lead("v").over(S.series()) > F.col("v")).cast("int").alias("y"))
    return df.drop("y").join(up, ["universe", "d"]), cols


add("gp04_walk_forward", lambda spark, sf: (lambda df, cols: learning.walk_forward(df, cols, _refits(spark), ("logistic_l1",), 4, 30, 5)[0])(*_rising(base(spark, sf, by_supplier=True))), None, doubles="p")

# --- stream tables --------------------------------------------------------------------------------------------------

E5 = ("click", "purchase", "signup", "view", "error")
add("sx01_windowed_counts", lambda spark, sf: online.windowed_counts(load(spark, sf, "events").withColumn("units", F.round(F.col("value") * 10000).cast("long")), "units").select(F.col("event_type").alias("kind"), F.date_format("start", "yyyy-MM-dd HH:mm").alias("label"), "n", "total"), "select event_type as kind, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as label, count(*) as n, sum(cast(round(value * 10000) as bigint)) as total from events group by 1, 2", keys="kind,label", ints="n,total")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["wf01_turbulence_top_weeks"](spark, sf)


__all__ = ["QUERIES", "ORACLES", "entry", "Window", "online"]
