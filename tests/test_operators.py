"""Causality, identities and hand-computed cases of the operators on small seeded panels."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gustline.functions import scalars
from gustline.operators import causality, eventclock, features, inference, learning, metrics, regimes, relevance, splits, typology, walkforward
from gustline.plans import panel


def days(n):
    return [d.date() for d in pd.bdate_range("2015-01-01", periods=n)]


def frame(spark, n=160, k=3, seed=0, universe="u"):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.01, (n, k))
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(k)])
    pdf.insert(0, "pos", np.arange(n))
    pdf.insert(0, "d", days(n))
    pdf.insert(0, "universe", universe)
    return spark.createDataFrame(pdf), x


def series(spark, values, name="v"):
    rows = [("u", d, i, None if v is None else float(v)) for i, (d, v) in enumerate(zip(days(len(values)), values))]
    return spark.createDataFrame(rows, f"universe string, d date, pos int, {name} double")


def column(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).collect()]


def ledoit_wolf(x):
    n, k = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / k
    delta = ((s - mu * np.eye(k)) ** 2).sum() / k
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n**2 / k, delta)
    return (1 - beta / delta) * s + beta / delta * mu * np.eye(k)


def test_turbulence_matches_direct_fit_and_sums(spark):
    df, x = frame(spark)
    t = walkforward.turbulence(panel.to_vectors(df, ["f0", "f1", "f2"]), ["f0", "f1", "f2"], 60, 30, flip=("f2",)).orderBy("pos").toPandas()
    assert t["turbulence"][:30].isna().all()
    for r in (40, 90, 159):
        w = x[max(0, r - 60) : r]
        delta = x[r] - w.mean(0)
        assert np.isclose(t["turbulence"][r], delta @ np.linalg.solve(ledoit_wolf(w), delta), rtol=1e-9)
        assert np.isclose(np.sum(t["contributions"][r]), t["turbulence"][r])
        assert np.isclose(t["turb_loss"][r] + t["turb_gain"][r], t["turbulence"][r])


def test_turbulence_is_causal_and_independent_of_partitions(spark):
    df, x = frame(spark)
    names = ["f0", "f1", "f2"]
    base = column(walkforward.turbulence(panel.to_vectors(df, names), names, 60, 30), "turbulence")
    shocked = df.toPandas()
    shocked.loc[120:, names] *= 50
    again = column(walkforward.turbulence(panel.to_vectors(spark.createDataFrame(shocked).repartition(7), names), names, 60, 30), "turbulence")
    assert np.allclose(np.array(base[30:120]), np.array(again[30:120]), rtol=1e-8)


def test_smoother_hand_cases(spark):
    run = lambda xs, m: column(regimes.smooth_min_duration(series(spark, xs, "x"), "x", m), "smoothed")
    assert run([0, 0, 1, 1, 1, 1, 1, 0, 0], 5) == [0, 0, 0, 0, 0, 0, 1, 1, 1]
    assert run([0, 0, None, 1, 1, 1, 1, 1], 3) == [0, 0, None, 0, 0, 1, 1, 1]


def test_event_clock_hand_cases(spark):
    e = eventclock.events(series(spark, [1] * 50), "v", 5).toPandas()
    assert len(e) == 10 and (e["trading_days_in_event"] == 5).all() and (e["cumulative_intensity"] == 5).all()
    e = eventclock.events(series(spark, [1, 2, 4, 8, 16]), "v", 3).orderBy("event_id").toPandas()
    assert e["trading_days_in_event"].tolist() == [2, 1, 1, 1]
    assert eventclock.events(series(spark, []), "v", 3).count() == 0
    with pytest.raises(ValueError):
        eventclock.check_intensity(series(spark, [1, -1]), "v")


def test_event_features_fill(spark):
    df = series(spark, [1, 1, 1, 1]).selectExpr("*", "0.0D as r")
    assert np.allclose(column(eventclock.event_features(df, "v", "r", 3, 2), "et_intensity_to_date"), [1 / 3, 2 / 3, 1, 1 / 3])


def test_entry_target_hand_case(spark):
    y = column(features.turbulence_entry(series(spark, [1, 1, 1, 1, 5, 1, 1, 1]), "v", 4, 3), "y")
    assert y[1:5] == [1, 1, 1, 0] and y[-1] is None


def test_episodes_find_planted_spikes(spark):
    rng = np.random.default_rng(1)
    v = rng.gamma(2, 5, 700)
    v[400:420] *= 30
    e = regimes.episodes(series(spark, v), "v", 0.9, 252, 126).toPandas()
    peak = e.loc[e["peak_turb"].idxmax()]
    assert peak["start"] <= days(700)[403] and peak["end"] >= days(700)[418]


def test_weekdays_between(spark):
    from pyspark.sql import functions as F

    rows = [(dt.date(2024, 1, a), dt.date(2024, 1, b)) for a in range(1, 15) for b in range(a, 29)]
    got = spark.createDataFrame(rows, "a date, b date").withColumn("n", regimes.weekdays_between(F.col("a"), F.col("b"))).collect()
    assert all(r["n"] == np.busday_count(r["a"], r["b"]) for r in got)


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("b", 1, 0.2)], "g string, y int, p double")
    got = {r["g"]: r["auc"] for r in metrics.roc_auc(df, ["g"]).collect()}
    assert got == {"a": 0.75, "b": None}


def test_kendall_equals_all_pairs(spark):
    rng = np.random.default_rng(11)
    rows = [(u, i, None if rng.random() < 0.05 else float(rng.integers(0, top)), None if rng.random() < 0.05 else float(rng.integers(0, top))) for u, n, top in (("a", 90, 7), ("b", 80, 10**6), ("c", 2, 5), ("d", 1, 5), ("e", 9, 1)) for i in range(n)]
    got = {r["universe"]: r["tau"] for r in metrics.kendall(spark.createDataFrame(rows, "universe string, pos int, a double, b double"), ["universe"], "pos", "a", "b").collect()}
    for u in "abce":
        sign = lambda p, q: np.nan if p is None or q is None else np.sign(p - q)
        s = np.array([(sign(x[2], y[2]), sign(x[3], y[3])) for x in rows for y in rows if x[0] == y[0] == u and x[1] < y[1]], float)
        na, nb = np.nansum(abs(s[:, 0])), np.nansum(abs(s[:, 1]))
        assert got[u] == pytest.approx(np.nansum(s[:, 0] * s[:, 1]) / (na * nb) ** 0.5) if na and nb else got[u] is None
    assert "d" not in got


def test_queries_take_every_row(spark, sf):
    from gustline import queries as q

    sf = sf.replace("sf0.001", "sf0.01")
    b = q.base(spark, sf).filter("xa is not null").selectExpr("universe", "pos", "year(d) yr", "xa", "xn").toPandas()
    tau = {r["universe"]: r["tau"] for r in q.QUERIES["agg07_kendall"](spark, sf).collect()}
    for u, g in b.groupby("universe"):
        s = np.sign(g["xa"].to_numpy()[:, None] - g["xa"].to_numpy()) * np.sign(g["xn"].to_numpy()[:, None] - g["xn"].to_numpy())
        assert len(g) > 60 and tau[u] == pytest.approx(s.sum() / (len(g) * (len(g) - 1)), abs=1e-6)
    assert q.QUERIES["in07_sign_flip_exact"](spark, sf).first()["n"] == b["yr"].nunique()
    rows = [(r["universe"], r["i"]) for r in q.QUERIES["rb01_relevance"](spark, sf).collect()]
    assert sorted(rows) == sorted(zip(b["universe"], b["pos"])) and len(rows) > 10


def test_alignments_take_every_row(spark, sf):
    from gustline import queries as q

    sf = sf.replace("sf0.001", "sf0.01")
    b = q.base(spark, sf).select("v", "xa", "xn").toPandas()
    n = {x: q.QUERIES[x](spark, sf).count() for x in ("jn01_inner_align", "jn03_outer_align", "jn04_left_on_spine", "jn05_coalesce_sources")}
    l, r = b["v"] > 0.2, b["xa"] > 0  # noqa: E741
    assert list(n.values()) == [(l & r).sum(), (l | r).sum(), len(b), (l | r).sum()]
    assert sum(x["n"] for x in q.QUERIES["flt01_complete_rows"](spark, sf).collect()) == len(b.dropna())


def test_queries_take_every_universe(spark, sf):
    from gustline import queries as q

    b = q.base(spark, sf).filter("xa is not null").select("universe", "pos", "v", "xa", "xn").toPandas()
    names = set(b["universe"])
    assert len(names) == 5
    for name in ("in02_block_bootstrap", "in03_stationary_bootstrap", "in05_mean_difference", "in09_label_permutation", "in10_spearman_interval", "in11_incremental_r2", "rb06_prediction_grid", "rb07_importance", "rb09_stability"):
        assert {r["universe"] for r in q.QUERIES[name](spark, sf).collect()} == names, name
    rows = [(r["universe"], r["pos"]) for r in q.QUERIES["rb04_predictions"](spark, sf).collect()]
    assert sorted(rows) == sorted(zip(b["universe"], b["pos"]))


def test_purged_folds_keep_their_distance(spark):
    f = splits.purged_folds(spark.createDataFrame([("u", 1000)], "universe string, n int"), 5, 21, 10, 100).toPandas()
    assert ((f["test_lo"] - f["train_hi"]) == 31).all() and f["test_hi"].max() == 1000
    with pytest.raises(ValueError):
        splits.guard(series(spark, [1, 2, 3]), "2015-01-01")


def test_granger_finds_the_leader(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    y = 0.6 * np.roll(x, 1) + 0.2 * rng.normal(size=400)
    pdf = pd.DataFrame({"universe": "u", "pos": np.arange(400), "x": x, "y": y})
    got = {(r["causing"], r["caused"]): r["p_value"] for r in causality.granger_matrix(spark.createDataFrame(pdf), ["x", "y"], 2).collect()}
    assert got["x", "y"] < 1e-10 < 1e-4 < got["y", "x"]


def test_connectedness_shares(spark):
    rng = np.random.default_rng(3)
    t = causality.gfevd(rng.normal(size=(500, 3)))
    assert np.allclose(t.sum(1), 1) and (np.diag(t) > 0.9).all()


def test_ward_and_silhouette_recover_two_groups():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.1, (12, 4)), rng.normal(3, 0.1, (12, 4))])
    labels = typology.cut_tree(typology.ward(x), 24, 2)
    assert len(set(labels[:12])) == 1 and len(set(labels[12:])) == 1 and labels[0] != labels[12]
    assert typology.silhouette(x, labels) > 0.9


def test_permutation_and_its_mean(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1, 1, 1], 30)
    df = spark.createDataFrame([(a.tolist(), a.tolist()) for a in p], "pre array<double>, real array<double>")
    r = inference.permutation_cosine(df, "pre", "real", 300).first()
    m = inference.null_mean_cosine(df, "pre", "real").first()[0]
    assert r["observed"] > 0.999 and r["p_value"] < 0.05 and abs(m - r["null_mean"]) < 0.02


def test_replicates_do_not_depend_on_partitions(spark):
    df = series(spark, np.random.default_rng(6).normal(size=200)).selectExpr("d", "v as a", "v * 0.5 as b")
    one = inference.bootstrap_difference(df, "a", "b", n=100, block=10).first()
    two = inference.bootstrap_difference(df.repartition(5), "a", "b", n=100, block=10).first()
    assert one == two


def test_isotonic_and_permutation_alignment():
    f = learning.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.allclose(f(np.array([1.0, 2, 3, 4])), [0, 0.5, 0.5, 1])
    m = np.eye(4)
    assert walkforward.best_permutation(m, m[[2, 0, 3, 1]]) == [2, 0, 3, 1]


def test_relevance_importance_finds_the_signal(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 3))
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, x[:, 0]]), columns=["a", "b", "c", "y"]))
    cells = relevance.grid_cells(df, ["a", "b", "c"], "y", relevance.subsets(["a", "b", "c"], 4), (0.0, 0.5), 40)
    assert relevance.importance(cells, ["a", "b", "c"]).first()["variable"] == "a"


def test_walk_forward_never_trains_on_the_future(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=n)
    pdf = pd.DataFrame({"universe": "u", "d": days(n), "pos": np.arange(n), "x": x, "y": (x + rng.normal(size=n) > 0).astype(float)})
    refits = spark.createDataFrame([(days(n)[200],), (days(n)[300],)], "asof date")
    pred, log = learning.walk_forward(spark.createDataFrame(pdf), ["x"], refits, purge=21, min_train=100)
    assert pred.count() == n - 201
    for r in log.collect():
        assert days(n).index(r["asof"]) - days(n).index(r["train_end"]) >= 21
    assert metrics.roc_auc(pred, ["model"]).first()["auc"] > 0.7


def test_streaming_clock_equals_batch(spark, tmp_path):
    from gustline.streaming import online

    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"universe": "u", "ts": pd.date_range("2024-01-01", periods=80, freq="h"), "v": rng.random(80)})
    spark.createDataFrame(pdf.iloc[:50]).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(pdf.iloc[50:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("universe string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    online.run_once(online.event_clock(src, "v", 3.0), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").toPandas()
    s, e = eventclock.absorb(pdf["v"].to_numpy(), 3.0)
    assert got["n_rows"].tolist() == (e - s + 1).tolist()


def _stream(spark, tmp_path, rows, schema, parts):
    """A stream that reads ``rows`` in as many files, one a batch."""
    for k, some in enumerate(parts):
        spark.createDataFrame([rows[i] for i in some], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streaming_smoother_equals_batch(spark, tmp_path):
    from gustline.streaming import online

    r = np.random.default_rng(10)
    at = pd.date_range("2024-01-01", periods=60, freq="D")
    rows = [(u, t.to_pydatetime(), None if r.random() < 0.1 else int(r.random() < 0.5)) for u in ("a", "b") for t in at]
    parts = [[i for i in range(120) if i % 60 < 25], [i for i in range(120) if i % 60 >= 25]]
    src = _stream(spark, tmp_path, rows, "universe string, ts timestamp, x int", parts)
    online.run_once(online.smoother(src, "x", 3), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(g["universe"], g["ts"]): g["smoothed"] for g in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame([(u, t.date(), x) for u, t, x in rows], "universe string, d date, x int").withColumn("pos", F.datediff("d", F.lit("2024-01-01")))
    want = {(g["universe"], dt.datetime.combine(g["d"], dt.time())): g["smoothed"] for g in regimes.smooth_min_duration(batch, "x", 3).collect()}
    assert len(got) == 120 and got == want


def test_streaming_windows_and_sessions(spark, tmp_path):
    from gustline.streaming import online

    start = dt.datetime(2024, 1, 1)
    hours = [0, 0.2, 0.9, 1.5, 6, 6.5, 0.5, 30, 60]  # the seventh comes last but one, when its window is closed
    rows = [("u", start + dt.timedelta(hours=h), "click", k) for k, h in enumerate(hours)]
    src = _stream(spark, tmp_path, rows, "universe string, ts timestamp, event_type string, n long", [[0, 1, 2, 3], [4, 5], [7], [6], [8]])
    online.run_once(online.windowed_counts(src, "n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {int((g["start"] - start).total_seconds() // 3600): (g["n"], g["total"]) for g in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (3, 3), 1: (1, 3), 6: (2, 9), 30: (1, 7)}  # the last window is still open
    online.run_once(online.sessions(src.drop("n"), "2 hours", "1 hour"), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    got = {int((g["start"] - start).total_seconds() // 3600): (g["n"], (g["end"] - start).total_seconds() / 3600) for g in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert got == {0: (4, 3.5), 6: (2, 8.5), 30: (1, 32.0)}


def test_io_round_trip(spark, tmp_path):
    from gustline.sources import io

    df = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "k string, x double")
    for suffix in ("parquet", "csv", "json"):
        io.write(df, f"{tmp_path}/t.{suffix}")
        assert sorted((r["k"], r["x"]) for r in io.read_any(spark, f"{tmp_path}/t.{suffix}").collect())[0] == ("a", 1.5)
    assert io.read_parquet(spark, f"{tmp_path}/t.parquet").filter("x is null").count() == 1


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_forest_learns_keeps_its_limits_and_repeats():
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no linear model sees it
    f = learning.Forest(x[:600], y[:600], trees=100)
    assert learning._auc(y[600:], f.predict(x[600:])) > 0.9
    assert np.array_equal(f.predict(x), learning.Forest(x[:600], y[:600], trees=100).predict(x))
    assert (learning.Forest(x[:39], y[:39], trees=5).feature == -1).all()  # two leaves of 20 do not fit
    # a depth of one: each tree is the best of the tried splits over its drawn rows
    g = learning.Forest(x[:, :1], (x[:, 0] > 0.5).astype(float), trees=20, depth=1)
    assert (g.feature[:, 0] == 0).all() and all(abs(g.edges[0][c] - 0.5) < 0.1 for c in g.cut[:, 0])


def test_calibrated_svm_gives_probabilities():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 2))
    true = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (r.random(3000) < true).astype(float)
    p = learning.calibrated_svm(x[:2000], y[:2000], x[2000:])
    assert np.abs(p - true[2000:]).mean() < 0.05
    raw = r.normal(size=4000)
    a, b = learning.fit_sigmoid(raw, (r.random(4000) < 1 / (1 + np.exp(-(3 * raw - 1)))).astype(float))
    assert abs(a - 3) < 0.3 and abs(b + 1) < 0.2
    assert np.isfinite(learning.calibrated_svm(x[:5], np.array([1.0, 0, 0, 0, 0]), x[:5])).all()


def _supervised(spark, n=900, k=2):
    r = np.random.default_rng(5)
    days = pd.bdate_range("2015-01-01", periods=n)
    rows = []
    for u in range(k):
        x = r.normal(size=(n, 2))
        y = (x[:, 0] + 0.3 * r.normal(size=n) > 0).astype(float)
        y[-5:] = np.nan
        rows += [(f"u{u}", d.date(), float(a), float(b), None if np.isnan(t) else float(t)) for d, (a, b), t in zip(days, x, y)]
    return spark.createDataFrame(rows, "universe string, d date, x1 double, x2 double, y double"), days


@pytest.mark.parametrize("calendar", [False, True])
def test_walk_forward_equals_a_loop_over_refits(spark, calendar):
    df, days = _supervised(spark)
    asofs = [days[300].date(), days[420].date(), days[700].date()]
    refits = spark.createDataFrame([(a,) for a in asofs], "asof date")
    models = ("random_forest", "logistic_l1", "elastic_net", "linear_svm")
    got, log = learning.walk_forward(df.repartition(5), ["x1", "x2"], refits, models, 21, 100, calendar_compat=calendar)
    got = got.toPandas()
    pdf = df.toPandas().sort_values(["universe", "d"])
    assert len(got) == 2 * 4 * (900 - 301)
    for u in ("u0", "u1"):
        own = pdf[pdf["universe"] == u].reset_index(drop=True)
        for k, a in enumerate(asofs):
            at = own.index[own["d"] == a][0]
            train = own[(own["d"] < a - pd.Timedelta(days=21)) if calendar else own.index <= at - 21]
            train = train[train["y"].notna()]
            block = own[(own["d"] > a) & ((own["d"] <= asofs[k + 1]) if k + 1 < len(asofs) else True)]
            for m in models:
                want = learning.predict_small(m, train[["x1", "x2"]].to_numpy(), train["y"].to_numpy(), block[["x1", "x2"]].to_numpy())
                mine = got[(got["universe"] == u) & (got["model"] == m) & got["d"].isin(block["d"])].sort_values("d")
                assert np.allclose(mine["p"], want)
    log = log.toPandas()
    assert len(log) == 2 * 4 * 3 and (pd.to_datetime(log["train_end"]) < pd.to_datetime(log["asof"])).all()


def test_cutoff_sweep_refits_after_each_cutoff(spark, tmp_path):
    df, days = _supervised(spark)
    refits = spark.createDataFrame([(days[i].date(),) for i in (360, 480, 600, 720)], "asof date")
    cuts = [days[300].date(), days[500].date(), days[880].date()]
    sweep = lambda: learning.cutoff_sweep(df.repartition(4), ["x1", "x2"], spark.createDataFrame([(c,) for c in cuts], "cutoff date"), refits, ("logistic_l1",), 21, 100)
    got = {(r["universe"], r["cutoff"]): r for r in sweep().collect()}
    assert {c for _, c in got} == set(cuts[:2])  # too little is left after the last
    assert got["u0", cuts[0]]["n_refits"] == 5 and got["u0", cuts[1]]["n_refits"] == 3
    for c in cuts[:2]:
        later = [(c,), *[(r["asof"],) for r in refits.collect() if r["asof"] > c]]
        one = learning.walk_forward(df, ["x1", "x2"], spark.createDataFrame(later, "asof date"), ("logistic_l1",), 21, 100)[0].filter("y is not null").toPandas()
        for u, g in one.groupby("universe"):
            assert got[u, c]["n"] == len(g) and np.isclose(got[u, c]["brier"], ((g["p"] - g["y"]) ** 2).mean())
            assert np.isclose(got[u, c]["auc"], learning._auc(g["y"].to_numpy(), g["p"].to_numpy()))
    calls = []
    make = lambda: (calls.append(1), sweep())[1]
    first = learning.cached_sweep(str(tmp_path), {"purge": 21}, make, spark).collect()
    again = learning.cached_sweep(str(tmp_path), {"purge": 21}, make, spark).collect()
    assert len(calls) == 1 and sorted(first) == sorted(again)
    learning.cached_sweep(str(tmp_path), {"purge": 5}, make, spark)
    assert len(calls) == 2


def test_prediction_grid_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 3))
    pdf = pd.DataFrame({"universe": "u", "pos": np.arange(300), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": x @ np.array([1, -0.5, 0.25])})
    df = spark.createDataFrame(pdf)
    cells = lambda d: sorted(map(tuple, relevance.grid_cells(d, ["a", "b", "c"], "y", relevance.subsets(["a", "b", "c"], 4), (0.0, 0.5), 64, order=["universe", "pos"]).select("subset_id", "censor", "adjusted_fit", "mean_prediction", "n_eval").collect()))
    assert cells(df) == cells(df.repartition(7)) == cells(df.orderBy(F.rand(3)).repartition(3))
    # one cell by hand
    t = relevance.Training.of(df.repartition(5), ["a", "b", "c"], "y", ["universe", "pos"])
    assert np.array_equal(t.x, x)
    xt, inv = x[0], np.linalg.pinv(np.cov(x.T))
    want = [0.5 * (v - x.mean(0)) @ inv @ (v - x.mean(0)) - 0.5 * (v - xt) @ inv @ (v - xt) for v in x]
    assert np.allclose(relevance.relevance(t, xt), want)


def test_normal_distribution_function(spark):
    import math

    z = [-38.0, -9.0, -3.5355339, -3.5, -1.0, -1e-9, 0.0, 0.3, 2.0, 3.6, 8.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(scalars.normal_cdf(F.col("z"))).collect()]
    assert got[-1] is None and all(math.isclose(g, 0.5 * math.erfc(-x / math.sqrt(2)), rel_tol=1e-10) for g, x in zip(got[:-1], z[:-1]))


def test_blocks_joined_on_the_feature_matrix(spark):
    days = pd.bdate_range("2020-01-01", periods=30)
    m = spark.createDataFrame([("u", d.date(), i, 1.0 * i, 2.0, 3.0) for i, d in enumerate(days)], "universe string, d date, pos int, turb_lag1 double, regime_ma21 double, eq double")
    labels = m.select("universe", "d", "pos", (F.col("pos") % 3).alias("k"))
    got = features.gmm_features(m, labels, "k", 3).orderBy("pos").collect()
    assert set(got[0].asDict()) == {"universe", "d", "pos", "eq", "gmm_regime_lag1", "gmm_regime_ma21", "gmm_k_1", "gmm_k_2"}
    assert got[0]["gmm_regime_lag1"] is None and [g["gmm_regime_lag1"] for g in got[1:5]] == [0, 1, 2, 0] and [g["gmm_k_2"] for g in got[1:5]] == [0, 0, 1, 0]
    assert got[9]["gmm_regime_ma21"] is None and got[10]["gmm_regime_ma21"] == np.mean([i % 3 for i in range(10)])
    ev = labels.select("universe", "d", F.when(F.col("pos") > 4, F.col("pos") * 2.0).alias("et"))
    assert [r["et"] for r in features.event_block(m, ev, ["et"]).orderBy("pos").collect()] == [2.0 * i for i in range(5, 30)]
    with pytest.raises(ValueError):
        features.correction_label(F.lit(-0.1), 1.5)


def test_average_precision_without_positives(spark):
    rows = [("a", 0, 0.2), ("a", 0, 0.7), ("b", 1, 0.9), ("b", 0, 0.5), ("b", 1, 0.4), ("b", None, 0.8)]
    got = {r["universe"]: r["average_precision"] for r in metrics.average_precision(spark.createDataFrame(rows, "universe string, y int, p double"), ["universe"]).collect()}
    assert np.isnan(got["a"]) and np.isclose(got["b"], (1 + 2 / 3) / 2)


@pytest.mark.parametrize("label", [0, 1])
@pytest.mark.parametrize("name", ["logistic_l1", "random_forest", "linear_svm"])
def test_training_on_one_class(spark, name, label):
    df, _ = frame(spark, 120)
    df = df.withColumn("y", F.when(F.col("pos") < 80, label).otherwise(F.col("pos") % 2))
    end = str(days(80)[-1])
    folds = spark.createDataFrame([("u", 1, 20, 40, 60)], "universe string, fold int, train_hi int, test_lo int, test_hi int")
    got = learning.train_one(df, ["f0", "f1"], name, folds, end, trees=5)
    out = got["oos"].orderBy("pos").toPandas()
    assert list(out["pos"]) == list(range(80, 120)) and (out["p"] == label).all() and got["cv"] is None
    assert [(r["feature"], r["weight"]) for r in learning.coefficients(got["model"], ["f0", "f1"]).collect()] == [("f0", 0.0), ("f1", 0.0)]
    with pytest.raises(ValueError):
        learning.train_one(df, ["f0", "f1"], name, None, "1999-12-31")


def test_events_where_none_closes(spark):
    quiet, busy = series(spark, [0.1, None, 0.1]), series(spark, [2, 2]).withColumn("universe", F.lit("b"))
    assert eventclock.events(quiet, "v", 3).collect() == []
    assert eventclock.events(series(spark, [None, None]), "v", 3).collect() == []
    got = eventclock.events(quiet.unionByName(busy), "v", 3).collect()
    assert [(r["universe"], r["start_date"], r["end_date"], r["trading_days_in_event"], r["cumulative_intensity"]) for r in got] == [("b", days(2)[0], days(2)[1], 2, 4.0)]


def test_training_computes_its_input_once(spark):
    """However many fits and scores read them, rows and folds are made once."""
    df, _ = frame(spark, 120)
    df = df.withColumn("y", F.col("pos") % 2)
    folds = spark.createDataFrame([("u", 1, 20, 40, 60), ("u", 2, 40, 60, 80)], "universe string, fold int, train_hi int, test_lo int, test_hi int")
    made = {n: spark.sparkContext.accumulator(0) for n in ("rows", "folds")}

    def counted(table, name):
        def count(batches):
            for pdf in batches:
                made[name].add(len(pdf))
                yield pdf

        return table.mapInPandas(count, table.schema)

    got = learning.train_one(counted(df, "rows"), ["f0", "f1"], "logistic_l1", counted(folds, "folds"), str(days(80)[-1]))
    assert got["cv"].count() == 2 and got["oos"].count() == 40
    assert {n: a.value for n, a in made.items()} == {"rows": 120, "folds": 2}
