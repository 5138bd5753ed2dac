import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import days
from varloom.operators import calibration as cal, confidence_set as cs, coverage as cv, scoring as sc, significance as sg, verdicts as vd, verification as vf


def diffs(board, pairs=(("good", "bad"), ("bad", "good"), ("good", "mid"))):
    return sg.pair_losses(board, list(pairs))


def test_leaderboard_orders_models(board):
    got = sc.leaderboard(board).orderBy("rank").toPandas()
    assert list(got.model) == ["good", "mid", "bad"]


def test_dm_is_antisymmetric_and_matches_numpy(board):
    got = sg.diebold_mariano(diffs(board)).toPandas().set_index(["model_a", "model_b"])
    ab, ba = got.loc[("good", "bad")], got.loc[("bad", "good")]
    assert ab.dm_stat == pytest.approx(-ba.dm_stat) and ab.p_value == pytest.approx(ba.p_value) and ab.better == "good"
    d = diffs(board, [("good", "bad")]).orderBy("date").toPandas().d.to_numpy()
    n, e = len(d), d - d.mean()
    lag = int(np.floor(n ** (1 / 3) + 1e-9))
    lrv = (e * e).mean() + sum(2 * (1 - k / (lag + 1)) * (e[k:] * e[:-k]).mean() for k in range(1, lag + 1))
    assert ab.dm_stat == pytest.approx(d.mean() / np.sqrt(lrv / n) * np.sqrt((n - 1) / n))


def test_lag_zero_identity_of_conditional_test(board):
    got = sg.gw_lagged_difference(diffs(board)).first()
    assert got["gw_uncentred"] == pytest.approx(got["gw_stat"] / (1 + got["gw_stat"] / got["n"]))


def test_regime_test_matches_dense_quadratic_form(spark, board):
    lagged = spark.createDataFrame([("X", d, int(i) % 3) for i, d in enumerate(days(400))], "asset string, date date, state int")
    rows = diffs(board, [("good", "mid")])
    got = sg.gw_regime(rows, lagged).first()
    pdf = rows.join(lagged, ["asset", "date"]).orderBy("date").toPandas()
    z = np.eye(3)[pdf.state] * pdf.d.to_numpy()[:, None]
    m = z.mean(0)
    assert got["gw_uncentred"] == pytest.approx(len(z) * m @ np.linalg.solve(z.T @ z / len(z), m))
    c = z - m
    assert got["gw_stat"] == pytest.approx(len(z) * m @ np.linalg.solve(c.T @ c / len(z), m))
    per = sg.per_regime_pairs(rows, lagged, ("a", "b", "c")).toPandas()
    assert per.n.sum() == len(pdf)


def test_dead_state_leaves_statistic_undefined(spark, board):
    lagged = spark.createDataFrame([("X", d, i % 2) for i, d in enumerate(days(400))], "asset string, date date, state int")
    assert sg.gw_regime(diffs(board), lagged).first()["gw_stat"] is None


def test_autocorrelation_and_portmanteau(board):
    acov = sg.autocovariances(diffs(board, [("good", "bad")]), "d", sg.PAIR, lags=30)
    d = diffs(board, [("good", "bad")]).orderBy("date").toPandas().d.to_numpy()
    e = d - d.mean()
    r = np.array([(e[k:] * e[:-k]).sum() / (e @ e) for k in range(1, 21)])
    assert np.allclose(sg.sample_acf(acov).orderBy("lag").toPandas().acf, r)
    n = len(d)
    q = n * (n + 2) * np.cumsum(r**2 / (n - np.arange(1, 21)))
    assert np.allclose(sg.ljung_box(acov).orderBy("lag").toPandas().lb_stat, q[[4, 9, 19]])
    sens = sg.lag_sensitivity(acov).toPandas()
    assert sens.is_default.sum() == 1


def test_hac_divisors(board):
    rows = diffs(board, [("good", "bad")])
    a = sg.hac_matrix(rows, ["d"], sg.PAIR, 3, "n").first()["omega"]
    b = sg.hac_matrix(rows, ["d"], sg.PAIR, 3, "n-k").first()["omega"]
    assert a != b and a == pytest.approx(b, rel=0.05)
    with pytest.raises(ValueError):
        sg.hac_matrix(rows, ["d"], sg.PAIR, 1, "x")


@pytest.fixture(scope="module")
def hits(spark):
    rng = np.random.default_rng(4)
    n = 600
    rows = pd.DataFrame({"asset": "X", "date": days(n), "method": "m", "level_pct": 90, "side": "both", "hit": (rng.random(n) < 0.13).astype(float), "alpha": 0.1,
                         "g": (rng.random(n) < 0.3).astype(float), "w": rng.normal(size=n)})
    return spark.createDataFrame(rows)


def test_kupiec_and_christoffersen(hits):
    got = cv.likelihood_ratio_tests(cv.hit_counts(hits)).first()
    h = hits.orderBy("date").toPandas().hit.to_numpy()
    x, n = h.sum(), len(h)
    want = -2 * (x * np.log(0.1) + (n - x) * np.log(0.9) - x * np.log(x / n) - (n - x) * np.log(1 - x / n))
    assert got["lr_uc"] == pytest.approx(want)
    assert got["n00"] + got["n01"] + got["n10"] + got["n11"] == n - 1
    assert got["lr_cc"] == pytest.approx(got["lr_uc"] + got["lr_ind"])


def test_no_hits_is_degenerate(hits):
    got = cv.likelihood_ratio_tests(cv.hit_counts(hits.withColumn("hit", F.lit(0.0)))).first()
    assert got["degenerate"] and got["p_ind"] == 1 and got["lr_ind"] == 0


def test_incremental_regression_is_the_difference(hits):
    got = cv.dynamic_quantile(hits, ["g", "w"]).first()
    pdf = hits.orderBy("date").toPandas()
    y = pdf.hit - 0.1
    x = pd.concat([pd.Series(1.0, index=y.index), *[y.shift(k) for k in range(1, 5)], pdf.g, pdf.w], axis=1).iloc[4:].to_numpy()
    t = y.iloc[4:].to_numpy()
    form = lambda a: (a.T @ t) @ np.linalg.solve(a.T @ a, a.T @ t) / 0.09
    assert got["dq_full"] == pytest.approx(form(x)) and got["dq_restricted"] == pytest.approx(form(x[:, :5]))
    assert got["dq_incremental"] == pytest.approx(got["dq_full"] - got["dq_restricted"])


def test_dead_regressor_gives_no_statistic(hits):
    assert cv.dynamic_quantile(hits.withColumn("g", F.lit(0.0)), ["g"]).first()["dq_full"] is None


def test_difference_test_matches_regression(hits):
    got = cv.two_sample_difference(hits, "g").first()
    pdf = hits.orderBy("date").toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.g])
    b = np.linalg.lstsq(x, pdf.hit, rcond=None)[0]
    u = x * (pdf.hit.to_numpy() - x @ b)[:, None]
    n, lag = len(pdf), int(np.floor(len(pdf) ** (1 / 3) + 1e-9))
    s = u.T @ u / n
    for k in range(1, lag + 1):
        c = u[k:].T @ u[:-k] / n
        s += (1 - k / (lag + 1)) * (c + c.T)
    inv = np.linalg.inv(x.T @ x / n)
    assert got["z_hac"] == pytest.approx(b[1] / np.sqrt((inv @ s @ inv / n)[1, 1]))


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([("f", p) for p in (0.01, 0.04, 0.03, 0.005)], "fam string, p_value double")
    got = cv.holm(df, family=("fam",)).orderBy("p_value").toPandas()
    assert np.allclose(got.p_holm, [0.02, 0.03, 0.06, 0.06])


def test_missing_is_not_a_miss(spark):
    rows = [("X", d, "m", 90, v, 0.0, 2.0) for d, v in zip(days(3), (1.0, float("nan"), 5.0))]
    iv = spark.createDataFrame(rows, "asset string, date date, method string, level_pct int, y_true double, lo double, hi double")
    assert sc.interval_table(iv).first()["n"] == 2
    h = cv.interval_hits(iv, ("both", "upper", "lower")).groupBy("side").agg(F.sum("hit").alias("h")).toPandas().set_index("side").h
    assert h["both"] == h["upper"] + h["lower"] == 1
    with pytest.raises(ValueError):
        cv.interval_hits(iv, ("left",))


def test_confidence_set_keeps_the_best_and_drops_the_worst(board):
    got = cs.model_confidence_set(board, ["good", "mid", "bad"], reps=200).toPandas().set_index("model")
    assert got.in_set["good"] and not got.in_set["bad"] and got.p_value["good"] == 1.0
    again = cs.model_confidence_set(board.repartition(5), ["good", "mid", "bad"], reps=200).toPandas().set_index("model")
    assert np.allclose(got.p_value.sort_index(), again.p_value.sort_index())


def test_comparison_statuses(spark):
    cols = "asset string, table string, item string, quantity string, value double"
    pub = spark.createDataFrame([("X", "t", "a", "q", 1.0), ("X", "t", "b", "q", 1.0), ("X", "t", "c", "q", float("nan")), ("X", "t", "d", "q", 1.0)], cols)
    red = spark.createDataFrame([("X", "t", "a", "q", 1.0 + 1e-12), ("X", "t", "b", "q", 1.001), ("X", "t", "c", "q", 1.0)], cols)
    got = {r["item"]: r["status"] for r in vf.compare(pub, red).collect()}
    assert got == {"a": "OK", "b": "MISMATCH", "c": "SKIP", "d": "MISSING"}
    assert vf.exit_status(vf.compare(pub, red)).first()["exit_code"] == 1


@pytest.mark.parametrize("picps,shape,degrades", [((0.92, 0.9, 0.85), "monotone decreasing", True), ((0.85, 0.9, 0.92), "monotone increasing", False),
                                                  ((0.9, 0.8, 0.9), "non-monotone", False), ((0.9, None, 0.8), "undetermined", False), ((0.91, 0.905, 0.9), "monotone decreasing", False)])
def test_coverage_shapes(spark, picps, shape, degrades):
    df = spark.createDataFrame([("X", "m", 90, k, 200, p) for k, p in enumerate(picps)], "asset string, method string, level_pct int, state int, n int, picp double")
    got = vd.coverage_shape(df).first()
    assert (got["shape"], got["degrades"]) == (shape, degrades)


@pytest.mark.parametrize("row,verdict", [((0.2, 0.3, 0.5, 0.01), "replicates"), ((0.2, 0.3, 0.01, 0.01), "replicates conditionally"), ((0.2, 0.3, 0.5, 0.5), "direction only"),
                                         ((0.4, 0.3, 0.5, 0.01), "does not replicate"), ((0.2, None, 0.5, 0.01), "indeterminate")])
def test_transfer_verdicts(spark, row, verdict):
    df = spark.createDataFrame([("R", 0.2, 0.3, 0.5, 0.01), ("C", *row)], "asset string, qlike_model double, qlike_benchmark double, dm_p double, gw_p double")
    assert vd.transfer(df, "R").first()["verdict"] == verdict


@pytest.mark.parametrize("scales,evidence,want", [((1.0, 1.4), True, "per-regime"), ((1.0, 1.4), False, "global, per-regime indicative"), ((1.0, 1.05), True, "global, shape problem noted"), ((1.0, 1.05), False, "global")])
def test_width_verdicts(spark, scales, evidence, want):
    s = spark.createDataFrame([("X", "m", "all", 1.1), *[("X", "m", f"state{i}", v) for i, v in enumerate(scales)]], "asset string, method string, scope string, scale_coverage double")
    e = spark.createDataFrame([("X", "m", evidence)], "asset string, method string, conditional_evidence boolean")
    assert vd.width_correction(s, e).first()["recommendation"] == want


def test_long_series_have_all_their_lags(spark):
    n = 45_000
    r = np.random.default_rng(3)
    d = r.normal(0.1, 1, n)
    rows = pd.DataFrame({"asset": "A", "model_a": "x", "model_b": "y", "date": pd.date_range("1900-01-01", periods=n).date, "d": d})
    got = sg.diebold_mariano(spark.createDataFrame(rows)).collect()[0]
    assert got.hac_lag == 35
    c = d - d.mean()
    lrv = (c @ c) / n + sum(2 * (1 - k / 36) * (c[k:] @ c[:-k]) / (n - k) for k in range(1, 36))
    assert np.isclose(got.dm_raw, d.mean() / np.sqrt(lrv / n), rtol=1e-9)


def test_poisson_counts_are_not_cut_off(spark):
    from varloom.operators.forecasters import poisson_steps, poisson_weight

    steps = poisson_steps()
    assert len(steps) > 12 and steps[-1] >= 1 - 2**-52
    u = spark.createDataFrame([(0.0,), (0.5,), (1 - 2.0**-32,)], "u double")
    assert [x.w for x in u.select(poisson_weight(u.u).alias("w")).collect()][:2] == [0.0, 1.0]
    assert u.select(poisson_weight(u.u).alias("w")).collect()[2].w > 11
