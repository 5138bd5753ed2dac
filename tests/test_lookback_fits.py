"""Lookback fits from product sums, the sweep, quantile regressions and rolling moments, against plain numpy."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import forecasters as fc, splicing as sp, verification as vf, walkforward as wf
from varloom.operators.linear import added, product_sums

START = dt.date(1998, 1, 1)
PLAN = wf.SplitPlan(train_end="1999-02-28", val_start="1999-03-01", val_end="1999-03-31", test_start="1999-04-01", min_train=50)
ROLLING = wf.SplitPlan(train_end="1999-02-28", val_start="1999-03-01", val_end="1999-03-31", test_start="1999-04-01", min_train=50, scheme="rolling")


def panel(spark, n=600, level=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for asset in ("X", "Y"):
        logs = np.zeros(n)
        for i in range(1, n):
            logs[i] = 0.7 * logs[i - 1] + rng.normal(0, 0.3)
        for i in range(n):
            d, w, m = (float(level + v) for v in rng.normal(0, 1, 3))
            rows.append((asset, START + dt.timedelta(days=i), float(rng.normal(0, 0.01)), float(np.exp(logs[i] - 9)), d, w, m, float(level + d + rng.normal())))
    return spark.createDataFrame(rows, "asset string, date date, oc double, rv double, a double, b double, c double, y2 double")


def test_weighted_sums_of_products(spark):
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=(90, 4)), rng.random((90, 3))
    df = spark.createDataFrame([("X", v[i].tolist(), w[i].tolist()) for i in range(90)], "asset string, v array<double>, w array<double>").repartition(5)
    got = product_sums(df, "asset string", True).toPandas()
    for slot, part in got.groupby("slot"):
        assert np.allclose(added(part["cells"], 4), (v * w[:, [slot]]).T @ v)


def test_sweep_equals_a_refit_of_every_point(spark):
    folded = wf.assign_folds(panel(spark), PLAN)
    inputs = {"log_rv": F.ln("rv"), "oc": F.col("oc")}
    got = fc.lookback_sweep(folded, inputs, {"one": ("log_rv",), "both": ("log_rv", "oc")}, (2, 5), (0.1, 10.0)).toPandas()
    design, _ = fc.lookback_design(folded, inputs, 5)
    rows = design.where("asset = 'X'").toPandas().sort_values("pos")
    first = rows[rows.fold_idx.notna()].train_end_pos.min()
    head, tail = rows[rows.pos <= int(first * 0.85)], rows[(rows.pos > int(first * 0.85)) & (rows.pos <= first)]
    assert len(got.groupby(["inputs", "lookback", "ridge"])) == 8
    for (label, lookback, ridge), part in got[got.asset == "X"].groupby(["inputs", "lookback", "ridge"]):
        names = [f"x{i}_{k}" for i in range(1 if label == "one" else 2) for k in range(1, lookback + 1)] + ["one"]
        x = head[names].to_numpy()
        beta = np.linalg.solve(x.T @ x + np.diag([ridge] * (len(names) - 1) + [0.0]), x.T @ head.y.to_numpy())
        s2 = np.mean((tail.y - tail[names].to_numpy() @ beta) ** 2)
        oos = rows[rows.fold_idx.notna()].set_index("date")
        want = oos.loc[part.date, names].to_numpy() @ beta
        assert np.allclose(part.lin, want, atol=1e-9)
        assert np.allclose(part.s2, s2, rtol=1e-8)


def test_sweep_rejects_unknown_inputs(spark):
    with pytest.raises(KeyError):
        fc.lookback_sweep(wf.assign_folds(panel(spark, 60), PLAN), {"log_rv": F.ln("rv")}, {"bad": ("other",)}, (2,), (1.0,))


def pinball(r, w, tau):
    return w @ np.maximum(tau * r, (tau - 1) * r)


def test_pinball_regression_reaches_the_least_loss():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=40), np.ones(40)])
    y, w = 0.5 * x[:, 0] + rng.standard_t(3, 40), rng.random(40)
    for tau in (0.05, 0.5, 0.9):
        # The least loss is reached by a line through two of the points.
        best = np.inf
        for i, j in itertools.combinations(range(40), 2):
            line = np.linalg.solve(x[[i, j]], y[[i, j]])
            best = min(best, pinball(y - x @ line, w, tau))
        found = fc.pinball_regression(x, y, w, tau, ridge=0.0)
        assert best - 1e-9 <= pinball(y - x @ found, w, tau) <= best * (1 + 1e-3)


def test_state_quantiles_keep_their_order_and_beat_a_constant_offset(spark):
    rng = np.random.default_rng(8)
    rows, gates, prev = [], [], 0.0
    for i in range(600):
        calm = (i // 30) % 2 == 0
        date = START + dt.timedelta(days=i)
        prev = 0.5 * prev + rng.normal(0, 0.1 if calm else 0.8)
        rows.append(("X", date, float(np.exp(prev - 9))))
        gates.append(("X", date, [0.95, 0.05] if calm else [0.05, 0.95]))
    folded = wf.assign_folds(spark.createDataFrame(rows, "asset string, date date, rv double"), PLAN)
    gate = spark.createDataFrame(gates, "asset string, date date, gate array<double>")
    feats = {"log_rv": F.ln("rv")}
    ours = fc.state_quantile_forecast(folded, feats, 2, gate).toPandas()
    plain = fc.quantile_forecast(folded, feats, 2).toPandas()
    wide = ours.pivot(index="date", columns="tau", values="q")
    assert (np.diff(wide.to_numpy(), axis=1) >= 0).all()

    def loss(df):
        r = np.log(df.y_true) - np.log(df.q)
        return np.maximum(df.tau * r, (df.tau - 1) * r).mean()

    assert loss(ours) < 0.95 * loss(plain)


def test_rolling_moments_of_a_high_level(spark):
    """Level 10^6 times the spread: windows agree with a direct refit."""
    folded = wf.assign_folds(panel(spark, 500, level=1e6, seed=9), ROLLING)
    got = wf.bounded_moments(folded, ("a", "b"), ("y2",), ("c",)).toPandas()
    rows = folded.toPandas()
    assert len(got) and len(got) == rows.fold_idx.notna().sum()
    for (asset, fold), part in got.groupby(["asset", "fold_idx"]):
        one = part.iloc[0]
        used = rows[(rows.asset == asset) & rows.pos.between(one.train_start_pos, one.train_end_pos)]
        cov = np.cov(used[["a", "b", "y2", "c"]].to_numpy().T - 1e6, bias=True)
        assert one.n == len(used)
        for name, value in (("c_a_a", cov[0, 0]), ("c_a_b", cov[0, 1]), ("c_a_y2", cov[0, 2]), ("v_y2", cov[2, 2]), ("sd_c", np.sqrt(cov[3, 3]))):
            assert one[name] == pytest.approx(value, rel=1e-8, abs=1e-8)
        assert one.m_a == pytest.approx(used.a.mean(), rel=1e-12)


def test_a_splice_respects_its_gate(spark):
    days = [START + dt.timedelta(days=i) for i in range(100)]
    rng = np.random.default_rng(2)
    near = [("N", d, float(v)) for d, v in zip(days, np.exp(rng.normal(size=100)))]
    far = [("F", d, v * 3) for _, d, v in near]
    head = spark.createDataFrame(near + [("F", d, v) for _, d, v in near], "asset string, date date, rv double")
    tail = spark.createDataFrame(near + far, "asset string, date date, rv double")
    report = sp.overlap(head, tail)

    def assets(**how):
        return {r.asset for r in sp.splice(head, tail, "1998-02-01", report, **how).select("asset").distinct().collect()}

    assert assets() == {"N"}
    assert assets(thresholds=(60, 0.9, 2.5)) == assets(force=True) == {"N", "F"}
    assert assets(thresholds=(101, 0.9, 2.5)) == set()


def test_rederived_interval_tables_by_state(spark):
    days = [START + dt.timedelta(days=i) for i in range(6)]
    states = spark.createDataFrame([("X", d, i % 2) for i, d in enumerate(days)], "asset string, date date, state int")
    iv = spark.createDataFrame([("X", d, "m", float(i), 90, 0.5, 3.5) for i, d in enumerate(days)], "asset string, date date, method string, y_true double, level_pct int, lo double, hi double")
    got = {(r["item"], r["quantity"]): r["value"] for r in vf.rederive_per_regime_intervals(iv, states).collect()}
    # Yesterday's state 0 holds days 1, 3, 5; state 1 holds days 2, 4.
    assert got[("m@90/0", "n")] == 3 and got[("m@90/0", "picp")] == pytest.approx(2 / 3)
    assert got[("m@90/1", "n")] == 2 and got[("m@90/1", "picp")] == pytest.approx(1 / 2)
    assert got[("m@90/1", "winkler")] == pytest.approx(3 + 20 * 0.5 / 2)
