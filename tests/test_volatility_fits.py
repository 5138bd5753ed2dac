"""Variance models refit per fold, width and scale tables, and checks over all assets, against plain Python."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from varloom.operators import calibration as cal, crossasset as ca, forecasters as fc, replication as rep
from varloom.operators.walkforward import SplitPlan, assign_folds

START = dt.date(1998, 1, 1)


def returns(n, seed):
    rng, h, out = random.Random(seed), 1.0, []
    for _ in range(n):
        e = rng.gauss(0, math.sqrt(h))
        out.append(e / 100)
        h = 0.1 + 0.1 * e * e + 0.8 * h
    return out


def folded_of(spark, series, plan):
    rows = [(a, START + dt.timedelta(days=i), r, r * r + 1e-6, r * r + 1e-6, r * r + 1e-6, r * r + 1e-6) for a, rs in series.items() for i, r in enumerate(rs)]
    return assign_folds(spark.createDataFrame(rows, "asset string, date date, log_return double, rv double, rv_d double, rv_w double, rv_m double"), plan)


def plain(rs, ts, te, pe, grid, start, step, share):
    window = [x * 100 for x in rs[ts : pe + 1]]
    n = te - ts + 1
    mu = sum(window[:n]) / n
    e = [x - mu for x in window]
    s2 = sum(x * x for x in e[:n]) / n
    best = None
    for point in grid:
        h, ll, path = start(s2), 0.0, []
        for i, x in enumerate(e):
            if i < n:
                ll += share(h, x)
            else:
                path.append(h)
            h = step(point, s2, h, x)
        if best is None or (ll, point) > best[:2]:
            best = (ll, point, path)
    return best


def check(spark, forecast, names, grid, start, step, share, variance, scheme):
    plan = SplitPlan(train_end="1998-08-31", val_start="1998-09-01", val_end="1998-09-30", test_start="1998-10-01", refit_every=21, min_train=100, scheme=scheme)
    series = {"A": returns(330, 1), "B": returns(300, 2)}
    folded = folded_of(spark, series, plan).cache()
    got = {(r.asset, r.date): r for r in forecast(folded).collect()}
    windows = folded.where("fold_idx IS NOT NULL").groupBy("asset", "fold_idx").agg(
        F.min("train_start_pos").alias("ts"), F.min("train_end_pos").alias("te"), F.max("pos").alias("pe")).collect()
    assert len(windows) > 4 and len(got) == sum(w.pe - w.te for w in windows)
    for w in windows:
        ll, point, path = plain(series[w.asset], w.ts, w.te, w.pe, grid, start, step, share)
        for k, h in enumerate(path):
            row = got[w.asset, START + dt.timedelta(days=w.te + 1 + k)]
            assert tuple(row[n] for n in names) == point and row.fold_idx == w.fold_idx
            assert math.isclose(row.ll, ll, rel_tol=1e-9) and math.isclose(row.yhat, variance(h) / 1e4, rel_tol=1e-9)


def test_garch_refits_on_every_folds_own_window(spark):
    grid = [(a, b) for a in fc.GARCH_ALPHAS for b in fc.GARCH_BETAS if a + b < 1]
    share = lambda h, x: -0.5 * (math.log(h) + x * x / h)
    step = lambda p, s2, h, x: s2 * (1 - p[0] - p[1]) + p[0] * x * x + p[1] * h
    for scheme in ("anchored", "rolling"):
        check(spark, fc.garch_forecast, ("alpha", "beta"), grid, lambda s2: s2, step, share, lambda h: h, scheme)


def test_egarch_refits_on_every_folds_own_window(spark):
    grid = [(a, g, b) for a in fc.EGARCH_ALPHAS for g in fc.EGARCH_GAMMAS for b in fc.EGARCH_BETAS]

    def step(p, s2, h, x):
        z = x / math.exp(h / 2)
        return (1 - p[2]) * math.log(s2) + p[0] * (abs(z) - math.sqrt(2 / math.pi)) + p[1] * z + p[2] * h

    check(spark, fc.egarch_forecast, ("alpha", "gamma", "beta"), grid, math.log, step, lambda h, x: -0.5 * (h + x * x * math.exp(-h)), math.exp, "anchored")


def test_width_rows_cover_unlabelled_days(spark):
    days = [START + dt.timedelta(days=i) for i in range(4)]
    rows = [("A", d, "m", 1.0, 90, 0.5, hi) for d, hi in zip(days, (1.0, 2.0, 4.0, 8.0), strict=True)]
    intervals = spark.createDataFrame(rows, "asset string, date date, method string, y_true double, level_pct int, lo double, hi double")
    lagged = spark.createDataFrame([("A", days[0], None), ("A", days[1], 0), ("A", days[2], 1)], "asset string, date date, state int")
    got = {r.state: r for r in cal.width_by_regime(intervals, lagged).collect()}
    assert {k: r.n for k, r in got.items()} == {0: 1, 1: 1, None: 4}
    assert math.isclose(got[None].mean_log_width, sum(math.log(hi / 0.5) for hi in (1, 2, 4, 8)) / 4)


def test_fitted_spread_is_scored_even_if_the_grid_leaves_it_out(spark):
    rng = random.Random(3)
    rows = [("A", "m", "all", math.exp(rng.gauss(0, 1.5)), 0.0, 1.0) for _ in range(200)]
    laws = spark.createDataFrame(rows, "asset string, method string, scope string, y_true double, mu double, sigma double")
    row = cal.sigma_scale_search(laws, [1.25, 1.5, 1.75]).first()
    hits = lambda s: sum(abs(math.log(r[3])) <= 1.6448536269514722 * s for r in rows) / 200
    assert math.isclose(row.picp_fitted, hits(1.0)) and row.scale_coverage in (1.25, 1.5, 1.75)
    assert math.isclose(row.picp_calibrated, hits(row.scale_coverage)) and row.crps_fitted > row.crps_best and row.scale_crps != 1.0


def test_checks_cover_every_asset(spark):
    scores = spark.createDataFrame([(a, m) for a in "XYZ" for m in ("one", "two")] + [("X", "three"), ("Y", "three")], "asset string, model string")
    assert {r.model for r in ca.models_in_common(scores).collect()} == {"one", "two"}
    runs = spark.createDataFrame([("X", "one", 1), ("X", "two", 1), ("Q", "one", 1), ("Q", "two", 2)], "asset string, model string, n int")
    assert {r.asset: r.shared for r in rep.shared_protocol(runs, ["n"]).collect()} == {"X": True, "Q": False}
