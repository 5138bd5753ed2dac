import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import days
from varloom.operators import features as ft, realized as rz, splicing as sp, timing as tm, walkforward as wf

PLAN = wf.SplitPlan("2001-06-30", "2001-07-01", "2001-12-31", "2002-01-01", "2009-12-31")


def test_yang_zhang_matches_pandas(ohlc):
    got = rz.yang_zhang(ohlc).where("asset = 'X'").orderBy("date").toPandas()
    o = np.log(got.open / got.close.shift(1)).rolling(21).var()
    c = np.log(got.close / got.open).rolling(21).var()
    rs = (np.log(got.high / got.close) * np.log(got.high / got.open) + np.log(got.low / got.close) * np.log(got.low / got.open)).rolling(21).mean()
    k = 0.34 / (1.34 + 22 / 20)
    assert np.allclose(got.rv, o + k * c + (1 - k) * rs, equal_nan=True)


def test_har_lags_never_read_today(ohlc):
    rv = rz.yang_zhang(ohlc).where("rv > 0").select("asset", "date", "rv")
    full = ft.har_lags(rv).where("asset = 'X'").orderBy("date").toPandas()
    assert np.allclose(full.rv_w[30], full.rv[25:30].mean())
    cut = full.date[200]
    short = ft.har_lags(rv.where(F.col("date") <= F.lit(cut))).where("asset = 'X'").orderBy("date").toPandas()
    cols = ["rv_d", "rv_w", "rv_m"]
    assert np.allclose(short[cols], full[cols].iloc[: len(short)], equal_nan=True)


def test_trade_variance_does_not_depend_on_slicing(spark):
    rng = np.random.default_rng(2)
    n = 5000
    # One asset and day holds almost every row.
    pdf = pd.DataFrame({"asset": "X", "date": [days(2)[0]] * (n - 5) + [days(2)[1]] * 5, "k": rng.permutation(n), "px": np.exp(rng.normal(0, 0.01, n))})
    df = spark.createDataFrame(pdf)
    want = {}
    for d, g in pdf.groupby("date"):
        want[d] = (np.diff(np.log(g.sort_values("k").px)) ** 2).sum()
    for width in (1, 7, 640, 1 << 22):
        got = rz.trade_variance(df, ["k"], width=width).toPandas()
        assert dict(zip(got.date, got.n_returns)) == {days(2)[0]: n - 6, days(2)[1]: 4}
        for d, v in zip(got.date, got.rv):
            assert v == pytest.approx(want[d], rel=1e-10)


def test_day_summary_keeps_trade_order_across_slices(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"asset": "X", "date": days(1)[0], "k": rng.permutation(400) - 200, "px": np.exp(rng.normal(0, 0.01, 400))})
    inorder = pdf.sort_values("k").px
    for width in (1, 37, 1 << 22):
        got = rz.day_summary(spark.createDataFrame(pdf), ["k"], width).first()
        assert (got.open, got.close, got.high, got.low, got.n_trades) == (inorder.iloc[0], inorder.iloc[-1], inorder.max(), inorder.min(), 400)


def test_grids_from_minutes_equal_grids_from_bars(spark):
    from datetime import datetime, timedelta

    rng = np.random.default_rng(13)
    start = datetime(2000, 1, 3, 9, 30)
    bars = [("X", start + timedelta(seconds=int(s)), float(p), i) for i, (s, p) in enumerate(zip(rng.integers(0, 4 * 3600, 900), np.exp(rng.normal(0, 0.01, 900))))]
    got = rz.realized_variance(spark.createDataFrame(bars, "asset string, ts timestamp, price double, seq long"), grids=5).first()
    per_grid = []
    for off in range(5):
        last = {}
        for _, ts, price, seq in sorted(bars, key=lambda b: (b[1], b[3])):
            last[(ts + timedelta(minutes=off) - datetime(2000, 1, 3)) // timedelta(minutes=5)] = price
        per_grid.append((np.diff(np.log([last[k] for k in sorted(last)])) ** 2).sum())
    assert got.rv == pytest.approx(np.mean(per_grid), rel=1e-10)


def test_realized_variance_recovers_integrated_variance(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in days(40):
        t = pd.date_range(pd.Timestamp(d) + pd.Timedelta(hours=9), periods=79, freq="5min")
        rows.append(pd.DataFrame({"asset": "X", "ts": t, "price": 100 * np.exp(np.cumsum(rng.normal(0, 1e-3, 79))), "seq": np.arange(79)}))
    bars = spark.createDataFrame(pd.concat(rows))
    rv = rz.realized_variance(bars).toPandas()
    assert len(rv) == 40 and rv.rv.mean() == pytest.approx(78e-6, rel=0.1)
    assert rz.realized_variance(bars, min_returns=100).count() == 0


def test_annualisation_scales(ohlc):
    a, b = ohlc.select(rz.parkinson_variance().alias("a"), rz.parkinson_variance(True).alias("b")).limit(5).toPandas().T.values
    assert np.allclose(b, 252 * a)


def test_missing_columns_are_an_error(ohlc):
    with pytest.raises(KeyError):
        rz.require_columns(ohlc.drop("high"), rz.OHLC_COLUMNS)


def test_unknown_features_are_an_error(ohlc):
    with pytest.raises(KeyError):
        ft.forecast_features(ft.ohlc_frame(ohlc), ["nonsense"])


def test_joined_frame_equals_single_pass_frame(ohlc):
    target = ft.select_target("yang_zhang", ohlc=ohlc)
    a, b = ft.modelling_frame(ohlc, target), ft.ohlc_frame(ohlc)
    assert a.count() == b.count() and a.select("asset", "date").exceptAll(b.select("asset", "date")).isEmpty()


def test_every_out_of_sample_day_is_in_one_fold(ohlc):
    for scheme in ("anchored", "rolling"):
        plan = wf.SplitPlan(PLAN.train_end, PLAN.val_start, PLAN.val_end, PLAN.test_start, PLAN.test_end, 21, scheme)
        folded = wf.assign_folds(ft.ohlc_frame(ohlc), plan)
        assert folded.where("is_oos and fold_idx is null").isEmpty()
        folds = wf.fold_table(folded).toPandas()
        assert (pd.to_datetime(folds.train_end) < pd.to_datetime(folds.predict_start)).all()
        assert folds.n_predict.sum() == folded.where("is_oos").count()
        if scheme == "rolling":
            assert folds.groupby("asset").n_train.nunique().eq(1).all()


def test_minimum_training_rows(ohlc):
    plan = wf.SplitPlan("2000-03-01", "2000-03-02", "2000-03-31", "2000-04-01", "2009-12-31")
    folds = wf.fold_table(wf.assign_folds(ft.ohlc_frame(ohlc), plan)).toPandas()
    assert (folds.n_train >= 252).all()


def test_bad_split_bounds():
    with pytest.raises(ValueError):
        wf.SplitPlan(train_end="2005-01-01")


def test_regression_matches_least_squares_and_has_no_lookahead(ohlc):
    frame = ft.ohlc_frame(ohlc)
    wide = wf.har_fits(wf.assign_folds(frame, PLAN)).where("asset = 'X'").orderBy("date").toPandas()
    pdf = frame.where("asset = 'X'").orderBy("date").toPandas()
    row = wide.iloc[50]
    train = pdf.iloc[: int(row.train_end_pos) + 1]
    x = np.column_stack([np.ones(len(train)), train.rv_d, train.rv_w, train.rv_m])
    beta = np.linalg.lstsq(x, train.rv, rcond=None)[0]
    assert np.allclose([row.lev_const, row.lev_rv_d, row.lev_rv_w, row.lev_rv_m], beta, rtol=1e-5)
    cut = wide.date[80]
    early = wf.har_fits(wf.assign_folds(frame.where(F.col("date") <= F.lit(cut)), PLAN)).where("asset = 'X'").orderBy("date").toPandas()
    assert np.allclose(early.f_har, wide.f_har[: len(early)])


def test_lenient_forecaster_keeps_rows(ohlc):
    frame = ft.ohlc_frame(ohlc)
    nothing = lambda folded: folded.where("fold_idx is not null").withColumn("yhat", F.lit(None).cast("double"))
    board = wf.walk_forward({"none": nothing}, frame, PLAN)
    assert board.count() > 0 and board.where("yhat is not null").isEmpty()


def test_guard_reports_leaks(ohlc):
    folded = wf.assign_folds(ft.ohlc_frame(ohlc), PLAN)
    leak = folded.limit(1).select("asset", "date", F.lit("leak").alias("model"), F.lit(1.0).alias("yhat"), F.lit(0).cast("long").alias("fold_idx"))
    assert wf.guard_violations(leak, wf.fold_table(folded)).collect()[0]["reason"] == "inside training"
    good = folded.where("fold_idx is not null").select("asset", "date", F.lit("m").alias("model"), F.lit(1.0).alias("yhat"), "fold_idx")
    folds = wf.fold_table(folded)
    assert wf.guard_violations(good, folds).isEmpty()
    assert {r["reason"] for r in wf.guard_violations(good.withColumn("fold_idx", F.col("fold_idx") - 1), folds).collect()} == {"no such fold", "outside window"}
    assert {r["reason"] for r in wf.guard_violations(good.union(good.limit(1)), folds).collect()} == {"not the only one"}


def test_silent_models_are_reported(ohlc):
    folded = wf.assign_folds(ft.ohlc_frame(ohlc), PLAN)
    board = wf.to_board(wf.har_fits(folded), wf.BASELINES)
    share = {(r.asset, r.model): r.share for r in wf.coverage_report(board, folded, [*wf.BASELINES, "silent"]).collect()}
    assert {v for (_, m), v in share.items() if m == "silent"} == {0.0}
    assert {v for (_, m), v in share.items() if m != "silent"} == {1.0}


def test_rolling_windows_reach_the_fits(ohlc):
    frame = ft.ohlc_frame(ohlc)
    plan = wf.SplitPlan(PLAN.train_end, PLAN.val_start, PLAN.val_end, PLAN.test_start, PLAN.test_end, 21, "rolling")
    folded = wf.assign_folds(frame, plan)
    rows = folded.toPandas().sort_values(["asset", "pos"])
    got = wf.har_fits(folded, "rolling").toPandas()
    anchored = wf.har_fits(wf.assign_folds(frame, PLAN)).toPandas().set_index(["asset", "date"])
    last = got.sort_values("pos").groupby("asset").tail(3)
    for r in last.itertuples():
        mine = rows[rows.asset == r.asset]
        train = mine[(mine.pos >= r.train_start_pos) & (mine.pos <= r.train_end_pos)]
        assert len(train) == r.train_len
        x = np.column_stack([np.ones(len(train)), train[["rv_d", "rv_w", "rv_m"]]])
        for y, lin in ((train.rv, r.lev_lin), (np.log(train.rv), r.log_lin)):
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            assert np.isclose(beta @ [1, r.rv_d, r.rv_w, r.rv_m], lin, rtol=1e-6)
        assert not np.isclose(anchored.loc[(r.asset, r.date)].log_lin, r.log_lin, rtol=1e-6)


def test_splice_needs_the_gate(spark):
    n = 120
    rng = np.random.default_rng(1)
    rv = np.exp(rng.normal(-9, 1, n))
    a = spark.createDataFrame(pd.DataFrame({"asset": "X", "date": days(n), "rv": rv}))
    b = spark.createDataFrame(pd.DataFrame({"asset": "X", "date": days(n), "rv": 1.1 * rv}))
    report = sp.overlap(b, a)
    got = report.first()
    assert got["n"] == n and got["median_ratio"] == pytest.approx(1.1) and got["spearman"] == pytest.approx(1)
    out = sp.splice(a, b, str(days(n)[79]), report).orderBy("date").toPandas()
    assert len(out) == n and np.allclose(out.rv, rv)
    c = spark.createDataFrame(pd.DataFrame({"asset": "X", "date": days(n), "rv": 2.0 * rv}))
    assert sp.splice(a, c, str(days(n)[79]), sp.overlap(c, a)).isEmpty()


STATES = [0, 0, 0, 1, 1, 2, 2, 1, 0, 0]


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame([("X", d, s) for d, s in zip(days(10), STATES)], "asset string, date date, state int")


def test_label_is_lagged_on_its_own_calendar(states):
    window = states.where(F.col("date") >= F.lit(days(10)[4])).select("asset", "date")
    got = tm.align_labels(window, states).orderBy("date").toPandas().state
    assert list(got) == STATES[3:9]
    assert tm.label_reach(window, states).first()["ok"]
    sliced = tm.align_labels(window, states.join(window, ["asset", "date"])).where("state is null").count()
    assert sliced == 1


def test_transition_selectors(states):
    days_ = states.select("asset", "date")
    exante = tm.transitions(days_, states, 1).orderBy("date").toPandas()
    expost = tm.transitions(days_, states, 0).orderBy("date").toPandas()
    assert list(expost.is_transition[1:]) == [a != b for a, b in zip(STATES, STATES[1:])]
    assert list(exante.is_transition[2:]) == list(expost.is_transition[1:-1])
    row = tm.transition_summary(days_, states, 1).first()
    assert row["n"] == 8 and row["implementable"]
    assert not tm.transition_summary(days_, states, 0).first()["implementable"]


def test_runs(states):
    got = tm.run_table(states).orderBy("first_date").toPandas()
    assert list(got.length) == [3, 2, 2, 1, 2]
