import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import days
from varloom.operators import recursion as rc, regime_fits as rf, regimes as rg


@pytest.fixture(scope="module")
def panel(spark):
    """Blocks of calm and wild days with known states."""
    rng = np.random.default_rng(9)
    truth = np.repeat([0, 1, 0, 1, 0, 1], 60)
    x = rng.normal(0, np.where(truth == 0, 0.4, 2.0))
    return spark.createDataFrame(pd.DataFrame({"asset": "X", "date": days(len(x)), "x": x, "state": truth}))


def test_jump_path_is_the_exact_minimum(spark):
    rng = np.random.default_rng(1)
    for k, lam in ((2, 0.7), (3, 0.3)):
        loss = rng.random((7, k))
        df = spark.createDataFrame([(loss.tolist(),)], "l array<array<double>>")
        got = df.select(rc.jump_path(F.col("l"), F.lit(lam)).alias("r")).first()["r"]
        cost = lambda p: sum(loss[t, s] for t, s in enumerate(p)) + lam * sum(a != b for a, b in zip(p, p[1:]))
        best = min(itertools.product(range(k), repeat=7), key=cost)
        assert got["objective"] == pytest.approx(cost(best)) and tuple(got["path"]) == best


def test_single_state_and_short_series(spark):
    df = spark.createDataFrame([([[1.0], [2.0]],), ([[0.5]],)], "l array<array<double>>")
    got = [r["r"]["path"] for r in df.select(rc.jump_path(F.col("l"), F.lit(1.0)).alias("r")).collect()]
    assert got == [[0, 0], [0]]


def brute_posteriors(loss, start, a):
    t, k = loss.shape
    post = np.zeros((t, k))
    for p in itertools.product(range(k), repeat=t):
        w = start[p[0]] * np.prod([a[i, j] for i, j in zip(p, p[1:])]) * np.exp(-sum(loss[i, s] for i, s in enumerate(p)))
        for i, s in enumerate(p):
            post[i, s] += w
    return post / post.sum(1, keepdims=True), post[0].sum()


def test_filter_smoother_and_decoder_against_enumeration(spark):
    rng = np.random.default_rng(2)
    loss, start, a = rng.random((6, 3)) * 3, np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.3, 0.4]])
    df = spark.createDataFrame([(loss.tolist(), start.tolist(), a.tolist())], "l array<array<double>>, s array<double>, a array<array<double>>")
    cols = rc.transpose(F.col("a"), F.lit(3))
    f = rc.forward_filter(F.col("l"), F.col("s"), cols)
    row = df.select(f.alias("f"), rc.smoothed(f["p"], rc.backward_weights(F.col("l"), F.col("a"))).alias("g"), rc.viterbi(F.col("l"), F.col("s"), cols).alias("v")).first()
    post, z = brute_posteriors(loss, start, a)
    assert np.allclose(row["g"], post) and row["f"]["loglik"] == pytest.approx(np.log(z))
    for t in range(1, 7):
        assert np.allclose(row["f"]["p"][t - 1], brute_posteriors(loss[:t], start, a)[0][-1])
    best = max(itertools.product(range(3), repeat=6), key=lambda p: np.log(start[p[0]]) + sum(np.log(a[i, j]) for i, j in zip(p, p[1:])) - sum(loss[i, s] for i, s in enumerate(p)))
    assert tuple(row["v"]) == best


def test_filter_ignores_the_future_and_smoother_does_not(panel):
    par = rg.chain_parameters(panel, 2)
    full = rg.filter_states(rc.as_series(panel, "x"), par).orderBy("date").toPandas()
    cut = rg.filter_states(rc.as_series(panel.where(F.col("date") <= F.lit(days(200)[-1])), "x"), par).orderBy("date").toPandas()
    assert np.allclose(np.stack(cut.p), np.stack(full.p)[:200])
    assert not np.allclose(np.stack(cut.p_smooth), np.stack(full.p_smooth)[:200])


def test_packed_parameters_equal_the_tables(panel):
    par = rg.chain_parameters(panel, 2).first()
    moments = rg.state_moments(panel, 2, sample=True).orderBy("state").toPandas()
    trans = rg.transition_table(panel, 2, 1.0).orderBy("prev", "state").toPandas()
    assert np.allclose(par["means"], moments["mean"]) and np.allclose(par["variances"], moments["variance"])
    assert np.allclose(np.ravel(par["matrix"]), trans["p"])
    assert np.allclose(par["start"], rg.start_distribution(panel, 2).orderBy("state").toPandas().p0)


def test_empty_state_takes_pooled_moments(panel):
    got = rg.state_moments(panel, 3).where("state = 2").first()
    pooled = panel.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).first()
    assert got["n"] == 0 and got["mean"] == pytest.approx(pooled["m"]) and got["variance"] == pytest.approx(pooled["v"])


def test_larger_penalty_means_fewer_jumps_and_states_are_recovered(panel):
    fit = rf.fit_jump(rf.vector_series(panel, ["x"]), [2], [0.5, 5.0, 50.0], restarts=3)
    summary = rg.jump_summary(fit).orderBy("penalty").toPandas()
    assert summary.n_jumps.is_monotonic_decreasing and summary.converged.all() and (summary.restarts_converged == 3).all()
    path = fit.where("penalty = 5.0").first()
    truth = panel.orderBy("date").toPandas().state.to_numpy()
    assert (np.array(path["path"]) == truth).mean() > 0.9 and path["variances"][0] < path["variances"][1]
    chosen = rg.choose_penalty(rg.jump_summary(fit), 15.0).first()
    ok = summary[summary.mean_duration >= 15]
    assert chosen["penalty"] == (ok.penalty.min() if len(ok) else 50.0)


def test_chain_fit_raises_likelihood_converges_and_orders_states(panel):
    series = rf.vector_series(panel, ["x"])
    one, many = rf.fit_chain(series, [2], 1, rounds=1).first(), rf.fit_chain(series, [2], 4).first()
    assert many["loglik"] > one["loglik"] and many["covariances"][0] < many["covariances"][1]
    assert not one["converged"] and many["converged"] and 1 < many["n_iter"] < rf.CHAIN_ROUNDS
    assert np.allclose(np.sum(many["matrix"], axis=1), 1)


def test_likelihood_never_falls_and_more_rounds_change_nothing():
    rng = np.random.default_rng(4)
    truth = np.repeat([0, 1, 2, 0, 2, 1], 40)
    x = rng.normal(np.array([0, 1, -1])[truth][:, None], np.array([0.3, 1.0, 2.0])[truth][:, None], (240, 2))
    likelihoods = [rf.chain_fixed_point(x, 3, 1, r, 0.0, 17)["loglik"] for r in range(1, 12)]
    assert np.all(np.diff(likelihoods) > -1e-8)
    jump = rf.jump_fixed_point(x, 3, 2.0, 6, 40, 17)
    assert jump["converged"]
    mean, spread = rf.weighted_moments(x, (jump["path"][None, :, None] == np.arange(3)).astype(float))
    path, objective, _ = rf.penalised_paths(rf.emission_losses(x, mean, spread * np.eye(2)), 2.0)
    assert objective[0] == pytest.approx(jump["objective"], rel=1e-9) and (path[0] == jump["path"]).all()


def sequential_filter(loss, start, matrix):
    p, out, total = start, [], 0.0
    for t, l in enumerate(loss):
        w = (p if t == 0 else p @ matrix) * np.exp(-l)
        total += np.log(w.sum())
        p = w / w.sum()
        out.append(p)
    return np.array(out), total


@pytest.mark.parametrize("length", [1, 2, 3, 50, 1237])
def test_block_scans_equal_day_by_day_recursions(length):
    rng = np.random.default_rng(length)
    loss, start, matrix = rng.random((length, 3)) * 8, np.array([0.5, 0.3, 0.2]), np.array([[0.9, 0.05, 0.05], [0.2, 0.7, 0.1], [0.0, 0.3, 0.7]])
    likelihood, smooth, ahead, moves = rf.expectation(loss[None], start[None], matrix[None])
    want, total = sequential_filter(loss, start, matrix)
    assert np.allclose(ahead[0], want, atol=1e-12) and likelihood[0] == pytest.approx(total, rel=1e-12)
    assert np.allclose(smooth[0].sum(1), 1) and moves[0].sum() == pytest.approx(length - 1)
    v = loss[0]
    online = [v.argmin()]
    for l in loss[1:]:
        v = np.minimum(v, v.min() + 1.5) + l
        online.append(v.argmin())
    path, objective, causal = rf.penalised_paths(loss[None], 1.5)
    assert objective[0] == pytest.approx(v.min()) and list(causal[0]) == online
    assert loss[np.arange(length), path[0]].sum() + 1.5 * (np.diff(path[0]) != 0).sum() == pytest.approx(objective[0])


def test_short_series_have_no_fit(spark):
    tiny = spark.createDataFrame([("X", days(2)[i], float(i)) for i in range(2)], "asset string, date date, x double")
    assert rf.fit_jump(rf.vector_series(tiny, ["x"]), [3], [1.0]).count() == 0


def test_vector_losses_equal_the_multivariate_density(spark):
    rng = np.random.default_rng(8)
    x, means = rng.normal(size=(5, 3)), rng.normal(size=(2, 3))
    roots = rng.normal(size=(2, 3, 3))
    covs = roots @ roots.transpose(0, 2, 1) + 0.1 * np.eye(3)
    df = spark.createDataFrame([(x.tolist(), means.tolist(), covs.tolist())], "x array<array<double>>, m array<array<double>>, c array<array<array<double>>>")
    got = df.select(rc.vector_losses(F.col("x"), F.col("m"), F.col("c")).alias("l")).first()["l"]
    want = [[0.5 * ((v - m) @ np.linalg.inv(c) @ (v - m) + np.log(np.linalg.det(2 * np.pi * c))) for m, c in zip(means, covs)] for v in x]
    assert np.allclose(got, want) and np.allclose(rf.emission_losses(x, means[None], covs[None])[0], want)


def test_vector_parameters_of_one_column_equal_the_packed_ones(panel):
    one, packed = rg.vector_parameters(panel, ["x"], 2).first(), rg.chain_parameters(panel, 2).first()
    assert np.allclose(np.ravel(one["means"]), packed["means"]) and np.allclose(np.ravel(one["covariances"]), packed["variances"])
    assert np.allclose(one["matrix"], packed["matrix"]) and np.allclose(one["start"], packed["start"])


def test_adjusted_rand(spark):
    rows = [("X", a, b) for a, b in zip([0, 0, 1, 1, 2, 2], [1, 1, 0, 0, 2, 2])]
    df = spark.createDataFrame(rows, "asset string, a int, b int")
    got = rg.agreement(df, "a", "b").first()
    assert got["adjusted_rand"] == pytest.approx(1.0) and got["raw_agreement"] == pytest.approx(1 / 3)


def test_gate_falls_back_to_uniform(spark):
    df = spark.createDataFrame([([0.2, float("nan"), 0.6],), ([0.0, 0.0, 0.0],), (None,)], "p array<double>")
    got = [r["g"] for r in df.select(rg.gate(F.col("p"), 3).alias("g")).collect()]
    assert np.allclose(got[0], [0.25, 0, 0.75]) and np.allclose(got[1], 1 / 3) and np.allclose(got[2], 1 / 3)


def test_exponential_sums(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    assert df.select(rc.exponential_sums(F.col("x"), F.lit(0.5)).alias("b")).first()["b"] == [0.0, 1.0, 2.5]
