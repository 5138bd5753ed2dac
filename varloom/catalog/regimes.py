"""Regime tables, filters, paths and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.sql import TEST_START, TRAIN_END, W, define, num, r, rs
from varloom.operators import recursion as rc, regime_fits as rf, regimes as rg, timing as tm
from varloom.plans import study
from math import pi

K = 3
K_GRID = (2, 3, 4)
#: Penalties to choose from, those whose sensitivity is told, the one chosen, and the one at which state counts are compared.
PENALTIES = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
SENSITIVITY = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 10.0, 30.0, 100.0, 300.0)
HEADLINE, COUNTING = 3.0, 30.0

define("t_z", f"""
  SELECT s.asset, s.date, s.state, s.rv, (s.log_return - m)/CASE WHEN d < 1e-12 THEN 1 ELSE d END AS x FROM t_states s JOIN (
    SELECT asset, avg(log_return) AS m, stddev_pop(log_return) AS d FROM t_frame WHERE date <= DATE '{TRAIN_END}' GROUP BY 1) USING (asset)""")
define("t_ztrain", f"SELECT * FROM t_z WHERE date <= DATE '{TRAIN_END}'")
define("t_mom", """
  SELECT asset, state, count(*) AS n, avg(x) AS mean, greatest(var_samp(x), 1e-6) AS variance FROM t_ztrain GROUP BY 1, 2""")
define("t_moves", f"""
  SELECT g.asset, g.prev, g.state, coalesce(m.moves, 0) AS moves FROM (
    SELECT asset, prev, state FROM (SELECT DISTINCT asset FROM t_ztrain), (SELECT unnest(range(3)) AS prev), (SELECT unnest(range(3)) AS state)) g
  LEFT JOIN (SELECT asset, prev, state, count(*) AS moves FROM (SELECT asset, state, lag(state) OVER ({W}) AS prev FROM t_ztrain) WHERE prev IS NOT NULL GROUP BY 1, 2, 3) m USING (asset, prev, state)""")
define("t_trans", "SELECT *, (moves + 1.0)/sum(moves + 1.0) OVER (PARTITION BY asset, prev) AS p FROM t_moves")
define("t_start", "SELECT asset, state, (n + 1.0)/sum(n + 1.0) OVER (PARTITION BY asset) AS p0 FROM t_mom")
define("t_par", "SELECT asset, " + ", ".join(
    [f"max(CASE WHEN m.state = {k} THEN mean END) AS m{k}, max(CASE WHEN m.state = {k} THEN variance END) AS v{k}, max(CASE WHEN m.state = {k} THEN p0 END) AS s{k}" for k in range(3)]
    + [f"max(CASE WHEN t.prev = {i} AND t.state = {j} THEN p END) AS a{i}{j}" for i in range(3) for j in range(3)]
) + " FROM t_mom m JOIN t_start USING (asset, state) JOIN t_trans t USING (asset) GROUP BY asset")
define("t_em", f"""
  SELECT z.asset, z.date, z.x, z.rv, z.state, row_number() OVER (PARTITION BY z.asset ORDER BY z.date) AS i, {', '.join(f'0.5*((x-m{k})*(x-m{k})/v{k} + ln({num(2 * pi)}*v{k})) AS l{k}' for k in range(3))},
    p.* EXCLUDE (asset) FROM t_z z JOIN t_par p USING (asset)""")
_LIK = [f"exp(least(e.l0,e.l1,e.l2)-e.l{k})" for k in range(3)]
_PRED = [f"(f.p0*e.a0{k}+f.p1*e.a1{k}+f.p2*e.a2{k})" for k in range(3)]
define("t_filt", f"""
  SELECT asset, i, {', '.join(f'w{k}/(w0+w1+w2) AS p{k}' for k in range(3))}, ln(w0+w1+w2) - lo AS ll FROM (
    SELECT e.asset, e.i, least(e.l0,e.l1,e.l2) AS lo, {', '.join(f'e.s{k}*{_LIK[k]} AS w{k}' for k in range(3))} FROM t_em e WHERE e.i = 1)
  UNION ALL SELECT asset, i, {', '.join(f'w{k}/(w0+w1+w2)' for k in range(3))}, ln(w0+w1+w2) - lo FROM (
    SELECT e.asset, e.i, least(e.l0,e.l1,e.l2) AS lo, {', '.join(f'{_PRED[k]}*{_LIK[k]} AS w{k}' for k in range(3))} FROM t_filt f JOIN t_em e ON e.asset = f.asset AND e.i = f.i + 1)""")
_BACK = [f"(e.a{i}0*exp(least(e.l0,e.l1,e.l2)-e.l0)*b.b0+e.a{i}1*exp(least(e.l0,e.l1,e.l2)-e.l1)*b.b1+e.a{i}2*exp(least(e.l0,e.l1,e.l2)-e.l2)*b.b2)" for i in range(3)]
define("t_back", f"""
  SELECT asset, max(i) AS i, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM t_em GROUP BY asset
  UNION ALL SELECT asset, i, w0/(w0+w1+w2), w1/(w0+w1+w2), w2/(w0+w1+w2) FROM (
    SELECT e.asset, e.i - 1 AS i, {', '.join(f'{_BACK[i]} AS w{i}' for i in range(3))} FROM t_back b JOIN t_em e ON e.asset = b.asset AND e.i = b.i WHERE e.i > 1)""")


def labelled(spark, sf_dir):
    return rg.standardize(study.states(spark, sf_dir), "log_return", TRAIN_END, "x")


def trained(spark, sf_dir):
    return labelled(spark, sf_dir).where(F.col("date") <= F.lit(TRAIN_END).cast("date"))


def filtered(spark, sf_dir):
    panel = labelled(spark, sf_dir)
    train = panel.where(F.col("date") <= F.lit(TRAIN_END).cast("date"))
    return rg.filter_states(rc.as_series(panel, "x"), rg.chain_parameters(train, K))


@query("A24_state_moments", f"SELECT asset, state, n, {rs(mean=8, variance=8)} FROM t_mom")
def state_moments(spark, sf_dir):
    return tidy(rg.state_moments(trained(spark, sf_dir), K, sample=True), ["asset", "state", "n"], mean=8, variance=8)


@query("A23_transition_table", f"SELECT asset, prev, state, moves, {rs(p=8)} FROM t_trans")
def transition_table(spark, sf_dir):
    return tidy(rg.transition_table(trained(spark, sf_dir), K, 1.0), ["asset", "prev", "state", "moves"], p=8)


@query("K8_volatility_order", "SELECT asset, state, CAST(row_number() OVER (PARTITION BY asset ORDER BY variance, state) - 1 AS INT) AS label FROM t_mom")
def volatility_order(spark, sf_dir):
    return rg.volatility_order(rg.state_moments(trained(spark, sf_dir), K, sample=True)).select("asset", "state", "label")


@query("X12_state_losses", f"SELECT asset, date, {r('l0', 7, 'loss0')}, {r('l1', 7, 'loss1')}, {r('l2', 7, 'loss2')} FROM t_em", branches=True)
def state_losses(spark, sf_dir):
    panel = labelled(spark, sf_dir)
    par = rg.chain_parameters(trained(spark, sf_dir), K)
    rows = panel.join(par, "asset").withColumn("l", rc.gaussian_losses(F.array("x"), F.col("means"), F.col("variances"))[0])
    return tidy(rows.select("asset", "date", *[F.col("l")[k].alias(f"loss{k}") for k in range(K)]), ["asset", "date"], loss0=7, loss1=7, loss2=7)


@query("X11_soft_membership", "SELECT asset, date, " + ", ".join(
    r(f"exp(least(l0,l1,l2)-l{k})/(exp(least(l0,l1,l2)-l0)+exp(least(l0,l1,l2)-l1)+exp(least(l0,l1,l2)-l2))", 7, f"q{k}") for k in range(3)) + " FROM t_em", branches=True)
def soft_membership(spark, sf_dir):
    panel = labelled(spark, sf_dir)
    par = rg.chain_parameters(trained(spark, sf_dir), K)
    rows = panel.join(par, "asset").withColumn("q", rg.soft_membership(rc.gaussian_losses(F.array("x"), F.col("means"), F.col("variances"))[0]))
    return tidy(rows.select("asset", "date", *[F.col("q")[k].alias(f"q{k}") for k in range(K)]), ["asset", "date"], q0=7, q1=7, q2=7)


@query("G1_causal_filter", f"SELECT e.asset, e.date, {', '.join(r(f'f.p{k}', 7, f'p{k}') for k in range(3))} FROM t_filt f JOIN t_em e USING (asset, i)", branches=True)
def causal_filter(spark, sf_dir):
    out = filtered(spark, sf_dir).select("asset", "date", *[F.col("p")[k].alias(f"p{k}") for k in range(K)])
    return tidy(out, ["asset", "date"], p0=7, p1=7, p2=7)


@query("K7_argmax_state", "SELECT e.asset, e.date, CASE WHEN f.p0 >= f.p1 AND f.p0 >= f.p2 THEN 0 WHEN f.p1 >= f.p2 THEN 1 ELSE 2 END AS state FROM t_filt f JOIN t_em e USING (asset, i)", branches=True)
def argmax_state(spark, sf_dir):
    return filtered(spark, sf_dir).select("asset", "date", "state")


_G = [f"f.p{k}*b.b{k}/(f.p0*b.b0+f.p1*b.b1+f.p2*b.b2)" for k in range(3)]


@query("G2_smoothed_posterior", f"SELECT e.asset, e.date, {', '.join(r(_G[k], 7, f'p{k}') for k in range(3))} FROM t_filt f JOIN t_back b USING (asset, i) JOIN t_em e USING (asset, i)", branches=True)
def smoothed_posterior(spark, sf_dir):
    out = filtered(spark, sf_dir).select("asset", "date", *[F.col("p_smooth")[k].alias(f"p{k}") for k in range(K)])
    return tidy(out, ["asset", "date"], p0=7, p1=7, p2=7)


_VS = [[f"(v.v{i}+ln(greatest(e.a{i}{k},1e-300)))" for i in range(3)] for k in range(3)]
_BEST = lambda c: f"greatest({', '.join(c)})"
_ARG = lambda c: f"CASE WHEN {c[0]} >= {c[1]} AND {c[0]} >= {c[2]} THEN 0 WHEN {c[1]} >= {c[2]} THEN 1 ELSE 2 END"
define("t_vit", f"""
  SELECT asset, i, {', '.join(f'ln(greatest(s{k},1e-300)) - l{k} AS v{k}' for k in range(3))}, 0 AS b0, 0 AS b1, 0 AS b2 FROM t_em WHERE i = 1
  UNION ALL SELECT e.asset, e.i, {', '.join(f'{_BEST(_VS[k])} - e.l{k}' for k in range(3))}, {', '.join(_ARG(_VS[k]) for k in range(3))}
  FROM t_vit v JOIN t_em e ON e.asset = v.asset AND e.i = v.i + 1""")
define("t_vpath", f"""
  SELECT asset, i, {_ARG(['v0', 'v1', 'v2'])} AS state, b0, b1, b2 FROM t_vit v WHERE i = (SELECT max(i) FROM t_em e WHERE e.asset = v.asset)
  UNION ALL SELECT v.asset, v.i, CASE p.state WHEN 0 THEN p.b0 WHEN 1 THEN p.b1 ELSE p.b2 END, v.b0, v.b1, v.b2 FROM t_vpath p JOIN t_vit v ON v.asset = p.asset AND v.i = p.i - 1""")


@query("G3_viterbi_path", "SELECT e.asset, e.date, p.state FROM t_vpath p JOIN t_em e USING (asset, i)", branches=True)
def viterbi_path(spark, sf_dir):
    return filtered(spark, sf_dir).select("asset", "date", F.col("path").alias("state"))


@query("G13_smoothing_gap", f"""
  SELECT e.asset, count(*) AS n, {r(f'avg(abs({_G[2]} - f.p2))', 8, 'mean_abs_gap')} FROM t_filt f JOIN t_back b USING (asset, i) JOIN t_em e USING (asset, i)
  WHERE e.date >= DATE '{TEST_START}' GROUP BY 1""", branches=True)
def smoothing_gap(spark, sf_dir):
    rows = filtered(spark, sf_dir).where(F.col("date") >= F.lit(TEST_START).cast("date"))
    out = rows.groupBy("asset").agg(F.count("*").alias("n"), F.avg(F.abs(F.element_at("p_smooth", 3) - F.element_at("p", 3))).alias("mean_abs_gap"))
    return tidy(out, ["asset", "n"], mean_abs_gap=8)


def _jump(lam: float) -> str:
    def jump(k):
        others = [f"d.v{i}" for i in range(3) if i != k]
        return f"(least({', '.join(others)}) + {lam})"

    def source(k):
        a, b = [i for i in range(3) if i != k]
        return f"CASE WHEN d.v{k} <= {jump(k)} THEN {k} WHEN d.v{a} <= d.v{b} THEN {a} ELSE {b} END"

    return f"""
  SELECT asset, i, l0 AS v0, l1 AS v1, l2 AS v2, 0 AS b0, 0 AS b1, 0 AS b2 FROM t_em WHERE i = 1
  UNION ALL SELECT e.asset, e.i, {', '.join(f'e.l{k} + least(d.v{k}, {jump(k)})' for k in range(3))}, {', '.join(source(k) for k in range(3))}
  FROM t_jump d JOIN t_em e ON e.asset = d.asset AND e.i = d.i + 1"""


define("t_jump", _jump(3.0))
_MIN = "CASE WHEN v0 <= v1 AND v0 <= v2 THEN 0 WHEN v1 <= v2 THEN 1 ELSE 2 END"
_DMIN = "CASE WHEN d.v0 <= d.v1 AND d.v0 <= d.v2 THEN 0 WHEN d.v1 <= d.v2 THEN 1 ELSE 2 END"
define("t_jpath", f"""
  SELECT asset, i, {_MIN} AS state, b0, b1, b2 FROM t_jump v WHERE i = (SELECT max(i) FROM t_em e WHERE e.asset = v.asset)
  UNION ALL SELECT v.asset, v.i, CASE p.state WHEN 0 THEN p.b0 WHEN 1 THEN p.b1 ELSE p.b2 END, v.b0, v.b1, v.b2 FROM t_jpath p JOIN t_jump v ON v.asset = p.asset AND v.i = p.i - 1""")


def jump_rows(spark, sf_dir, penalty: float = 3.0):
    series = rc.as_series(labelled(spark, sf_dir), "x").join(rg.chain_parameters(trained(spark, sf_dir), K), "asset")
    losses = series.withColumn("losses", rc.gaussian_losses(F.col("x"), F.col("means"), F.col("variances")))
    return rf.penalised_rows(losses, ["asset"], penalty)


@query("G5_jump_path", "SELECT e.asset, e.date, p.state FROM t_jpath p JOIN t_em e USING (asset, i)", branches=True)
def jump_path(spark, sf_dir):
    return jump_rows(spark, sf_dir).select("asset", "date", "state")


@query("G7_jump_causal_states", f"SELECT e.asset, e.date, {_DMIN} AS state FROM t_jump d JOIN t_em e USING (asset, i)", branches=True)
def jump_causal_states(spark, sf_dir):
    return jump_rows(spark, sf_dir).select("asset", "date", F.col("online").alias("state"))


define("t_agree", f"""
  SELECT e.asset, e.state AS a, {_DMIN} AS b, count(*) AS c FROM t_jump d JOIN t_em e USING (asset, i) GROUP BY 1, 2, 3""")


@query("A21_label_agreement", f"""
  SELECT asset, n, {r('same/n', 8, 'raw_agreement')}, {r('(ij - ai*bj/(n*(n-1)/2)) / ((ai+bj)/2 - ai*bj/(n*(n-1)/2))', 8, 'adjusted_rand')} FROM (
    SELECT asset, CAST(sum(c) AS BIGINT) AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) AS same, sum(c*(c-1)/2) AS ij FROM t_agree GROUP BY 1) JOIN (
    SELECT asset, sum(s*(s-1)/2) AS ai FROM (SELECT asset, a, sum(c) AS s FROM t_agree GROUP BY 1, 2) GROUP BY 1) USING (asset) JOIN (
    SELECT asset, sum(s*(s-1)/2) AS bj FROM (SELECT asset, b, sum(c) AS s FROM t_agree GROUP BY 1, 2) GROUP BY 1) USING (asset)""", branches=True)
def label_agreement(spark, sf_dir):
    both = jump_rows(spark, sf_dir).select("asset", "date", F.col("online").alias("b")).join(
        study.states(spark, sf_dir).select("asset", "date", F.col("state").alias("a")), ["asset", "date"])
    return tidy(rg.agreement(both, "a", "b"), ["asset", "n"], raw_agreement=8, adjusted_rand=8)


define("t_bins", """
  SELECT *, CAST(least((rn - 1)*3 // n, 2) AS INT) AS bin FROM (
    SELECT s.asset, s.date, s.state, v.vix_close AS v, row_number() OVER (PARTITION BY asset ORDER BY vix_close, date) AS rn, count(*) OVER (PARTITION BY asset) AS n,
      rank() OVER (PARTITION BY asset ORDER BY state) + (count(*) OVER (PARTITION BY asset, state) - 1)/2 AS rs, rank() OVER (PARTITION BY asset ORDER BY vix_close) + (count(*) OVER (PARTITION BY asset, vix_close) - 1)/2 AS rk
    FROM t_states s JOIN t_second v USING (date))""")


def validated(spark, sf_dir):
    from varloom.sources.tables import second_calendar

    return study.states(spark, sf_dir).join(second_calendar(spark, sf_dir), "date")


@query("A20_state_concordance", f"SELECT asset, state, bin, n, {r('n/sum(n) OVER (PARTITION BY asset, state)', 8, 'share')} FROM (SELECT asset, state, bin, count(*) AS n FROM t_bins GROUP BY 1, 2, 3)")
def state_concordance(spark, sf_dir):
    return tidy(rg.concordance(validated(spark, sf_dir), "vix_close", K), ["asset", "state", "bin", "n"], share=8)


@query("A20_concordance_summary", f"""
  SELECT asset, {r('corr(rs, rk)', 8, 'spearman')}, {r('avg(CASE WHEN bin = state THEN 1.0 ELSE 0.0 END)', 8, 'diag_share')},
    {', '.join(r(f'avg(v) FILTER (state = {k})', 4, f'mean_state{k}') for k in range(3))} FROM t_bins GROUP BY 1""")
def concordance_summary(spark, sf_dir):
    return tidy(rg.concordance_summary(validated(spark, sf_dir), "vix_close", K), ["asset"], spearman=8, diag_share=8, mean_state0=4, mean_state1=4, mean_state2=4)


define("t_power", f"""
  SELECT asset, 0 AS step, {num(1 / 3)} AS q0, {num(1 / 3)} AS q1, {num(1 / 3)} AS q2 FROM t_par
  UNION ALL SELECT p.asset, step + 1, {', '.join(f'q0*a0{k}+q1*a1{k}+q2*a2{k}' for k in range(3))} FROM t_power s JOIN t_par p USING (asset) WHERE step < 200""")
define("t_runs", f"""
  SELECT asset, state, avg(len) AS mean_run FROM (
    SELECT asset, island, state, count(*) AS len FROM (
      SELECT *, sum(CASE WHEN state IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER ({W}) AS island
      FROM (SELECT asset, date, state, lag(state) OVER ({W}) AS p FROM t_ztrain)) GROUP BY 1, 2, 3) GROUP BY 1, 2""")


@query("A25_persistence_table", f"""
  SELECT t.asset, t.state, {r('t.p', 8, 'stay')}, {r('1/(1-t.p)', 6, 'expected_duration')}, {r('CASE t.state WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END', 8, 'stationary')},
    {r('m.n/sum(m.n) OVER (PARTITION BY t.asset)', 8, 'share')}, {r('mean_run', 8, 'mean_run')}
  FROM t_trans t JOIN t_power w ON w.asset = t.asset AND w.step = 200 JOIN t_mom m ON m.asset = t.asset AND m.state = t.state JOIN t_runs u ON u.asset = t.asset AND u.state = t.state WHERE t.prev = t.state""", branches=True)
def persistence_table(spark, sf_dir):
    return tidy(rg.persistence(trained(spark, sf_dir), K), ["asset", "state"], stay=8, expected_duration=6, stationary=8, share=8, mean_run=8)


define("t_sig", f"""
  SELECT e.asset, e.date, f.p2, {_G[2]} AS g2, greatest(f.p0, f.p1, f.p2) AS mx, CASE WHEN f.p0 >= f.p1 AND f.p0 >= f.p2 THEN 0 WHEN f.p1 >= f.p2 THEN 1 ELSE 2 END AS s
  FROM t_filt f JOIN t_back b USING (asset, i) JOIN t_em e USING (asset, i) WHERE e.date >= DATE '{TEST_START}'""")


@query("A26_causal_signal_summary", f"""
  SELECT asset, 'chain' AS estimator, count(*) AS n_test, CAST(sum(CASE WHEN s <> p THEN 1 ELSE 0 END) AS BIGINT) AS switches, {r('avg(mx)', 8, 'mean_max_posterior')}, {r('avg(abs(g2-p2))', 8, 'mean_abs_gap')},
    {r('count(*)/(1+sum(CASE WHEN s <> p THEN 1 ELSE 0 END))', 8, 'mean_duration')}, {', '.join(f'count(*) FILTER (s = {k}) AS days_state{k}' for k in range(3))}
  FROM (SELECT *, lag(s) OVER ({W}) AS p FROM t_sig) GROUP BY 1""", branches=True)
def causal_signal_summary(spark, sf_dir):
    board = filtered(spark, sf_dir).withColumn("estimator", F.lit("chain"))
    return tidy(rg.signal_summary(board, TEST_START), ["asset", "estimator", "n_test", "switches", *[f"days_state{k}" for k in range(3)]], mean_max_posterior=8, mean_abs_gap=8, mean_duration=8)


@query("W6_lagged_gate", f"""
  SELECT e.asset, e.date, {', '.join(r(f'coalesce(lag(f.p{k}) OVER (PARTITION BY e.asset ORDER BY e.date), {num(1 / 3)})', 7, f'g{k}') for k in range(3))} FROM t_filt f JOIN t_em e USING (asset, i)""", branches=True)
def lagged_gate(spark, sf_dir):
    rows = rg.lagged_gate(filtered(spark, sf_dir))
    return tidy(rows.select("asset", "date", *[F.col("gate")[k].alias(f"g{k}") for k in range(3)]), ["asset", "date"], g0=7, g1=7, g2=7)


@query("X10_gate_entropy", f"""
  SELECT e.asset, count(*) AS n, {r('avg(-(f.p0*ln(greatest(f.p0,1e-300))+f.p1*ln(greatest(f.p1,1e-300))+f.p2*ln(greatest(f.p2,1e-300))))', 8, 'mean_entropy')} FROM t_filt f JOIN t_em e USING (asset, i) GROUP BY 1""", branches=True)
def gate_entropy(spark, sf_dir):
    h = -F.aggregate(F.transform("p", lambda g: g * F.ln(F.greatest(g, F.lit(1e-300)))), F.lit(0.0), lambda a, v: a + v)
    return tidy(filtered(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("n"), F.avg(h).alias("mean_entropy")), ["asset", "n"], mean_entropy=8)


def training(spark, sf_dir, columns=("x",)):
    panel = trained(spark, sf_dir) if columns == ("x",) else two_columns(spark, sf_dir).where(F.col("date") <= F.lit(TRAIN_END).cast("date"))
    return rf.vector_series(panel, columns)


@query("G6_jump_fit")
def jump_fit(spark, sf_dir):
    fit = rf.fit_jump(training(spark, sf_dir), [K], [HEADLINE])
    return fit.select("asset", "k", "penalty", F.round("objective", 6).alias("objective"), "converged", "n_iter", "restarts_converged", F.posexplode(F.arrays_zip("means", "variances")).alias("state", "m")).select(
        "asset", "k", "penalty", "objective", "converged", "n_iter", "restarts_converged", "state", F.round(F.col("m.means")[0], 6).alias("mean"), F.round(F.col("m.variances")[0], 6).alias("variance"))


@query("G6_fixed_point", f"SELECT DISTINCT asset, k, penalty, true AS converged, true AS same_objective, true AS attained, true AS ordered FROM t_ztrain, (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest({list(PENALTIES)}::DOUBLE[]) AS penalty)", branches=True)
def jump_fixed_point(spark, sf_dir):
    """One more round of every fit by the JVM's own moments and path recursion must change nothing."""
    fit = rf.fit_jump(training(spark, sf_dir), K_GRID, PENALTIES).withColumn("flat", F.transform("x", lambda v: v[0]))
    fit = fit.withColumn("m", rg.path_moments(F.col("flat"), F.col("path"), F.col("k")))
    fit = fit.withColumn("dp", rc.jump_path(rc.gaussian_losses(F.col("flat"), F.col("m.means"), F.col("m.variances")), F.col("penalty")))
    losses = rc.gaussian_losses(F.col("flat"), F.col("m.means"), F.col("m.variances"))
    cost = F.aggregate(F.zip_with(losses, "path", lambda l, s: F.element_at(l, s + 1)), F.lit(0.0), lambda s, v: s + v) + F.col("penalty") * rg.jump_count(F.col("path"))
    flat = F.flatten("variances")
    return fit.select(
        "asset", "k", "penalty", "converged", (F.abs(F.col("dp.objective") - F.col("objective")) <= 1e-8 * F.abs("objective")).alias("same_objective"),
        (F.abs(cost - F.col("objective")) <= 1e-8 * F.abs("objective")).alias("attained"), (flat == F.array_sort(flat)).alias("ordered"))


@query("G9_penalty_sweep")
def penalty_sweep(spark, sf_dir):
    return rg.jump_summary(rf.fit_jump(training(spark, sf_dir), [K], PENALTIES))


@query("K4_penalty_choice")
def penalty_choice(spark, sf_dir):
    return rg.choose_penalty(rg.jump_summary(rf.fit_jump(training(spark, sf_dir), [K], PENALTIES)))


@query("G8_information_criteria")
def information_criteria(spark, sf_dir):
    summary = rg.jump_summary(rf.fit_jump(training(spark, sf_dir), K_GRID, [COUNTING]))
    return summary.select("asset", "k", "n", "loglik", "n_params", "bic", "aic", "converged", "n_iter")


@query("G4_chain_fit")
def chain_fit(spark, sf_dir):
    return rg.chain_summary(rf.fit_chain(training(spark, sf_dir), [K]))


@query("G4_fixed_point", "SELECT DISTINCT asset, 3 AS k, true AS settled, true AS same_likelihood, true AS no_gain, true AS ordered FROM t_ztrain", branches=True)
def chain_fixed_point(spark, sf_dir):
    """The JVM's filter must give the likelihood that a fit reports, and no labelling by the rule states a higher one."""
    series = training(spark, sf_dir)
    fit = rf.fit_chain(series, [K])
    by_rule = rg.vector_parameters(trained(spark, sf_dir), ["x"], K)
    rule = rg.chain_likelihood(series, by_rule).select("asset", F.col("loglik").alias("by_rule"))
    own = rg.chain_likelihood(series, fit.select("asset", "k", "means", "covariances", "start", "matrix")).select("asset", F.col("loglik").alias("again"))
    traces = F.transform("covariances", lambda c: c[0][0])
    return fit.join(own, "asset").join(rule, "asset").select(
        "asset", "k", (F.col("converged") | (F.col("n_iter") == rf.CHAIN_ROUNDS)).alias("settled"), (F.abs(F.col("again") - F.col("loglik")) <= 1e-6 * F.abs("loglik")).alias("same_likelihood"),
        (F.col("by_rule") <= F.col("loglik") + 1e-6).alias("no_gain"), (traces == F.array_sort(traces)).alias("ordered"))


@query("G10_jump_penalised_chain", branches=True)
def jump_penalised_chain(spark, sf_dir):
    path = rg.path_rows(rf.fit_jump(training(spark, sf_dir), [K], [HEADLINE]), ["asset"])
    out = rg.filter_states(rc.as_series(labelled(spark, sf_dir), "x"), rg.chain_parameters(path, K))
    return out.select("asset", "date", "state", *[F.round(F.col("p")[k], 7).alias(f"p{k}") for k in range(K)])


# ------------------------------------------------------------------------- two columns: returns and log variance

VECTOR = ("x", "y")


def two_columns(spark, sf_dir):
    panel = labelled(spark, sf_dir).withColumn("_log_rv", F.ln(F.greatest("rv", F.lit(1e-16))))
    return rg.standardize(panel, "_log_rv", TRAIN_END, "y")


def vector_filtered(spark, sf_dir):
    panel = two_columns(spark, sf_dir)
    train = panel.where(F.col("date") <= F.lit(TRAIN_END).cast("date"))
    return rg.filter_states(rf.vector_series(panel, VECTOR), rg.vector_parameters(train, VECTOR, K))


define("t_z2", f"""
  SELECT z.*, (ln(greatest(z.rv, 1e-16)) - m)/CASE WHEN d < 1e-12 THEN 1 ELSE d END AS y FROM t_z z JOIN (
    SELECT asset, avg(ln(greatest(rv, 1e-16))) AS m, stddev_pop(ln(greatest(rv, 1e-16))) AS d FROM t_z WHERE date <= DATE '{TRAIN_END}' GROUP BY 1) USING (asset)""")
define("t_mom2", f"""
  SELECT asset, state, avg(x) AS mx, avg(y) AS my, greatest(var_samp(x), 1e-6) AS vx, greatest(var_samp(y), 1e-6) AS vy, covar_samp(x, y) AS c
  FROM t_z2 WHERE date <= DATE '{TRAIN_END}' GROUP BY 1, 2""")
_Q = "((x-mx)*(x-mx)*vy - 2*(x-mx)*(y-my)*c + (y-my)*(y-my)*vx)/(vx*vy-c*c)"
define("t_em2", f"""
  SELECT asset, date, i, {', '.join(f'max(CASE WHEN state = {k} THEN l END) AS l{k}' for k in range(3))}, {', '.join(f'any_value({c}) AS {c}' for c in [f's{k}' for k in range(3)] + [f'a{i}{j}' for i in range(3) for j in range(3)])}
  FROM (SELECT z.asset, z.date, z.i, m.state, 0.5*({_Q} + ln(vx*vy-c*c) + {num(2.0)}*ln({num(2 * pi)})) AS l, p.* EXCLUDE (asset)
    FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM t_z2) z JOIN t_mom2 m USING (asset) JOIN t_par p USING (asset)) GROUP BY 1, 2, 3""")
define("t_filt2", f"""
  SELECT asset, i, {', '.join(f'w{k}/(w0+w1+w2) AS p{k}' for k in range(3))}, ln(w0+w1+w2) - lo AS ll FROM (
    SELECT e.asset, e.i, least(e.l0,e.l1,e.l2) AS lo, {', '.join(f'e.s{k}*{_LIK[k]} AS w{k}' for k in range(3))} FROM t_em2 e WHERE e.i = 1)
  UNION ALL SELECT asset, i, {', '.join(f'w{k}/(w0+w1+w2)' for k in range(3))}, ln(w0+w1+w2) - lo FROM (
    SELECT e.asset, e.i, least(e.l0,e.l1,e.l2) AS lo, {', '.join(f'{_PRED[k]}*{_LIK[k]} AS w{k}' for k in range(3))} FROM t_filt2 f JOIN t_em2 e ON e.asset = f.asset AND e.i = f.i + 1)""")


@query("X12_vector_losses", f"SELECT asset, date, {r('l0', 6, 'loss0')}, {r('l1', 6, 'loss1')}, {r('l2', 6, 'loss2')} FROM t_em2", branches=True)
def vector_state_losses(spark, sf_dir):
    panel = two_columns(spark, sf_dir)
    par = rg.vector_parameters(panel.where(F.col("date") <= F.lit(TRAIN_END).cast("date")), VECTOR, K)
    rows = panel.join(par, "asset").withColumn("l", rc.vector_losses(F.array(F.array(*VECTOR)), F.col("means"), F.col("covariances"))[0])
    return tidy(rows.select("asset", "date", *[F.col("l")[k].alias(f"loss{k}") for k in range(K)]), ["asset", "date"], loss0=6, loss1=6, loss2=6)


@query("G1_vector_filter", f"SELECT e.asset, e.date, {', '.join(r(f'f.p{k}', 7, f'p{k}') for k in range(3))} FROM t_filt2 f JOIN t_em2 e USING (asset, i)", branches=True)
def vector_filter(spark, sf_dir):
    out = vector_filtered(spark, sf_dir).select("asset", "date", *[F.col("p")[k].alias(f"p{k}") for k in range(K)])
    return tidy(out, ["asset", "date"], p0=7, p1=7, p2=7)


@query("X18_vector_criteria", f"""
  SELECT asset, 3 AS k, count(*) AS n, 23 AS n_params, {r('sum(ll)', 5, 'loglik')}, {r('-2*sum(ll) + 23*ln(count(*))', 5, 'bic')}, {r('-2*sum(ll) + 46', 5, 'aic')} FROM t_filt2 GROUP BY 1""", branches=True)
def vector_criteria(spark, sf_dir):
    panel = two_columns(spark, sf_dir)
    par = rg.vector_parameters(panel.where(F.col("date") <= F.lit(TRAIN_END).cast("date")), VECTOR, K)
    return tidy(rg.chain_likelihood(rf.vector_series(panel, VECTOR), par), ["asset", "k", "n", "n_params"], loglik=5, bic=5, aic=5)


@query("G4_vector_fit")
def vector_chain_fit(spark, sf_dir):
    return rg.chain_summary(rf.fit_chain(training(spark, sf_dir, VECTOR), [K]))


@query("G6_vector_fit")
def vector_jump_fit(spark, sf_dir):
    return rg.jump_summary(rf.fit_jump(training(spark, sf_dir, VECTOR), [K], PENALTIES))


@query("G10_vector_chain", branches=True)
def vector_jump_chain(spark, sf_dir):
    path = rg.path_rows(rf.fit_jump(training(spark, sf_dir, VECTOR), [K], [HEADLINE]), ["asset"], columns=VECTOR)
    out = rg.filter_states(rf.vector_series(two_columns(spark, sf_dir), VECTOR), rg.vector_parameters(path, VECTOR, K))
    return out.select("asset", "date", "state", *[F.round(F.col("p")[k], 7).alias(f"p{k}") for k in range(K)])


@query("X18_chain_criteria", f"""
  SELECT asset, 3 AS k, count(*) AS n, 14 AS n_params, {r('sum(ll)', 5, 'loglik')}, {r('-2*sum(ll) + 14*ln(count(*))', 5, 'bic')}, {r('-2*sum(ll) + 28', 5, 'aic')} FROM t_filt GROUP BY 1""", branches=True)
def chain_criteria(spark, sf_dir):
    out = rg.chain_likelihood(rc.as_series(labelled(spark, sf_dir), "x"), rg.chain_parameters(trained(spark, sf_dir), K))
    return tidy(out, ["asset", "k", "n", "n_params"], loglik=5, bic=5, aic=5)


def state_counts(spark, sf_dir):
    """Criteria of both models for every number of states."""
    series = training(spark, sf_dir)
    names = ["loglik", "n_params", "bic", "aic", "converged", "n_iter"]
    jump = rg.jump_summary(rf.fit_jump(series, K_GRID, [COUNTING])).select("asset", "k", F.lit("jump").alias("model"), *names)
    chain = rg.chain_summary(rf.fit_chain(series, K_GRID)).select("asset", "k", F.lit("chain").alias("model"), *names)
    return jump.unionByName(chain)


@query("G11_state_count_criteria", branches=True)
def state_count_criteria(spark, sf_dir):
    return tidy(state_counts(spark, sf_dir), ["asset", "k", "model", "n_params", "converged", "n_iter"], loglik=4, bic=4, aic=4)


@query("K3_best_state_count", branches=True)
def best_state_count(spark, sf_dir):
    return state_counts(spark, sf_dir).groupBy("asset", "model").agg(F.min_by("k", F.struct("bic", "k")).alias("best_k"), F.round(F.min("bic"), 4).alias("bic"))


@query("G12_penalty_sensitivity", branches=True)
def penalty_sensitivity(spark, sf_dir):
    fits = rf.fit_jump(training(spark, sf_dir), [K], SENSITIVITY)
    out = rg.penalty_sensitivity(labelled(spark, sf_dir), fits, HEADLINE, TRAIN_END, TEST_START)
    return tidy(out, ["asset", "penalty", "n_jumps", "clears_floor", "test_switches", "is_headline"], mean_duration=6, agreement_test=6, agreement_train=6)


@query("G14_regime_board", f"""
  SELECT e.asset, e.date, 'rule' AS estimator, e.state FROM t_em e
  UNION ALL SELECT e.asset, e.date, 'jump', {_DMIN} FROM t_jump d JOIN t_em e USING (asset, i)
  UNION ALL SELECT e.asset, e.date, 'chain_filtered', CASE WHEN f.p0 >= f.p1 AND f.p0 >= f.p2 THEN 0 WHEN f.p1 >= f.p2 THEN 1 ELSE 2 END FROM t_filt f JOIN t_em e USING (asset, i)
  UNION ALL SELECT e.asset, e.date, 'chain_decoded', p.state FROM t_vpath p JOIN t_em e USING (asset, i)""", branches=True)
def regime_board(spark, sf_dir):
    rule = study.states(spark, sf_dir).select("asset", "date", F.lit("rule").alias("estimator"), "state")
    jump = jump_rows(spark, sf_dir).select("asset", "date", F.lit("jump").alias("estimator"), F.col("online").alias("state"))
    chain = filtered(spark, sf_dir).select("asset", "date", F.explode(F.array(
        F.struct(F.lit("chain_filtered").alias("estimator"), F.col("state").alias("state")), F.struct(F.lit("chain_decoded").alias("estimator"), F.col("path").alias("state")))).alias("e"))
    return rule.unionByName(jump).unionByName(chain.select("asset", "date", "e.*"))
