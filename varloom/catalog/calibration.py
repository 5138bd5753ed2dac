"""Point, interval and distribution scores, and their breakdown by lagged regime."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.significance import lagged_states
from varloom.catalog.sql import QLIKE, W, define, num, phi, r, rs, z
from varloom.functions import laws as fl
from varloom.operators import calibration as cal, forecasters as fc, scoring as sc, timing as tm, walkforward as wf
from varloom.operators.walkforward import BASELINES
from varloom.plans import study

TAUS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
IKEY = ["asset", "method", "level_pct"]
IV = """count(*) AS n, avg(CASE WHEN y_true BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS picp, avg(hi - lo) AS mpiw,
  avg(hi - lo + CASE WHEN y_true < lo THEN 200.0/(100-level_pct)*(lo-y_true) WHEN y_true > hi THEN 200.0/(100-level_pct)*(y_true-hi) ELSE 0 END) AS winkler,
  avg(CASE WHEN y_true BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) - any_value(level_pct)/100 AS coverage_error"""
IVR = rs(picp=8, mpiw=8, winkler=8, coverage_error=8)
IVD = dict(picp=8, mpiw=8, winkler=8, coverage_error=8)


@query("A4_point_losses", f"""
  SELECT asset, model, count(*) AS n, {r('avg((y_true-yhat)*(y_true-yhat))', 9, 'mse')}, {r('sqrt(avg((y_true-yhat)*(y_true-yhat)))', 9, 'rmse')},
         {r('avg(abs(y_true-yhat))', 9, 'mae')} FROM t_board GROUP BY 1, 2""")
def point_losses(spark, sf_dir):
    out = sc.aligned(study.board(spark, sf_dir)).groupBy("asset", "model").agg(*sc.point_aggregates())
    return tidy(out, ["asset", "model", "n"], mse=9, rmse=9, mae=9)


@query("X6_row_losses", f"SELECT asset, date, model, {r(QLIKE, 9, 'qlike')}, {r('(y_true-yhat)*(y_true-yhat)', 9, 'se')} FROM t_board")
def row_losses(spark, sf_dir):
    from varloom.functions.losses import loss_by_name

    y, h = F.col("y_true"), F.col("yhat")
    out = study.board(spark, sf_dir).select("asset", "date", "model", loss_by_name("qlike")(y, h).alias("qlike"), loss_by_name("mse")(y, h).alias("se"))
    return tidy(out, ["asset", "date", "model"], qlike=9, se=9)


@query("A7_interval_coverage", f"SELECT asset, method, level_pct, n, {rs(picp=8, mpiw=8, coverage_error=8)} FROM (SELECT asset, method, level_pct, {IV} FROM t_iv GROUP BY 1, 2, 3)")
def interval_coverage(spark, sf_dir):
    return tidy(sc.interval_table(study.intervals(spark, sf_dir)), [*IKEY, "n"], picp=8, mpiw=8, coverage_error=8)


@query("A12_interval_metrics", f"SELECT asset, method, level_pct, n, {IVR} FROM (SELECT asset, method, level_pct, {IV} FROM t_iv GROUP BY 1, 2, 3)")
def interval_metrics(spark, sf_dir):
    return tidy(sc.interval_table(study.intervals(spark, sf_dir)), [*IKEY, "n"], **IVD)


@query("A8_winkler_score", f"SELECT method, level_pct, n, {rs(winkler=8)} FROM (SELECT method, level_pct, {IV} FROM t_iv GROUP BY 1, 2)")
def winkler_score(spark, sf_dir):
    return tidy(sc.interval_table(study.intervals(spark, sf_dir), ("method", "level_pct")), ["method", "level_pct", "n"], winkler=8)


define("t_q", " UNION ALL ".join(
    f"SELECT asset, date, method, y_true, {num(t)} AS tau, greatest(exp(mu + {z(t)}*sigma), 1e-14) AS q FROM t_law" for t in TAUS))
define("t_pin", """
  SELECT asset, method, tau, count(*) AS n, avg(greatest(tau*(y_true-q), (tau-1)*(y_true-q))) AS pinball,
         avg(CASE WHEN y_true <= q THEN 1.0 ELSE 0.0 END) AS empirical FROM t_q GROUP BY 1, 2, 3""")


def quantiles(spark, sf_dir):
    return cal.expand_quantiles(study.law(spark, sf_dir), TAUS)


@query("A9_pinball_loss", f"SELECT asset, method, tau, n, {rs(pinball=9, empirical=8)} FROM t_pin")
def pinball_loss(spark, sf_dir):
    return tidy(sc.pinball_table(quantiles(spark, sf_dir)), ["asset", "method", "tau", "n"], pinball=9, empirical=8)


@query("A9_mean_pinball", f"SELECT asset, method, {r('avg(pinball)', 9, 'mean_pinball')} FROM t_pin GROUP BY 1, 2")
def mean_pinball(spark, sf_dir):
    out = sc.pinball_table(quantiles(spark, sf_dir)).groupBy("asset", "method").agg(F.avg("pinball").alias("mean_pinball"))
    return tidy(out, ["asset", "method"], mean_pinball=9)


@query("A10_quantile_crps", f"""
  SELECT asset, method, n_levels, {r('crps', 9, 'crps')} FROM (
    SELECT asset, method, count(*) AS n_levels, 2*sum((nt - tau)*(np + pinball)/2) AS crps FROM (
      SELECT *, lead(tau) OVER w AS nt, lead(pinball) OVER w AS np FROM t_pin WINDOW w AS (PARTITION BY asset, method ORDER BY tau)) GROUP BY 1, 2)""")
def quantile_crps(spark, sf_dir):
    return tidy(sc.quantile_crps(sc.pinball_table(quantiles(spark, sf_dir))), ["asset", "method", "n_levels"], crps=9)


CRPS = f"(y_true*(2*{phi('(ln(y_true)-mu)/sigma')}-1) - 2*exp(mu+sigma*sigma/2)*({phi('(ln(y_true)-mu)/sigma - sigma')}+{phi('sigma/sqrt(2)')}-1))"
define("t_crps", f"SELECT asset, date, method, {CRPS} AS crps FROM t_law")


@query("A11_lognormal_crps", f"SELECT asset, method, count(*) AS n, {r('avg(crps)', 9, 'crps')} FROM t_crps GROUP BY 1, 2")
def lognormal_crps(spark, sf_dir):
    return tidy(cal.crps_table(study.law(spark, sf_dir)), ["asset", "method", "n"], crps=9)


@query("A13_reliability_curve", f"""
  SELECT asset, method, tau, n, {r('empirical', 8, 'empirical')}, {r('empirical - tau', 8, 'gap')} FROM t_pin""")
def reliability_curve(spark, sf_dir):
    return tidy(cal.reliability(study.law(spark, sf_dir), cal.law_quantile, TAUS), ["asset", "method", "tau", "n"], empirical=8, gap=8)


@query("A31_uq_point_table", f"""
  SELECT asset, method, n, {rs(mse=8, mae=8, qlike=8)} FROM (
    SELECT asset, method, count(*) AS n, avg((y_true-yhat)*(y_true-yhat)) AS mse, avg(abs(y_true-yhat)) AS mae, avg({QLIKE}) AS qlike
    FROM (SELECT asset, method, y_true, greatest(exp(mu+sigma*sigma/2),1e-14) AS yhat FROM t_law) GROUP BY 1, 2)""")
def uq_point_table(spark, sf_dir):
    return tidy(cal.uq_point_table(study.law(spark, sf_dir)), ["asset", "method", "n"], mse=8, mae=8, qlike=8)


@query("A31_crps_estimators", f"""
  SELECT asset, method, 'closed form' AS estimator, {r('avg(crps)', 9, 'crps')} FROM t_crps GROUP BY 1, 2
  UNION ALL SELECT asset, method, 'trapezoid', {r('2*sum((nt - tau)*(np + pinball)/2)', 9)} FROM (
      SELECT *, lead(tau) OVER w AS nt, lead(pinball) OVER w AS np FROM t_pin WINDOW w AS (PARTITION BY asset, method ORDER BY tau)) GROUP BY 1, 2""", branches=True)
def crps_estimators(spark, sf_dir):
    laws = study.law(spark, sf_dir)
    closed = cal.crps_table(laws).select("asset", "method", F.lit("closed form").alias("estimator"), "crps")
    grid = sc.quantile_crps(sc.pinball_table(cal.expand_quantiles(laws, TAUS))).select("asset", "method", F.lit("trapezoid").alias("estimator"), "crps")
    return tidy(closed.unionByName(grid), ["asset", "method", "estimator"], crps=9)


SCALES = [round(0.5 + 0.01 * i, 2) for i in range(251)]
define("t_lawscope", """
  SELECT asset, method, y_true, mu, sigma AS s0, 'all' AS scope FROM t_law
  UNION ALL SELECT asset, method, y_true, mu, sigma, 'state' || s1 FROM t_law JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL""")
define("t_scales", f"""
  SELECT asset, method, scope, scale, count(*) AS n, avg(CASE WHEN abs(ln(y_true)-mu) <= {z(0.95)}*sigma THEN 1.0 ELSE 0.0 END) AS picp, avg({CRPS}) AS crps FROM (
    SELECT *, s0*scale AS sigma FROM t_lawscope, (SELECT unnest([{', '.join(map(str, SCALES))}])::DOUBLE AS scale))
  GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20""")
define("t_scalebest", """
  SELECT asset, method, scope, max(n) AS n, first(scale ORDER BY crps, scale) AS scale_crps, min(crps) AS crps_best, first(scale ORDER BY abs(picp - 0.9), scale) AS scale_coverage,
    max(picp) FILTER (scale = 1.0) AS picp_fitted, max(crps) FILTER (scale = 1.0) AS crps_fitted, first(picp ORDER BY abs(picp - 0.9), scale) AS picp_calibrated,
    min(scale) FILTER (crps <= low*1.001) AS plateau_lo, max(scale) FILTER (crps <= low*1.001) AS plateau_hi
  FROM (SELECT *, min(crps) OVER (PARTITION BY asset, method, scope) AS low FROM t_scales) GROUP BY 1, 2, 3""")


def scale_table(spark, sf_dir):
    return cal.sigma_scale_search(cal.with_scopes(study.law(spark, sf_dir), lagged_states(spark, sf_dir)), SCALES)


@query("A29_sigma_scale_search", f"SELECT asset, method, scope, n, scale_crps, scale_coverage, plateau_lo, plateau_hi, {rs(crps_best=8, picp_fitted=8, crps_fitted=8, picp_calibrated=8)} FROM t_scalebest", branches=True)
def sigma_scale_search(spark, sf_dir):
    return tidy(scale_table(spark, sf_dir), ["asset", "method", "scope", "n", "scale_crps", "scale_coverage", "plateau_lo", "plateau_hi"], crps_best=8, picp_fitted=8, crps_fitted=8, picp_calibrated=8)


# ------------------------------------------------------------------------------------ laws and boards


@query("X8_lognormal_law", f"""
  SELECT asset, date, method, {r('exp(mu)', 8, 'median')}, {r('exp(mu+sigma*sigma/2)', 8, 'mean')}, {r(f'exp(mu+{z(0.95)}*sigma)', 8, 'q95')},
    {r('mu', 8, 'mu_back')}, {r('sigma', 8, 'sigma_back')}, {r('exp(mu+sigma*sigma/2)', 8, 'mean_back')} FROM t_law""")
def lognormal_law(spark, sf_dir):
    mu, sigma = F.col("mu"), F.col("sigma")
    out = study.law(spark, sf_dir).select(
        "asset", "date", "method", fl.lognormal_quantile(mu, sigma, 0.5).alias("median"), fl.lognormal_mean(mu, sigma).alias("mean"),
        fl.lognormal_quantile(mu, sigma, 0.95).alias("q95"), fl.lognormal_quantile(mu, sigma, 0.05).alias("q05"),
    )
    back = fl.lognormal_from_quantiles(F.col("q05"), F.col("median"), F.col("q95"), 0.05, 0.95)
    out = out.select("*", back[0].alias("mu_back"), back[1].alias("sigma_back"),
                     fl.lognormal_mean_from_quantiles(F.col("q05"), F.col("median"), F.col("q95"), 0.05, 0.95).alias("mean_back"))
    return tidy(out, ["asset", "date", "method"], median=8, mean=8, q95=8, mu_back=8, sigma_back=8, mean_back=8)


@query("F12_prediction_intervals", f"SELECT asset, date, method, level_pct, {rs(y_true=7, lo=7, hi=7)} FROM t_iv")
def prediction_intervals(spark, sf_dir):
    return tidy(study.intervals(spark, sf_dir), ["asset", "date", *IKEY[1:]], y_true=7, lo=7, hi=7)


@query("X9_level_from_tag", """
  SELECT DISTINCT method, level_pct, CAST((100 - level_pct) / 200 AS DOUBLE) AS lower_tau, CAST((100 + level_pct) / 200 AS DOUBLE) AS upper_tau FROM t_iv""")
def level_from_tag(spark, sf_dir):
    from varloom.sources.boards import discover_intervals, intervals_wide

    tags = discover_intervals(intervals_wide(study.intervals(spark, sf_dir)))
    return tags.select("method", "level_pct").distinct().select(
        "method", "level_pct", ((100 - F.col("level_pct")) / 200).alias("lower_tau"), ((100 + F.col("level_pct")) / 200).alias("upper_tau"))


@query("S12_interval_discovery", f"SELECT asset, date, method, level_pct, {rs(lo=7, hi=7)} FROM t_iv WHERE method = 'log-walk'")
def interval_discovery(spark, sf_dir):
    from varloom.sources.boards import discover_intervals, intervals_wide

    out = discover_intervals(intervals_wide(study.intervals(spark, sf_dir)))
    return tidy(out.where(F.col("method") == "log-walk"), ["asset", "date", "method", "level_pct"], lo=7, hi=7)


@query("B4_walk_forward_board", f"SELECT asset, date, model, {rs(yhat=7, y_true=7)} FROM t_board")
def walk_forward_board(spark, sf_dir):
    return tidy(study.board(spark, sf_dir), ["asset", "date", "model"], yhat=7, y_true=7)


@query("F1_random_walk", f"SELECT asset, date, {r('f_rw', 9, 'yhat')} FROM t_boardw")
def random_walk(spark, sf_dir):
    folded = study.folded(spark, sf_dir).where("fold_idx is not null")
    return tidy(folded.withColumn("yhat", F.greatest("rv_d", F.lit(wf.FORECAST_FLOOR))), ["asset", "date"], yhat=9)


COEF = {"const": 7, "rv_d": 7, "rv_w": 7, "rv_m": 7, "r2": 7}


@query("F2_level_regression", f"""
  SELECT asset, fold_idx, count(*) AS n_days, count(*) FILTER (lev_lin < 1e-12) AS n_floored,
    {', '.join(r(f'any_value(lev_{k})', d, k) for k, d in COEF.items())} FROM t_fits GROUP BY 1, 2""")
def level_regression(spark, sf_dir):
    fits = study.fits(spark, sf_dir)
    out = fits.groupBy("asset", "fold_idx").agg(
        F.count("*").alias("n_days"), F.count_if("floored").alias("n_floored"), *[F.first(f"lev_{k}").alias(k) for k in COEF])
    return tidy(out, ["asset", "fold_idx", "n_days", "n_floored"], **COEF)


@query("F3_log_regression", f"""
  SELECT asset, fold_idx, {', '.join(r(f'any_value(log_{k})', d, k) for k, d in COEF.items())}, {r('any_value(log_s2)', 8, 's2')} FROM t_fits GROUP BY 1, 2""")
def log_regression(spark, sf_dir):
    out = study.fits(spark, sf_dir).groupBy("asset", "fold_idx").agg(*[F.first(f"log_{k}").alias(k) for k in (*COEF, "s2")])
    return tidy(out, ["asset", "fold_idx"], **COEF, s2=8)


@query("A33_fold_diagnostics", f"""
  SELECT asset, count(*) AS n_folds, {r('avg(r2)', 7, 'mean_r2')}, {r('avg(c)', 7, 'mean_const')}, CAST(sum(fl) AS BIGINT) AS n_floored,
         {r('avg(CASE WHEN r2 IS NOT NULL THEN 1.0 ELSE 0.0 END)', 8, 'solved_share')} FROM (
    SELECT asset, fold_idx, any_value(lev_r2) AS r2, any_value(lev_const) AS c, count(*) FILTER (lev_lin < 1e-12) AS fl FROM t_fits GROUP BY 1, 2) GROUP BY 1""")
def fold_diagnostics(spark, sf_dir):
    folds = study.fits(spark, sf_dir).groupBy("asset", "fold_idx").agg(
        F.first("lev_r2").alias("r2"), F.first("lev_const").alias("c"), F.count_if("floored").alias("fl"))
    out = folds.groupBy("asset").agg(F.count("*").alias("n_folds"), F.avg("r2").alias("mean_r2"), F.avg("c").alias("mean_const"),
                                     F.sum("fl").alias("n_floored"), F.avg(F.col("r2").isNotNull().cast("double")).alias("solved_share"))
    return tidy(out, ["asset", "n_folds", "n_floored"], mean_r2=7, mean_const=7, solved_share=8)


GARCH_ENDS = {"alpha": (0.02, 0.2), "beta": (0.7, 0.95)}
EGARCH_ENDS = {"alpha": (0.05, 0.2), "gamma": (-0.1, 0.1), "beta": (0.8, 0.95)}


def _fit_rows(model: str, table: str, persistence: str, ends: dict) -> str:
    inside = " AND ".join(f"{k} > {lo} AND {k} < {hi}" for k, (lo, hi) in ends.items())
    return f"SELECT asset, '{model}' AS model, count(*) AS n_fits, {r(f'avg({persistence})', 8, 'persistence')}, {r(f'avg(CASE WHEN {inside} THEN 1.0 ELSE 0.0 END)', 8, 'inside_share')} FROM {table} GROUP BY 1"


@query("A33_volatility_diagnostics", f"{_fit_rows('GARCH', 't_gb', 'alpha + beta', GARCH_ENDS)} UNION ALL {_fit_rows('EGARCH', 't_egb', 'beta', EGARCH_ENDS)}", branches=True)
def volatility_diagnostics(spark, sf_dir):
    """Fits, mean persistence and the share of fits inside their grids, per asset and variance model."""
    folded = study.folded(spark, sf_dir)
    garch = fc.grid_fit_summary(fc.garch_forecast(folded), GARCH_ENDS).withColumn("model", F.lit("GARCH"))
    egarch = fc.grid_fit_summary(fc.egarch_forecast(folded), EGARCH_ENDS).withColumn("model", F.lit("EGARCH"))
    return tidy(garch.unionByName(egarch), ["asset", "model", "n_fits"], persistence=8, inside_share=8)


@query("B5_output_guard", """
  SELECT b.asset, count(*) AS n_forecasts, count(*) FILTER (NOT coalesce(b.date BETWEEN f.predict_start AND f.predict_end AND b.date > f.train_end, false)) AS n_violations
  FROM t_board b JOIN t_folded d USING (asset, date) LEFT JOIN t_folds f ON f.asset = b.asset AND f.fold_idx = d.fold_idx GROUP BY 1""", branches=True)
def output_guard(spark, sf_dir):
    folded = study.folded(spark, sf_dir)
    board = wf.to_board(study.fits(spark, sf_dir), wf.BASELINES, keep=["fold_idx"])
    bad = wf.guard_violations(board, wf.fold_table(folded)).groupBy("asset").agg(F.count("*").alias("v"))
    return board.groupBy("asset").agg(F.count("*").alias("n_forecasts")).join(bad, "asset", "left").select(
        "asset", "n_forecasts", F.coalesce("v", F.lit(0)).alias("n_violations"))


@query("B5_caught_leaks", """
  SELECT asset, reason, count(*) AS n FROM (
    SELECT b.asset, CASE WHEN d.fold_idx = 0 THEN 'no such fold' ELSE 'outside window' END AS reason
    FROM t_board b JOIN t_folded d USING (asset, date)) GROUP BY 1, 2""", branches=True)
def caught_leaks(spark, sf_dir):
    """Forecasts filed under the fold before their own: each is caught."""
    board = wf.to_board(study.fits(spark, sf_dir), wf.BASELINES, keep=["fold_idx"]).withColumn("fold_idx", F.col("fold_idx") - 1)
    bad = wf.guard_violations(board, wf.fold_table(study.folded(spark, sf_dir)))
    return bad.groupBy("asset", "reason").agg(F.count("*").alias("n"))


@query("B6_coverage_report", f"""
  SELECT d.asset, m.model, coalesce(k, 0) AS n_forecasts, d.n AS n_days, {r('coalesce(k, 0)/d.n', 8, 'share')}
  FROM (SELECT asset, count(*) AS n FROM t_folded WHERE is_oos GROUP BY 1) d CROSS JOIN (SELECT unnest(['RW-RV', 'HAR-RV', 'HAR-RV-log', 'silent']) AS model) m
  LEFT JOIN (SELECT asset, model, count(DISTINCT date) AS k FROM t_board b JOIN t_folded f USING (asset, date) WHERE f.is_oos AND yhat IS NOT NULL GROUP BY 1, 2) h
    ON h.asset = d.asset AND h.model = m.model""", branches=True)
def coverage_report(spark, sf_dir):
    """The baselines and one registered model that never forecasts."""
    out = wf.coverage_report(study.board(spark, sf_dir), study.folded(spark, sf_dir), [*wf.BASELINES, "silent"])
    return tidy(out, ["asset", "model", "n_forecasts", "n_days"], share=8)


# ----------------------------------------------------------------------------------- regime breakdown


@query("J5_lagged_labels", """
  SELECT f.asset, f.date, l.s1 AS state, l.s2 AS state2 FROM t_folded f LEFT JOIN t_lagged l USING (asset, date) WHERE f.fold_idx IS NOT NULL""")
def lagged_labels(spark, sf_dir):
    days = study.folded(spark, sf_dir).where("fold_idx is not null").select("asset", "date")
    lagged = tm.lag_states(study.states(spark, sf_dir), (1, 2)).withColumnsRenamed({"s1": "state", "s2": "state2"})
    return days.join(lagged, ["asset", "date"], "left")


@query("J6_label_reach", """
  SELECT asset, count(*) FILTER (s.date < f.first) AS n_before, greatest(1 - count(*) FILTER (s.date < f.first), 0) AS n_short,
         greatest(1 - count(*) FILTER (s.date < f.first), 0) = 0 AS ok
  FROM t_states s JOIN (SELECT asset, min(date) AS first FROM t_board GROUP BY 1) f USING (asset) GROUP BY asset""")
def label_reach(spark, sf_dir):
    days = study.folded(spark, sf_dir).where("fold_idx is not null").select("asset", "date")
    return tm.label_reach(days, study.states(spark, sf_dir))


@query("J4_complete_left_join", """
  SELECT asset, count(*) AS n_rows, count(*) FILTER (s.state IS NULL) AS n_missing FROM t_board b LEFT JOIN t_states s USING (asset, date) GROUP BY 1""")
def complete_left_join(spark, sf_dir):
    from varloom.sources.boards import attach_complete

    joined = attach_complete(study.board(spark, sf_dir), study.states(spark, sf_dir).select("asset", "date", "state"))
    return joined.groupBy("asset").agg(F.count("*").alias("n_rows"), F.count_if(F.col("state").isNull()).alias("n_missing"))


@query("W7_regime_indicators", f"""
  SELECT asset, date, {', '.join(f'CASE WHEN s1 IS NOT NULL THEN CAST(s1 = {k} AS INT)::DOUBLE END AS state{k}' for k in range(3))}
  FROM t_lagged WHERE s1 IS NOT NULL""")
def regime_indicators(spark, sf_dir):
    lagged = lagged_states(spark, sf_dir).where("state is not null")
    return lagged.select("asset", "date", *[tm.one_hot(F.col("state"), k).alias(f"state{k}") for k in range(3)])


@query("W8_transition_mask", """
  SELECT b.asset, b.date, s1 IS NOT NULL AND s2 IS NOT NULL AS scored, coalesce(s1 <> s2, false) AS is_transition
  FROM (SELECT DISTINCT asset, date FROM t_board) b LEFT JOIN t_lagged USING (asset, date)""")
def transition_mask(spark, sf_dir):
    days = study.folded(spark, sf_dir).where("fold_idx is not null").select("asset", "date")
    return tm.transitions(days, study.states(spark, sf_dir))


@query("W9_bucket_masks", f"""
  SELECT asset, {', '.join(f'count(*) FILTER (s1 = {k}) AS n_state{k}' for k in range(3))}, count(*) AS n FROM (SELECT DISTINCT asset, date FROM t_board) JOIN t_lagged USING (asset, date) GROUP BY 1""")
def bucket_masks(spark, sf_dir):
    days = study.folded(spark, sf_dir).where("fold_idx is not null").select("asset", "date")
    return tm.align_labels(days, study.states(spark, sf_dir)).groupBy("asset").agg(
        *[F.count_if(F.col("state") == k).alias(f"n_state{k}") for k in range(3)], F.count("*").alias("n"))


@query("V12_bucket_invariant", """
  SELECT asset, count(*) AS n, count(s1) AS n_bucketed, count(*) = count(s1) AS holds FROM (SELECT DISTINCT asset, date FROM t_board) LEFT JOIN t_lagged USING (asset, date) GROUP BY 1""")
def bucket_invariant(spark, sf_dir):
    days = study.folded(spark, sf_dir).where("fold_idx is not null").select("asset", "date")
    labelled = tm.align_labels(days, study.states(spark, sf_dir))
    return labelled.groupBy("asset").agg(F.count("*").alias("n"), F.count("state").alias("n_bucketed")).withColumn("holds", F.col("n") == F.col("n_bucketed"))


define("t_tr", """
  SELECT b.asset, b.date, s1 IS NOT NULL AND s2 IS NOT NULL AS scored, coalesce(s1 <> s2, false) AS is_transition
  FROM (SELECT DISTINCT asset, date FROM t_board) b LEFT JOIN t_lagged USING (asset, date)""")


@query("A17_transition_summary", f"""
  SELECT asset, count(*) FILTER (scored) AS n, count(*) FILTER (is_transition) AS n_transition,
    {r('count(*) FILTER (is_transition) / count(*) FILTER (scored)', 8, 'share')}, 1 AS selector_shift, true AS implementable FROM t_tr GROUP BY 1""")
def transition_summary(spark, sf_dir):
    days = study.folded(spark, sf_dir).where("fold_idx is not null").select("asset", "date")
    return tidy(tm.transition_summary(days, study.states(spark, sf_dir)), ["asset", "n", "n_transition", "selector_shift", "implementable"], share=8)


@query("A18_transition_coverage", f"""
  SELECT asset, method, level_pct, is_transition, n, {IVR} FROM (
    SELECT asset, method, level_pct, is_transition, {IV} FROM t_iv JOIN t_tr USING (asset, date) WHERE scored GROUP BY 1, 2, 3, 4)""", branches=True)
def transition_coverage(spark, sf_dir):
    days = study.folded(spark, sf_dir).where("fold_idx is not null").select("asset", "date")
    out = cal.transition_coverage(study.intervals(spark, sf_dir), tm.transitions(days, study.states(spark, sf_dir)))
    return tidy(out, [*IKEY, "is_transition", "n"], **IVD)


@query("A14_per_regime_intervals", f"""
  SELECT asset, method, level_pct, state, n, {IVR} FROM (
    SELECT asset, method, level_pct, s1 AS state, {IV} FROM t_iv JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL GROUP BY 1, 2, 3, 4
    UNION ALL SELECT asset, method, level_pct, 3, {IV} FROM t_iv JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL GROUP BY 1, 2, 3)""", branches=True)
def per_regime_intervals(spark, sf_dir):
    out = cal.per_regime_intervals(study.intervals(spark, sf_dir), lagged_states(spark, sf_dir))
    return tidy(out, [*IKEY, "state", "n"], **IVD)


@query("A15_per_regime_qlike", f"""
  SELECT asset, coalesce(s1, -1) AS state, count(DISTINCT date) AS n,
    {', '.join(r(f"avg({QLIKE}) FILTER (model = '{m}')", 8, '"' + m + '"') for m in BASELINES)}
  FROM t_board JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL GROUP BY GROUPING SETS ((asset, s1), (asset))""", branches=True)
def per_regime_qlike(spark, sf_dir):
    out = cal.per_regime_qlike(study.board(spark, sf_dir), lagged_states(spark, sf_dir), list(BASELINES))
    out = out.withColumn("state", F.coalesce("state", F.lit(-1)))
    return out.select("asset", "state", "n", *[F.round(m, 8).alias(m) for m in BASELINES])


WIDTH = f"""count(*) AS n, {r('avg(hi-lo)', 8, 'mpiw')}, {r('avg(ln(hi/lo))', 8, 'mean_log_width')}, {r('avg(sigma)', 8, 'mean_sigma_log')},
    {r('avg(CASE WHEN y_true < lo THEN 1.0 ELSE 0.0 END)', 8, 'below_rate')}, {r('avg(CASE WHEN y_true > hi THEN 1.0 ELSE 0.0 END)', 8, 'above_rate')}"""
define("t_width", "SELECT i.*, l.sigma, s.s1 FROM t_iv i JOIN t_law l USING (asset, date, method) LEFT JOIN t_lagged s USING (asset, date)")


@query("A30_width_by_regime", f"""
  SELECT asset, method, level_pct, s1 AS state, {WIDTH} FROM t_width WHERE s1 IS NOT NULL GROUP BY 1, 2, 3, 4
  UNION ALL SELECT asset, method, level_pct, -1, {WIDTH} FROM t_width GROUP BY 1, 2, 3""", branches=True)
def width_by_regime(spark, sf_dir):
    sigmas = study.law(spark, sf_dir).select("asset", "date", "method", "sigma")
    rows = study.intervals(spark, sf_dir).join(sigmas, ["asset", "date", "method"])
    out = cal.width_by_regime(rows, lagged_states(spark, sf_dir), [F.avg("sigma").alias("mean_sigma_log")]).withColumn("state", F.coalesce("state", F.lit(-1)))
    return tidy(out, [*IKEY, "state", "n"], mpiw=8, mean_log_width=8, mean_sigma_log=8, below_rate=8, above_rate=8)
