"""Rolling training windows and refit cadences as forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.forecasters import GH, L, LIN, NAMES, RIDGE, features, solution
from varloom.catalog.sql import CTES, TEST_START, define, folds_of, r, rs
from varloom.catalog.sql import _moments as moments
from varloom.operators import forecasters as fc, walkforward as wf
from varloom.plans import study

ROLLING = wf.SplitPlan(scheme="rolling")
REFIT_FOLDS = 12


def rolled(spark, sf_dir):
    return study.folded(spark, sf_dir, ROLLING)


define("t_rollf", folds_of("t_frame", TEST_START, "2099-12-31", "rolling"))
define("t_rollw", "SELECT asset, fold_idx, min(train_end_pos) AS te, min(train_end_pos) - min(train_len) + 1 AS ts, min(train_len) AS n_train FROM t_rollf WHERE fold_idx IS NOT NULL GROUP BY 1, 2")
define("t_rollm", f"""
  SELECT w.asset, w.fold_idx, {moments().replace(' OVER run', '')}
  FROM t_rollw w JOIN (SELECT asset, date, pos, rv, rv_d, rv_w, rv_m, ln(greatest(rv, 1e-12)) AS lrv, ln(rv) - ln(rv_d) AS lstep FROM t_rollf) g
    ON g.asset = w.asset AND g.pos BETWEEN w.ts AND w.te GROUP BY 1, 2""")
define("t_rollc", CTES["t_coefs"].replace("t_moments", "t_rollm"))


@query("W21_rolling_forecasts", f"""
  SELECT f.asset, f.date, f.fold_idx, f.train_len AS n_train, {r('c.lev_const + c.lev_rv_d*f.rv_d + c.lev_rv_w*f.rv_w + c.lev_rv_m*f.rv_m', 6, 'lev_lin')},
    {r('c.log_const + c.log_rv_d*f.rv_d + c.log_rv_w*f.rv_w + c.log_rv_m*f.rv_m', 6, 'log_lin')}, {r('c.log_s2', 6, 'log_s2')}, {r('c.sd_step', 6, 'sd_step')}
  FROM t_rollf f JOIN t_rollc c USING (asset, fold_idx)""", branches=True)
def rolling_forecasts(spark, sf_dir):
    out = wf.har_fits(rolled(spark, sf_dir), "rolling")
    return tidy(out, ["asset", "date", "fold_idx", F.col("train_len").alias("n_train")], lev_lin=6, log_lin=6, log_s2=6, sd_step=6)


define("t_rollg", """
  SELECT w.asset, w.fold_idx, w.ts, w.te, avg(g.r) AS mu, var_pop(g.r) AS s2 FROM t_rollw w JOIN t_gr g ON g.asset = w.asset AND g.pos BETWEEN w.ts AND w.te GROUP BY 1, 2, 3, 4""")
H = GH.replace("b1", "(s.b1 - s.dk/z.dk*z.b1)").replace("b2", "(s.b2 - s.dk/z.dk*z.b2)").replace("(1-dk)", "(1-s.dk/z.dk)").replace("+ dk*s2", "+ s.dk/z.dk*s2").replace("beta", "s.beta")
ALPHAS = f"(SELECT unnest([{', '.join(map(str, fc.GARCH_ALPHAS))}])::DOUBLE AS alpha)"
define("t_rollll", f"""
  SELECT asset, fold_idx, alpha, beta, sum(-0.5*(ln(greatest(h,1e-12)) + (r-mu)*(r-mu)/greatest(h,1e-12))) AS ll FROM (
    SELECT s.asset, f.fold_idx, alpha, s.beta, s.r, mu, {H} AS h FROM t_gs s JOIN t_rollg f ON f.asset = s.asset AND s.pos BETWEEN f.ts AND f.te
      JOIN t_gs z ON z.asset = s.asset AND z.beta = s.beta AND z.pos = f.ts, {ALPHAS} WHERE alpha + s.beta < 1) GROUP BY 1, 2, 3, 4""")
define("t_rollb", "SELECT asset, fold_idx, arg_max(alpha, ll) AS alpha, arg_max(beta, ll) AS beta, max(ll) AS ll FROM t_rollll GROUP BY 1, 2")


@query("W21_rolling_volatility", f"""
  SELECT g.asset, g.date, b.alpha, b.beta, {r('b.ll', 4, 'll')}, {r('100*' + H + '/1e4', 6, 'yhat')} FROM (SELECT asset, date, pos, fold_idx FROM t_rollf WHERE fold_idx IS NOT NULL) g
  JOIN t_rollg f USING (asset, fold_idx) JOIN t_rollb b USING (asset, fold_idx) JOIN t_gs s ON s.asset = g.asset AND s.beta = b.beta AND s.pos = g.pos
  JOIN t_gs z ON z.asset = g.asset AND z.beta = b.beta AND z.pos = f.ts""", branches=True)
def rolling_volatility(spark, sf_dir):
    out = fc.garch_forecast(rolled(spark, sf_dir)).withColumn("yhat", F.col("yhat") * 100)
    return tidy(out, ["asset", "date", "alpha", "beta"], ll=4, yhat=6)


def refit(name: str, folds: str, bounds: str) -> None:
    """Lookback regression refitted every REFIT_FOLDS folds on the windows of a scheme."""
    define(f"t_{name}e", f"""
      SELECT asset, fit, fit_start, fit_end, fit_start + CAST(floor((fit_end - fit_start)*0.85) AS BIGINT) AS head_end FROM (
        SELECT asset, fold_idx // {REFIT_FOLDS} * {REFIT_FOLDS} AS fit, {bounds} FROM {folds} WHERE fold_idx IS NOT NULL GROUP BY 1, 2)""")
    define(f"t_{name}d", f"SELECT d.* EXCLUDE (fit_end, head_end), e.fit, e.fit_start, e.fit_end, e.head_end FROM t_des d JOIN t_{name}e e USING (asset)")
    define(f"t_{name}f", solution(f"(SELECT * FROM t_{name}d WHERE pos BETWEEN fit_start AND head_end)", NAMES, "y", "asset, fit", RIDGE))
    define(f"t_{name}s", f"SELECT d.asset, d.fit, avg((y - ({LIN}))*(y - ({LIN}))) AS s2 FROM t_{name}d d JOIN t_{name}f f USING (asset, fit) WHERE pos > head_end AND pos <= fit_end GROUP BY 1, 2")


def refit_sql(name: str) -> str:
    return f"""
  SELECT d.asset, d.date, d.fold_idx, {r(LIN, 6, 'lin')}, {r('s2', 6, 's2')}
  FROM (SELECT *, fold_idx // {REFIT_FOLDS} * {REFIT_FOLDS} AS fit FROM t_des WHERE fold_idx IS NOT NULL) d JOIN t_{name}f f USING (asset, fit) JOIN t_{name}s s USING (asset, fit)"""


refit("refa", "t_folded", "0 AS fit_start, min(train_end_pos) AS fit_end")
refit("refr", "t_rollf", "min(train_end_pos - train_len + 1) AS fit_start, min(train_end_pos) AS fit_end")


@query("B10_refit_forecasts", refit_sql("refa"))
def refit_forecasts(spark, sf_dir):
    out = fc.lookback_forecast(study.folded(spark, sf_dir), features(), L, REFIT_FOLDS, RIDGE)
    return tidy(out, ["asset", "date", "fold_idx"], lin=6, s2=6)


@query("W21_rolling_lookback", refit_sql("refr"))
def rolling_lookback(spark, sf_dir):
    out = fc.lookback_forecast(rolled(spark, sf_dir), features(), L, REFIT_FOLDS, RIDGE)
    return tidy(out, ["asset", "date", "fold_idx"], lin=6, s2=6)
