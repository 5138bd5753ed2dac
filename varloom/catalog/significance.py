"""Tests of equal and conditional predictive ability."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.sql import CTES, QLIKE, chi2, define, num, r, rs, student
from varloom.operators import significance as sg, timing as tm
from varloom.operators.walkforward import BASELINES
from varloom.plans import study

PAIRS = [("HAR-RV", "RW-RV"), ("HAR-RV-log", "RW-RV"), ("HAR-RV-log", "HAR-RV")]
KEY = "asset, model_a, model_b"
KEYS = ["asset", "model_a", "model_b"]
LABELS = tm.LABELS[3]

define("t_loss", f"SELECT asset, date, model, {QLIKE} AS loss FROM t_board")
define("t_pairs", " UNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b" for a, b in PAIRS))
define("t_d", """
  SELECT a.asset, a.date, p.model_a, p.model_b, a.loss AS loss_a, b.loss AS loss_b, a.loss - b.loss AS d
  FROM t_pairs p JOIN t_loss a ON a.model = p.model_a JOIN t_loss b ON b.model = p.model_b AND b.asset = a.asset AND b.date = a.date""")
define("t_dev", f"""
  SELECT {KEY}, date, d, d - avg(d) OVER (PARTITION BY {KEY}) AS dev, row_number() OVER (PARTITION BY {KEY} ORDER BY date) AS i,
         count(*) OVER (PARTITION BY {KEY}) AS n FROM t_d""")
define("t_acov", f"""
  SELECT x.asset, x.model_a, x.model_b, k, any_value(x.n) AS n, sum(x.dev*y.dev) AS c
  FROM t_dev x, (SELECT unnest(range(0, 35)) AS k), t_dev y
  WHERE y.asset = x.asset AND y.model_a = x.model_a AND y.model_b = x.model_b AND y.i = x.i - k GROUP BY 1, 2, 3, 4""")
define("t_dmean", f"SELECT {KEY}, avg(d) AS mean, count(*) AS n, avg(loss_a) AS la, avg(loss_b) AS lb FROM t_d GROUP BY {KEY}")


def dm_sql(lag_source: str, lag: str) -> str:
    return f"""
  SELECT {KEY}, hac_lag, n, mean, raw, raw*sqrt((n + 1 - 2)/n) AS stat, ratio FROM (
    SELECT {KEY}, hac_lag, n, mean, mean/sqrt(greatest(lrv,1e-24)/n) AS raw, greatest(lrv,1e-24)/g0 AS ratio FROM (
      SELECT m.asset, m.model_a, m.model_b, {lag} AS hac_lag, any_value(m.n) AS n, any_value(m.mean) AS mean,
             max(CASE WHEN k = 0 THEN c END)/any_value(m.n) AS g0,
             max(CASE WHEN k = 0 THEN c END)/any_value(m.n) + coalesce(sum(CASE WHEN k BETWEEN 1 AND {lag} THEN 2*(1-k/({lag}+1))*c/(m.n-k) END), 0) AS lrv
      FROM t_dmean m JOIN t_acov a ON a.asset = m.asset AND a.model_a = m.model_a AND a.model_b = m.model_b {lag_source}
      GROUP BY 1, 2, 3, 4))"""


define("t_dm", dm_sql("", "CAST(floor(power(m.n, 1/3) + 1e-9) AS INT)"))
define("t_dmlags", dm_sql(
    ", LATERAL (SELECT unnest(list_distinct([0, 1, 2, 5, 10, 15, 20, 30, CAST(floor(power(m.n, 1/3) + 1e-9) AS INT)])) AS hl) g", "g.hl"))


# The same chain for squared-error losses.
define("t_lossse", "SELECT asset, date, model, (y_true - yhat)*(y_true - yhat) AS loss FROM t_board")
for _name in ("t_d", "t_dev", "t_acov", "t_dmean", "t_dm"):
    _text = CTES[_name].replace("t_loss ", "t_lossse ")
    for _other in ("t_acov", "t_dmean", "t_dev", "t_d"):
        _text = re.sub(rf"\b{_other}\b", f"{_other}se", _text)
    define(f"{_name}se", _text)


def differences(spark, sf_dir, loss: str = "qlike"):
    return sg.pair_losses(study.board(spark, sf_dir), PAIRS, loss)


def acov(spark, sf_dir):
    return sg.autocovariances(differences(spark, sf_dir), "d", sg.PAIR, lags=30)


def lagged_states(spark, sf_dir):
    return tm.lag_states(study.states(spark, sf_dir), (1,)).withColumnRenamed("s1", "state")


@query("T1_diebold_mariano", f"""
  SELECT {KEY}, n, hac_lag, CASE WHEN stat < 0 THEN model_a ELSE model_b END AS better, {r('stat', 7, 'dm_stat')}, {r('raw', 7, 'dm_raw')},
         {r(student('stat', 'n - 1'), 8, 'p_value')}, {r('mean', 9, 'mean_loss_diff')}, {r('ratio', 7, 'lrv_over_gamma0')} FROM t_dm""")
def diebold_mariano(spark, sf_dir):
    out = sg.diebold_mariano(differences(spark, sf_dir))
    return tidy(out, [*KEYS, "n", "hac_lag", "better"], dm_stat=7, dm_raw=7, p_value=8, mean_loss_diff=9, lrv_over_gamma0=7)


@query("E5_squared_error_test", f"""
  SELECT {KEY}, n, hac_lag, CASE WHEN stat < 0 THEN model_a ELSE model_b END AS better, {r('stat', 6, 'dm_stat')},
         {r(student('stat', 'n - 1'), 7, 'p_value')}, {r('mean', 8, 'mean_loss_diff')} FROM t_dmse""")
def squared_error_test(spark, sf_dir):
    out = sg.diebold_mariano(differences(spark, sf_dir, "mse"))
    return tidy(out, [*KEYS, "n", "hac_lag", "better"], dm_stat=6, p_value=7, mean_loss_diff=8)


@query("J10_paired_differences", f"SELECT {KEY}, count(*) AS n, min(date) AS first_date, max(date) AS last_date, {r('avg(d)', 8, 'mean_loss_diff')} FROM t_d GROUP BY {KEY}")
def paired_differences(spark, sf_dir):
    out = differences(spark, sf_dir).groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("d").alias("mean_loss_diff"))
    return tidy(out, [*KEYS, "n", "first_date", "last_date"], mean_loss_diff=8)


@query("T2_loss_differential", f"SELECT {KEY}, date, {rs(loss_a=9, loss_b=9, d=9)} FROM t_d")
def loss_differential(spark, sf_dir):
    return tidy(differences(spark, sf_dir), [*KEYS, "date"], loss_a=9, loss_b=9, d=9)


define("t_acf", f"""
  SELECT a.asset, a.model_a, a.model_b, a.k AS lag, a.n, a.c/b.c AS acf FROM t_acov a JOIN t_acov b USING (asset, model_a, model_b)
  WHERE b.k = 0 AND a.k BETWEEN 1 AND 20""")
define("t_acfb", f"""
  SELECT *, 1/sqrt(n) AS se_white, sqrt((1 + 2*coalesce(sum(acf*acf) OVER (PARTITION BY {KEY} ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))/n) AS se_bartlett
  FROM t_acf""")


@query("T3_sample_acf", f"""
  SELECT {KEY}, lag, n, abs(acf) > 1.96*se_white AS significant_white, abs(acf) > 1.96*se_bartlett AS significant_bartlett,
         {rs(acf=8, se_white=8, se_bartlett=8)} FROM t_acfb""")
def sample_acf(spark, sf_dir):
    out = sg.sample_acf(acov(spark, sf_dir))
    return tidy(out, [*KEYS, "lag", "n", "significant_white", "significant_bartlett"], acf=8, se_white=8, se_bartlett=8)


define("t_ljung", f"""
  SELECT {KEY}, lag, n, n*(n+2.0)*sum(acf*acf/(n-lag)) OVER (PARTITION BY {KEY} ORDER BY lag) AS q FROM t_acf""")


@query("T4_ljung_box", f"""
  SELECT {KEY}, lag, n, {r('q', 6, 'lb_stat')}, {r(f"CASE lag WHEN 5 THEN {chi2('q', 5)} WHEN 10 THEN {chi2('q', 10)} ELSE {chi2('q', 20)} END", 8, 'p_value')}
  FROM t_ljung WHERE lag IN (5, 10, 20)""")
def ljung_box(spark, sf_dir):
    return tidy(sg.ljung_box(acov(spark, sf_dir)), [*KEYS, "lag", "n"], lb_stat=6, p_value=8)


@query("T5_lag_sensitivity", f"""
  SELECT {KEY}, hac_lag, n, hac_lag = floor(power(n, 1/3) + 1e-9) AS is_default, {r('stat', 7, 'dm_stat')},
         {r(student('stat', 'n - 1'), 8, 'p_value')}, {r('ratio', 7, 'lrv_over_gamma0')} FROM t_dmlags""")
def lag_sensitivity(spark, sf_dir):
    out = sg.lag_sensitivity(acov(spark, sf_dir))
    return tidy(out, [*KEYS, "hac_lag", "n", "is_default"], dm_stat=7, p_value=8, lrv_over_gamma0=7)


@query("A36_dm_diagnostics", f"""
  SELECT {KEY}, n_significant_white, n_significant_bartlett, stable, {rs(max_abs_acf=8, p_min=8, p_max=8)} FROM (
    SELECT {KEY}, max(abs(acf)) AS max_abs_acf, count(*) FILTER (abs(acf) > 1.96*se_white) AS n_significant_white,
           count(*) FILTER (abs(acf) > 1.96*se_bartlett) AS n_significant_bartlett FROM t_acfb GROUP BY {KEY}) JOIN (
    SELECT {KEY}, min(p) AS p_min, max(p) AS p_max, bool_and(p < 0.05) OR bool_and(p >= 0.05) AS stable
    FROM (SELECT {KEY}, {student('stat', 'n - 1')} AS p FROM t_dmlags) GROUP BY {KEY}) USING ({KEY})""", branches=True)
def dm_diagnostics(spark, sf_dir):
    out = sg.dm_diagnostics(acov(spark, sf_dir))
    return tidy(out, [*KEYS, "n_significant_white", "n_significant_bartlett", "stable"], max_abs_acf=8, p_min=8, p_max=8)


HAC = """
  SELECT x.asset, x.model_a, x.model_b, {i} AS i, {j} AS j, sum(CASE WHEN k = 0 THEN x.{a}*y.{b} ELSE (1-k/4)*(x.{a}*y.{b} + x.{b}*y.{a}) END)/any_value(x.n) AS omega
  FROM t_dz x, (SELECT unnest(range(0, 4)) AS k), t_dz y
  WHERE y.asset = x.asset AND y.model_a = x.model_a AND y.model_b = x.model_b AND y.i = x.i - k GROUP BY 1, 2, 3"""
define("t_dz", f"""
  SELECT {KEY}, date, d - avg(d) OVER g AS zd, loss_a - avg(loss_a) OVER g AS za, row_number() OVER (PARTITION BY {KEY} ORDER BY date) AS i, count(*) OVER g AS n
  FROM t_d WINDOW g AS (PARTITION BY {KEY})""")


@query("T6_hac_matrix", "SELECT " + KEY + ", i, j, " + r("omega", 9, "omega") + " FROM (" + " UNION ALL ".join(
    HAC.format(i=f"'{i}'", j=f"'{j}'", a=a, b=b) for i, j, a, b in (("d", "d", "zd", "zd"), ("d", "loss_a", "zd", "za"), ("loss_a", "loss_a", "za", "za"))) + ")")
def hac_matrix(spark, sf_dir):
    return tidy(sg.hac_matrix(differences(spark, sf_dir), ["d", "loss_a"], sg.PAIR, 3), [*KEYS, "i", "j"], omega=9)


define("t_gwm", """
  SELECT asset, model_a, model_b, count(*) AS n, avg(d) AS mean_loss_diff,
    """ + ", ".join(f"count(*) FILTER (s1 = {k}) AS n{k}, sum(CASE WHEN s1 = {k} THEN d ELSE 0 END)/count(*) AS m{k}, sum(CASE WHEN s1 = {k} THEN d*d ELSE 0 END)/count(*) AS w{k}" for k in range(3)) + """
  FROM t_d JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL GROUP BY 1, 2, 3""")
define("t_gw", """
  SELECT *, u/(1 - u/n) AS c FROM (SELECT *, CASE WHEN n0*n1*n2 = 0 THEN NULL ELSE n*(m0*m0/w0 + m1*m1/w1 + m2*m2/w2) END AS u FROM t_gwm)""")
define("t_gwl", f"""
  SELECT *, u/(1 - u/n) AS c FROM (
    SELECT *, n*(m1*m1*sc - 2*m1*m2*sb + m2*m2*sa)/(sa*sc - sb*sb) AS u FROM (
      SELECT {KEY}, count(*) AS n, avg(d) AS m1, avg(d*p) AS m2, avg(d*d) AS sa, avg(d*d*p) AS sb, avg(d*p*d*p) AS sc
      FROM (SELECT {KEY}, d, lag(d) OVER (PARTITION BY {KEY} ORDER BY date) AS p FROM t_d) WHERE p IS NOT NULL GROUP BY {KEY}))""")


@query("T7_giacomini_white_regime", f"""
  SELECT {KEY}, n, n0 AS n_state0, n1 AS n_state1, n2 AS n_state2, {rs(mean_loss_diff=9)}, {r('c', 6, 'gw_stat')}, {r(chi2('c', 3), 8, 'p_value')},
         {r('u', 6, 'gw_uncentred')}, {r(chi2('u', 3), 8, 'p_uncentred')}, {r('m0', 9, 'moment0')}, {r('m1', 9, 'moment1')}, {r('m2', 9, 'moment2')} FROM t_gw""", branches=True)
def giacomini_white_regime(spark, sf_dir):
    out = sg.gw_regime(differences(spark, sf_dir), lagged_states(spark, sf_dir))
    return tidy(out, [*KEYS, "n", "n_state0", "n_state1", "n_state2"], mean_loss_diff=9, gw_stat=6, p_value=8, gw_uncentred=6,
                p_uncentred=8, moment0=9, moment1=9, moment2=9)


@query("T7_giacomini_white_lagged", f"""
  SELECT {KEY}, n, {r('c', 6, 'gw_stat')}, {r(chi2('c', 2), 8, 'p_value')}, {r('u', 6, 'gw_uncentred')}, {r(chi2('u', 2), 8, 'p_uncentred')},
         {r('m1', 9, 'moment_const')}, {r('m2', 9, 'moment_lag')} FROM t_gwl""")
def giacomini_white_lagged(spark, sf_dir):
    out = sg.gw_lagged_difference(differences(spark, sf_dir))
    return tidy(out, [*KEYS, "n"], gw_stat=6, p_value=8, gw_uncentred=6, p_uncentred=8, moment_const=9, moment_lag=9)


@query("T8_joint_table", f"""
  SELECT {KEY}, g.n, {r('dm.stat', 7, 'dm_stat_pooled')}, {r(student('dm.stat', 'dm.n - 1'), 8, 'dm_p_pooled')},
         {r('g.c', 6, 'gw_regime_stat')}, {r(chi2('g.c', 3), 8, 'gw_regime_p')}, {r('l.c', 6, 'gw_lagdiff_stat')}, {r(chi2('l.c', 2), 8, 'gw_lagdiff_p')},
         {r('g.m0', 9, 'moment_calm')}, {r('g.m1', 9, 'moment_transitional')}, {r('g.m2', 9, 'moment_crisis')},
         CASE least(g.m0, g.m1, g.m2) WHEN g.m0 THEN 'calm' WHEN g.m1 THEN 'transitional' ELSE 'crisis' END AS a_relative_edge_in,
         coalesce(nullif(concat_ws(', ', CASE WHEN g.m0 < 0 THEN 'calm' END, CASE WHEN g.m1 < 0 THEN 'transitional' END, CASE WHEN g.m2 < 0 THEN 'crisis' END), ''), 'none') AS a_wins_in
  FROM t_gw g JOIN t_dm dm USING ({KEY}) JOIN t_gwl l USING ({KEY})""", branches=True)
def joint_table(spark, sf_dir):
    out = sg.joint_table(differences(spark, sf_dir), lagged_states(spark, sf_dir), LABELS)
    return tidy(out, [*KEYS, "n", "a_relative_edge_in", "a_wins_in"], dm_stat_pooled=7, dm_p_pooled=8, gw_regime_stat=6, gw_regime_p=8,
                gw_lagdiff_stat=6, gw_lagdiff_p=8, moment_calm=9, moment_transitional=9, moment_crisis=9)


define("t_ds", f"""
  SELECT {KEY}, s1 AS state, loss_a, loss_b, d, d - avg(d) OVER (PARTITION BY {KEY}, s1) AS dev, count(*) OVER (PARTITION BY {KEY}, s1) AS n,
         row_number() OVER (PARTITION BY {KEY}, s1 ORDER BY date) AS i FROM t_d JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL""")
define("t_dslrv", f"""
  SELECT x.asset, x.model_a, x.model_b, x.state, any_value(x.n) AS n,
         sum(CASE WHEN k = 0 THEN x.dev*y.dev/x.n WHEN k <= floor(power(x.n, 1/3) + 1e-9) THEN 2*(1-k/(floor(power(x.n, 1/3) + 1e-9)+1))*x.dev*y.dev/(x.n-k) END) AS lrv
  FROM t_ds x, (SELECT unnest(range(0, 35)) AS k), t_ds y
  WHERE y.asset = x.asset AND y.model_a = x.model_a AND y.model_b = x.model_b AND y.state = x.state AND y.i = x.i - k GROUP BY 1, 2, 3, 4""")


@query("A16_per_regime_pairs", f"""
  SELECT {KEY}, state, n, CASE WHEN n < 10 THEN 'insufficient n' WHEN la < lb THEN model_a ELSE model_b END AS better,
         {r('CASE WHEN n >= 10 THEN la END', 8, 'qlike_a')}, {r('CASE WHEN n >= 10 THEN lb END', 8, 'qlike_b')},
         {r('CASE WHEN n >= 10 THEN stat END', 6, 'dm_stat')}, {r('CASE WHEN n >= 10 THEN ' + student('stat', 'n - 1') + ' END', 8, 'p_value')} FROM (
    SELECT {KEY}, state, l.n, m.la, m.lb, (m.la - m.lb)/sqrt(greatest(lrv, 1e-24)/l.n)*sqrt((l.n - 1)/l.n) AS stat FROM t_dslrv l JOIN (
      SELECT {KEY}, state, avg(loss_a) AS la, avg(loss_b) AS lb FROM t_ds GROUP BY {KEY}, state) m USING ({KEY}, state))""", branches=True)
def per_regime_pairs(spark, sf_dir):
    out = sg.per_regime_pairs(differences(spark, sf_dir), lagged_states(spark, sf_dir), LABELS)
    return tidy(out, [*KEYS, "state", "n", "better"], qlike_a=8, qlike_b=8, dm_stat=6, p_value=8)
