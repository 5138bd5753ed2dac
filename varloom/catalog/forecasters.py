"""Lookback regressions, experts, draws, quantiles, volatility grids and replicated boards."""

from __future__ import annotations

from math import exp, pi, sqrt

from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.coverage import quadratic_form
from varloom.catalog.regimes import filtered
from varloom.catalog.significance import lagged_states
from varloom.catalog.sql import QLIKE, W, define, num, r, rs, z
from varloom.functions.laws import lognormal_interval
from varloom.operators import calibration as cal, forecasters as fc, regimes as rg, replication as rep
from varloom.plans import study
from varloom.session import cut_lineage

L = 10
RIDGE = 1.0


def features():
    return {"log_rv": F.ln("rv"), "oc_log_return": F.col("oc_log_return")}


XS = [f"x{k}" for k in range(1, 2 * L + 1)]
define("t_fe", """
  SELECT asset, min(train_end_pos) AS fit_end, CAST(floor(min(train_end_pos)*0.85) AS BIGINT) AS head_end FROM t_folded GROUP BY asset""")
define("t_sc", """
  SELECT asset, avg(ln(rv)) AS m, stddev_pop(ln(rv)) AS s, avg(oc_log_return) AS mo, stddev_pop(oc_log_return) AS so FROM t_folded JOIN t_fe USING (asset) WHERE pos <= fit_end GROUP BY asset""")
define("t_des", f"""
  SELECT * FROM (SELECT f.asset, f.date, f.pos, f.fold_idx, f.rv, ln(f.rv) AS y, 1.0 AS one, fit_end, head_end,
    {', '.join(f'(lag(ln(f.rv), {k}) OVER (PARTITION BY f.asset ORDER BY f.date) - m)/s AS x{k}, (lag(f.oc_log_return, {k}) OVER (PARTITION BY f.asset ORDER BY f.date) - mo)/so AS x{L + k}' for k in range(1, L + 1))}
  FROM t_folded f JOIN t_fe USING (asset) JOIN t_sc USING (asset)) WHERE x{L} IS NOT NULL""")


def solution(source: str, names, y: str, by: str, ridge: float) -> str:
    """Cholesky factor and coefficients b0.. of the penalised normal equations; the last name is the constant."""
    text = quadratic_form(source, names, y, by)
    for i in range(len(names) - 1):
        text = text.replace(f"sum({names[i]}*{names[i]}) AS a{i}_{i}", f"sum({names[i]}*{names[i]}) + {ridge} AS a{i}_{i}")
    k = len(names)
    for j in reversed(range(k)):
        text = f"SELECT *, (z{j}{''.join(f'-l{m}_{j}*c{m}' for m in range(j + 1, k))})/l{j}_{j} AS c{j} FROM ({text})"
    return text


NAMES = [*XS, "one"]
LIN = "+".join(f"c{i}*d.{n}" for i, n in enumerate(NAMES))
define("t_lbf", solution("(SELECT * FROM t_des WHERE pos <= head_end)", NAMES, "y", "asset", RIDGE))
define("t_lbs", f"SELECT d.asset, avg((y - ({LIN}))*(y - ({LIN}))) AS s2 FROM t_des d JOIN t_lbf f USING (asset) WHERE pos > head_end AND pos <= fit_end GROUP BY d.asset")
define("t_lb", f"""
  SELECT d.asset, d.date, d.pos, d.fit_end, d.y, d.fold_idx, d.rv AS y_true, {LIN} AS lin, s2 FROM t_des d JOIN t_lbf f USING (asset) JOIN t_lbs USING (asset)""")


@query("F6_lookback_regression", f"SELECT asset, date, {r('lin', 7, 'lin')}, {r('s2', 7, 's2')}, {r('exp(lin + s2/2)', 7, 'yhat')} FROM t_lb WHERE fold_idx IS NOT NULL")
def lookback_regression(spark, sf_dir):
    return tidy(fc.lookback_forecast(study.folded(spark, sf_dir), features(), L, 0, RIDGE), ["asset", "date"], lin=7, s2=7, yhat=7)


@query("B10_refit_cadence", f"""
  SELECT asset, fold_idx // 12 * 12 AS fit, min(train_end_pos) AS fit_end, count(DISTINCT fold_idx) AS n_folds FROM t_folded WHERE fold_idx IS NOT NULL GROUP BY 1, 2""")
def refit_cadence(spark, sf_dir):
    folded = study.folded(spark, sf_dir).where("fold_idx is not null")
    return folded.withColumn("fit", fc.fit_groups(folded, 12)).groupBy("asset", "fit").agg(
        F.min("train_end_pos").alias("fit_end"), F.countDistinct("fold_idx").alias("n_folds"))


@query("F11_quantile_forecast", f"""
  SELECT asset, date, tau, {r('exp(lin + CASE tau WHEN 0.05 THEN o1 WHEN 0.5 THEN o2 ELSE o3 END)', 7, 'q')} FROM t_lb JOIN (
    SELECT asset, quantile_cont(y - lin, 0.05) AS o1, quantile_cont(y - lin, 0.5) AS o2, quantile_cont(y - lin, 0.95) AS o3 FROM t_lb WHERE pos <= fit_end GROUP BY 1) USING (asset),
    (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS tau) WHERE fold_idx IS NOT NULL""")
def quantile_forecast(spark, sf_dir):
    return tidy(fc.quantile_forecast(study.folded(spark, sf_dir), features(), L, ridge=RIDGE), ["asset", "date", "tau"], q=7)


def gates(spark, sf_dir):
    return cut_lineage(rg.lagged_gate(filtered(spark, sf_dir)).select("asset", "date", "gate", "p"))


define("t_gate", """
  SELECT e.asset, e.date, """ + ", ".join(f"coalesce(lag(f.p{k}) OVER (PARTITION BY e.asset ORDER BY e.date), {num(1 / 3)}) AS g{k}" for k in range(3)) + """
  FROM t_filt f JOIN t_em e USING (asset, i)""")

@query("F11_state_quantiles", branches=True)
def state_quantiles(spark, sf_dir):
    """Held against brute force in the tests; ``F11_quantile_balance`` states in SQL what must hold of the fits."""
    out = fc.state_quantile_forecast(study.folded(spark, sf_dir), features(), L, gates(spark, sf_dir), ridge=RIDGE)
    return tidy(out, ["asset", "date", "tau"], q=7)


@query("F11_quantile_balance", f"""
  SELECT asset, k AS state, tau, count(*) AS n, true AS balanced FROM t_des JOIN t_gate USING (asset, date), (SELECT unnest(range(3)) AS k), (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS tau) WHERE pos <= fit_end GROUP BY 1, 2, 3""", branches=True)
def quantile_balance(spark, sf_dir):
    """At the least loss the constant's slope is 0: below the fit lies the level's share, but for days on the fit itself."""
    design, names = fc.lookback_design(study.folded(spark, sf_dir), features(), L)
    fits = fc.state_quantile_fits(design, names, gates(spark, sf_dir), ridge=RIDGE)
    balanced = F.abs(F.col("below") - F.col("tau")) <= F.col("near") + F.col("largest")
    return fits.select("asset", F.col("state").cast("long").alias("state"), "tau", "n", balanced.alias("balanced"))


define("t_fdes", "SELECT d.*, g.g1 AS e1, g.g2 AS e2 FROM t_des d JOIN t_gate g USING (asset, date) JOIN t_em e USING (asset, date) WHERE e.i > 1")
FN = [*XS, "e1", "e2", "one"]
FLIN = "+".join(f"c{i}*d.{n}" for i, n in enumerate(FN))
define("t_fbf", solution("(SELECT * FROM t_fdes WHERE pos <= head_end)", FN, "y", "asset", RIDGE))
define("t_fbs", f"SELECT d.asset, avg((y - ({FLIN}))*(y - ({FLIN}))) AS s2 FROM t_fdes d JOIN t_fbf f USING (asset) WHERE pos > head_end AND pos <= fit_end GROUP BY d.asset")


@query("F7_regime_feature_regression", f"""
  SELECT d.asset, d.date, {r(FLIN, 6, 'lin')}, {r('s2', 6, 's2')} FROM t_fdes d JOIN t_fbf f USING (asset) JOIN t_fbs USING (asset) WHERE fold_idx IS NOT NULL""", branches=True)
def regime_feature_regression(spark, sf_dir):
    posterior = gates(spark, sf_dir).select("asset", "date", F.col("p")[1].alias("reg_p1"), F.col("p")[2].alias("reg_p2"))
    folded = study.folded(spark, sf_dir).join(posterior, ["asset", "date"])
    out = fc.lookback_forecast(folded, features(), L, 0, RIDGE, {"reg_p1": F.col("reg_p1"), "reg_p2": F.col("reg_p2")})
    return tidy(out, ["asset", "date"], lin=6, s2=6)


define("t_ex", "SELECT d.*, k AS expert, CASE k WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE g2 END AS w FROM t_des d JOIN t_gate g USING (asset, date), (SELECT unnest(range(3)) AS k)")


def weighted(text: str) -> str:
    """Weights every sum of products of the moment aggregation."""
    import re

    return re.sub(r"sum\((\w+)\*(\w+)\)", r"sum(w*\1*\2)", text)


define("t_exf", weighted(solution("(SELECT * FROM t_ex WHERE pos <= head_end)", NAMES, "y", "asset, expert", RIDGE).replace(f"+ {RIDGE} AS", f"+ {RIDGE} AS")))
define("t_exs", f"SELECT d.asset, d.expert, sum(w*(y - ({LIN}))*(y - ({LIN})))/sum(w) AS s2 FROM t_ex d JOIN t_exf f USING (asset, expert) WHERE pos > head_end AND pos <= fit_end GROUP BY 1, 2")


@query("F8_regime_experts", f"""
  SELECT d.asset, d.date, {r(f'sum(w*exp({LIN} + s2/2))', 6, 'yhat')}, {r('sum(w*s2)', 6, 's2')}, {r('-sum(w*ln(greatest(w,1e-300)))', 6, 'gate_entropy')}
  FROM t_ex d JOIN t_exf f USING (asset, expert) JOIN t_exs USING (asset, expert) WHERE fold_idx IS NOT NULL GROUP BY 1, 2""", branches=True)
def regime_experts(spark, sf_dir):
    return tidy(fc.expert_forecast(study.folded(spark, sf_dir), features(), L, gates(spark, sf_dir), ridge=RIDGE), ["asset", "date"], yhat=6, s2=6, gate_entropy=6)


def poisson_sql(u: str) -> str:
    """Count of cumulative Poisson(1) probabilities at or below u, until they are 1 in double precision."""
    from math import factorial

    total, parts, k = 0.0, [], 0
    while total < 1.0 and (not k or total + exp(-1.0) / factorial(k) != total):
        total += exp(-1.0) / factorial(k)
        parts.append(f"CASE WHEN {u} >= {num(total)} THEN 1.0 ELSE 0.0 END")
        k += 1
    return "(" + "+".join(parts) + ")"


DRAWS = 100
define("t_dr", f"""
  SELECT *, {poisson_sql('u')} AS w FROM (SELECT d.*, k AS draw, (('0x' || substr(md5(concat_ws('|', 17, d.asset, d.date, k)), 1, 8))::BIGINT)/4294967296 AS u FROM t_des d, (SELECT unnest(range({DRAWS})) AS k))""")
define("t_drf", weighted(solution("(SELECT * FROM t_dr WHERE pos <= head_end)", NAMES, "y", "asset, draw", RIDGE)))
define("t_drs", f"SELECT d.asset, d.draw, sum(w*(y - ({LIN}))*(y - ({LIN})))/sum(w) AS s2 FROM t_dr d JOIN t_drf f USING (asset, draw) WHERE pos > head_end AND pos <= fit_end GROUP BY 1, 2")
define("t_drl", f"""
  SELECT asset, date, any_value(y_true) AS y_true, avg(lin) AS mu, var_pop(lin) AS ve, avg(s2) AS va FROM (
    SELECT d.asset, d.date, d.rv AS y_true, {LIN} AS lin, s2 FROM t_dr d JOIN t_drf f USING (asset, draw) JOIN t_drs USING (asset, draw) WHERE fold_idx IS NOT NULL) GROUP BY 1, 2""")


@query("F9_predictive_draws", f"SELECT asset, date, {rs(mu=6)}, {r('sqrt(ve+va)', 6, 'sigma')}, {r('sqrt(ve)', 6, 'sd_epistemic')}, {r('sqrt(va)', 6, 'sd_aleatoric')}, {r('exp(mu+(ve+va)/2)', 6, 'yhat')} FROM t_drl")
def predictive_draws(spark, sf_dir):
    draws = fc.draw_forecast(study.folded(spark, sf_dir), features(), L, DRAWS, RIDGE)
    return tidy(fc.draws_to_law(draws), ["asset", "date"], mu=6, sigma=6, sd_epistemic=6, sd_aleatoric=6, yhat=6)


define("t_mx", f"""
  SELECT * EXCLUDE (w, u), w AS gate, w*{poisson_sql('u')} AS w FROM (
    SELECT e.*, k AS draw, (('0x' || substr(md5(concat_ws('|', 17, e.asset, e.date, k)), 1, 8))::BIGINT)/4294967296 AS u FROM t_ex e, (SELECT unnest(range({DRAWS})) AS k))""")
define("t_mxf", weighted(solution("(SELECT * FROM t_mx WHERE pos <= head_end)", NAMES, "y", "asset, expert, draw", RIDGE)))
define("t_mxs", f"SELECT d.asset, d.expert, d.draw, sum(w*(y - ({LIN}))*(y - ({LIN})))/sum(w) AS s2 FROM t_mx d JOIN t_mxf f USING (asset, expert, draw) WHERE pos > head_end AND pos <= fit_end GROUP BY 1, 2, 3")
define("t_mxlaw", "SELECT asset, date, avg(ln(yhat)) AS mu, var_pop(ln(yhat)) AS ve, avg(s2) AS va, any_value(h) AS h FROM t_mxd GROUP BY 1, 2")
define("t_mxd", f"""
  SELECT d.asset, d.date, d.draw, sum(gate*exp({LIN} + s2/2)) AS yhat, sum(gate*s2) AS s2, -sum(gate*ln(greatest(gate,1e-300))) AS h
  FROM t_mx d JOIN t_mxf f USING (asset, expert, draw) JOIN t_mxs USING (asset, expert, draw) WHERE fold_idx IS NOT NULL GROUP BY 1, 2, 3""")


@query("F10_mixture_draws", f"""
  SELECT asset, date, {rs(mu=6)}, {r('sqrt(ve+va)', 6, 'sigma')}, {r('sqrt(ve)', 6, 'sd_epistemic')}, {r('sqrt(va)', 6, 'sd_aleatoric')}, {r('exp(mu+(ve+va)/2)', 6, 'yhat')}, {r('h', 6, 'gate_entropy')} FROM (
    SELECT asset, date, avg(ln(yhat)) AS mu, var_pop(ln(yhat)) AS ve, avg(s2) AS va, any_value(h) AS h FROM t_mxd GROUP BY 1, 2)""", branches=True)
def mixture_draws(spark, sf_dir):
    return tidy(mixture_law(spark, sf_dir), ["asset", "date"], mu=6, sigma=6, sd_epistemic=6, sd_aleatoric=6, yhat=6, gate_entropy=6)


def mixture_law(spark, sf_dir):
    """Predictive law of the gated experts' draws, with both parts of its spread and the gate's entropy."""
    draws = fc.expert_forecast(study.folded(spark, sf_dir), features(), L, gates(spark, sf_dir), ridge=RIDGE, draws=DRAWS).withColumn("lin", F.ln("yhat"))
    entropy = draws.groupBy("asset", "date").agg(F.first("gate_entropy").alias("gate_entropy"))
    return fc.draws_to_law(draws).join(entropy, ["asset", "date"])


MIX_Z = z(0.95)
MIX_ROW = f"""count(*) AS n, {r('avg(hi-lo)', 6, 'mpiw')}, {r('avg(ln(hi/lo))', 6, 'mean_log_width')}, {r('avg(sigma)', 6, 'mean_sigma_log')}, {r('avg(ve)/(avg(ve)+avg(va))', 6, 'epistemic_share')},
    {r('avg(h)', 6, 'mean_gate_entropy')}, {r('avg(CASE WHEN y_true > hi THEN 1.0 ELSE 0.0 END)', 8, 'above_rate')}, {r('avg(CASE WHEN y_true < lo THEN 1.0 ELSE 0.0 END)', 8, 'below_rate')}, 0.05::DOUBLE AS expected_rate"""
define("t_mxiv", f"""
  SELECT asset, date, rv AS y_true, exp(mu - {MIX_Z}*sigma) AS lo, exp(mu + {MIX_Z}*sigma) AS hi, sigma, ve, va, h, s1 FROM (SELECT *, sqrt(ve+va) AS sigma FROM t_mxlaw)
  JOIN (SELECT asset, date, rv FROM t_frame) USING (asset, date) LEFT JOIN (SELECT asset, date, s1 FROM t_lagged) USING (asset, date)""")


@query("A30_mixture_width_by_regime", f"""
  SELECT asset, s1 AS state, {MIX_ROW} FROM t_mxiv WHERE s1 IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT asset, -1, {MIX_ROW} FROM t_mxiv GROUP BY 1""", branches=True)
def mixture_width_by_regime(spark, sf_dir):
    """Does the gated mixture's width follow the lagged state, and through which part of its spread?"""
    laws = mixture_law(spark, sf_dir).withColumn("method", F.lit("mixture"))
    lo, hi = lognormal_interval(F.col("mu"), F.col("sigma"), 90)
    rows = laws.select("*", F.lit(90).alias("level_pct"), lo.alias("lo"), hi.alias("hi"))
    ve, va = F.avg(F.pow("sd_epistemic", F.lit(2.0))), F.avg(F.pow("sd_aleatoric", F.lit(2.0)))
    extra = [F.avg("sigma").alias("mean_sigma_log"), F.try_divide(ve, ve + va).alias("epistemic_share"), F.avg("gate_entropy").alias("mean_gate_entropy")]
    out = cal.width_by_regime(rows, lagged_states(spark, sf_dir), extra).withColumns({"state": F.coalesce("state", F.lit(-1)), "expected_rate": F.lit(0.05)})
    return tidy(out, ["asset", "state", "n"], mpiw=6, mean_log_width=6, mean_sigma_log=6, epistemic_share=6, mean_gate_entropy=6, above_rate=8, below_rate=8, expected_rate=8)


# ------------------------------------------------------------------------------- volatility grids
define("t_gr", "SELECT asset, date, pos, fold_idx, train_end_pos, rv, log_return*100 AS r FROM t_folded")
define("t_gf", """
  SELECT f.asset, f.fold_idx, f.te, avg(g.r) AS mu, var_pop(g.r) AS s2 FROM (SELECT asset, fold_idx, min(train_end_pos) AS te FROM t_gr WHERE fold_idx IS NOT NULL GROUP BY 1, 2) f
  JOIN t_gr g ON g.asset = f.asset AND g.pos <= f.te GROUP BY 1, 2, 3""")
define("t_gs", f"""
  SELECT asset, date, pos, r, beta, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 1.0::DOUBLE AS dk
  FROM t_gr, (SELECT unnest([{', '.join(map(str, fc.GARCH_BETAS))}])::DOUBLE AS beta) WHERE pos = 0
  UNION ALL SELECT n.asset, n.date, n.pos, n.r, p.beta, p.beta*p.b1 + p.r, p.beta*p.b2 + p.r*p.r, p.dk*p.beta
  FROM t_gs p JOIN t_gr n ON n.asset = p.asset AND n.pos = p.pos + 1""")
GH = "(s2*(1-alpha-beta)*(1-dk)/(1-beta) + alpha*(b2 - 2*mu*b1 + mu*mu*(1-dk)/(1-beta)) + dk*s2)"
define("t_gll", f"""
  SELECT asset, fold_idx, alpha, beta, sum(-0.5*(ln(greatest(h,1e-12)) + (r-mu)*(r-mu)/greatest(h,1e-12))) AS ll FROM (
    SELECT s.asset, f.fold_idx, alpha, beta, r, mu, {GH} AS h FROM t_gs s JOIN t_gf f ON f.asset = s.asset AND s.pos <= f.te,
      (SELECT unnest([{', '.join(map(str, fc.GARCH_ALPHAS))}])::DOUBLE AS alpha) WHERE alpha + beta < 1) GROUP BY 1, 2, 3, 4""")
define("t_gb", "SELECT asset, fold_idx, arg_max(alpha, ll) AS alpha, arg_max(beta, ll) AS beta, max(ll) AS ll FROM t_gll GROUP BY 1, 2")


@query("F4_garch_grid", f"""
  SELECT asset, date, alpha, beta, {r('ll', 4, 'll')}, {r('100*' + GH + '/1e4', 6, 'yhat')} FROM t_gr g JOIN t_gf f USING (asset, fold_idx) JOIN t_gb b USING (asset, fold_idx) JOIN t_gs s USING (asset, beta, pos, date)""".replace("FROM t_gr g JOIN", "FROM (SELECT asset, date, pos, fold_idx FROM t_gr) g JOIN"), branches=True)
def garch_grid(spark, sf_dir):
    out = fc.garch_forecast(study.folded(spark, sf_dir)).withColumn("yhat", F.col("yhat") * 100)
    return tidy(out, ["asset", "date", "alpha", "beta"], ll=4, yhat=6)


EG = [(a, g, b) for a in fc.EGARCH_ALPHAS for g in fc.EGARCH_GAMMAS for b in fc.EGARCH_BETAS]
define("t_egf", "SELECT f.*, p.pe FROM t_gf f JOIN (SELECT asset, fold_idx, max(pos) AS pe FROM t_gr WHERE fold_idx IS NOT NULL GROUP BY 1, 2) p USING (asset, fold_idx)")
define("t_egg", " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, {g}::DOUBLE AS gamma, {b}::DOUBLE AS beta" for a, g, b in EG))
define("t_eg", f"""
  SELECT f.asset, f.fold_idx, pos, alpha, gamma, beta, ln(s2) AS lh, r - mu AS e FROM t_egf f JOIN t_gr n ON n.asset = f.asset AND n.pos = 0, t_egg
  UNION ALL SELECT n.asset, p.fold_idx, n.pos, p.alpha, p.gamma, p.beta, (1-p.beta)*ln(f.s2) + p.alpha*(abs(p.e/exp(p.lh/2)) - {num(sqrt(2 / pi))}) + p.gamma*p.e/exp(p.lh/2) + p.beta*p.lh, n.r - f.mu
  FROM t_eg p JOIN t_egf f ON f.asset = p.asset AND f.fold_idx = p.fold_idx JOIN t_gr n ON n.asset = p.asset AND n.pos = p.pos + 1 WHERE n.pos <= f.pe""")
define("t_egl", "SELECT asset, fold_idx, alpha, gamma, beta, sum(-0.5*(lh + e*e*exp(-lh))) AS ll FROM t_eg JOIN (SELECT asset, fold_idx, te FROM t_egf) USING (asset, fold_idx) WHERE pos <= te GROUP BY 1, 2, 3, 4, 5")
define("t_egb", "SELECT asset, fold_idx, arg_max(alpha, ll) AS alpha, arg_max(gamma, ll) AS gamma, arg_max(beta, ll) AS beta, max(ll) AS ll FROM t_egl GROUP BY 1, 2")


@query("F5_egarch_grid", f"""
  SELECT f.asset, f.date, f.fold_idx, alpha, gamma, beta, {r('ll', 4, 'll')}, {r('exp(lh)/100', 6, 'yhat')} FROM t_folded f JOIN t_egb b USING (asset, fold_idx) JOIN t_eg g USING (asset, fold_idx, pos, alpha, gamma, beta)""", branches=True)
def egarch_grid(spark, sf_dir):
    out = fc.egarch_forecast(study.folded(spark, sf_dir)).withColumn("yhat", F.col("yhat") * 100)
    return tidy(out, ["asset", "date", "fold_idx", "alpha", "gamma", "beta"], ll=4, yhat=6)


# --------------------------------------------------------------------------------- replicated boards
define("t_seed", f"""
  SELECT asset, draw AS seed, model, avg({QLIKE}) AS qlike FROM (
    SELECT d.asset, d.draw, 'lookback' AS model, d.rv AS y_true, exp({LIN} + s2/2) AS yhat FROM t_dr d JOIN t_drf f USING (asset, draw) JOIN t_drs USING (asset, draw) WHERE fold_idx IS NOT NULL
    UNION ALL SELECT b.asset, k, 'HAR-RV', y_true, yhat FROM t_board b, (SELECT unnest(range({DRAWS})) AS k) WHERE model = 'HAR-RV'
    UNION ALL SELECT b.asset, k, 'RW-RV', y_true, yhat FROM t_board b, (SELECT unnest(range({DRAWS})) AS k) WHERE model = 'RW-RV') GROUP BY 1, 2, 3""")


def seeded_scores(spark, sf_dir):
    draws = fc.draw_forecast(study.folded(spark, sf_dir), features(), L, DRAWS, RIDGE)
    seeded = draws.select("asset", F.col("draw").alias("seed"), F.lit("lookback").alias("model"), "y_true", F.exp(F.col("lin") + F.col("s2") / 2).alias("yhat"))
    fixed = study.board(spark, sf_dir).where(F.col("model").isin("HAR-RV", "RW-RV")).select("asset", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("seed"), "model", "y_true", "yhat")
    return rep.replicate_scores(seeded.unionByName(fixed))


@query("F13_seed_replication", f"SELECT asset, seed, model, {rs(qlike=8)} FROM t_seed", branches=True)
def seed_replication(spark, sf_dir):
    return tidy(seeded_scores(spark, sf_dir), ["asset", "seed", "model"], qlike=8)


@query("A27_replicate_summary", f"""
  SELECT asset, model, count(*) AS n, {r('avg(qlike)', 8, 'mean')}, {r('stddev_samp(qlike)', 8, 'sd')}, {r('min(qlike)', 8, 'min')}, {r('max(qlike)', 8, 'max')}, {r('max(qlike)-min(qlike)', 8, 'range')},
    {r('avg(qlike) - max(qlike) FILTER (seed = 0)', 8, 'deviation')} FROM t_seed GROUP BY 1, 2""", branches=True)
def replicate_summary(spark, sf_dir):
    scores = seeded_scores(spark, sf_dir)
    return tidy(rep.summarise(scores, published_seed=0), ["asset", "model", "n"], mean=8, sd=8, min=8, max=8, range=8, deviation=8)


@query("A27_rank_stability", """
  SELECT asset, ordering, count(*) AS n_seeds FROM (SELECT asset, seed, string_agg(model, ' < ' ORDER BY qlike, model) AS ordering FROM t_seed GROUP BY 1, 2) GROUP BY 1, 2""", branches=True)
def rank_stability(spark, sf_dir):
    return rep.rank_stability(seeded_scores(spark, sf_dir))


@query("A28_pairwise_wins", """
  SELECT a.asset, a.model AS model_a, b.model AS model_b, count(*) AS n, count(*) FILTER (a.qlike < b.qlike) AS a_wins
  FROM t_seed a JOIN t_seed b ON a.asset = b.asset AND a.seed = b.seed AND a.model < b.model GROUP BY 1, 2, 3""", branches=True)
def pairwise_wins(spark, sf_dir):
    return rep.pairwise_wins(seeded_scores(spark, sf_dir))
