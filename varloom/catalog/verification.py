"""Confidence set, master and cross-asset tables, verification gates and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.calibration import CRPS, IV, IVR, scale_table
from varloom.catalog.coverage import conditioned
from varloom.catalog.significance import KEYS, LABELS, differences, lagged_states
from varloom.catalog.sql import QLIKE, chi2, define, num, r, rs, student
from varloom.functions.laws import lognormal_mean
from varloom.operators import calibration as cal, confidence_set as cs, coverage as cv, crossasset as ca, replication as rep, scoring as sc
from varloom.operators import significance as sg, timing as tm, verdicts as vd, verification as vf
from varloom.operators.walkforward import BASELINES
from varloom.plans import study

REPS = 2000
MODELS = sorted(BASELINES)
define("t_lm", "SELECT asset, date, " + ", ".join(f"max(loss) FILTER (model = '{m}') AS l{k}" for k, m in enumerate(MODELS)) + """,
  row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM t_loss GROUP BY asset, date""")
define("t_picks", f"""
  SELECT asset, rep, CAST((last_value(s IGNORE NULLS) OVER w + i - last_value(CASE WHEN s IS NOT NULL THEN i END IGNORE NULLS) OVER w) % n AS BIGINT) AS i FROM (
    SELECT asset, i, n, rep, CASE WHEN i = 0 OR (('0x' || substr(md5(concat_ws('|', 17, asset, rep, i, 'r')), 1, 8))::BIGINT)/4294967296 < 0.1
      THEN floor((('0x' || substr(md5(concat_ws('|', 17, asset, rep, i, 's')), 1, 8))::BIGINT)/4294967296*n) END AS s
    FROM t_lm, (SELECT unnest(range({REPS})) AS rep))
  WINDOW w AS (PARTITION BY asset, rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
define("t_boot", "SELECT p.asset, p.rep, " + ", ".join(f"avg(l{k}) AS b{k}" for k in range(3)) + " FROM t_picks p JOIN t_lm m USING (asset, i) GROUP BY 1, 2")
define("t_full", "SELECT asset, " + ", ".join(f"avg(l{k}) AS f{k}" for k in range(3)) + " FROM t_lm GROUP BY 1")
define("t_bz", "SELECT asset, rep, " + ", ".join(
    f"(f{a}-f{b})/sqrt(avg(((b{a}-b{b})-(f{a}-f{b}))*((b{a}-b{b})-(f{a}-f{b}))) OVER (PARTITION BY asset)) AS t{a}{b}, abs((b{a}-b{b})-(f{a}-f{b}))/sqrt(avg(((b{a}-b{b})-(f{a}-f{b}))*((b{a}-b{b})-(f{a}-f{b}))) OVER (PARTITION BY asset)) AS z{a}{b}"
    for a, b in ((0, 1), (0, 2), (1, 2))) + " FROM t_boot JOIN t_full USING (asset)")
define("t_r1", """
  SELECT asset, avg(CASE WHEN greatest(z01, z02, z12) > greatest(abs(t01), abs(t02), abs(t12)) THEN 1.0 ELSE 0.0 END) AS p1,
    any_value(CASE greatest(abs(t01), abs(t02), abs(t12)) WHEN t01 THEN 0 WHEN t02 THEN 0 WHEN -t01 THEN 1 WHEN t12 THEN 1 ELSE 2 END) AS w1 FROM t_bz GROUP BY 1""")
define("t_r2", """
  SELECT asset, any_value(p1) AS p1, any_value(w1) AS w1, avg(CASE WHEN CASE w1 WHEN 0 THEN z12 WHEN 1 THEN z02 ELSE z01 END > abs(CASE w1 WHEN 0 THEN t12 WHEN 1 THEN t02 ELSE t01 END) THEN 1.0 ELSE 0.0 END) AS p2,
    any_value(CASE w1 WHEN 0 THEN CASE WHEN t12 > 0 THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN t02 > 0 THEN 0 ELSE 2 END ELSE CASE WHEN t01 > 0 THEN 0 ELSE 1 END END) AS w2
  FROM t_bz JOIN t_r1 USING (asset) GROUP BY 1""")
define("t_mcs", "SELECT asset, f.m AS model, f.v AS avg_loss, CASE f.k WHEN w1 THEN p1 WHEN w2 THEN greatest(p1, p2) ELSE 1.0 END AS p_value FROM t_r2 JOIN (" + " UNION ALL ".join(
    f"SELECT asset, {k} AS k, '{m}' AS m, f{k} AS v FROM t_full" for k, m in enumerate(MODELS)) + ") f USING (asset)")


@query("T9_model_confidence_set", f"""
  SELECT asset, model, p_value > 0.1 AS in_set, row_number() OVER (PARTITION BY asset ORDER BY avg_loss, model) AS rank, {rs(avg_loss=8, p_value=6)} FROM t_mcs""", branches=True)
def model_confidence_set(spark, sf_dir):
    out = cs.model_confidence_set(study.board(spark, sf_dir), MODELS, reps=REPS)
    return tidy(out, ["asset", "model", "in_set", "rank"], avg_loss=8, p_value=6)


@query("U5_excluded_models", "SELECT asset, model FROM t_mcs WHERE p_value <= 0.1", branches=True)
def excluded_models(spark, sf_dir):
    out = cs.model_confidence_set(study.board(spark, sf_dir), MODELS, reps=REPS)
    return out.select("asset", "model").exceptAll(out.where("in_set").select("asset", "model"))


# ------------------------------------------------------------------------------------- master table
define("t_points", """
  SELECT asset, date, y_true, model, yhat FROM t_board UNION ALL SELECT asset, date, y_true, method, greatest(exp(mu+sigma*sigma/2),1e-14) FROM t_law""")


def points(spark, sf_dir):
    law_means = study.law(spark, sf_dir).select("asset", "date", F.col("method").alias("model"), lognormal_mean(F.col("mu"), F.col("sigma")).alias("yhat"), "y_true")
    return study.board(spark, sf_dir).unionByName(law_means)


define("t_master", f"""
  SELECT p.*, t.qt AS qlike_transitional, t.nt AS n_transitional, i.picp, i.mpiw, i.winkler, i.coverage_error, c.crps, p.model <> 'log-walk' AS ranked,
    CASE WHEN p.model <> 'log-walk' THEN row_number() OVER (PARTITION BY p.asset, p.model <> 'log-walk' ORDER BY p.qlike, p.model) END AS rank_qlike
  FROM (SELECT asset, model, count(*) AS n, avg((y_true-yhat)*(y_true-yhat)) AS mse, avg(abs(y_true-yhat)) AS mae, avg({QLIKE}) AS qlike FROM t_points GROUP BY 1, 2) p
  LEFT JOIN (SELECT asset, model, avg({QLIKE}) AS qt, count(*) AS nt FROM t_points JOIN t_lagged USING (asset, date) WHERE s1 = 1 GROUP BY 1, 2) t USING (asset, model)
  LEFT JOIN (SELECT asset, method AS model, {IV} FROM t_iv WHERE level_pct = 90 GROUP BY 1, 2) i USING (asset, model)
  LEFT JOIN (SELECT asset, method AS model, avg(crps) AS crps FROM t_crps GROUP BY 1, 2) c USING (asset, model)""")


@query("A32_master_table", f"""
  SELECT asset, model, n, n_transitional, ranked, coalesce(rank_qlike, -1) AS rank_qlike, {rs(mse=8, mae=8, qlike=8, qlike_transitional=8)},
    {', '.join(r(f'coalesce({c}, -1)', 8, c) for c in ('picp', 'mpiw', 'winkler', 'coverage_error', 'crps'))} FROM t_master""", branches=True)
def master_table(spark, sf_dir):
    out = ca.master_table(points(spark, sf_dir), study.law(spark, sf_dir), study.intervals(spark, sf_dir), lagged_states(spark, sf_dir), unranked=("log-walk",))
    filled = out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("picp", "mpiw", "winkler", "coverage_error", "crps", "rank_qlike")})
    return tidy(filled, ["asset", "model", "n", "n_transitional", "ranked", "rank_qlike"], mse=8, mae=8, qlike=8, qlike_transitional=8, picp=8, mpiw=8, winkler=8, coverage_error=8, crps=8)


define("t_ranks", f"SELECT asset, model, qlike, rank() OVER (PARTITION BY asset ORDER BY qlike) AS rank FROM (SELECT asset, model, avg({QLIKE}) AS qlike FROM t_points GROUP BY 1, 2)")


@query("A34_rank_agreement", f"""
  SELECT asset, 'A' AS reference, n_models, models, {rs(spearman=8, kendall=8)} FROM (
    SELECT a.asset, count(*) AS n_models, corr(a.rank, b.rank) AS spearman, string_agg(a.model, ', ' ORDER BY a.model) AS models FROM t_ranks a JOIN t_ranks b USING (model) WHERE a.asset <> 'A' AND b.asset = 'A' GROUP BY 1) JOIN (
    SELECT a.asset, sum(sign(a.rank - c.rank)*sign(b.rank - d.rank))/sqrt(sum(abs(sign(a.rank-c.rank)))*sum(abs(sign(b.rank-d.rank)))) AS kendall
    FROM t_ranks a JOIN t_ranks b USING (model) JOIN t_ranks c ON c.asset = a.asset AND c.model > a.model JOIN t_ranks d ON d.asset = 'A' AND d.model = c.model WHERE a.asset <> 'A' AND b.asset = 'A' GROUP BY 1) USING (asset)""", branches=True)
def rank_agreement(spark, sf_dir):
    out = ca.rank_agreement(sc.leaderboard(points(spark, sf_dir)), "A")
    return tidy(out, ["asset", "reference", "n_models", "models"], spearman=8, kendall=8)


@query("A35_cross_asset_board", f"""
  SELECT asset, model, rank() OVER (PARTITION BY asset ORDER BY q) AS rank, n, {r('q', 8, 'qlike')}, {r('e2', 8, 'mse')}, {r('e1', 8, 'mae')} FROM (
    SELECT asset, model, count(*) AS n, avg({QLIKE}) AS q, avg((y_true-yhat)*(y_true-yhat)) AS e2, avg(abs(y_true-yhat)) AS e1 FROM t_points GROUP BY 1, 2)""")
def cross_asset_board(spark, sf_dir):
    """Point scores and ranks of every asset in one long table; assets come from the data."""
    return tidy(sc.leaderboard(points(spark, sf_dir)), ["asset", "model", "rank", "n"], qlike=8, mse=8, mae=8)


define("t_assetfacts", f"""
  SELECT asset, 'metrics' AS "table", model, -1 AS state, unnest(['n', 'mse', 'mae', 'qlike']) AS quantity, unnest([n, e2, e1, q]) AS value FROM (
    SELECT asset, model, CAST(count(*) AS DOUBLE) AS n, avg({QLIKE}) AS q, avg((y_true-yhat)*(y_true-yhat)) AS e2, avg(abs(y_true-yhat)) AS e1 FROM t_points GROUP BY 1, 2)
  UNION ALL SELECT asset, 'ranks', model, -1, 'rank', CAST(rank AS DOUBLE) FROM t_ranks
  UNION ALL SELECT asset, 'tests', model_a || ' - ' || model_b, -1, 'dm_p', {student('stat', 'n - 1')} FROM t_dm
  UNION ALL SELECT asset, 'tests', model_a || ' - ' || model_b, -1, 'gw_p', {chi2('c', 3)} FROM t_gw
  UNION ALL SELECT asset, 'per_regime', model, s1, unnest(['n', 'qlike']), unnest([n, q]) FROM (
    SELECT asset, model, s1, CAST(count(*) AS DOUBLE) AS n, avg({QLIKE}) AS q FROM t_points JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL GROUP BY 1, 2, 3)
  UNION ALL SELECT asset, 'regimes', '', state, unnest(['n', 'mean_rv', 'sd_return']), unnest([n, m, s]) FROM (
    SELECT asset, state, CAST(count(*) AS DOUBLE) AS n, avg(rv) AS m, stddev_pop(log_return) AS s FROM t_states GROUP BY 1, 2)
  UNION ALL SELECT asset, 'sample', '', -1, unnest(['n_days', 'first_day', 'last_day']), unnest([n, a, b]) FROM (
    SELECT asset, CAST(count(DISTINCT date) AS DOUBLE) AS n, CAST(min(date) - DATE '1970-01-01' AS DOUBLE) AS a, CAST(max(date) - DATE '1970-01-01' AS DOUBLE) AS b FROM t_points GROUP BY 1)""")


@query("A35_cross_asset_facts", f"""SELECT asset, "table", model, state, quantity, {r('value', 6, 'value')} FROM t_assetfacts""", branches=True)
def cross_asset_facts(spark, sf_dir):
    board, d = points(spark, sf_dir), differences(spark, sf_dir)
    lagged = lagged_states(spark, sf_dir)
    tests = {"dm_p": sg.diebold_mariano(d), "gw_p": sg.gw_regime(d, lagged)}
    out = ca.collect_facts(board, sc.leaderboard(board), tests, study.states(spark, sf_dir), lagged)
    return tidy(out, ["asset", "table", "model", "state", "quantity"], value=6)


@query("U4_models_in_common", "SELECT model, count(DISTINCT asset) AS n_assets FROM t_ranks GROUP BY 1 HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM t_ranks)", branches=True)
def models_in_common(spark, sf_dir):
    return ca.models_in_common(sc.leaderboard(points(spark, sf_dir)))


# ----------------------------------------------------------------------------------------- gates
define("t_pub", f"""
  SELECT asset, 'metrics' AS tbl, model AS item, unnest(['n', 'mse', 'rmse', 'mae', 'qlike']) AS quantity, unnest([n, mse, sqrt(mse), mae, qlike]) AS value FROM (
    SELECT asset, model, CAST(count(*) AS DOUBLE) AS n, avg((y_true-yhat)*(y_true-yhat)) AS mse, avg(abs(y_true-yhat)) AS mae, avg({QLIKE}) AS qlike FROM t_board GROUP BY 1, 2)""")
define("t_pubiv", f"""
  SELECT asset, 'calibration' AS tbl, method || '@' || level_pct AS item, unnest(['n', 'picp', 'mpiw', 'winkler']) AS quantity, unnest([CAST(n AS DOUBLE), picp, mpiw, winkler]) AS value FROM (SELECT asset, method, level_pct, {IV} FROM t_iv GROUP BY 1, 2, 3)""")
define("t_pubreg", f"""
  SELECT asset, 'per_regime' AS tbl, model || '/' || s1 AS item, unnest(['n', 'qlike']) AS quantity, unnest([CAST(n AS DOUBLE), q]) AS value FROM (
    SELECT asset, model, s1, count(*) AS n, avg({QLIKE}) AS q FROM t_board JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL GROUP BY 1, 2, 3)""")
define("t_pubpr", f"""
  SELECT asset, 'per_regime_intervals' AS tbl, method || '@' || level_pct || '/' || s1 AS item, unnest(['n', 'picp', 'mpiw', 'winkler']) AS quantity, unnest([CAST(n AS DOUBLE), picp, mpiw, winkler]) AS value FROM (
    SELECT asset, method, level_pct, s1, {IV} FROM t_iv JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL GROUP BY 1, 2, 3, 4)""")
MASTER = ("mse", "mae", "qlike", "n_transitional", "qlike_transitional", "picp", "mpiw")
define("t_pubmaster", f"""
  SELECT asset, 'master' AS tbl, model AS item, unnest([{', '.join(f"'{c}'" for c in MASTER)}]) AS quantity, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in MASTER)}]) AS value FROM t_master""")
# One planted error a printed table: (table, item, quantity), all of asset A.
PLANTED = (("metrics", "RW-RV", "mae"), ("calibration", "log-walk@90", "mpiw"), ("per_regime", "RW-RV/1", "qlike"), ("per_regime_intervals", "log-walk@90/1", "mpiw"), ("master", "HAR-RV", "mse"))
_WRONG = " OR ".join(f"(tbl = '{t}' AND item = '{i}' AND quantity = '{q}')" for t, i, q in PLANTED)
define("t_checks", f"""
  SELECT asset, tbl AS "table", item, quantity, CASE WHEN value IS NULL THEN 'SKIP' WHEN asset = 'A' AND ({_WRONG}) THEN 'MISMATCH' ELSE 'OK' END AS status
  FROM (SELECT * FROM t_pub UNION ALL SELECT * FROM t_pubiv UNION ALL SELECT * FROM t_pubreg UNION ALL SELECT * FROM t_pubpr UNION ALL SELECT * FROM t_pubmaster)
  UNION ALL SELECT 'A', 'metrics', 'unknown model', 'qlike', 'MISSING'""")


def published_points(spark, sf_dir):
    return vf.melt(sc.leaderboard(study.board(spark, sf_dir)), "metrics", F.col("model"), ("n", "mse", "rmse", "mae", "qlike"))


def published(spark, sf_dir):
    """All printed tables with a planted error in each and one row no forecast exists for."""
    pts, lagged, iv = published_points(spark, sf_dir), lagged_states(spark, sf_dir), study.intervals(spark, sf_dir)
    ghost = pts.where((F.col("asset") == "A") & (F.col("item") == "HAR-RV") & (F.col("quantity") == "qlike")).withColumn("item", F.lit("unknown model"))
    level = F.concat("method", F.lit("@"), F.col("level_pct").cast("string"))
    scores = ("n", "picp", "mpiw", "winkler")
    inner = cal.per_regime_intervals(iv, lagged).where("state < 3 AND n > 0")
    wide = cal.per_regime_qlike(study.board(spark, sf_dir), lagged, MODELS).where("state is not null")
    per = wide.unpivot(["asset", "state", "n"], MODELS, "model", "qlike")
    master = ca.master_table(points(spark, sf_dir), study.law(spark, sf_dir), iv, lagged, unranked=("log-walk",))
    tables = [
        pts, ghost, vf.melt(sc.interval_table(iv), "calibration", level, scores),
        vf.melt(per, "per_regime", F.concat("model", F.lit("/"), F.col("state").cast("string")), ("n", "qlike")),
        vf.melt(inner, "per_regime_intervals", F.concat(level, F.lit("/"), F.col("state").cast("string")), scores),
        vf.melt(master, "master", F.col("model"), MASTER),
    ]
    everything = reduce(DataFrame.unionByName, tables)
    wrong = reduce(lambda a, b: a | b, [(F.col("table") == t) & (F.col("item") == i) & (F.col("quantity") == q) for t, i, q in PLANTED])
    return everything.withColumn("value", F.when((F.col("asset") == "A") & wrong, F.col("value") * 1.0001).otherwise(F.col("value")))


def rederived(spark, sf_dir):
    board, iv = study.board(spark, sf_dir), study.intervals(spark, sf_dir)
    states = study.states(spark, sf_dir).select("asset", "date", "state")
    tables = [vf.rederive_points(board), vf.rederive_intervals(iv), vf.rederive_per_regime(board, states),
              vf.rederive_per_regime_intervals(iv, states), vf.rederive_master(points(spark, sf_dir), iv, states)]
    return reduce(DataFrame.unionByName, tables)


def checks(spark, sf_dir):
    return vf.compare(published(spark, sf_dir), rederived(spark, sf_dir))


@query("V1_compare_published", """SELECT asset, item, quantity, status FROM t_checks WHERE "table" = 'metrics'""", branches=True)
def compare_published(spark, sf_dir):
    pub = published(spark, sf_dir).where(F.col("table") == "metrics")
    return vf.compare(pub, vf.rederive_points(study.board(spark, sf_dir))).select("asset", "item", "quantity", "status")


@query("V2_rederived_tables", 'SELECT asset, "table", item, quantity, status FROM t_checks', branches=True)
def rederived_tables(spark, sf_dir):
    return checks(spark, sf_dir).select("asset", "table", "item", "quantity", "status")


@query("V4_verification_exit", "SELECT count(*) AS n_checks, count(*) FILTER (status IN ('MISMATCH', 'MISSING')) AS n_failing, 1 AS exit_code FROM t_checks", branches=True)
def verification_exit(spark, sf_dir):
    return vf.exit_status(checks(spark, sf_dir))


@query("A37_status_counts", """SELECT "table", count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'MISMATCH') AS mismatch, count(*) FILTER (status = 'SKIP') AS skip,
  count(*) FILTER (status = 'MISSING') AS missing, count(*) AS total FROM t_checks GROUP BY 1""", branches=True)
def status_counts(spark, sf_dir):
    return vf.status_counts(checks(spark, sf_dir))


@query("J13_missing_forecasts", """
  SELECT asset, item AS model FROM (SELECT DISTINCT asset, item FROM t_checks WHERE "table" = 'metrics') c WHERE NOT EXISTS (SELECT 1 FROM t_board b WHERE b.asset = c.asset AND b.model = c.item)""", branches=True)
def missing_forecasts(spark, sf_dir):
    rows = published(spark, sf_dir).where(F.col("table") == "metrics").select("asset", F.col("item").alias("model")).distinct()
    return rows.join(study.board(spark, sf_dir).select("asset", "model").distinct(), ["asset", "model"], "left_anti")


@query("V3_cross_table_agreement", """
  SELECT asset, item, 'master' AS table_a, 'metrics' AS table_b, quantity, CASE WHEN asset = 'A' AND item = 'RW-RV' AND quantity = 'mae' THEN 'MISMATCH' ELSE 'OK' END AS status
  FROM t_pub WHERE quantity IN ('mae', 'qlike')""", branches=True)
def cross_table_agreement(spark, sf_dir):
    master = ca.master_table(study.board(spark, sf_dir), study.law(spark, sf_dir), study.intervals(spark, sf_dir), lagged_states(spark, sf_dir))
    both = published(spark, sf_dir).where(F.col("table") == "metrics").unionByName(vf.melt(master, "master", F.col("model"), ("mae", "qlike")))
    return vf.cross_table(both).select("asset", "item", "table_a", "table_b", "quantity", "status")


@query("V5_distinct_crps", "SELECT asset, count(*) AS n_methods, count(*) - count(DISTINCT crps) AS n_shared FROM (SELECT asset, method, avg(crps) AS crps FROM t_crps GROUP BY 1, 2) GROUP BY 1")
def distinct_crps(spark, sf_dir):
    table = cal.crps_table(study.law(spark, sf_dir))
    shared = vf.duplicate_scores(table).groupBy("asset").agg(F.sum(F.col("n") - 1).alias("s"))
    return table.groupBy("asset").agg(F.count("*").alias("n_methods")).join(shared, "asset", "left").select("asset", "n_methods", F.coalesce("s", F.lit(0)).alias("n_shared"))


@query("V6_log_agreement", f"""
  SELECT asset, n, {rs(max_dev=7, sd_dev=7)}, worst_day, max_dev <= 1e-6 AS within FROM (
    SELECT asset, count(*) AS n, max(abs(ln(a.yhat/b.yhat))) AS max_dev, stddev_pop(abs(ln(a.yhat/b.yhat))) AS sd_dev, arg_max(date, abs(ln(a.yhat/b.yhat))) AS worst_day
    FROM t_board a JOIN t_board b USING (asset, date) WHERE a.model = 'HAR-RV' AND b.model = 'HAR-RV-log' GROUP BY 1)""", branches=True)
def log_agreement(spark, sf_dir):
    board = study.board(spark, sf_dir)
    out = vf.log_agreement(board.where(F.col("model") == "HAR-RV"), board.where(F.col("model") == "HAR-RV-log"))
    return tidy(out, ["asset", "n", "worst_day", "within"], max_dev=7, sd_dev=7)


@query("V7_shared_protocol", "SELECT asset, count(*) AS n_runs, count(DISTINCT (a, b, n)) AS n_protocols, count(DISTINCT (a, b, n)) = 1 AS shared FROM (SELECT asset, model, min(date) AS a, max(date) AS b, count(*) AS n FROM t_board GROUP BY 1, 2) GROUP BY 1")
def shared_protocol(spark, sf_dir):
    runs = study.board(spark, sf_dir).groupBy("asset", "model").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n"))
    return rep.shared_protocol(runs, ["a", "b", "n"])


# --------------------------------------------------------------------------------------- verdicts
define("t_pr", f"SELECT asset, method, level_pct, s1 AS state, {IV} FROM t_iv JOIN t_lagged USING (asset, date) WHERE s1 IS NOT NULL GROUP BY 1, 2, 3, 4")


@query("V8_coverage_shape", f"""
  SELECT asset, method, level_pct, CASE WHEN down THEN 'monotone decreasing' WHEN up THEN 'monotone increasing' ELSE 'non-monotone' END AS shape, down AND g >= 0.02 AS degrades,
    {r('g', 8, 'gap')}, {r('se', 8, 'gap_se')}, CASE WHEN se <= 0 THEN 'not assessable' WHEN abs(g) < 2*se THEN 'well inside sampling noise' ELSE 'larger than sampling noise' END AS endpoint_gap FROM (
    SELECT asset, method, level_pct, p0 >= p1 AND p1 >= p2 AS down, p0 <= p1 AND p1 <= p2 AS up, p0 - p2 AS g, sqrt(p0*(1-p0)/n0 + p2*(1-p2)/n2) AS se FROM (
      SELECT asset, method, level_pct, {', '.join(f'max(picp) FILTER (state = {k}) AS p{k}, max(n) FILTER (state = {k}) AS n{k}' for k in range(3))} FROM t_pr GROUP BY 1, 2, 3))""", branches=True)
def coverage_shape(spark, sf_dir):
    per = cal.per_regime_intervals(study.intervals(spark, sf_dir), lagged_states(spark, sf_dir)).where("state < 3")
    return tidy(vd.coverage_shape(per), ["asset", "method", "level_pct", "shape", "degrades", "endpoint_gap"], gap=8, gap_se=8)


@query("V9_width_correction", f"""
  SELECT asset, method, {r('spread', 8, 'spread')}, spread > 0.15 AS material, ev AS conditional_evidence,
    CASE WHEN spread > 0.15 AND ev THEN 'per-regime' WHEN spread > 0.15 THEN 'global, per-regime indicative' WHEN ev THEN 'global, shape problem noted' ELSE 'global' END AS recommendation FROM (
    SELECT asset, method, max(scale_coverage) - min(scale_coverage) AS spread FROM t_scalebest WHERE scope <> 'all' GROUP BY 1, 2) JOIN (
    SELECT asset, method, bool_or(p_holm < 0.05 AND kind = 'DQ incremental') AS ev FROM t_holm WHERE level_pct = 90 AND side = 'both' GROUP BY 1, 2) USING (asset, method)""", branches=True)
def width_correction(spark, sf_dir):
    table = cv.conditional_table(conditioned(spark, sf_dir)).where((F.col("level_pct") == 90) & (F.col("side") == "both"))
    evidence = table.groupBy("asset", "method").agg(F.bool_or((F.col("p_holm") < 0.05) & (F.col("kind") == "DQ incremental")).alias("conditional_evidence"))
    return tidy(vd.width_correction(scale_table(spark, sf_dir), evidence), ["asset", "method", "material", "conditional_evidence", "recommendation"], spread=8)


@query("V10_pooled_view", """
  SELECT *, CASE WHEN n_upper_significant > n_pooled_significant THEN 'pooled understates' WHEN n_pooled_significant > n_upper_significant THEN 'pooled is sharper' WHEN n_upper_significant > 0 THEN 'views agree' ELSE 'no structure either way' END AS verdict FROM (
    SELECT asset, method, level_pct, count(*) FILTER (side = 'both' AND p_holm < 0.05) AS n_pooled_significant, count(*) FILTER (side = 'both') AS n_pooled,
      count(*) FILTER (side = 'upper' AND p_holm < 0.05) AS n_upper_significant, count(*) FILTER (side = 'upper') AS n_upper FROM t_holm WHERE kind = 'difference in coverage' GROUP BY 1, 2, 3)""", branches=True)
def pooled_view(spark, sf_dir):
    return vd.pooled_view(cv.conditional_table(conditioned(spark, sf_dir)))


define("t_facts", f"""
  SELECT g.asset, m.la AS qa, m.lb AS qb, {student('dm.stat', 'dm.n - 1')} AS dm_p, {chi2('g.c', 3)} AS gw_p FROM t_gw g JOIN t_dm dm USING (asset, model_a, model_b) JOIN t_dmean m USING (asset, model_a, model_b)
  WHERE model_a = 'HAR-RV-log' AND model_b = 'HAR-RV'""")


@query("V11_transfer_verdict", """
  SELECT asset, 'A' AS reference_asset, s AS sign_agrees, d AS pooled_agrees, g AS conditional_agrees,
    CASE WHEN s AND d AND g THEN 'replicates' WHEN s AND g THEN 'replicates conditionally' WHEN s THEN 'direction only' ELSE 'does not replicate' END AS verdict FROM (
    SELECT x.asset, (x.qa < x.qb) = (f.qa < f.qb) AS s, (x.dm_p < 0.05) = (f.dm_p < 0.05) AS d, (x.gw_p < 0.05) = (f.gw_p < 0.05) AS g FROM t_facts x, t_facts f WHERE f.asset = 'A' AND x.asset <> 'A')""", branches=True)
def transfer_verdict(spark, sf_dir):
    d = differences(spark, sf_dir).where((F.col("model_a") == "HAR-RV-log") & (F.col("model_b") == "HAR-RV"))
    dm = sg.diebold_mariano(d).select("asset", F.col("p_value").alias("dm_p"))
    gw = sg.gw_regime(d, lagged_states(spark, sf_dir)).select("asset", F.col("p_value").alias("gw_p"))
    means = d.groupBy("asset").agg(F.avg("loss_a").alias("qlike_model"), F.avg("loss_b").alias("qlike_benchmark"))
    return vd.transfer(means.join(dm, "asset").join(gw, "asset"), "A")
