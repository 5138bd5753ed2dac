"""Sources, sinks, projections, masks, set operations, rankings and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.calibration import scale_table
from varloom.catalog.significance import KEY, KEYS, PAIRS, acov, differences
from varloom.catalog.sql import QLIKE, TEST_START, TRAIN_END, VAL_END, VAL_START, W, chi2, define, folds_of, num, phi, r, rs, student
from varloom.functions import math as fm
from varloom.operators import features as ft, forecasters as fc, realized as rz, scoring as sc, timing as tm, walkforward as wf
from varloom.operators.walkforward import BASELINES
from varloom.plans import study
from varloom.sources import boards as bd, library as lb, tables as tb

# ------------------------------------------------------------------------------- sources and sinks


def library_file(spark, sf_dir) -> str:
    """The intraday measure of every asset as a long CSV with offset timestamps, repeated days and a broken row."""
    rv = rz.trade_variance(tb.trades(spark, sf_dir), tb.TRADE_ORDER)
    base = rv.select(F.date_format("date", "yyyy-MM-dd").alias("d"), F.concat(F.lit("."), F.lower("asset")).alias("Symbol"), F.col("rv").alias("rv5"))
    rows = base.select(F.explode(F.array(F.concat("d", F.lit(" 00:00:00+00:00")), F.concat("d", F.lit(" 00:00:00+01:00")))).alias("obs_date"), "Symbol", "rv5")
    rows = rows.withColumn("rv5", F.when(F.col("obs_date").endswith("+01:00"), F.col("rv5") * 2).otherwise(F.col("rv5")))
    broken = spark.range(1).select(F.lit("not a date").alias("obs_date"), F.lit(".a").alias("Symbol"), F.lit(1.0).alias("rv5"))
    path = lb.scratch_folder(spark, "library")
    lb.write_table(rows.unionByName(broken), path)
    return path


@query("S1_measure_library", f"SELECT '.' || lower(asset) AS asset, date, {r('rv', 8, 'rv5')} FROM t_rv")
def measure_library(spark, sf_dir):
    return tidy(lb.load_library(spark, library_file(spark, sf_dir)), ["asset", "date"], rv5=8)


@query("S2_column_aliases", f"SELECT '.n' AS asset, count(*) AS n, {r('sum(rv)', 6, 'total')} FROM t_rv WHERE asset = 'N'")
def column_aliases(spark, sf_dir):
    raw = spark.read.option("header", "true").csv(library_file(spark, sf_dir)).withColumnsRenamed({"obs_date": "when_seen", "Symbol": "Ticker"})
    path = lb.scratch_folder(spark, "renamed")
    lb.write_table(raw, path)
    panel = lb.require_symbol(lb.load_library(spark, path), ".N")
    return tidy(panel.groupBy("asset").agg(F.count("*").alias("n"), F.sum("rv5").alias("total")), ["asset", "n"], total=6)


@query("S4_bars_from_files", "SELECT 'csv' AS source, count(*) AS n, round(sum(price), 4) + 0.0 AS total FROM t_bars UNION ALL SELECT 'parquet', count(*), round(sum(price), 4) + 0.0 FROM t_bars")
def bars_from_files(spark, sf_dir):
    bars = tb.bars(spark, sf_dir).select("asset", F.col("ts").alias("timestamp"), F.col("price").alias("close"))
    csv, parquet = lb.scratch_folder(spark, "bars"), lb.scratch_folder(spark, "bars") + ".parquet"
    lb.write_table(bars.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")), csv)
    bars.write.parquet(parquet)
    both = lb.load_bars(spark, csv).withColumn("source", F.lit("csv")).unionByName(lb.load_bars(spark, parquet).withColumn("source", F.lit("parquet")))
    return tidy(both.groupBy("source").agg(F.count("*").alias("n"), F.sum("price").alias("total")), ["source", "n"], total=4)


@query("S6_panel_round_trip", f"SELECT asset, date, {rs(rv=8)} FROM t_frame")
def panel_round_trip(spark, sf_dir):
    path = lb.scratch_folder(spark, "panel")
    lb.write_panel(study.frame(spark, sf_dir), path)
    return tidy(spark.read.parquet(path), ["asset", "date"], rv=8)


@query("S7_csv_round_trip", f"SELECT asset, model, {r(f'avg({QLIKE})', 7, 'qlike')} FROM t_board GROUP BY 1, 2")
def csv_round_trip(spark, sf_dir):
    path = lb.scratch_folder(spark, "metrics")
    lb.write_table(sc.leaderboard(study.board(spark, sf_dir)), path)
    back = spark.read.option("header", "true").csv(path)
    return tidy(back, ["asset", "model"], qlike=7)


@query("S8_snapshot_record", "SELECT 'frame' AS source, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM t_frame")
def snapshot_record(spark, sf_dir):
    path = lb.scratch_folder(spark, "meta")
    lb.write_snapshot(study.frame(spark, sf_dir), path, "frame")
    return lb.read_snapshot(spark, path).select("source", "rows", "first_date", "last_date")


@query("S10_load_boards", """
  SELECT CASE model WHEN 'RW-RV' THEN 'm01_walk' ELSE 'm02_regressions' END AS source, model, count(*) AS n, round(sum(yhat), 5) + 0.0 AS total FROM t_board GROUP BY 1, 2""")
def load_boards(spark, sf_dir):
    folder = lb.scratch_folder(spark, "boards")
    wide = study.fits(spark, sf_dir).select("asset", "date", F.col("rv").alias("y_true"), *[F.col(c).alias(m) for m, c in BASELINES.items()])
    wide.select("asset", "date", "y_true", "RW-RV").write.parquet(f"{folder}/m01_walk.parquet")
    wide.drop("RW-RV").write.parquet(f"{folder}/m02_regressions.parquet")
    out = bd.load_boards(spark, f"{folder}/*.parquet").groupBy("source", "model").agg(F.count("*").alias("n"), F.sum("yhat").alias("total"))
    return tidy(out, ["source", "model", "n"], total=5)


@query("S11_load_result_tables", """SELECT 'm02_metrics' AS "table", count(*) AS n FROM (SELECT DISTINCT asset, model FROM t_board)""")
def load_result_tables(spark, sf_dir):
    folder = lb.scratch_folder(spark, "tables")
    board = sc.leaderboard(study.board(spark, sf_dir))
    lb.write_table(board, f"{folder}/m02_metrics.csv")
    lb.write_table(board.select("asset", "model"), f"{folder}/m02_models.csv")
    return bd.load_tables(spark, f"{folder}/*.csv", "_metrics").groupBy("table").agg(F.count("*").alias("n"))


@query("S14_regime_source", """
  SELECT DISTINCT 'm05_' || asset || '_x' AS stem, asset || '_x' AS profile, 'jump_filtered' AS estimator FROM t_frame
  UNION SELECT DISTINCT 'm02_' || asset || '_x_hmm', asset || '_x', 'chain_filtered' FROM t_frame""")
def regime_source(spark, sf_dir):
    assets = study.frame(spark, sf_dir).select("asset").distinct()
    stems = assets.select(F.explode(F.array(F.concat(F.lit("m05_"), "asset", F.lit("_x")), F.concat(F.lit("m02_"), "asset", F.lit("_x_hmm")))).alias("stem"))
    return stems.select("stem", bd.regime_source(F.col("stem"), ("m05_", "m02_"), "jump_filtered", "chain_filtered").alias("s")).select("stem", "s.*")


# ------------------------------------------------------------------------------ masks and projections
def holes():
    """Days whose entries are made unusable, to exercise the masks."""
    return F.dayofmonth("date").isin(1, 2)



@query("P1_finite_filter", """
  SELECT asset, count(*) AS n, count(*) FILTER (day(date) NOT IN (1, 2, 3)) AS n_finite FROM t_frame GROUP BY 1""")
def finite_filter(spark, sf_dir):
    day = F.dayofmonth("date")
    holes = F.when(day == 1, F.lit(float("nan"))).when(day == 2, F.lit(float("inf"))).when(day == 3, F.lit(None)).otherwise(F.col("rv"))
    rows = study.frame(spark, sf_dir).withColumn("v", holes)
    return rows.groupBy("asset").agg(F.count("*").alias("n"), F.count_if(fm.is_finite(F.col("v"))).alias("n_finite"))


@query("P2_pairwise_mask", f"SELECT asset, model, count(*) AS n, {r('avg(abs(y_true-yhat))', 8, 'mae')} FROM t_board WHERE day(date) NOT IN (1, 2) GROUP BY 1, 2")
def pairwise_mask(spark, sf_dir):
    board = study.board(spark, sf_dir).withColumn("yhat", F.when(holes(), F.lit(float("nan"))).otherwise(F.col("yhat")))
    out = sc.aligned(board).groupBy("asset", "model").agg(*sc.point_aggregates())
    return tidy(out, ["asset", "model", "n"], mae=8)


@query("P3_interval_mask", f"SELECT method, level_pct, count(*) AS n, {r('avg(hi-lo)', 8, 'mpiw')} FROM t_iv WHERE day(date) NOT IN (1, 2) GROUP BY 1, 2")
def interval_mask(spark, sf_dir):
    iv = study.intervals(spark, sf_dir).withColumn("hi", F.when(holes(), F.lit(float("inf"))).otherwise(F.col("hi")))
    return tidy(sc.interval_table(iv, ("method", "level_pct")), ["method", "level_pct", "n"], mpiw=8)


@query("P4_triple_mask", f"SELECT {KEY}, count(*) AS n, {r('avg(d)', 9, 'mean_d')} FROM t_d WHERE NOT (day(date) IN (1, 2) AND (model_a = 'HAR-RV' OR model_b = 'HAR-RV')) GROUP BY {KEY}")
def triple_mask(spark, sf_dir):
    from varloom.operators import significance as sg

    hole = holes() & (F.col("model") == "HAR-RV")
    board = study.board(spark, sf_dir).withColumn("yhat", F.when(hole, F.lit(float("nan"))).otherwise(F.col("yhat")))
    out = sg.pair_losses(board, PAIRS).groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"))
    return tidy(out, [*KEYS, "n"], mean_d=9)


@query("P5_column_validation", "SELECT count(*) AS n, count(DISTINCT asset) AS n_assets FROM t_ohlc")
def column_validation(spark, sf_dir):
    upper = study.ohlc(spark, sf_dir).withColumnsRenamed({"open": "Open", "high": "HIGH", "low": "Low", "close": "CLOSE"})
    return rz.require_columns(upper, rz.OHLC_COLUMNS).agg(F.count("close").alias("n"), F.countDistinct("asset").alias("n_assets"))


@query("P8_model_exclusion", "SELECT asset, model, count(*) AS n FROM t_board WHERE model NOT IN ('RW-RV') GROUP BY 1, 2")
def model_exclusion(spark, sf_dir):
    return study.board(spark, sf_dir).where(~F.col("model").isin("RW-RV")).groupBy("asset", "model").agg(F.count("*").alias("n"))


@query("P9_numeric_model_columns", "SELECT model, count(*) AS n FROM t_board GROUP BY 1")
def numeric_model_columns(spark, sf_dir):
    wide = study.fits(spark, sf_dir).select("asset", "date", F.col("rv").alias("y_true"), F.lit("note").alias("remark"), *[F.col(c).alias(m) for m, c in BASELINES.items()])
    numeric = [n for n, t in wide.dtypes if t == "double" and n != "y_true"]
    return wide.unpivot(["asset", "date"], numeric, "model", "yhat").groupBy("model").agg(F.count("yhat").alias("n"))


@query("P10_regime_columns", "SELECT asset, date, state AS reg_state FROM t_states")
def regime_columns(spark, sf_dir):
    return study.states(spark, sf_dir).select("asset", "date", F.col("state").alias("reg_state"))


# ------------------------------------------------------------------------------------- joins and sets


@query("J8_merge_onto_baseline", f"""
  SELECT w.asset, w.date, {r('f_har', 7, 'baseline')}, {r('exp(mu+sigma*sigma/2)', 7, 'added')} FROM t_boardw w JOIN t_law l ON l.asset = w.asset AND l.date = w.date AND l.method = 'log-walk' AND day(l.date) NOT IN (1, 2)""")
def merge_onto_baseline(spark, sf_dir):
    base = study.board(spark, sf_dir).where(F.col("model") == "HAR-RV").select("asset", "date", F.col("yhat").alias("baseline"))
    mean = F.exp(F.col("mu") + F.col("sigma") * F.col("sigma") / 2)
    new = study.law(spark, sf_dir).where(F.col("method") == "log-walk").select("asset", "date", F.when(~holes(), mean).alias("added"))
    return tidy(base.join(new, ["asset", "date"], "left").na.drop(), ["asset", "date"], baseline=7, added=7)


@query("J14_common_sample", f"SELECT asset, method, level_pct, count(*) AS n FROM t_iv WHERE EXISTS (SELECT 1 FROM t_second s WHERE s.date = t_iv.date) GROUP BY 1, 2, 3")
def common_sample(spark, sf_dir):
    kept = study.intervals(spark, sf_dir).join(tb.second_calendar(spark, sf_dir).select("date"), "date", "left_semi")
    return kept.groupBy("asset", "method", "level_pct").agg(F.count("*").alias("n"))


@query("J16_assembled_board", f"""
  SELECT asset, date, model, {r('yhat', 7, 'yhat')}, {r('y_true', 7, 'y_true')} FROM t_points""", branches=True)
def assembled_board(spark, sf_dir):
    actual = study.folded(spark, sf_dir).where("fold_idx is not null").select("asset", "date", F.col("rv").alias("y_true"))
    laws = study.law(spark, sf_dir).select("asset", "date", F.col("method").alias("model"), F.exp(F.col("mu") + F.col("sigma") * F.col("sigma") / 2).alias("yhat"))
    long = study.board(spark, sf_dir).select("asset", "date", "model", "yhat").unionByName(laws)
    return tidy(long.join(actual, ["asset", "date"]), ["asset", "date", "model"], yhat=7, y_true=7)


@query("U3_stacked_tables", f"""
  SELECT asset, model AS name, {r(f'avg({QLIKE})', 8, 'qlike')}, -1.0::DOUBLE AS crps FROM t_board GROUP BY 1, 2
  UNION ALL SELECT asset, method, -1.0, {r('avg(crps)', 8)} FROM t_crps GROUP BY 1, 2""", branches=True)
def stacked_tables(spark, sf_dir):
    from varloom.operators.calibration import crps_table

    a = sc.leaderboard(study.board(spark, sf_dir)).select("asset", F.col("model").alias("name"), "qlike")
    b = crps_table(study.law(spark, sf_dir)).select("asset", F.col("method").alias("name"), "crps")
    both = a.unionByName(b, allowMissingColumns=True).withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in ("qlike", "crps")})
    return tidy(both, ["asset", "name"], qlike=8, crps=8)


@query("U6_distinct_pairs", "SELECT DISTINCT model_a, model_b FROM t_d")
def distinct_pairs(spark, sf_dir):
    return differences(spark, sf_dir).select("model_a", "model_b").distinct()


# ---------------------------------------------------------------------------------- ranks and top rows


@query("K1_sorted_leaderboard", f"SELECT asset, model, row_number() OVER (PARTITION BY asset ORDER BY q, model) AS place, {r('q', 8, 'qlike')} FROM (SELECT asset, model, avg({QLIKE}) AS q FROM t_board GROUP BY 1, 2)")
def sorted_leaderboard(spark, sf_dir):
    scored = sc.leaderboard(study.board(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("asset").orderBy("qlike", "model"))
    return tidy(scored.withColumn("place", place), ["asset", "model", "place"], qlike=8).orderBy("asset", "place")


@query("W14_conditional_rank", f"""
  SELECT asset, model, rank() OVER (PARTITION BY asset ORDER BY q) AS rank_all, coalesce(CASE WHEN model <> 'RW-RV' THEN row_number() OVER (PARTITION BY asset, model <> 'RW-RV' ORDER BY q, model) END, -1) AS rank_eligible
  FROM (SELECT asset, model, avg({QLIKE}) AS q FROM t_board GROUP BY 1, 2)""")
def conditional_rank(spark, sf_dir):
    eligible = F.col("model") != "RW-RV"
    scored = sc.leaderboard(study.board(spark, sf_dir)).withColumn("_e", eligible)
    place = F.row_number().over(Window.partitionBy("asset", "_e").orderBy("qlike", "model"))
    return scored.select("asset", "model", F.col("rank").alias("rank_all"), F.coalesce(F.when(F.col("_e"), place), F.lit(-1)).alias("rank_eligible"))


@query("K2_best_grid_row", f"SELECT asset, method, arg_min(scope, crps_best) AS scope, arg_min(scale_crps, crps_best) AS scale, {r('min(crps_best)', 8, 'crps')} FROM t_scalebest GROUP BY 1, 2", branches=True)
def best_grid_row(spark, sf_dir):
    best = scale_table(spark, sf_dir).groupBy("asset", "method").agg(F.min_by(F.struct("scope", F.col("scale_crps").alias("scale")), "crps_best").alias("b"), F.min("crps_best").alias("crps"))
    return tidy(best.select("asset", "method", "b.*", "crps"), ["asset", "method", "scope", "scale"], crps=8)


@query("A38_grid_minimum", "SELECT asset, " + ", ".join(r(f"min(crps_best) FILTER (method = '{m}')", 8, n) for m, n in (("log-regression", "regression"), ("log-walk", "walk"))) + " FROM t_scalebest GROUP BY 1", branches=True)
def grid_minimum(spark, sf_dir):
    out = scale_table(spark, sf_dir).groupBy("asset").pivot("method", ["log-regression", "log-walk"]).agg(F.min("crps_best"))
    return tidy(out.withColumnsRenamed({"log-regression": "regression", "log-walk": "walk"}), ["asset"], regression=8, walk=8)


@query("K5_last_price_in_bin", """
  SELECT asset, time_bucket(INTERVAL '5 minutes', ts) AS bin, last(price ORDER BY ts, seq) AS price FROM t_bars GROUP BY 1, 2""")
def last_price_in_bin(spark, sf_dir):
    binned = tb.bars(spark, sf_dir).groupBy("asset", F.window("ts", "5 minutes").alias("b")).agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))
    return binned.select("asset", F.col("b.start").alias("bin"), "price")


@query("K6_available_symbols", "SELECT DISTINCT l_returnflag AS asset FROM lineitem ORDER BY 1 LIMIT 25")
def available_symbols(spark, sf_dir):
    return tb.trades(spark, sf_dir).select("asset").distinct().orderBy("asset").limit(25)


@query("W10_lagged_products", f"SELECT {KEY}, k AS lag, n, {r('c', 7, 'product_sum')} FROM t_acov WHERE k BETWEEN 1 AND 10")
def lagged_products(spark, sf_dir):
    out = acov(spark, sf_dir).select(*KEYS, "n", F.posexplode(F.slice("products", 1, 10)).alias("i", "product_sum")).withColumn("lag", F.col("i") + 1)
    return tidy(out, [*KEYS, "lag", "n"], product_sum=7)


@query("W20_training_prefix", f"""
  SELECT f.asset, f.fold_idx, count(*) AS n, {r('avg(d.rv)', 8, 'mean_rv')}, {r('var_pop(d.rv)', 8, 'var_rv')}, {r('covar_pop(d.rv_d, d.rv)', 8, 'cov_d')}
  FROM t_folds f JOIN t_frame d ON d.asset = f.asset AND d.date BETWEEN f.train_start AND f.train_end GROUP BY 1, 2""")
def training_prefix(spark, sf_dir):
    out = study.fits(spark, sf_dir).groupBy("asset", "fold_idx").agg(
        F.first("n").alias("n"), F.first("m_rv").alias("mean_rv"), F.first("v_rv").alias("var_rv"), F.first("c_rv_d_rv").alias("cov_d"))
    return tidy(out, ["asset", "fold_idx", "n"], mean_rv=8, var_rv=8, cov_d=8)


# --------------------------------------------------------------------------------- engine and grids


def walk(folded):
    return folded.where("fold_idx is not null").withColumn("yhat", F.greatest("rv_d", F.lit(wf.FORECAST_FLOOR)))


def patchy(folded):
    """A forecaster that has no answer on every other fold."""
    return folded.where("fold_idx is not null").withColumn("yhat", F.try_divide(F.col("rv_w"), F.col("fold_idx") % 2))


@query("E1_registered_forecasters", f"""
  SELECT asset, date, 'walk' AS model, {r('rv_d', 7, 'yhat')} FROM t_folded WHERE fold_idx IS NOT NULL
  UNION ALL SELECT asset, date, 'week', {r('rv_w', 7)} FROM t_folded WHERE fold_idx IS NOT NULL""")
def registered_forecasters(spark, sf_dir):
    week = lambda folded: folded.where("fold_idx is not null").withColumn("yhat", F.col("rv_w"))
    return tidy(wf.walk_forward({"walk": walk, "week": week}, study.frame(spark, sf_dir), study.PLAN), ["asset", "date", "model"], yhat=7)


@query("B7_lenient_mode", """
  SELECT asset, 'patchy' AS model, count(*) AS n_rows, count(*) FILTER (fold_idx % 2 = 1) AS n_forecasts FROM t_folded WHERE fold_idx IS NOT NULL GROUP BY 1""")
def lenient_mode(spark, sf_dir):
    board = wf.walk_forward({"patchy": patchy}, study.frame(spark, sf_dir), study.PLAN)
    return board.groupBy("asset", "model").agg(F.count("*").alias("n_rows"), F.count("yhat").alias("n_forecasts"))


@query("B8_predictive_board", f"SELECT asset, date, method, {rs(mu=7, sigma=7)} FROM t_law")
def predictive_board(spark, sf_dir):
    return tidy(study.law(spark, sf_dir), ["asset", "date", "method"], mu=7, sigma=7)


define("t_vfolded", folds_of("t_frame", VAL_START, VAL_END))
define("t_vfe", "SELECT asset, min(train_end_pos) AS fit_end, CAST(floor(min(train_end_pos)*0.85) AS BIGINT) AS head_end FROM t_vfolded GROUP BY asset")
define("t_vsc", "SELECT asset, avg(ln(rv)) AS m, stddev_pop(ln(rv)) AS s, avg(oc_log_return) AS mo, stddev_pop(oc_log_return) AS so FROM t_vfolded JOIN t_vfe USING (asset) WHERE pos <= fit_end GROUP BY asset")
SWEEP_SETS = {"history": ("log_rv",), "history_and_return": ("log_rv", "oc_log_return")}
SWEEP_LOOKBACKS, SWEEP_RIDGES = (10, 20, 40), (0.1, 1.0, 10.0)
_WIDE = max(SWEEP_LOOKBACKS)
_ONE, _Y = 2 * _WIDE + 1, 2 * _WIDE + 2
_lags = [f"(lag(ln(f.rv), {k}) OVER (PARTITION BY f.asset ORDER BY f.date) - m)/s" for k in range(1, _WIDE + 1)]
_lags += [f"(lag(f.oc_log_return, {k}) OVER (PARTITION BY f.asset ORDER BY f.date) - mo)/so" for k in range(1, _WIDE + 1)]
define("t_vdes", f"""
  SELECT * FROM (SELECT f.asset, f.date, f.pos, f.fold_idx, f.rv, ln(f.rv) AS y, fit_end, head_end, [{', '.join(_lags)}, 1.0, ln(f.rv)] AS v
  FROM t_vfolded f JOIN t_vfe USING (asset) JOIN t_vsc USING (asset)) WHERE pos >= {_WIDE}""")
define("t_vlong", f"SELECT asset, pos, i, v[i] AS x FROM t_vdes, (SELECT unnest(range(1, {_Y + 1})) AS i) WHERE pos <= head_end")
define("t_vcell", "SELECT a.asset, a.i, b.i AS j, sum(a.x*b.x) AS g FROM t_vlong a JOIN t_vlong b USING (asset, pos) GROUP BY 1, 2, 3")
define("t_vpoint", " UNION ALL ".join(
    f"SELECT '{label}' AS inputs, {n} AS lookback, {num(ridge)} AS ridge, {[*range(1, n + 1), *(range(_WIDE + 1, _WIDE + n + 1) if len(chosen) > 1 else ()), _ONE]} AS own"
    for label, chosen in SWEEP_SETS.items() for n in SWEEP_LOOKBACKS for ridge in SWEEP_RIDGES))
define("t_vrow", f"""
  SELECT asset, inputs, lookback, ridge, own, list_position(own, i) AS i, list(g + CASE WHEN i = j AND i <> {_ONE} THEN ridge ELSE 0.0 END ORDER BY j) AS line
  FROM t_vcell JOIN t_vpoint ON list_contains(own, i) AND (j = {_Y} OR list_contains(own, j)) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY asset, inputs, lookback, ridge, own, i"))
# Elimination without pivoting, a step per row of the recursion: the systems are symmetric and positive definite.
define("t_vgauss", """
  SELECT 1 AS k, * FROM t_vrow
  UNION ALL SELECT k + 1, asset, inputs, lookback, ridge, own, i, CASE WHEN i = k THEN list_transform(line, lambda z: z/f) ELSE list_transform(list_zip(line, top), lambda z: z[1] - f*z[2]) END FROM (
    SELECT a.*, p.line AS top, CASE WHEN a.i = a.k THEN a.line[a.k] ELSE a.line[a.k]/p.line[a.k] END AS f
    FROM t_vgauss a JOIN t_vgauss p ON p.i = a.k AND p.k = a.k AND p.asset = a.asset AND p.inputs = a.inputs AND p.lookback = a.lookback AND p.ridge = a.ridge WHERE a.k <= len(a.own))""")
define("t_vbeta", "SELECT asset, inputs, lookback, ridge, own, list(line[len(own) + 1] ORDER BY i) AS beta FROM t_vgauss WHERE k = len(own) + 1 GROUP BY 1, 2, 3, 4, 5")
define("t_vlin", "SELECT d.*, inputs, lookback, ridge, list_dot_product(list_transform(own, lambda e: v[e]), beta) AS lin FROM t_vdes d JOIN t_vbeta USING (asset)")
define("t_vs2", "SELECT asset, inputs, lookback, ridge, avg((y - lin)*(y - lin)) AS s2 FROM t_vlin WHERE pos > head_end AND pos <= fit_end GROUP BY 1, 2, 3, 4")
define("t_sweep", f"""
  SELECT asset, inputs, lookback, ridge, count(*) AS n, avg((y_true-yhat)*(y_true-yhat)) AS mse, avg(abs(y_true-yhat)) AS mae, avg({QLIKE}) AS qlike
  FROM (SELECT *, rv AS y_true, exp(lin + s2/2) AS yhat FROM t_vlin JOIN t_vs2 USING (asset, inputs, lookback, ridge) WHERE fold_idx IS NOT NULL) GROUP BY 1, 2, 3, 4""")


def sweep_scores(spark, sf_dir):
    """Eighteen grid points, trained once before the validation segment and scored on it."""
    folded = wf.assign_folds(study.frame(spark, sf_dir), study.PLAN, "val")
    out = fc.lookback_sweep(folded, {"log_rv": F.ln("rv"), "oc_log_return": F.col("oc_log_return")}, SWEEP_SETS, SWEEP_LOOKBACKS, SWEEP_RIDGES)
    return sc.aligned(out).groupBy("asset", "inputs", "lookback", "ridge").agg(*sc.point_aggregates())


@query("B9_validation_sweep", f"SELECT asset, inputs, lookback, ridge, n, {rs(mse=7, mae=7, qlike=7)} FROM t_sweep")
def validation_sweep(spark, sf_dir):
    return tidy(sweep_scores(spark, sf_dir), ["asset", "inputs", "lookback", "ridge", "n"], mse=7, mae=7, qlike=7)


@query("K2_best_sweep_point", f"""
  SELECT asset, inputs, lookback, ridge, {rs(qlike=7)} FROM t_sweep QUALIFY row_number() OVER (PARTITION BY asset ORDER BY qlike, inputs, lookback, ridge) = 1""")
def best_sweep_point(spark, sf_dir):
    point = F.struct("inputs", "lookback", "ridge")
    best = sweep_scores(spark, sf_dir).groupBy("asset").agg(F.min_by(point, F.struct("qlike", point)).alias("b"), F.min("qlike").alias("qlike"))
    return tidy(best.select("asset", "b.*", "qlike"), ["asset", "inputs", "lookback", "ridge"], qlike=7)


@query("A38_sweep_minimum", "SELECT asset, lookback, " + ", ".join(r(f"min(qlike) FILTER (inputs = '{s}')", 7, s) for s in SWEEP_SETS) + " FROM t_sweep GROUP BY 1, 2")
def sweep_minimum(spark, sf_dir):
    """Lowest loss over the ridges, lookbacks down and input sets across."""
    out = sweep_scores(spark, sf_dir).groupBy("asset", "lookback").pivot("inputs", list(SWEEP_SETS)).agg(F.min("qlike"))
    return tidy(out, ["asset", "lookback"], **dict.fromkeys(SWEEP_SETS, 7))


# -------------------------------------------------------------------------------- scalar functions


@query("X1_elementwise_math", f"""
  SELECT asset, date, {r('ln(rv)', 8, 'log_rv')}, {r('exp(log_return)', 8, 'gross')}, {r('sqrt(rv)', 8, 'vol')}, {r('abs(log_return)', 8, 'abs_ret')}, {r('power(rv, 1.5)', 8, 'rv15')},
    {r('least(greatest(log_return, -0.1), 0.1)', 8, 'clipped')} FROM t_frame""")
def elementwise_math(spark, sf_dir):
    out = study.frame(spark, sf_dir).select(
        "asset", "date", F.ln("rv").alias("log_rv"), F.exp("log_return").alias("gross"), F.sqrt("rv").alias("vol"), F.abs("log_return").alias("abs_ret"),
        F.pow("rv", F.lit(1.5)).alias("rv15"), F.least(F.greatest("log_return", F.lit(-0.1)), F.lit(0.1)).alias("clipped"))
    return tidy(out, ["asset", "date"], log_rv=8, gross=8, vol=8, abs_ret=8, rv15=8, clipped=8)


define("t_zs", "SELECT asset, date, method, (ln(y_true)-mu)/sigma AS zz FROM t_law")


@query("X3_normal_distribution", f"SELECT asset, date, method, {r(phi('zz'), 9, 'cdf')}, {r('exp(-zz*zz/2)/sqrt(2*pi())', 9, 'pdf')}, {r('2*' + phi('-abs(zz)'), 9, 'two_sided')} FROM t_zs")
def normal_distribution(spark, sf_dir):
    zz = (F.ln("y_true") - F.col("mu")) / F.col("sigma")
    rows = study.law(spark, sf_dir).withColumn("zz", zz)
    out = rows.select("asset", "date", "method", fm.normal_cdf(F.col("zz")).alias("cdf"), fm.normal_pdf(F.col("zz")).alias("pdf"), fm.normal_two_sided(F.col("zz")).alias("two_sided"))
    return tidy(out, ["asset", "date", "method"], cdf=9, pdf=9, two_sided=9)


@query("X4_chi_square_tail", "SELECT asset, date, method, " + ", ".join(r(chi2("zz*zz*2", k), 8, f"sf{k}") for k in (1, 2, 3, 4, 5, 10)) + " FROM t_zs")
def chi_square_tail(spark, sf_dir):
    zz = (F.ln("y_true") - F.col("mu")) / F.col("sigma")
    rows = study.law(spark, sf_dir).withColumn("q", zz * zz * 2)
    out = rows.select("asset", "date", "method", *[fm.chi2_sf(F.col("q"), k).alias(f"sf{k}") for k in (1, 2, 3, 4, 5, 10)])
    return tidy(out, ["asset", "date", "method"], sf1=8, sf2=8, sf3=8, sf4=8, sf5=8, sf10=8)


@query("X5_student_tail", f"SELECT asset, date, method, {r(student('zz', 'df'), 8, 'p')} FROM (SELECT asset, date, method, zz, 3 + day(date) AS df FROM t_zs)")
def student_tail(spark, sf_dir):
    zz = (F.ln("y_true") - F.col("mu")) / F.col("sigma")
    rows = study.law(spark, sf_dir).withColumns({"zz": zz, "df": (F.dayofmonth("date") + 3)})
    return tidy(rows.withColumn("p", fm.student_two_sided(F.col("zz"), F.col("df"))), ["asset", "date", "method"], p=8)


@query("X13_date_functions", """
  SELECT asset, CAST(ts AS DATE) AS day, count(*) AS n, min(ts + INTERVAL 7 MINUTE) AS first_shifted, strftime(min(ts), '%Y-%m') AS month FROM t_bars GROUP BY 1, 2""")
def date_functions(spark, sf_dir):
    return tb.bars(spark, sf_dir).groupBy("asset", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.min(F.col("ts") + F.make_dt_interval(mins=F.lit(7))).alias("first_shifted"), F.date_format(F.min("ts"), "yyyy-MM").alias("month"))


@query("X14_string_functions", """
  SELECT DISTINCT model, upper(model) AS up, substr(model, 1, 3) AS head, regexp_extract(model, '^[A-Z]+-(.*)$', 1) AS tail, regexp_replace(model, '^HAR-', '') AS stripped, model || '_lo90' AS tag FROM t_board""")
def string_functions(spark, sf_dir):
    m = F.col("model")
    return study.board(spark, sf_dir).select(
        "model", F.upper(m).alias("up"), F.substring(m, 1, 3).alias("head"), F.regexp_extract(m, "^[A-Z]+-(.*)$", 1).alias("tail"),
        F.regexp_replace(m, "^HAR-", "").alias("stripped"), F.concat(m, F.lit("_lo90")).alias("tag")).distinct()


@query("X16_json_record", """SELECT asset, '{"asset":"' || asset || '","rows":' || count(*) || ',"first_date":"' || min(date) || '"}' AS record FROM t_frame GROUP BY asset""")
def json_record(spark, sf_dir):
    facts = study.frame(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"))
    return facts.select("asset", F.to_json(F.struct("asset", "rows", "first_date")).alias("record"))
