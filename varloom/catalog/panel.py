"""Realised measures, features, joins, segments and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.sql import TEST_START, TRAIN_END, VAL_END, VAL_START, W, compose, define, finite, folds_of, num, r, rs
from varloom.operators import features as ft, realized as rz, splicing as sp, walkforward as wf
from varloom.plans import study
from varloom.sources import tables as tb

# ------------------------------------------------------------------------------------- scans and views


@query("S3_daily_ohlc", f"SELECT asset, date, {rs(open=9, high=9, low=9, close=9)} FROM t_ohlc")
def daily_ohlc(spark, sf_dir):
    return tidy(study.ohlc(spark, sf_dir), ["asset", "date"], open=9, high=9, low=9, close=9)


@query("S4_intraday_bars", """
  SELECT asset, CAST(ts AS DATE) AS date, count(*) AS n_bars, min(price) AS lo, max(price) AS hi FROM t_bars GROUP BY 1, 2""")
def intraday_bars(spark, sf_dir):
    return (
        tb.bars(spark, sf_dir).groupBy("asset", F.to_date("ts").alias("date"))
        .agg(F.count("*").alias("n_bars"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    )


@query("S5_target_selector", f"""
  SELECT asset, date, 'yang_zhang' AS target, {rs(rv=9)} FROM t_yz
  UNION ALL SELECT asset, date, 'intraday', {r('rv', 9)} FROM t_rv
  UNION ALL SELECT asset, date, 'spliced', {r('rv', 9)} FROM t_splice WHERE rv > 0""")
def target_selector(spark, sf_dir):
    days = study.days(spark, sf_dir)
    intraday, ranged = _sources(days)
    spliced = sp.splice(ranged, intraday, TRAIN_END, sp.overlap(intraday, ranged), force=True)
    out = None
    for which in ft.TARGETS:
        part = ft.select_target(which, days, intraday, spliced).withColumn("target", F.lit(which))
        out = part if out is None else out.unionByName(part)
    return tidy(out, ["asset", "date", "target"], rv=9)


@query("S13_registry_lookup", """
  SELECT w.asset, r.symbol, r.measure_symbol, r.session, coalesce(r.vix_feature, false) AS vix_feature, r.asset IS NULL AS unknown
  FROM (SELECT DISTINCT l_returnflag AS asset FROM lineitem UNION SELECT 'ZZ') w LEFT JOIN t_registry r USING (asset)""")
def registry_lookup(spark, sf_dir):
    registry = tb.asset_registry(spark, sf_dir)
    wanted = registry.select("asset").unionByName(spark.range(1).select(F.lit("ZZ").alias("asset")))
    return wanted.join(registry.withColumn("known", F.lit(True)), "asset", "left").select(
        "asset", "symbol", "measure_symbol", "session",
        F.coalesce("vix_feature", F.lit(False)).alias("vix_feature"), F.col("known").isNull().alias("unknown")
    )


# ------------------------------------------------------------------------------------ realised variance
GRID = """
  SELECT asset, date, avg(v) AS rv, max(n) AS n_returns FROM (
    SELECT asset, date, off, count(*) - 1 AS n, CASE WHEN count(*) - 1 >= 2 THEN coalesce(sum(x*x), 0.0) END AS v FROM (
      SELECT asset, off, CAST(bin AS DATE) AS date,
             ln(price) - ln(lag(price) OVER (PARTITION BY asset, off, CAST(bin AS DATE) ORDER BY bin)) AS x FROM (
        SELECT asset, off, time_bucket(INTERVAL '5 minutes', ts + to_minutes(off)) AS bin, last(price ORDER BY ts, seq) AS price
        FROM t_bars, (SELECT unnest([{offsets}]) AS off) GROUP BY 1, 2, 3)) GROUP BY 1, 2, 3) GROUP BY 1, 2
  HAVING avg(v) IS NOT NULL"""
define("t_grid1", GRID.format(offsets="0"))
define("t_grid5", GRID.format(offsets="0, 1, 2, 3, 4"))


@query("A1_realized_variance", f"SELECT asset, date, n_returns, {rs(rv=8)} FROM t_grid1")
def realized_variance(spark, sf_dir):
    return tidy(rz.realized_variance(tb.bars(spark, sf_dir)), ["asset", "date", "n_returns"], rv=8)


@query("A2_subsampled_variance", f"SELECT asset, date, n_returns, {rs(rv=8)} FROM t_grid5")
def subsampled_variance(spark, sf_dir):
    return tidy(rz.realized_variance(tb.bars(spark, sf_dir), grids=5), ["asset", "date", "n_returns"], rv=8)


@query("A3_min_observation_guard", f"""
  SELECT asset, count(*) AS days, count(*) FILTER (n_returns >= 8) AS days_kept, {r('sum(rv) FILTER (n_returns >= 8)', 7, 'kept_rv')}
  FROM t_rv GROUP BY asset""")
def min_observation_guard(spark, sf_dir):
    rv = rz.trade_variance(tb.trades(spark, sf_dir), tb.TRADE_ORDER)
    kept = F.col("n_returns") >= 8
    out = rv.groupBy("asset").agg(
        F.count("*").alias("days"), F.count_if(kept).alias("days_kept"), F.sum(F.when(kept, F.col("rv"))).alias("kept_rv")
    )
    return tidy(out, ["asset", "days", "days_kept"], kept_rv=7)


@query("A1_trade_variance", f"SELECT asset, date, n_returns, {rs(rv=9)} FROM t_rv")
def trade_variance(spark, sf_dir):
    return tidy(rz.trade_variance(tb.trades(spark, sf_dir), tb.TRADE_ORDER), ["asset", "date", "n_returns"], rv=9)


define("t_measures", f"""
  SELECT asset, date, 'parkinson' AS estimator, ln(high/low)*ln(high/low)/(4*ln(2::DOUBLE)) AS v FROM t_ohlc
  UNION ALL SELECT asset, date, 'squared_return', log_return*log_return FROM t_daily
  UNION ALL SELECT asset, date, 'rogers_satchell', rs FROM t_daily
  UNION ALL SELECT asset, date, 'yang_zhang', rv FROM t_yzall
  UNION ALL SELECT asset, date, 'intraday', rv FROM t_rv""")


@query("X2_range_estimators", f"""
  SELECT asset, date, {r('v_park', 9, 'parkinson')}, {r('sqrt(v_park*252)', 9, 'parkinson_vol')}, {r('log_return*log_return', 9, 'squared_return')},
         {r('rs', 9, 'rogers_satchell')}, {r('oc_log_return', 9, 'open_to_close')}, {r('100*sqrt(greatest(v_park,0)*252)', 7, 'vol_percent')}
  FROM (SELECT *, ln(high/low)*ln(high/low)/(4*ln(2::DOUBLE)) AS v_park FROM t_daily)""")
def range_estimators(spark, sf_dir):
    out = study.ohlc(spark, sf_dir).select(
        "asset", "date", rz.parkinson_variance().alias("parkinson"), F.sqrt(rz.parkinson_variance(True)).alias("parkinson_vol"),
        rz.squared_return_variance().alias("squared_return"), rz.rogers_satchell().alias("rogers_satchell"),
        rz.open_to_close().alias("open_to_close"), rz.parkinson_variance().alias("_p"),
    ).withColumn("vol_percent", 100 * rz.volatility_from_variance("_p", True))
    return tidy(out, ["asset", "date"], parkinson=9, parkinson_vol=9, squared_return=9, rogers_satchell=9, open_to_close=9, vol_percent=7)


@query("A22_variance_summary", f"""
  SELECT asset, estimator, count(v) AS n, {r('avg(v)', 8, 'mean')}, {r('quantile_cont(v, 0.5)', 8, 'median')},
         {r('stddev_samp(v)', 8, 'std')}, {r('quantile_cont(v, 0.99)', 8, 'p99')}
  FROM t_measures WHERE v IS NOT NULL GROUP BY asset, estimator""")
def variance_summary(spark, sf_dir):
    names = ["yang_zhang", "parkinson", "squared_return", "rogers_satchell", "intraday"]
    days = rz.day_summary(tb.trades(spark, sf_dir), tb.TRADE_ORDER).withColumn("intraday", F.when(rz.has_variance(), F.col("rv")))
    daily = rz.yang_zhang(days, name="yang_zhang").select(
        "asset", "date", "yang_zhang", rz.parkinson_variance().alias("parkinson"),
        rz.squared_return_variance().alias("squared_return"), rz.rogers_satchell().alias("rogers_satchell"), "intraday",
    )
    out = daily.unpivot(["asset", "date"], names, "estimator", "v").where("v is not null").groupBy("asset", "estimator").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"),
        F.stddev_samp("v").alias("std"), F.percentile("v", 0.99).alias("p99"),
    )
    return tidy(out, ["asset", "estimator", "n"], mean=8, median=8, std=8, p99=8)


define("t_park", "SELECT asset, date, ln(high/low)*ln(high/low)/(4*ln(2::DOUBLE)) AS rv FROM t_ohlc")
define("t_overlap", """
  SELECT asset, count(*) AS n, corr(a, b) AS pearson, corr(ra, rb) AS spearman, quantile_cont(a/b, 0.5) AS median_ratio,
         avg(abs(ln(a/b))) AS mean_abs_log_ratio, min(date) AS first_date, max(date) AS last_date
  FROM (SELECT *, rank() OVER (PARTITION BY asset ORDER BY a) + (count(*) OVER (PARTITION BY asset, a) - 1) / 2 AS ra,
                  rank() OVER (PARTITION BY asset ORDER BY b) + (count(*) OVER (PARTITION BY asset, b) - 1) / 2 AS rb
        FROM (SELECT x.asset, x.date, x.rv AS a, p.rv AS b FROM t_rv x JOIN t_park p USING (asset, date) WHERE x.rv > 0 AND p.rv > 0))
  GROUP BY asset""")


def splice_sql(gate: str = "") -> str:
    return f"""
  SELECT p.asset, p.date, 'head' AS part, p.rv FROM t_park p JOIN t_overlap o USING (asset) WHERE p.date <= DATE '{TRAIN_END}' {gate}
  UNION ALL SELECT x.asset, x.date, 'tail', x.rv / o.median_ratio FROM t_rv x JOIN t_overlap o USING (asset) WHERE x.date > DATE '{TRAIN_END}' {gate}"""


LOOSE, WIDE = (60, 0.5, 3.0), (60, 0.8, 4.0)
define("t_splice", splice_sql())
define("t_splicegated", splice_sql("AND o.n >= 60 AND o.pearson >= 0.9 AND abs(o.median_ratio - 1) <= 0.15"))
define("t_splicewide", splice_sql("AND o.n >= 60 AND o.pearson >= 0.8 AND abs(o.median_ratio - 1) <= 4.0"))


def _sources(days):
    """Realised variance of all trades, and the range estimate, of the same days."""
    return days.where(rz.has_variance()).select("asset", "date", "rv"), days.select("asset", "date", rz.parkinson_variance().alias("rv"))


@query("A19_overlap_statistics", f"""
  SELECT asset, n, first_date, last_date, {rs(pearson=8, spearman=8, median_ratio=8, mean_abs_log_ratio=8)} FROM t_overlap""")
def overlap_statistics(spark, sf_dir):
    out = sp.overlap(*_sources(study.days(spark, sf_dir)))
    return tidy(out, ["asset", "n", "first_date", "last_date"], pearson=8, spearman=8, median_ratio=8, mean_abs_log_ratio=8)


@query("U2_splice_gate", """
  SELECT asset, n, n >= 60 AND pearson >= 0.9 AND abs(median_ratio - 1) <= 0.15 AS passes,
         n >= 60 AND pearson >= 0.5 AND abs(median_ratio - 1) <= 3.0 AS passes_loose FROM t_overlap""")
def splice_gate(spark, sf_dir):
    report = sp.overlap(*_sources(study.days(spark, sf_dir)))
    loose = sp.gate(report, *LOOSE).withColumnRenamed("passes", "passes_loose")
    return sp.gate(loose).select("asset", "n", "passes", "passes_loose")


def spliced(spark, sf_dir, **how):
    intraday, ranged = _sources(study.days(spark, sf_dir))
    return tidy(sp.splice(ranged, intraday, TRAIN_END, sp.overlap(intraday, ranged), **how), ["asset", "date", "part"], rv=9)


@query("U1_gated_splice", f"SELECT asset, date, part, {rs(rv=9)} FROM t_splicegated")
def gated_splice(spark, sf_dir):
    """Only assets whose sources agree closely enough; others have no spliced series."""
    return spliced(spark, sf_dir)


@query("U1_wide_gate_splice", f"SELECT asset, date, part, {rs(rv=9)} FROM t_splicewide")
def wide_gate_splice(spark, sf_dir):
    """A gate for sources of different levels, which the splice then brings to one level."""
    return spliced(spark, sf_dir, thresholds=WIDE)


@query("U1_forced_splice", f"SELECT asset, date, part, {rs(rv=9)} FROM t_splice")
def forced_splice(spark, sf_dir):
    return spliced(spark, sf_dir, force=True)


# ------------------------------------------------------------------------------------ window functions


@query("W1_log_returns", f"SELECT asset, date, {rs(log_return=9, oc_log_return=9)} FROM t_daily")
def log_returns(spark, sf_dir):
    return tidy(ft.daily_returns(study.ohlc(spark, sf_dir)), ["asset", "date"], log_return=9, oc_log_return=9)


@query("W2_har_lags", f"SELECT asset, date, {rs(rv=9, rv_d=9, rv_w=9, rv_m=9)} FROM t_rvlags")
def har_lags(spark, sf_dir):
    rv = ft.select_target("intraday", intraday=rz.trade_variance(tb.trades(spark, sf_dir), tb.TRADE_ORDER))
    return tidy(ft.har_lags(rv), ["asset", "date"], rv=9, rv_d=9, rv_w=9, rv_m=9)


@query("W3_yang_zhang", f"SELECT asset, date, {rs(rv=9)}, {r('sqrt(rv*252)', 8, 'vol')} FROM t_yzall")
def yang_zhang(spark, sf_dir):
    out = rz.yang_zhang(study.ohlc(spark, sf_dir)).withColumn("vol", F.when(F.col("rv").isNotNull(), rz.volatility_from_variance("rv", True)))
    return tidy(out, ["asset", "date"], rv=9, vol=8)


@query("W4_rolling_abs_return", f"""
  SELECT asset, date, {r('CASE WHEN count(log_return) OVER w = 21 THEN avg(abs(log_return)) OVER w END', 9, 'mean_abs')}
  FROM t_daily WINDOW w AS ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def rolling_abs_return(spark, sf_dir):
    out = ft.daily_returns(study.ohlc(spark, sf_dir)).withColumn("mean_abs", ft.rolling_abs_return())
    return tidy(out, ["asset", "date"], mean_abs=9)


@query("W5_supervised_windows", f"""
  SELECT asset, date, n, {rs(first_ret=9, last_ret=9, sum_rv=8)} FROM (
    SELECT asset, date, count(*) OVER p AS n, first_value(log_return) OVER p AS first_ret, last_value(log_return) OVER p AS last_ret,
           sum(rv) OVER p AS sum_rv
    FROM t_frame WINDOW p AS ({W} ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING)) WHERE n = 22""")
def supervised_windows(spark, sf_dir):
    x = ft.supervised_windows(study.frame(spark, sf_dir), 22, ["log_return", "rv"])
    out = x.select(
        "asset", "date", F.size("x").cast("long").alias("n"), F.element_at("x", 1)["log_return"].alias("first_ret"),
        F.element_at("x", -1)["log_return"].alias("last_ret"),
        F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v["rv"]).alias("sum_rv"),
    )
    return tidy(out, ["asset", "date", "n"], first_ret=9, last_ret=9, sum_rv=8)


@query("W11_keep_first", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY date, l_partkey, l_suppkey, px, asset) AS i FROM t_trades)
  WHERE i = 1""")
def keep_first(spark, sf_dir):
    out = ft.keep_first(tb.trades(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["date", "l_partkey", "l_suppkey", "px", "asset"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px")


@query("W12_lag_correlation", f"""
  SELECT asset, {r('corr(rv, p)', 9, 'acf1')} FROM (SELECT asset, rv, lag(rv) OVER ({W}) AS p FROM t_frame) GROUP BY asset""")
def lag_correlation(spark, sf_dir):
    return tidy(ft.lag_one_correlation(study.frame(spark, sf_dir)), ["asset"], acf1=9)


@query("W13_rank_bins", """
  SELECT asset, date, CAST(least((rn - 1) * 4 // n, 3) AS INT) AS bin FROM (
    SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY rv, date) AS rn, count(*) OVER (PARTITION BY asset) AS n FROM t_frame)""")
def rank_bins(spark, sf_dir):
    return study.frame(spark, sf_dir).select("asset", "date", ft.rank_bins("rv", 4).alias("bin"))


@query("W15_short_mean", f"""
  SELECT asset, date, {r(f'avg(rv) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)', 9, 'm')} FROM t_frame""")
def short_mean(spark, sf_dir):
    return tidy(study.frame(spark, sf_dir).withColumn("m", ft.short_mean("rv", 10)), ["asset", "date"], m=9)


@query("W16_run_lengths", f"""
  SELECT asset, state, count(*) AS runs, max(len) AS longest, {r('avg(len)', 8, 'mean_run')} FROM (
    SELECT asset, island, state, count(*) AS len FROM (
      SELECT *, sum(CASE WHEN state IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER ({W}) AS island
      FROM (SELECT asset, date, state, lag(state) OVER ({W}) AS p FROM t_states)) GROUP BY 1, 2, 3) GROUP BY asset, state""")
def run_lengths(spark, sf_dir):
    from varloom.operators.timing import run_table

    out = run_table(study.states(spark, sf_dir)).groupBy("asset", "state").agg(
        F.count("*").alias("runs"), F.max("length").alias("longest"), F.avg("length").alias("mean_run")
    )
    return tidy(out, ["asset", "state", "runs", "longest"], mean_run=8)


@query("W17_next_trading_day", f"""
  SELECT * FROM (SELECT asset, date, lead(date) OVER ({W}) AS target_date FROM t_frame) WHERE target_date IS NOT NULL""")
def next_trading_day(spark, sf_dir):
    return study.frame(spark, sf_dir).select("asset", "date", ft.next_date().alias("target_date")).where("target_date is not null")


# ----------------------------------------------------------------------------- projections, joins
define("t_jframe", f"""
  SELECT d.asset, d.date, d.log_return, d.oc_log_return, l.rv, l.rv_d, l.rv_w, l.rv_m, s.vix_close
  FROM t_daily d JOIN t_rvlags l USING (asset, date) JOIN t_second s USING (date)""")


@query("J1_calendar_join", f"""
  SELECT asset, date, {rs(log_return=9, oc_log_return=9, rv=9, rv_d=9, rv_w=9, rv_m=9, vix_close=6)} FROM t_jframe
  WHERE {finite('log_return', 'oc_log_return', 'rv', 'rv_d', 'rv_w', 'rv_m', 'vix_close')}""")
def calendar_join(spark, sf_dir):
    days = study.days(spark, sf_dir)
    target = ft.select_target("intraday", intraday=_sources(days)[0])
    out = ft.modelling_frame(days, target, tb.second_calendar(spark, sf_dir))
    return tidy(out, ["asset", "date"], log_return=9, oc_log_return=9, rv=9, rv_d=9, rv_w=9, rv_m=9, vix_close=6)


@query("J2_join_attrition", """
  SELECT asset, n_target, n_joined, n_final, n_target - n_joined AS lost_to_join, n_joined - n_final AS lost_to_warmup,
         (n_target - n_joined) / n_target > 0.02 AS warn FROM (
    SELECT l.asset, count(*) AS n_target, count(*) FILTER (d.asset IS NOT NULL AND s.date IS NOT NULL) AS n_joined,
           count(*) FILTER (d.log_return IS NOT NULL AND s.date IS NOT NULL AND l.rv_d IS NOT NULL AND l.rv_w IS NOT NULL AND l.rv_m IS NOT NULL) AS n_final
    FROM t_rvlags l LEFT JOIN t_daily d USING (asset, date) LEFT JOIN t_second s ON s.date = l.date GROUP BY l.asset)""")
def join_attrition(spark, sf_dir):
    days = study.days(spark, sf_dir)
    target = ft.select_target("intraday", intraday=_sources(days)[0])
    return ft.attrition(days, target, tb.second_calendar(spark, sf_dir))


@query("J3_minimal_feature_join", f"""
  SELECT d.asset, d.date, {r('d.log_return', 9, 'log_return')}, {r('l.rv_d', 9, 'rv_d')}, {r('l.rv_w', 9, 'rv_w')}, {r('l.rv_m', 9, 'rv_m')}
  FROM t_daily d JOIN t_lags l USING (asset, date)
  WHERE d.log_return IS NOT NULL AND l.rv_d IS NOT NULL AND l.rv_w IS NOT NULL AND l.rv_m IS NOT NULL""")
def minimal_feature_join(spark, sf_dir):
    return tidy(study.frame(spark, sf_dir), ["asset", "date"], log_return=9, rv_d=9, rv_w=9, rv_m=9)


@query("J15_eligibility_join", f"""
  SELECT f.asset, f.date, {r('f.rv', 9, 'rv')}, {r('CASE WHEN g.vix_feature THEN s.vix_close END', 6, 'vix_close')}
  FROM t_frame f JOIN t_registry g USING (asset) LEFT JOIN t_second s USING (date)
  WHERE NOT g.vix_feature OR s.date IS NOT NULL""")
def eligibility_join(spark, sf_dir):
    flagged = study.frame(spark, sf_dir).join(tb.asset_registry(spark, sf_dir).select("asset", "vix_feature"), "asset")
    joined = flagged.join(tb.second_calendar(spark, sf_dir).withColumn("_has", F.lit(True)), "date", "left")
    kept = joined.where(~F.col("vix_feature") | F.col("_has").isNotNull())
    return tidy(kept.withColumn("vix_close", F.when(F.col("vix_feature"), F.col("vix_close"))), ["asset", "date"], rv=9, vix_close=6)


@query("P6_positivity_filter", "SELECT asset, count(*) AS n, count(*) FILTER (rv > 0) AS n_positive FROM t_yzall GROUP BY asset")
def positivity_filter(spark, sf_dir):
    yz = rz.yang_zhang(study.ohlc(spark, sf_dir))
    return yz.groupBy("asset").agg(F.count("*").alias("n"), F.count_if(F.col("rv") > 0).alias("n_positive"))


@query("P7_date_slice", f"""
  SELECT asset, date, {rs(rv=9)} FROM t_frame WHERE date BETWEEN DATE '{VAL_START}' AND DATE '{VAL_END}'""")
def date_slice(spark, sf_dir):
    return tidy(study.frame(spark, sf_dir).where(F.col("date").between(F.lit(VAL_START).cast("date"), F.lit(VAL_END).cast("date"))), ["asset", "date"], rv=9)


@query("P11_forecast_features", f"""
  SELECT asset, date, {r('ln(rv)', 9, 'log_rv')}, {r('abs(log_return)', 9, 'abs_log_return')}, {r('ln(rv_d)', 9, 'log_rv_d')},
         {r('ln(rv_w)', 9, 'log_rv_w')}, {r('ln(rv_m)', 9, 'log_rv_m')}, {r('ln(rv)', 9, 'y')} FROM t_frame""")
def forecast_features(spark, sf_dir):
    out = ft.forecast_features(study.frame(spark, sf_dir), ["log_rv", "abs_log_return", "log_rv_d", "log_rv_w", "log_rv_m"])
    return tidy(out, ["asset", "date"], log_rv=9, abs_log_return=9, log_rv_d=9, log_rv_w=9, log_rv_m=9, y=9)


@query("P12_regime_features", f"SELECT asset, date, {r('log_return', 9, 'ret')}, {r('ln(rv)', 9, 'log_rv')} FROM t_frame")
def regime_features(spark, sf_dir):
    return tidy(ft.regime_features(study.frame(spark, sf_dir), "returns_logrv"), ["asset", "date"], ret=9, log_rv=9)


# -------------------------------------------------------------------------------------- segments, folds


@query("B2_three_way_split", f"""
  SELECT asset, segment, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM (
    SELECT asset, date, CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' WHEN date BETWEEN DATE '{VAL_START}' AND DATE '{VAL_END}' THEN 'val'
           WHEN date >= DATE '{TEST_START}' THEN 'test' END AS segment FROM t_frame) GROUP BY 1, 2""")
def three_way_split(spark, sf_dir):
    p = study.PLAN
    seg = ft.segment(p.train_end, p.val_start, p.val_end, p.test_start, p.test_end)
    return study.frame(spark, sf_dir).withColumn("segment", seg).groupBy("asset", "segment").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query("B3_walk_forward_folds", "SELECT * FROM t_folds")
def walk_forward_folds(spark, sf_dir):
    return wf.fold_table(study.folded(spark, sf_dir))


define("t_rolled", folds_of("t_frame", VAL_START, "2099-12-31", "rolling"))


@query("W21_rolling_folds", """
  SELECT f.asset, f.fold_idx, s.date AS train_start, e.date AS train_end, f.predict_start, f.predict_end, f.n_train, f.n_predict
  FROM (SELECT asset, fold_idx, min(date) AS predict_start, max(date) AS predict_end, min(train_end_pos) AS tep,
               min(train_len) AS n_train, count(*) AS n_predict
        FROM t_rolled WHERE fold_idx IS NOT NULL GROUP BY asset, fold_idx) f
  JOIN t_rolled e ON e.asset = f.asset AND e.pos = f.tep
  JOIN t_rolled s ON s.asset = f.asset AND s.pos = f.tep - f.n_train + 1""")
def rolling_folds(spark, sf_dir):
    plan = wf.SplitPlan(scheme="rolling")
    return wf.fold_table(wf.assign_folds(study.frame(spark, sf_dir), plan, "val+test"))


@query("W19_fold_positions", """
  SELECT asset, date, pos, oos_pos, fold_idx, train_end_pos, train_len FROM t_folded WHERE is_oos""")
def fold_positions(spark, sf_dir):
    return study.folded(spark, sf_dir).where("is_oos").select("asset", "date", "pos", "oos_pos", "fold_idx", "train_end_pos", "train_len")


@query("J9_fold_membership", """
  SELECT f.asset, f.fold_idx, count(*) FILTER (d.date BETWEEN f.train_start AND f.train_end) AS n_train_rows,
         count(*) FILTER (d.date BETWEEN f.predict_start AND f.predict_end) AS n_predict_rows
  FROM t_folds f JOIN t_frame d ON d.asset = f.asset GROUP BY 1, 2""")
def fold_membership(spark, sf_dir):
    folds = study.folded(spark, sf_dir).where("fold_idx is not null").groupBy("asset", "fold_idx")
    return folds.agg(F.max("train_len").alias("n_train_rows"), F.count("*").alias("n_predict_rows"))


@query("B11_train_standardizer", f"""
  SELECT f.asset, f.date, {r('(f.log_return - m) / CASE WHEN s < 1e-12 THEN 1 ELSE s END', 9, 'z')} FROM t_frame f JOIN (
    SELECT asset, avg(log_return) AS m, stddev_pop(log_return) AS s FROM t_frame WHERE date <= DATE '{TRAIN_END}' GROUP BY asset) USING (asset)""")
def train_standardizer(spark, sf_dir):
    from varloom.operators.regimes import standardize

    return tidy(standardize(study.frame(spark, sf_dir), "log_return", TRAIN_END, "z"), ["asset", "date"], z=9)
