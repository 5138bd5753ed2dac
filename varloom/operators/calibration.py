"""Interval and distribution calibration tables, spread-scale searches and regime breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.laws import lognormal_crps, lognormal_mean, lognormal_quantile
from varloom.functions.losses import qlike_loss
from varloom.functions.math import all_finite, normal_cdf, normal_quantile
from varloom.operators.scoring import aligned, interval_aggregates


def expand_quantiles(laws: DataFrame, taus) -> DataFrame:
    """One row per law and quantile level; the small grid is a literal, not a table."""
    rows = [F.struct(F.lit(float(t)).alias("tau"), lognormal_quantile(F.col("mu"), F.col("sigma"), t).alias("q")) for t in taus]
    return laws.withColumn("_q", F.explode(F.array(*rows))).select("asset", "date", "method", "y_true", "_q.tau", "_q.q")


def reliability(laws: DataFrame, quantile_fn, taus, by=("asset", "method")) -> DataFrame:
    """Share of outcomes at or below each predicted quantile; ``quantile_fn(tau)`` returns a column."""
    rows = [F.struct(F.lit(float(t)).alias("tau"), (F.col("y_true") <= quantile_fn(t)).cast("double").alias("below")) for t in taus]
    long = laws.where(all_finite("y_true")).withColumn("_r", F.explode(F.array(*rows)))
    return long.groupBy(*by, F.col("_r.tau").alias("tau")).agg(
        F.avg("_r.below").alias("empirical"), (F.avg("_r.below") - F.max("_r.tau")).alias("gap"), F.count("*").alias("n")
    )


def law_quantile(tau: float) -> Column:
    return lognormal_quantile(F.col("mu"), F.col("sigma"), tau)


def crps_table(laws: DataFrame, by=("asset", "method")) -> DataFrame:
    ok = all_finite("y_true", "mu", "sigma") & (F.col("y_true") > 0) & (F.col("sigma") > 0)
    return laws.where(ok).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(lognormal_crps(F.col("y_true"), F.col("mu"), F.col("sigma"))).alias("crps")
    )


def uq_point_table(laws: DataFrame, by=("asset", "method")) -> DataFrame:
    """Point losses of the mean of each predictive law."""
    from varloom.operators.scoring import point_aggregates

    means = laws.withColumn("yhat", lognormal_mean(F.col("mu"), F.col("sigma")))
    return aligned(means).groupBy(*by).agg(*point_aggregates())


def with_all_row(df: DataFrame, key, aggregates) -> DataFrame:
    """Grouped by key and state, plus one row per key over every labelled row (state null)."""
    sets = [[F.col(k) for k in key] + [F.col("state")], [F.col(k) for k in key]]
    return df.groupingSets(sets, *[F.col(k) for k in key], F.col("state")).agg(*aggregates)


def per_regime_intervals(intervals: DataFrame, lagged: DataFrame, states: int = 3) -> DataFrame:
    """Interval scores inside each lagged state and over all; empty states appear with n = 0."""
    key = ["asset", "method", "level_pct"]
    rows = aligned(intervals, "y_true", "lo", "hi").join(lagged, ["asset", "date"]).where(F.col("state").isNotNull())
    scored = with_all_row(rows, key, interval_aggregates()).withColumn("state", F.coalesce("state", F.lit(states)))
    grid = scored.select(*key).distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(states))))
    return grid.join(scored, [*key, "state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_regime_qlike(board: DataFrame, lagged: DataFrame, models) -> DataFrame:
    """Mean QLIKE per lagged state, one column per model, with a pooled row (state null)."""
    scored = aligned(board).join(lagged, ["asset", "date"]).where(F.col("state").isNotNull())
    loss = qlike_loss(F.col("y_true"), F.col("yhat"))
    aggregates = [F.count_if(F.col("model") == models[0]).alias("n")]
    aggregates += [F.avg(F.when(F.col("model") == m, loss)).alias(m) for m in models]
    return with_all_row(scored, ["asset"], aggregates)


def transition_coverage(intervals: DataFrame, marked: DataFrame) -> DataFrame:
    """Interval scores on transition days against stable days; unscored days stay out."""
    rows = aligned(intervals, "y_true", "lo", "hi").join(marked.where("scored").select("asset", "date", "is_transition"), ["asset", "date"])
    return rows.groupBy("asset", "method", "level_pct", "is_transition").agg(*interval_aggregates())


def with_scopes(laws: DataFrame, lagged: DataFrame) -> DataFrame:
    """Every row once under scope 'all' and once under its lagged state."""
    joined = laws.join(lagged, ["asset", "date"], "left")
    named = F.when(F.col("state").isNotNull(), F.concat(F.lit("state"), F.col("state").cast("string")))
    scopes = F.array_compact(F.array(F.lit("all"), named))
    return joined.withColumn("scope", F.explode(scopes)).drop("state")


def sigma_scale_search(laws: DataFrame, scales, level_pct: int = 90, by=("asset", "method", "scope"), min_n: int = 20, plateau: float = 1.001) -> DataFrame:
    """Spread multiplier that minimises CRPS, with its plateau, and the one that calibrates coverage.

    Coverage and CRPS at the fitted spread (multiplier 1) and coverage at the calibrating one stand beside them.

    The literal grid multiplies rows before a map-side combined average; the search then runs over
    one row per key and scale. Scopes with too few days are left out.
    """
    z = normal_quantile(1 - (100 - level_pct) / 200)
    ok = laws.where(all_finite("y_true", "mu", "sigma") & (F.col("y_true") > 0) & (F.col("sigma") > 0))
    tried = sorted({*map(float, scales), 1.0})
    searched = F.col("scale").isin(*map(float, scales))
    grid = ok.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in tried])))
    s = F.col("sigma") * F.col("scale")
    inside = (F.abs(F.ln("y_true") - F.col("mu")) <= F.lit(z) * s).cast("double")
    table = grid.groupBy(*by, "scale").agg(
        F.count("*").alias("n"), F.avg(lognormal_crps(F.col("y_true"), F.col("mu"), s)).alias("crps"), F.avg(inside).alias("picp")
    ).where(F.col("n") >= min_n)
    lowest = F.min(F.when(searched, F.col("crps"))).over(Window.partitionBy(*by))
    near = searched & (F.col("crps") <= F.col("_low") * F.lit(plateau))
    fitted = F.col("scale") == 1.0
    gap = F.abs(F.col("picp") - F.lit(level_pct / 100))
    return table.withColumn("_low", lowest).groupBy(*by).agg(
        F.max("n").alias("n"),
        F.max(F.when(fitted, F.col("picp"))).alias("picp_fitted"), F.max(F.when(fitted, F.col("crps"))).alias("crps_fitted"),
        F.min_by("scale", F.when(searched, F.struct("crps", "scale"))).alias("scale_crps"), F.min("_low").alias("crps_best"),
        F.min_by("scale", F.when(searched, F.struct(gap, F.col("scale")))).alias("scale_coverage"),
        F.min_by("picp", F.when(searched, F.struct(gap, F.col("scale")))).alias("picp_calibrated"),
        F.min(F.when(near, F.col("scale"))).alias("plateau_lo"), F.max(F.when(near, F.col("scale"))).alias("plateau_hi"),
    )


def width_by_regime(intervals: DataFrame, lagged: DataFrame, extra=()) -> DataFrame:
    """Width, log ratio of the ends and one-sided miss rates per lagged state, and over every day (state null).

    ``extra`` are further aggregates over the columns that the intervals carry.
    """
    unlabelled = F.lit(-2)
    rows = aligned(intervals, "y_true", "lo", "hi").join(lagged, ["asset", "date"], "left").withColumn("state", F.coalesce("state", unlabelled))
    ratio = F.ln(F.when((F.col("lo") > 0) & (F.col("hi") > 0), F.col("hi") / F.col("lo")))
    return with_all_row(rows, ["asset", "method", "level_pct"], [
        F.count("*").alias("n"), F.avg(F.col("hi") - F.col("lo")).alias("mpiw"), F.avg(ratio).alias("mean_log_width"), *extra,
        F.avg((F.col("y_true") < F.col("lo")).cast("double")).alias("below_rate"),
        F.avg((F.col("y_true") > F.col("hi")).cast("double")).alias("above_rate"),
    ]).where(F.col("state").isNull() | (F.col("state") != unlabelled))


def pit(laws: DataFrame) -> DataFrame:
    return laws.withColumn("pit", normal_cdf((F.ln("y_true") - F.col("mu")) / F.col("sigma")))
