"""Point losses, leaderboards and interval scores as grouped aggregates over long boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.losses import absolute_error, pinball, qlike_loss, squared_error, winkler
from varloom.functions.math import all_finite


def aligned(board: DataFrame, *names: str) -> DataFrame:
    """Pairwise complete rows: a missing or infinite entry never counts as a miss."""
    return board.where(all_finite(*(names or ("y_true", "yhat"))))


def point_aggregates() -> list[Column]:
    y, h = F.col("y_true"), F.col("yhat")
    return [
        F.count("*").alias("n"),
        F.avg(squared_error(y, h)).alias("mse"),
        F.sqrt(F.avg(squared_error(y, h))).alias("rmse"),
        F.avg(absolute_error(y, h)).alias("mae"),
        F.avg(qlike_loss(y, h)).alias("qlike"),
    ]


def leaderboard(board: DataFrame) -> DataFrame:
    """One row per asset and model with the point losses and a competition rank by QLIKE."""
    scored = aligned(board).groupBy("asset", "model").agg(*point_aggregates())
    return scored.withColumn("rank", F.rank().over(Window.partitionBy("asset").orderBy("qlike")))


def interval_aggregates() -> list[Column]:
    """Expects y_true, lo, hi and level_pct."""
    y, lo, hi = F.col("y_true"), F.col("lo"), F.col("hi")
    level = F.max("level_pct") / 100
    hit = F.avg(y.between(lo, hi).cast("double"))
    alpha = (100 - F.col("level_pct")) / 100
    return [
        F.count("*").alias("n"),
        hit.alias("picp"),
        F.avg(hi - lo).alias("mpiw"),
        F.avg(winkler(y, lo, hi, alpha)).alias("winkler"),
        (hit - level).alias("coverage_error"),
    ]


def interval_table(intervals: DataFrame, by=("asset", "method", "level_pct")) -> DataFrame:
    return aligned(intervals, "y_true", "lo", "hi").groupBy(*by).agg(*interval_aggregates())


def pinball_table(quantiles: DataFrame, by=("asset", "method", "tau")) -> DataFrame:
    """Mean pinball loss and empirical coverage per quantile level; expects y_true, q, tau."""
    y, q, tau = F.col("y_true"), F.col("q"), F.col("tau")
    return aligned(quantiles, "y_true", "q").groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(pinball(y, q, tau)).alias("pinball"),
        F.avg((y <= q).cast("double")).alias("empirical"),
    )


def quantile_crps(pinballs: DataFrame, by=("asset", "method")) -> DataFrame:
    """Twice the trapezoid of mean pinball loss over the quantile grid."""
    w = Window.partitionBy(*by).orderBy("tau")
    step = (F.lead("tau").over(w) - F.col("tau")) * (F.lead("pinball").over(w) + F.col("pinball")) / 2
    return pinballs.withColumn("_step", step).groupBy(*by).agg(
        (F.lit(2.0) * F.sum("_step")).alias("crps"), F.count("*").alias("n_levels")
    )
