"""The standing study over the given tables: frame, folds, baseline board, laws, intervals, rule states."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.functions.laws import lognormal_interval
from varloom.operators.features import ohlc_frame
from varloom.operators.realized import day_summary
from varloom.operators.walkforward import BASELINES, SplitPlan, assign_folds, har_fits, to_board
from varloom.session import cut_lineage
from varloom.sources.tables import TRADE_ORDER, daily_ohlc, trades

PLAN = SplitPlan()
LEVELS = (50, 80, 90, 95)


class Study:
    """One study over one folder whose frame and fits are written once and read by every branch of a query.

    The frame holds a row per asset and trading day, so what is written is small next to the raw rows, and a
    query with several branches neither repeats the raw scan nor replans it. Stands in for the folder name in
    every function below.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.path = spark, str(sf_dir)

    def __str__(self) -> str:
        return self.path

    @cached_property
    def frame(self) -> DataFrame:
        return cut_lineage(frame(self.spark, self.path))

    @cached_property
    def fits(self) -> DataFrame:
        return cut_lineage(har_fits(assign_folds(self.frame, PLAN)))


def ohlc(spark: SparkSession, sf_dir) -> DataFrame:
    return daily_ohlc(trades(spark, sf_dir))


def days(spark: SparkSession, sf_dir) -> DataFrame:
    """Prices and realised variance of every day from one scan, written once for the branches that read it."""
    return cut_lineage(day_summary(trades(spark, sf_dir), TRADE_ORDER))


def frame(spark: SparkSession, sf_dir) -> DataFrame:
    return sf_dir.frame if isinstance(sf_dir, Study) else ohlc_frame(ohlc(spark, sf_dir))


def folded(spark: SparkSession, sf_dir, plan: SplitPlan = PLAN) -> DataFrame:
    return assign_folds(frame(spark, sf_dir), plan)


def fits(spark: SparkSession, sf_dir) -> DataFrame:
    return sf_dir.fits if isinstance(sf_dir, Study) else har_fits(folded(spark, sf_dir))


def board(spark: SparkSession, sf_dir) -> DataFrame:
    return to_board(fits(spark, sf_dir), BASELINES)


def law(spark: SparkSession, sf_dir) -> DataFrame:
    """Two log-normal predictive laws: the log regression, and a random walk in logs."""
    wide = fits(spark, sf_dir).select(
        "asset", "date", F.col("rv").alias("y_true"),
        F.explode(
            F.array(
                F.struct(F.lit("log-regression").alias("method"), F.col("log_lin").alias("mu"), F.sqrt("log_s2").alias("sigma")),
                F.struct(F.lit("log-walk").alias("method"), F.ln("rv_d").alias("mu"), F.col("sd_step").alias("sigma")),
            )
        ).alias("l"),
    )
    return wide.select("asset", "date", "y_true", "l.method", "l.mu", "l.sigma")


def intervals_from_law(laws: DataFrame, levels=LEVELS) -> DataFrame:
    parts = []
    for level in levels:
        lo, hi = lognormal_interval(F.col("mu"), F.col("sigma"), level)
        parts.append(F.struct(F.lit(level).alias("level_pct"), lo.alias("lo"), hi.alias("hi")))
    return laws.withColumn("i", F.explode(F.array(*parts))).select(
        "asset", "date", "method", "y_true", "i.level_pct", "i.lo", "i.hi"
    )


def intervals(spark: SparkSession, sf_dir) -> DataFrame:
    return intervals_from_law(law(spark, sf_dir))


def rule_states(panel: DataFrame, train_end: str = PLAN.train_end, states: int = 3) -> DataFrame:
    """Volatility state by quantiles of the training rows, on the full history of every asset."""
    cuts = [k / states for k in range(1, states)]
    seen = F.when(F.col("date") <= F.lit(train_end).cast("date"), F.col("rv"))
    whole = Window.partitionBy("asset")
    with_cuts = panel.withColumn("_q", F.percentile(seen, F.array(*[F.lit(c) for c in cuts])).over(whole))
    state = sum((F.col("rv") > F.element_at("_q", k + 1)).cast("int") for k in range(len(cuts)))
    return with_cuts.withColumn("state", state).select("asset", "date", "state", "rv", "log_return")


def states(spark: SparkSession, sf_dir) -> DataFrame:
    return rule_states(frame(spark, sf_dir))
