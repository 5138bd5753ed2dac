"""Overlap diagnostics between two variance sources, the gate on them, and the gated splice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.math import all_finite

# The overlap gate.
MIN_OVERLAP, MIN_PEARSON, RATIO_TOLERANCE = 60, 0.9, 0.15


def average_rank(value: str, by) -> Column:
    """Rank where ties share their mean position."""
    ranked = Window.partitionBy(*by).orderBy(value)
    tied = Window.partitionBy(*by, value)
    return F.rank().over(ranked) + (F.count("*").over(tied) - 1) / 2


def overlap(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Agreement of two (asset, date, rv) sources on their common positive days."""
    both = (
        ours.select("asset", "date", F.col("rv").alias("a"))
        .join(theirs.select("asset", "date", F.col("rv").alias("b")), ["asset", "date"])
        .where(all_finite("a", "b") & (F.col("a") > 0) & (F.col("b") > 0))
    )
    ranked = both.withColumn("ra", average_rank("a", ["asset"])).withColumn("rb", average_rank("b", ["asset"]))
    ratio = F.col("a") / F.col("b")
    return ranked.groupBy("asset").agg(
        F.count("*").alias("n"),
        F.corr("a", "b").alias("pearson"),
        F.corr("ra", "rb").alias("spearman"),
        F.percentile(ratio, 0.5).alias("median_ratio"),
        F.avg(F.abs(F.ln(ratio))).alias("mean_abs_log_ratio"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def gate(report: DataFrame, min_n: int = MIN_OVERLAP, min_pearson: float = MIN_PEARSON, tolerance: float = RATIO_TOLERANCE) -> DataFrame:
    ok = (F.col("n") >= min_n) & (F.col("pearson") >= min_pearson) & (F.abs(F.col("median_ratio") - 1) <= tolerance)
    return report.withColumn("passes", F.coalesce(ok, F.lit(False)))


def splice(head: DataFrame, tail: DataFrame, cutoff: str, report: DataFrame, level_adjust: bool = True, force: bool = False,
           thresholds: tuple[int, float, float] = (MIN_OVERLAP, MIN_PEARSON, RATIO_TOLERANCE)) -> DataFrame:
    """Head up to the cutoff, then the tail brought to the head's level; only assets that pass the gate.

    ``force`` splices every asset of the report, whatever the gate of ``thresholds`` says.
    The two date ranges are disjoint and each source has one row per day, so no duplicate can arise.
    """
    day = F.lit(cutoff).cast("date")
    gated = report if force else gate(report, *thresholds).where("passes")
    level = gated.select("asset", F.col("median_ratio").alias("_level"))
    first = head.where(F.col("date") <= day).join(level, "asset").select("asset", "date", "rv", F.lit("head").alias("part"))
    scale = F.when(F.lit(level_adjust) & F.col("_level").isNotNull(), F.col("_level")).otherwise(F.lit(1.0))
    second = tail.where(F.col("date") > day).join(level, "asset").select(
        "asset", "date", (F.col("rv") / scale).alias("rv"), F.lit("tail").alias("part")
    )
    return first.unionByName(second)
