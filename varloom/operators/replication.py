"""Replicated scores: spread over seeds, stability of the ordering, pairwise wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.losses import qlike_loss
from varloom.operators.scoring import aligned


def replicate_scores(board: DataFrame, by=("asset", "seed", "model")) -> DataFrame:
    return aligned(board).groupBy(*by).agg(F.avg(qlike_loss(F.col("y_true"), F.col("yhat"))).alias("qlike"))


def summarise(scores: DataFrame, published_seed: int | None = None) -> DataFrame:
    """Mean, sample spread, extremes, and the mean's distance from the published replicate."""
    q = F.col("qlike")
    published = F.max(F.when(F.col("seed") == F.lit(published_seed), q)) if published_seed is not None else F.lit(None).cast("double")
    return scores.groupBy("asset", "model").agg(
        F.count("*").alias("n"), F.avg(q).alias("mean"), F.stddev_samp(q).alias("sd"), F.min(q).alias("min"), F.max(q).alias("max"),
        (F.max(q) - F.min(q)).alias("range"), (F.avg(q) - published).alias("deviation"))


def rank_stability(scores: DataFrame) -> DataFrame:
    """How many seeds produce each ordering of the models; a seed holds one row per model."""
    ordered = F.array_sort(F.collect_list(F.struct("qlike", "model")))
    per_seed = scores.groupBy("asset", "seed").agg(F.array_join(F.transform(ordered, lambda s: s["model"]), " < ").alias("ordering"))
    return per_seed.groupBy("asset", "ordering").agg(F.count("*").alias("n_seeds"))


def pairwise_wins(scores: DataFrame) -> DataFrame:
    a = scores.select("asset", "seed", F.col("model").alias("model_a"), F.col("qlike").alias("_qa"))
    b = scores.select("asset", "seed", F.col("model").alias("model_b"), F.col("qlike").alias("_qb"))
    joined = a.join(b, ["asset", "seed"]).where(F.col("model_a") < F.col("model_b"))
    return joined.groupBy("asset", "model_a", "model_b").agg(F.count("*").alias("n"), F.count_if(F.col("_qa") < F.col("_qb")).alias("a_wins"))


def shared_protocol(runs: DataFrame, columns, by=("asset",)) -> DataFrame:
    """Per asset: do all its runs share the same protocol columns?"""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.countDistinct(F.struct(*columns)).alias("n_protocols")).withColumn("shared", F.col("n_protocols") == 1)
