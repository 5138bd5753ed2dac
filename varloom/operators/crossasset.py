"""Tables that put assets next to each other, and the master table of one study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.losses import qlike_loss
from varloom.operators.calibration import crps_table
from varloom.operators.scoring import aligned, interval_table, leaderboard
from varloom.operators.splicing import average_rank


def rank_agreement(board_scores: DataFrame, reference: str, min_models: int = 3) -> DataFrame:
    """Spearman and Kendall correlation of model ranks between every asset and the reference one.

    Works on one row per asset and model. Kendall counts concordant pairs from a self-join of models.
    """
    ranks = board_scores.select("asset", "model", "rank")
    ref = ranks.where(F.col("asset") == reference).select("model", F.col("rank").alias("ref"))
    both = ranks.where(F.col("asset") != reference).join(ref, "model")
    ranked = both.withColumns({"_a": average_rank("rank", ["asset"]), "_b": average_rank("ref", ["asset"])})
    rho = ranked.groupBy("asset").agg(F.count("*").alias("n_models"), F.corr("_a", "_b").alias("spearman"), F.array_join(F.array_sort(F.collect_list("model")), ", ").alias("models"))
    other = both.select("asset", F.col("model").alias("m2"), F.col("rank").alias("r2"), F.col("ref").alias("f2"))
    pairs = both.join(other, "asset").where(F.col("model") < F.col("m2"))
    s1, s2 = F.signum(F.col("rank") - F.col("r2")), F.signum(F.col("ref") - F.col("f2"))
    tau = pairs.groupBy("asset").agg(F.try_divide(F.sum(s1 * s2), F.sqrt(F.sum(s1 * s1) * F.sum(s2 * s2))).alias("kendall"))
    out = rho.join(tau, "asset", "left")
    enough = F.col("n_models") >= min_models
    return out.select("asset", F.lit(reference).alias("reference"), "n_models", F.when(enough, F.col("spearman")).alias("spearman"), F.when(enough, F.col("kendall")).alias("kendall"), "models")


def facts(rows: DataFrame, table: str, quantities, model: Column | None = None, state: Column | None = None) -> DataFrame:
    """A wide table of any study as (asset, table, model, state, quantity, value).

    The model is empty and the state -1 where the table has none.
    """
    keys = {"table": F.lit(table), "model": F.lit("") if model is None else model, "state": (F.lit(-1) if state is None else state).cast("int")}
    wide = rows.select("asset", *[c.alias(k) for k, c in keys.items()], *[F.col(q).cast("double").alias(q) for q in quantities])
    return wide.unpivot(["asset", *keys], list(quantities), "quantity", "value")


def collect_facts(board: DataFrame, scores: DataFrame, tests: dict[str, DataFrame], states: DataFrame, lagged: DataFrame) -> DataFrame:
    """Everything that is compared across assets in one long table; assets, models and states come from the data.

    Tables: metrics, ranks, tests (``tests``: quantity to a table with model_a, model_b and p_value), per_regime
    (by yesterday's state), regimes (days, mean variance and spread of returns by state) and sample.
    """
    pair = F.concat("model_a", F.lit(" - "), F.col("model_b"))
    scored = aligned(board).join(lagged.where(F.col("state").isNotNull()), ["asset", "date"]).groupBy("asset", "model", "state")
    per_regime = scored.agg(F.count("*").alias("n"), F.avg(qlike_loss(F.col("y_true"), F.col("yhat"))).alias("qlike"))
    regimes = states.groupBy("asset", "state").agg(F.count("*").alias("n"), F.avg("rv").alias("mean_rv"), F.stddev_pop("log_return").alias("sd_return"))
    sample = board.groupBy("asset").agg(F.countDistinct("date").alias("n_days"), F.unix_date(F.min("date")).alias("first_day"), F.unix_date(F.max("date")).alias("last_day"))
    parts = [
        facts(scores, "metrics", ("n", "mse", "mae", "qlike"), F.col("model")),
        facts(scores, "ranks", ("rank",), F.col("model")),
        *[facts(t.withColumnRenamed("p_value", q), "tests", (q,), pair) for q, t in tests.items()],
        facts(per_regime, "per_regime", ("n", "qlike"), F.col("model"), F.col("state")),
        facts(regimes, "regimes", ("n", "mean_rv", "sd_return"), state=F.col("state")),
        facts(sample, "sample", ("n_days", "first_day", "last_day")),
    ]
    return reduce(DataFrame.unionByName, parts)


def models_in_common(scores: DataFrame) -> DataFrame:
    """Models that every asset of the table has."""
    n_assets = scores.select(F.countDistinct("asset")).scalar()
    return scores.groupBy("model").agg(F.countDistinct("asset").alias("n_assets")).where(F.col("n_assets") == n_assets)


def master_table(board: DataFrame, laws: DataFrame, intervals: DataFrame, lagged: DataFrame, level_pct: int = 90, unranked=()) -> DataFrame:
    """Point, transitional-state, interval and distribution scores per model, ranked by QLIKE where eligible.

    ``board`` holds the point models; every law contributes its mean under its method name.
    """
    points = leaderboard(board).drop("rank", "rmse")
    loss = qlike_loss(F.col("y_true"), F.col("yhat"))
    trans = aligned(board).join(lagged, ["asset", "date"]).where(F.col("state") == 1).groupBy("asset", "model").agg(F.avg(loss).alias("qlike_transitional"), F.count("*").alias("n_transitional"))
    cover = interval_table(intervals.where(F.col("level_pct") == level_pct)).withColumnRenamed("method", "model").drop("level_pct", "n")
    crps = crps_table(laws).withColumnRenamed("method", "model").drop("n")
    out = points.join(trans, ["asset", "model"], "left").join(cover, ["asset", "model"], "left").join(crps, ["asset", "model"], "left")
    ranked = ~F.col("model").isin(*unranked) if unranked else F.lit(True)
    place = F.row_number().over(Window.partitionBy("asset", "ranked").orderBy("qlike", "model"))
    return out.withColumn("ranked", ranked).withColumn("rank_qlike", F.when(F.col("ranked"), place))
