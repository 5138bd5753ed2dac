"""Model confidence set by stationary bootstrap and the range statistic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.losses import loss_by_name
from varloom.functions.math import all_finite
from varloom.operators.forecasters import hash_uniform
from varloom.session import cut_lineage


def loss_matrix(board: DataFrame, models, loss: str = "qlike") -> DataFrame:
    """(asset, date, losses array in the order of ``models``); days missing any model go."""
    value = loss_by_name(loss)(F.col("y_true"), F.col("yhat"))
    day = board.where(all_finite("y_true", "yhat")).groupBy("asset", "date").agg(
        F.array(*[F.max(F.when(F.col("model") == m, value)) for m in models]).alias("losses"))
    return day.where(~F.exists("losses", lambda v: v.isNull()))


def bootstrap_means(matrix: DataFrame, models, reps: int, block: int, seed: int) -> DataFrame:
    """(asset, rep, means): block restarts come from hashes, so every replicate is the same on any cluster.

    Only restarts leave the map side, a row per block instead of one per day and replicate. A block is a
    circular stretch of days, so its losses are differences of running sums at its bounds.
    """
    w = Window.partitionBy("asset").orderBy("date")
    sums = F.array(*[F.sum(F.col("losses")[k]).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in range(len(models))])
    indexed = matrix.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy("asset")), "upto": sums})
    key = [F.lit(seed), F.col("asset"), F.col("rep"), F.col("i")]
    days = indexed.select("asset", "i", "n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    restarts = days.where((F.col("i") == 0) | (hash_uniform(*key, F.lit("r")) < 1.0 / block))
    restarts = restarts.withColumn("s", F.floor(hash_uniform(*key, F.lit("s")) * F.col("n")))
    length = F.lead("i").over(Window.partitionBy("asset", "rep").orderBy("i"))
    blocks = restarts.withColumn("e", F.col("s") + F.coalesce(length, F.col("n")) - F.col("i"))
    bounds = F.array(
        F.struct(F.least("e", "n").alias("to"), F.lit(1.0).alias("sign")), F.struct(F.col("s").alias("to"), F.lit(-1.0).alias("sign")),
        F.struct((F.col("e") - F.col("n")).alias("to"), F.lit(1.0).alias("sign")))
    ends = blocks.select("asset", "rep", F.explode(bounds).alias("x")).select("asset", "rep", "x.*").where(F.col("to") > 0)
    joined = ends.join(indexed.select("asset", "n", (F.col("i") + 1).alias("to"), "upto"), ["asset", "to"])
    return joined.groupBy("asset", "rep").agg(F.array(*[F.sum(F.col("sign") * F.col("upto")[k]) / F.first("n") for k in range(len(models))]).alias("means"))


def model_confidence_set(board: DataFrame, models, loss: str = "qlike", alpha: float = 0.1, reps: int = 2000, block: int = 10, seed: int = 17) -> DataFrame:
    """Survivors per asset with average losses and elimination p-values.

    One elimination round per model, each a pair of grouped aggregates over the bootstrap table; lineage is
    cut once after the bootstrap because every round reads it.
    """
    models = sorted(models)
    if len(models) < 2:
        raise ValueError("at least two models are needed")
    matrix = loss_matrix(board, models, loss)
    full = matrix.groupBy("asset").agg(F.array(*[F.avg(F.col("losses")[k]) for k in range(len(models))]).alias("full"))
    boot = bootstrap_means(matrix, models, reps, block, seed).join(full, "asset")
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(len(models)) for b in range(a + 1, len(models))])
    long = boot.select("asset", "rep", "full", "means", F.explode(pairs).alias("p")).select(
        "asset", "rep", "p.a", "p.b", (F.get("full", F.col("p.a")) - F.get("full", F.col("p.b"))).alias("d"),
        (F.get("means", F.col("p.a")) - F.get("means", F.col("p.b"))).alias("ds"))
    sd = F.sqrt(F.avg((F.col("ds") - F.col("d")) * (F.col("ds") - F.col("d"))).over(Window.partitionBy("asset", "a", "b")))
    scaled = cut_lineage(long.withColumn("sd", sd).select(
        "asset", "rep", "a", "b", F.try_divide(F.col("d"), F.col("sd")).alias("t"), F.abs(F.try_divide(F.col("ds") - F.col("d"), F.col("sd"))).alias("z")))
    alive = full.select("asset", F.sequence(F.lit(0), F.lit(len(models) - 1)).alias("alive"), F.array().cast("array<struct<m:int,p:double>>").alias("out"))
    for _ in range(len(models) - 1):
        live = scaled.join(alive.select("asset", "alive"), "asset").where(F.array_contains("alive", F.col("a")) & F.array_contains("alive", F.col("b")))
        pair = live.groupBy("asset", "a", "b").agg(F.first("t").alias("t"))
        sides = pair.select("asset", F.explode(F.array(F.struct(F.col("a").alias("m"), F.col("t").alias("t")), F.struct(F.col("b").alias("m"), (-F.col("t")).alias("t")))).alias("s"))
        worst = sides.groupBy("asset").agg(F.max_by("s.m", F.struct("s.t", "s.m")).alias("worst"), F.max("s.t").alias("top"))
        ranges = live.groupBy("asset", "rep").agg(F.max("z").alias("z"))
        p = ranges.join(worst, "asset").groupBy("asset").agg(F.first("worst").alias("worst"), F.avg((F.col("z") > F.col("top")).cast("double")).alias("p"))
        alive = cut_lineage(alive.join(p, "asset").select(
            "asset", F.array_remove("alive", F.col("worst")).alias("alive"), F.array_append("out", F.struct(F.col("worst").alias("m"), F.col("p").alias("p"))).alias("out")))
    rows = alive.join(full, "asset").select("asset", "full", F.posexplode(F.concat("out", F.transform("alive", lambda m: F.struct(m.alias("m"), F.lit(1.0).alias("p"))))).alias("step", "o"))
    monotone = F.max("o.p").over(Window.partitionBy("asset").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    named = F.element_at(F.array(*[F.lit(m) for m in models]), F.col("o.m") + 1)
    out = rows.select("asset", named.alias("model"), F.get("full", F.col("o.m")).alias("avg_loss"), monotone.alias("p_value"))
    return out.withColumns({"in_set": F.col("p_value") > alpha, "rank": F.row_number().over(Window.partitionBy("asset").orderBy("avg_loss", "model"))})
