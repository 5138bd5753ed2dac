"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: sources share the budget by weight; who would exceed its cap (epochs times its size) is clamped and
the excess is shared again by weight. With sources in ascending order of cap over weight, the clamped ones
are a prefix, so the repeated redistribution ends at one prefix sum over the sources, in whole numbers.

Repetitions: every document gets the whole part of target over size; the fractional part goes to documents
in seeded hash order until the remaining words are used, so a source misses its target by half a document at
most. The order is cut into hash buckets: sums per (source, bucket) give every bucket its place, and running
sums are needed inside a (source, bucket) only. A source with a third of all rows is spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets per source; rows per (source, bucket) are what one window group holds.
BUCKETS = 65_536


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """From (source, source_size): adds target, the words the mix takes of it. One row per source; null sorts last."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.row_number().over(rank) - 1) % len(weights) + 1)
    rows = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.sum("source_size").over(everything).alias("budget"),
        F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped_before"),
        F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    )
    clamped = F.col("weight") * (F.col("budget") - F.col("capped_before")) > F.col("cap") * F.col("weight_left")
    rows = rows.withColumn("clamped", clamped)
    left = F.col("budget") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything)
    share = F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(everything)
    open_target = (F.col("weight") * left).cast("double") / share
    return rows.select("source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(open_target).alias("target"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """All rows and columns of docs with size, source_size, target, reps (how often the mix takes the row) and taken.

    Null text has size 0; size-0 rows are taken as often as the whole part says and count no words. Null sources
    are one source. Rows with the same doc_id stand next to each other in the seeded order; reruns agree.
    Columns of docs with the names added here are replaced. An empty table gives no rows.
    """
    added = ("size", "source_size", "target", "reps", "taken")
    own = [c for c in docs.columns if c not in added]
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    # The columns travel under their places, so none meets a helper's name, and those not asked for needn't travel.
    rows = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(own)), F.col("doc_id").alias("id"), F.col("source").alias("of"), n_words().alias("size"), place.alias("place"))
    rows = rows.withColumn("bucket", (F.col("place") % BUCKETS).cast("int"))
    sums = rows.groupBy(F.col("of").alias("source"), "bucket").agg(F.sum("size").alias("in_bucket"))
    aims = targets(sums.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("earlier", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    same = aims["source"].eqNullSafe(sums["source"])
    plan = sums.join(aims, same).select(sums["source"], F.col("bucket").alias("plan_bucket"), "earlier", "source_size", "target", "whole", "rest")
    rows = rows.join(plan, F.col("of").eqNullSafe(F.col("source")) & (F.col("bucket") == F.col("plan_bucket")))
    inside = Window.partitionBy("of", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = (F.col("rest") > 0) & (2 * before + F.col("size") <= 2 * F.col("rest"))
    rows = rows.withColumn("reps", F.col("whole") + extra.cast("int")).withColumn("taken", F.col("reps") * F.col("size"))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)), *added)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as reps says."""
    rows = mixed.where("reps > 0").select(F.struct(*columns).alias("row"), F.explode(F.sequence(F.lit(1), F.col("reps"))))
    return rows.select(*(F.col("row")[c].alias(c) for c in columns))
