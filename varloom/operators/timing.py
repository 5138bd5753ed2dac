"""When a regime label is known: lagging on the label's own calendar, transitions, runs, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.realized import calendar_window

# Provenance labels of a shifted state and of a transition selector.
REGIME_TIMING = {0: "contemporaneous (ex-post description)", 1: "lagged t-1 (conditional / implementable)"}
SELECTOR_TIMING = {
    0: "ex-post 1{s_t != s_(t-1)} — uses the day-t return; DESCRIPTIVE ONLY",
    1: "ex-ante 1{s_(t-1) != s_(t-2)} — known at t-1; implementable",
}
LABELS = {2: ("calm", "crisis"), 3: ("calm", "transitional", "crisis"), 4: ("calm", "normal", "elevated", "crisis")}


def timing_label(shift: int) -> str:
    return REGIME_TIMING.get(shift, f"lagged t-{shift}")


def selector_label(k: int) -> str:
    return SELECTOR_TIMING.get(k, f"ex-ante 1{{s_(t-{k}) != s_(t-{k + 1})}} — known at t-{k}")


def state_label(state: Column, states: int = 3) -> Column:
    out = F.lit(None).cast("string")
    for k, name in enumerate(LABELS.get(states, [str(i) for i in range(states)])):
        out = F.when(state == k, F.lit(name)).otherwise(out)
    return out


def lag_states(states: DataFrame, shifts=(0, 1, 2)) -> DataFrame:
    """The state as known k rows earlier, for several k, from one Window over the full history."""
    w = calendar_window()
    return states.select("asset", "date", *[(F.lag("state", k).over(w) if k else F.col("state")).alias(f"s{k}") for k in shifts])


def align_labels(evaluation: DataFrame, states: DataFrame, shift: int = 1, name: str = "state") -> DataFrame:
    """Lag on the state series' own index first, then join to the evaluated rows."""
    if shift < 0:
        raise ValueError("shift must not be negative")
    lagged = lag_states(states, (shift,)).withColumnRenamed(f"s{shift}", name)
    return evaluation.join(lagged, ["asset", "date"], "left")


def label_reach(evaluation: DataFrame, states: DataFrame, shift: int = 1) -> DataFrame:
    """Does the state history start early enough before the first evaluated day of every asset?"""
    first = evaluation.groupBy("asset").agg(F.min("date").alias("_first"))
    before = states.join(first, "asset").groupBy("asset").agg(F.count_if(F.col("date") < F.col("_first")).alias("n_before"))
    short = F.greatest(F.lit(shift) - F.col("n_before"), F.lit(0))
    return before.select("asset", "n_before", short.alias("n_short"), (short == 0).alias("ok"))


def transitions(evaluation: DataFrame, states: DataFrame, selector: int = 1) -> DataFrame:
    """Adds ``is_transition`` and ``scored``: did the state change between t-k-1 and t-k?"""
    lagged = lag_states(states, (selector, selector + 1))
    a, b = F.col(f"s{selector}"), F.col(f"s{selector + 1}")
    known = a.isNotNull() & b.isNotNull()
    return (
        evaluation.join(lagged, ["asset", "date"], "left")
        .withColumn("scored", known)
        .withColumn("is_transition", F.coalesce((a != b) & known, F.lit(False)))
        .drop(f"s{selector}", f"s{selector + 1}")
    )


def transition_summary(evaluation: DataFrame, states: DataFrame, selector: int = 1) -> DataFrame:
    marked = transitions(evaluation.select("asset", "date").distinct(), states, selector)
    return marked.groupBy("asset").agg(
        F.count_if("scored").alias("n"), F.count_if("is_transition").alias("n_transition")
    ).select(
        "asset", "n", "n_transition", F.try_divide(F.col("n_transition"), F.col("n")).alias("share"),
        F.lit(selector).alias("selector_shift"), F.lit(selector_label(selector)).alias("selector"), F.lit(selector >= 1).alias("implementable"),
    )


def one_hot(state: Column, k: int) -> Column:
    """Indicator of state k that stays null where the state is unknown."""
    return F.when(state.isNotNull(), (state == k).cast("double"))


def run_table(states: DataFrame, by=("asset",)) -> DataFrame:
    """Gaps and islands: one row per unbroken run of a state."""
    w = Window.partitionBy(*by).orderBy("date")
    changed = F.when(F.col("state").eqNullSafe(F.lag("state").over(w)), 0).otherwise(1)
    islands = states.withColumn("_c", changed).withColumn("_i", F.sum("_c").over(w))
    return islands.groupBy(*by, "_i", "state").agg(
        F.count("*").alias("length"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    ).drop("_i")
