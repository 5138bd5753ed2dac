"""Verdict columns over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Material coverage gap, material spread of width scales, significance level.
MATERIAL_GAP, MATERIAL_SPREAD, LEVEL = 0.02, 0.15, 0.05


def coverage_shape(per_regime: DataFrame, by=("asset", "method", "level_pct")) -> DataFrame:
    """Ordering of coverage over states, whether it degrades materially, and the gap between the ends.

    ``per_regime`` has one row per key and state with n and picp.
    """
    w = Window.partitionBy(*by).orderBy("state")
    rows = per_regime.withColumn("_next", F.lead("picp").over(w))
    flat = F.coalesce(F.col("_next"), F.col("picp"))
    agg = rows.groupBy(*by).agg(
        F.bool_and(F.col("picp") >= flat).alias("_down"), F.bool_and(F.col("picp") <= flat).alias("_up"), F.bool_or(F.col("picp").isNull()).alias("_hole"),
        F.min_by(F.struct("n", "picp"), "state").alias("a"), F.max_by(F.struct("n", "picp"), "state").alias("z"))
    se2 = lambda s: F.greatest(F.col(f"{s}.picp") * (1 - F.col(f"{s}.picp")), F.lit(0.0)) / F.col(f"{s}.n")
    gap = F.col("a.picp") - F.col("z.picp")
    se = F.when((F.col("a.n") > 0) & (F.col("z.n") > 0), F.sqrt(se2("a") + se2("z")))
    shape = F.when(F.col("_hole"), "undetermined").when(F.col("_down"), "monotone decreasing").when(F.col("_up"), "monotone increasing").otherwise("non-monotone")
    noise = F.when(gap.isNull() | se.isNull() | (se <= 0), "not assessable").when(F.abs(gap) < 2 * se, "well inside sampling noise").otherwise("larger than sampling noise")
    return agg.select(*by, shape.alias("shape"), F.coalesce(F.col("_down") & ~F.col("_hole") & (gap >= MATERIAL_GAP), F.lit(False)).alias("degrades"),
                      gap.alias("gap"), se.alias("gap_se"), noise.alias("endpoint_gap"))


def width_correction(scales: DataFrame, evidence: DataFrame, by=("asset", "method")) -> DataFrame:
    """Global or per-state width correction, from the spread of state scales and the coverage tests.

    ``evidence`` has one row per key with a boolean ``conditional_evidence``.
    """
    per = scales.groupBy(*by).agg(F.min(F.when(F.col("scope") != "all", F.col("scale_coverage"))).alias("_lo"), F.max(F.when(F.col("scope") != "all", F.col("scale_coverage"))).alias("_hi"))
    j = per.join(evidence, list(by), "left").withColumn("conditional_evidence", F.coalesce("conditional_evidence", F.lit(False))).withColumn("spread", F.col("_hi") - F.col("_lo"))
    material, ev = F.coalesce(F.col("spread") > MATERIAL_SPREAD, F.lit(False)), F.col("conditional_evidence")
    verdict = F.when(F.col("spread").isNull(), "global").when(material & ev, "per-regime").when(material, "global, per-regime indicative").when(ev, "global, shape problem noted").otherwise("global")
    return j.select(*by, "spread", material.alias("material"), "conditional_evidence", verdict.alias("recommendation"))


def pooled_view(conditional: DataFrame, level: float = LEVEL, by=("asset", "method", "level_pct")) -> DataFrame:
    """Do pooled or upper-tail coverage differences survive the family adjustment more often?"""
    rows = conditional.where(F.col("kind") == "difference in coverage")
    hit = F.col("p_holm") < level
    c = rows.groupBy(*by).agg(
        F.count_if((F.col("side") == "both") & hit).alias("n_pooled_significant"), F.count_if(F.col("side") == "both").alias("n_pooled"),
        F.count_if((F.col("side") == "upper") & hit).alias("n_upper_significant"), F.count_if(F.col("side") == "upper").alias("n_upper"))
    po, up = F.col("n_pooled_significant"), F.col("n_upper_significant")
    return c.withColumn("verdict", F.when(up > po, "pooled understates").when(po > up, "pooled is sharper").when(up > 0, "views agree").otherwise("no structure either way"))


def transfer(facts: DataFrame, reference: str, level: float = LEVEL) -> DataFrame:
    """Does the reference asset's finding hold elsewhere: direction, pooled test, conditional test?

    ``facts`` is one row per asset with qlike_model, qlike_benchmark, dm_p, gw_p. The reference is one row, reached by its key.
    """
    names = ("qlike_model", "qlike_benchmark", "dm_p", "gw_p")
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n)
    flags = facts.select("asset", ok.alias("ok"), (F.col("qlike_model") < F.col("qlike_benchmark")).alias("ahead"), (F.col("dm_p") < level).alias("dm"), (F.col("gw_p") < level).alias("gw"))
    ref = flags.where(F.col("asset") == reference).select(F.col("asset").alias("reference_asset"), F.col("ok").alias("r_ok"), F.col("ahead").alias("r_ahead"), F.col("dm").alias("r_dm"), F.col("gw").alias("r_gw"))
    j = flags.where(F.col("asset") != reference).withColumn("reference_asset", F.lit(reference)).join(ref, "reference_asset", "left")
    known = F.coalesce(F.col("ok") & F.col("r_ok"), F.lit(False))
    sign, dm, gw = (F.col(c) == F.col(f"r_{c}") for c in ("ahead", "dm", "gw"))
    verdict = F.when(~known, "indeterminate").when(sign & dm & gw, "replicates").when(sign & gw, "replicates conditionally").when(sign, "direction only").otherwise("does not replicate")
    shown = lambda c: F.when(known, c)
    return j.select("asset", "reference_asset", verdict.alias("verdict"), shown(sign).alias("sign_agrees"), shown(dm).alias("pooled_agrees"), shown(gw).alias("conditional_agrees"))
