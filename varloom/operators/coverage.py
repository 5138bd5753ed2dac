"""Coverage tests of interval forecasts: level, clustering, predictability, and differences between days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.math import all_finite, chi2_sf, chi2_sf_for, normal_two_sided
from varloom.operators.linear import explained_form, gram
from varloom.operators.significance import autocovariances, bartlett, cube_root_lag
from varloom.operators.timing import one_hot
from varloom.session import cut_lineage

KEY = ("asset", "method", "level_pct", "side")
DQ_LAGS = 4


def interval_hits(intervals: DataFrame, sides=("both", "upper")) -> DataFrame:
    """One 0/1 violation per side with its expected rate; incomplete rows never count as violations."""
    y, lo, hi = F.col("y_true"), F.col("lo"), F.col("hi")
    tail = (100 - F.col("level_pct")) / 100
    known = {
        "both": ((y < lo) | (y > hi), tail),
        "upper": (y > hi, tail / 2),
        "lower": (y < lo, tail / 2),
    }
    unknown = [s for s in sides if s not in known]
    if unknown:
        raise ValueError(f"unknown sides {unknown}; known: {sorted(known)}")
    rows = [F.struct(F.lit(s).alias("side"), known[s][0].cast("double").alias("hit"), known[s][1].alias("alpha")) for s in sides]
    ok = intervals.where(all_finite("y_true", "lo", "hi"))
    return ok.withColumn("h", F.explode(F.array(*rows))).select("asset", "date", "method", "level_pct", "lo", "hi", "h.*")


def _xlog(count: Column, p: Column) -> Column:
    """count * ln(p) with 0 * ln(0) = 0."""
    return F.when(count == 0, F.lit(0.0)).otherwise(count * F.ln(F.greatest(p, F.lit(1e-16))))


def hit_counts(hits: DataFrame, by=KEY) -> DataFrame:
    """n, violations and the four one-step transition counts, from one Window and one aggregate."""
    w = Window.partitionBy(*by).orderBy("date")
    rows = hits.withColumn("_p", F.lag("hit").over(w))
    cells = {f"n{i}{j}": F.count_if((F.col("_p") == i) & (F.col("hit") == j)) for i in (0, 1) for j in (0, 1)}
    return rows.groupBy(*by).agg(
        F.max("alpha").alias("alpha"), F.count("*").alias("n"), F.sum("hit").cast("long").alias("n_violations"),
        *[c.alias(k) for k, c in cells.items()],
    )


def likelihood_ratio_tests(counts: DataFrame, by=KEY) -> DataFrame:
    """Unconditional coverage, independence and joint conditional coverage on one row per key."""
    n, x, a = F.col("n"), F.col("n_violations"), F.col("alpha")
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    rate = x / n
    uc = F.greatest(-2.0 * (_xlog(x, a) + _xlog(n - x, 1 - a) - _xlog(x, rate) - _xlog(n - x, 1 - rate)), F.lit(0.0))
    degenerate = (n00 + n01 == 0) | (n10 + n11 == 0)
    pi = F.try_divide(n01 + n11, n00 + n01 + n10 + n11)
    pi01, pi11 = F.try_divide(n01, n00 + n01), F.try_divide(n11, n10 + n11)
    free = _xlog(n00, 1 - pi01) + _xlog(n01, pi01) + _xlog(n10, 1 - pi11) + _xlog(n11, pi11)
    tied = _xlog(n00 + n10, 1 - pi) + _xlog(n01 + n11, pi)
    ind = F.when(degenerate, F.lit(0.0)).otherwise(F.greatest(-2.0 * (tied - free), F.lit(0.0)))
    close = F.abs(rate - a) <= 1e-8 + 1e-5 * a
    direction = F.when(close, "exact").when(rate > a, "under-covers").otherwise("over-covers")
    out = counts.where(n >= 3).withColumns({
        "violation_rate": rate, "direction": direction, "lr_uc": uc, "lr_ind": ind, "degenerate": degenerate,
        "pi01": F.when(~degenerate, pi01), "pi11": F.when(~degenerate, pi11),
    })
    return out.withColumns({
        "lr_cc": F.col("lr_uc") + F.col("lr_ind"),
        "p_uc": chi2_sf(F.col("lr_uc"), 1),
        "p_ind": F.when(F.col("degenerate"), F.lit(1.0)).otherwise(chi2_sf(F.col("lr_ind"), 1)),
        "p_cc": chi2_sf(F.col("lr_uc") + F.col("lr_ind"), 2),
    })


def _design(hits: DataFrame, exog, by, lags: int) -> tuple[DataFrame, list[str], list[str]]:
    w = Window.partitionBy(*by).orderBy("date")
    rows = hits.withColumns({"_y": F.col("hit") - F.col("alpha"), "_one": F.lit(1.0)})
    rows = rows.withColumns({f"_l{k}": F.lag("_y", k).over(w) for k in range(1, lags + 1)})
    names = ["_one", *[f"_l{k}" for k in range(1, lags + 1)]]
    return rows.where(all_finite(*names[1:], *exog)), names, list(exog)


def dynamic_quantile(hits: DataFrame, exog=(), by=KEY, lags: int = DQ_LAGS) -> DataFrame:
    """Regression of the demeaned hit on a constant, its own lags and known-yesterday columns.

    With ``exog`` the restricted statistic on the same sample and the incremental one are returned too.
    The full and the restricted design share one aggregation: the restricted sums are a corner of the full ones.
    """
    rows, base, extra = _design(hits, exog, by, lags)
    names = [*base, *extra]
    k, k0 = len(names), len(base)
    m = gram(rows, names, "_y", [*by, "alpha"])
    scale = F.col("alpha") * (1 - F.col("alpha"))
    corner = [F.element_at("xx", sum(k - a for a in range(i)) + (j - i) + 1) for i in range(k0) for j in range(i, k0)]
    dead = F.exists(F.slice("spread", 2, k - 1), lambda s: s == 0)
    m = m.withColumns({
        "_full": F.when(~dead & (F.col("n") > k + 2), explained_form("xx", "xy")),
        "_corner": explained_form(F.array(*corner), F.slice("xy", 1, k0)),
    })
    m = m.withColumns({
        "dq_full": F.greatest(F.col("_full") / scale, F.lit(0.0)), "dq_restricted": F.greatest(F.col("_corner") / scale, F.lit(0.0)),
    }).withColumn("dq_full", F.when(F.col("_full").isNotNull(), F.col("dq_full")))
    out = m.withColumns({"p_full": chi2_sf(F.col("dq_full"), k), "p_restricted": chi2_sf(F.col("dq_restricted"), k0)})
    if extra:
        gain = F.when(F.col("dq_full").isNotNull(), F.greatest(F.col("dq_full") - F.col("dq_restricted"), F.lit(0.0)))
        out = out.withColumn("dq_incremental", gain).withColumn("p_incremental", chi2_sf(F.col("dq_incremental"), len(extra)))
    return out.withColumns({"df_full": F.lit(k), "df_incremental": F.lit(len(extra))}).drop("xx", "xy", "yy", "spread", "_full", "_corner")


def two_sample_difference(hits: DataFrame, flag: str, by=KEY) -> DataFrame:
    """Does the violation rate differ on flagged days? Pooled-variance z and a Bartlett HAC z.

    The slope's HAC variance needs only the autocovariances of residual * (flag - share), one series per key.
    """
    g = F.col("_g")
    known = hits.where(F.col(flag).isNotNull()).withColumn("_g", F.col(flag).cast("double"))
    whole = Window.partitionBy(*by)
    p1, p0 = F.avg(F.when(g == 1, F.col("hit"))).over(whole), F.avg(F.when(g == 0, F.col("hit"))).over(whole)
    rows = known.withColumns({"_p1": p1, "_p0": p0, "_share": F.avg(g).over(whole)})
    score = (F.col("hit") - F.when(g == 1, F.col("_p1")).otherwise(F.col("_p0"))) * (g - F.col("_share"))
    rows = rows.withColumn("_u", score)
    sums = rows.groupBy(*by).agg(
        F.sum("_g").cast("long").alias("n_flagged"), F.sum(1 - g).cast("long").alias("n_rest"),
        F.max("_p1").alias("rate_flagged"), F.max("_p0").alias("rate_rest"), F.avg("hit").alias("_pool"), F.max("_share").alias("_share"),
    )
    acov = autocovariances(rows.where(F.col("_u").isNotNull()), "_u", by, centred=False).select(*by, "n", "ss", "products")
    j = sums.join(acov, list(by)).where((F.col("n_flagged") >= 2) & (F.col("n_rest") >= 2)).withColumn("hac_lag", cube_root_lag(F.col("n")))
    n = F.col("n")
    lrv = F.col("ss") / n + bartlett(F.col("products"), F.col("hac_lag"), lambda k: n)
    spread = F.col("_share") * (1 - F.col("_share"))
    j = j.withColumns({
        "diff": F.col("rate_flagged") - F.col("rate_rest"),
        "se_iid": F.sqrt(F.greatest(F.col("_pool") * (1 - F.col("_pool")), F.lit(0.0)) * (1.0 / F.col("n_flagged") + 1.0 / F.col("n_rest"))),
        "se_hac": F.sqrt(F.greatest(lrv, F.lit(0.0)) / (spread * spread) / n),
    })
    z = {f"z_{t}": F.when(F.col(f"se_{t}") > 0, F.col("diff") / F.col(f"se_{t}")).otherwise(F.lit(0.0)) for t in ("iid", "hac")}
    j = j.withColumns(z)
    return j.withColumns({"p_iid": normal_two_sided(F.col("z_iid")), "p_hac": normal_two_sided(F.col("z_hac"))}).drop(
        "ss", "products", "_pool", "_share"
    )


def holm(df: DataFrame, p: str = "p_value", family=KEY, tie_break=(), name: str = "p_holm") -> DataFrame:
    """Step-down adjustment inside each family, plus the family size."""
    whole = Window.partitionBy(*family)
    ordered = whole.orderBy(p, *tie_break)
    n = F.count("*").over(whole)
    step = df.withColumn("_s", (n - F.row_number().over(ordered) + 1) * F.col(p)).withColumn("n_tests_in_family", n)
    running = F.max("_s").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn(name, F.least(running, F.lit(1.0))).drop("_s")


def suite(hits: DataFrame, by=KEY) -> DataFrame:
    """Four rows per key: unconditional, independence, joint, dynamic quantile."""
    lr = likelihood_ratio_tests(hit_counts(hits, by), by)
    common = [*by, "n", "n_violations", "violation_rate"]
    clustered = F.when(F.col("p_ind") < 0.05, "clustered").otherwise("unclustered")
    rows = F.array(
        F.struct(F.lit("LR_uc").alias("test"), F.col("lr_uc").alias("stat"), F.lit(1).alias("df"), F.col("p_uc").alias("p_value"), F.col("direction").alias("direction")),
        F.struct(F.lit("LR_ind").alias("test"), F.col("lr_ind").alias("stat"), F.lit(1).alias("df"), F.col("p_ind").alias("p_value"), clustered.alias("direction")),
        F.struct(F.lit("LR_cc").alias("test"), F.col("lr_cc").alias("stat"), F.lit(2).alias("df"), F.col("p_cc").alias("p_value"), F.lit("").alias("direction")),
    )
    three = lr.select(*common, F.explode(rows).alias("t")).select(*common, "t.*")
    dq = dynamic_quantile(hits, (), by).select(
        *by, F.lit("DQ").alias("test"), F.col("dq_full").alias("stat"), F.col("df_full").alias("df"), F.col("p_full").alias("p_value"), F.lit("").alias("direction"))
    return three.unionByName(lr.select(*common).join(dq, list(by)))


def with_conditioners(hits: DataFrame, lagged: DataFrame, states: int = 3) -> DataFrame:
    """Columns known the day before: state indicators, an ex-ante transition flag, and the interval's log width.

    ``lagged`` holds s1 and s2, the states one and two rows earlier on the full state history.
    """
    width = F.col("hi") - F.col("lo")
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    return hits.join(lagged.select("asset", "date", "s1", "s2"), ["asset", "date"], "left").withColumns(
        {f"state{k}": one_hot(F.col("s1"), k) for k in range(states)}
        | {"transition": F.when(both, (F.col("s1") != F.col("s2")).cast("double")), "log_width": F.ln(F.when(width > 0, width))}
    )


def conditional_table(conditioned: DataFrame, states: int = 3, by=KEY) -> DataFrame:
    """Incremental regressions and coverage differences for every conditioner, Holm-adjusted per family."""
    conditioned = cut_lineage(conditioned)  # read by four branches below
    families = {"regime": [f"state{k}" for k in range(1, states)], "transition": ["transition"], "width": ["log_width"]}
    out = None
    for name, cols in families.items():
        rows = dynamic_quantile(conditioned.where(all_finite(*cols)), cols, by).where(F.col("dq_incremental").isNotNull()).select(
            *by, F.lit("DQ incremental").alias("kind"), F.lit(name).alias("conditioner"), F.col("dq_incremental").alias("stat"),
            F.col("p_incremental").alias("p_value"), "n")
        out = rows if out is None else out.unionByName(rows)
    flags = [*[f"state{k}" for k in range(states)], "transition"]
    long = conditioned.unpivot([*by, "date", "hit"], flags, "conditioner", "flag")
    diffs = two_sample_difference(long, "flag", [*by, "conditioner"]).where((F.col("n_flagged") >= 5) & (F.col("n_rest") >= 5)).select(
        *by, F.lit("difference in coverage").alias("kind"), "conditioner", F.col("z_hac").alias("stat"), F.col("p_hac").alias("p_value"), "n")
    return holm(out.unionByName(diffs), family=by, tie_break=("kind", "conditioner"))
