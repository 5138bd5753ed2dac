"""Equal and conditional predictive ability: pairs, autocovariances, Diebold-Mariano, Giacomini-White."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.losses import loss_by_name
from varloom.functions.math import all_finite, chi2_sf, chi2_sf_for, is_finite, student_two_sided

PAIR = ("asset", "model_a", "model_b")
VARIANCE_FLOOR = 1e-24


def pair_losses(board: DataFrame, pairs, loss: str = "qlike") -> DataFrame:
    """Losses of both models of each pair and their difference, per asset and date.

    One hash aggregate lines the models of a day up, then each day emits one row per requested pair.
    """
    value = loss_by_name(loss)(F.col("y_true"), F.col("yhat"))
    models = sorted({m for p in pairs for m in p})
    name = {m: f"_l{i}" for i, m in enumerate(models)}
    day = board.where(F.col("model").isin(models) & all_finite("y_true", "yhat")).groupBy("asset", "date").agg(
        *[F.max(F.when(F.col("model") == m, value)).alias(name[m]) for m in models]
    )
    rows = [
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(name[a]).alias("loss_a"), F.col(name[b]).alias("loss_b"))
        for a, b in pairs
    ]
    out = day.select("asset", "date", F.explode(F.array(*rows)).alias("p")).select("asset", "date", "p.*")
    return out.withColumn("d", F.col("loss_a") - F.col("loss_b")).where(is_finite(F.col("d")))


def all_pairs(models) -> list[tuple[str, str]]:
    models = sorted(models)
    return [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]


def autocovariances(series: DataFrame, col: str, by, lags: int = 0, centred: bool = True) -> DataFrame:
    """Per key: n, mean, sum of squares, and the array of lag-k product sums.

    Each key has the lags up to the whole cube root of its own n, or up to ``lags`` where that is more, and never
    more than n - 1. One aggregate gathers a key's values (a row per trading day) in date order; the products
    are array folds, so nothing bounds the length of a series and short series pay for their own lags only.
    """
    rows = series.groupBy(*by).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.array_sort(F.collect_list(F.struct("date", F.col(col).alias("v")))).alias("_v"))
    dev = F.transform("_v", lambda x: x["v"] - F.col("mean") if centred else x["v"])
    rows = rows.withColumn("_dev", dev)
    last = F.least(F.greatest(cube_root_lag(F.col("n")), F.lit(lags)), F.size("_dev") - 1)

    def product(k: Column) -> Column:
        """Sum over t of dev(t) dev(t - k); pairs with a missing value count as zero."""
        early, late = F.slice("_dev", 1, F.size("_dev") - k), F.slice("_dev", k + 1, F.size("_dev") - k)
        return F.aggregate(F.zip_with(late, early, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda acc, v: acc + v)

    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return rows.select(
        *by, "n", "mean",
        F.aggregate("_dev", F.lit(0.0), lambda acc, v: acc + F.coalesce(v * v, F.lit(0.0))).alias("ss"),
        F.transform(steps, product).alias("products"),
    )


def cube_root_lag(n: Column) -> Column:
    """Whole cube root of n, exact at perfect cubes."""
    root = F.floor(F.pow(n.cast("double"), F.lit(1 / 3)) + F.lit(1e-9))
    return root.cast("int")


def bartlett(products: Column, lag: Column, divisor) -> Column:
    """Sum over k of twice the Bartlett weight times the k-th product over its divisor."""
    steps = F.when(lag >= 1, F.sequence(F.lit(1), lag)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps, F.lit(0.0),
        lambda acc, k: acc + 2.0 * (1.0 - k / (lag + 1)) * F.coalesce(F.get(products, k - 1), F.lit(0.0)) / divisor(k),
    )


def dm_from_autocovariances(acov: DataFrame, lag: Column | None = None, horizon: int = 1, corrected: bool = True) -> DataFrame:
    """Diebold-Mariano from autocovariances; lag-k products are divided by n - k."""
    n = F.col("n")
    lag = F.greatest(cube_root_lag(n), F.lit(horizon - 1)) if lag is None else lag
    gamma0 = F.col("ss") / n
    lrv = F.greatest(gamma0 + bartlett(F.col("products"), F.col("hac_lag"), lambda k: n - k), F.lit(VARIANCE_FLOOR))
    raw = F.col("mean") / F.sqrt(F.col("_lrv") / n)
    h = horizon
    factor = F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(1e-12))) if corrected else F.lit(1.0)
    return (
        acov.where(n >= 3).withColumn("hac_lag", lag.cast("int"))
        .withColumn("_lrv", lrv)
        .withColumns({"dm_raw": raw, "lrv_over_gamma0": F.col("_lrv") / F.greatest(gamma0, F.lit(1e-300))})
        .withColumn("dm_stat", F.col("dm_raw") * factor)
        .withColumn("p_value", student_two_sided(F.col("dm_stat"), n - 1))
        .drop("_lrv")
    )


def diebold_mariano(differences: DataFrame, by=PAIR, horizon: int = 1) -> DataFrame:
    out = dm_from_autocovariances(autocovariances(differences, "d", by, horizon - 1), horizon=horizon)
    better = F.when(F.col("dm_stat") < 0, F.col("model_a")).otherwise(F.col("model_b"))
    return out.select(*by, "dm_stat", "dm_raw", "p_value", F.col("mean").alias("mean_loss_diff"), "n", "hac_lag", "lrv_over_gamma0", better.alias("better"))


def lag_sensitivity(acov: DataFrame, lags=(0, 1, 2, 5, 10, 15, 20, 30), by=PAIR) -> DataFrame:
    """The same statistic over a grid of truncation lags plus the automatic one, which is flagged."""
    default = cube_root_lag(F.col("n"))
    grid = F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(x) for x in lags]), F.array(default))))
    rows = acov.withColumn("_lag", F.explode(grid)).where(F.col("_lag") < F.col("n"))
    out = dm_from_autocovariances(rows, F.col("_lag"))
    return out.select(*by, "hac_lag", "dm_stat", "p_value", "lrv_over_gamma0", (F.col("hac_lag") == default).alias("is_default"), "n")


def sample_acf(acov: DataFrame, max_lag: int = 20, by=PAIR) -> DataFrame:
    """Autocorrelations with the white-noise band and Bartlett's band."""
    rows = acov.select(*by, "n", "ss", F.posexplode(F.slice("products", 1, max_lag)).alias("i", "c")).where(F.col("i") + 1 < F.col("n"))
    r = F.when(F.col("ss") > 0, F.col("c") / F.col("ss")).otherwise(F.lit(0.0))
    before = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("lag", F.col("i") + 1).withColumn("acf", r)
    shorter = F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(before), F.lit(0.0))
    return (
        out.withColumns({"se_white": 1.0 / F.sqrt("n"), "se_bartlett": F.sqrt((1.0 + 2.0 * shorter) / F.col("n"))})
        .withColumns({
            "significant_white": F.abs("acf") > 1.96 * F.col("se_white"),
            "significant_bartlett": F.abs("acf") > 1.96 * F.col("se_bartlett"),
        })
        .drop("i", "c", "ss")
    )


def ljung_box(acov: DataFrame, lags=(5, 10, 20), by=PAIR) -> DataFrame:
    n = F.col("n")
    terms = sample_acf(acov, max(lags), by).withColumn("_t", F.col("acf") * F.col("acf") / (n - F.col("lag")))
    run = Window.partitionBy(*by).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = terms.withColumn("lb_stat", n * (n + 2.0) * F.sum("_t").over(run)).where(F.col("lag").isin(*lags))
    return q.select(*by, "lag", "lb_stat", chi2_sf_for(F.col("lb_stat"), F.col("lag"), lags).alias("p_value"), "n")


def dm_diagnostics(acov: DataFrame, by=PAIR, level: float = 0.05) -> DataFrame:
    """One line per pair: strongest autocorrelation, bands broken, and whether the verdict depends on the lag."""
    acf = sample_acf(acov, 20, by).groupBy(*by).agg(
        F.max(F.abs("acf")).alias("max_abs_acf"),
        F.count_if("significant_white").alias("n_significant_white"),
        F.count_if("significant_bartlett").alias("n_significant_bartlett"),
    )
    sens = lag_sensitivity(acov, by=by).groupBy(*by).agg(
        F.min("p_value").alias("p_min"), F.max("p_value").alias("p_max"),
        (F.bool_and(F.col("p_value") < level) | F.bool_and(F.col("p_value") >= level)).alias("stable"),
    )
    return acf.join(sens, list(by))


def hac_matrix(series: DataFrame, cols, by, lag: int, divisor: str = "n", centred: bool = True) -> DataFrame:
    """Bartlett long-run covariance of several columns as long rows (key, i, j, omega)."""
    if divisor not in ("n", "n-k"):
        raise ValueError("divisor must be 'n' or 'n-k'")
    whole = Window.partitionBy(*by)
    w = whole.orderBy("date")
    dev = series.withColumns({f"_z{i}": F.col(c) - F.avg(c).over(whole) if centred else F.col(c) for i, c in enumerate(cols)})
    dev = dev.withColumns({f"_z{i}_{k}": F.lag(f"_z{i}", k).over(w) for i in range(len(cols)) for k in range(1, lag + 1)})
    n = F.count("*")

    def cell(i: int, j: int) -> Column:
        total = F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")) / n
        for k in range(1, lag + 1):
            cross = F.coalesce(F.sum(F.col(f"_z{i}") * F.col(f"_z{j}_{k}") + F.col(f"_z{j}") * F.col(f"_z{i}_{k}")), F.lit(0.0))
            total = total + F.lit(1 - k / (lag + 1)) * cross / (n if divisor == "n" else n - k)
        return total

    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"_o{i}_{j}").alias("omega"))
             for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    wide = dev.groupBy(*by).agg(*[cell(i, j).alias(f"_o{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))])
    return wide.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")


def gw_regime(differences: DataFrame, lagged: DataFrame, states: int = 3, by=PAIR) -> DataFrame:
    """Giacomini-White with lagged state indicators as test functions, at lag zero.

    The indicators are disjoint, so the uncentred covariance is diagonal; the centred statistic follows
    from it in closed form. A state with no days leaves the statistic undefined (null).
    """
    joined = differences.join(lagged, ["asset", "date"], "left").where(F.col("state").isNotNull() & F.col("d").isNotNull())
    n = F.count("*")
    aggregates = [n.alias("n"), F.avg("d").alias("mean_loss_diff")]
    for k in range(states):
        hit = F.col("state") == k
        aggregates += [
            F.count_if(hit).alias(f"n_state{k}"),
            (F.sum(F.when(hit, F.col("d")).otherwise(F.lit(0.0))) / n).alias(f"moment{k}"),
            (F.sum(F.when(hit, F.col("d") * F.col("d")).otherwise(F.lit(0.0))) / n).alias(f"_w{k}"),
        ]
    m = joined.groupBy(*by).agg(*aggregates)
    dead = F.lit(False)
    identical = F.lit(True)
    total = F.lit(0.0)
    for k in range(states):
        dead = dead | (F.col(f"n_state{k}") == 0)
        identical = identical & (F.col(f"_w{k}") == 0)
        total = total + F.try_divide(F.col(f"moment{k}") * F.col(f"moment{k}"), F.col(f"_w{k}"))
    uncentred = F.when(dead, F.lit(None)).when(identical, F.lit(0.0)).otherwise(F.col("n") * total)
    m = m.withColumn("gw_uncentred", uncentred)
    m = m.withColumn("gw_stat", F.try_divide(F.col("gw_uncentred"), 1 - F.col("gw_uncentred") / F.col("n")))
    return m.select(
        *by, "n", "mean_loss_diff", "gw_stat", chi2_sf(F.col("gw_stat"), states).alias("p_value"),
        "gw_uncentred", chi2_sf(F.col("gw_uncentred"), states).alias("p_uncentred"),
        *[f"moment{k}" for k in range(states)], *[f"n_state{k}" for k in range(states)],
    )


def gw_lagged_difference(differences: DataFrame, by=PAIR) -> DataFrame:
    """Giacomini-White with the canonical test functions (1, yesterday's difference)."""
    w = Window.partitionBy(*by).orderBy("date")
    rows = differences.withColumn("_p", F.lag("d").over(w)).where(F.col("_p").isNotNull()).withColumn("_z", F.col("d") * F.col("_p"))
    m = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("d").alias("m1"), F.avg("_z").alias("m2"),
        F.avg(F.col("d") * F.col("d")).alias("a"), F.avg(F.col("d") * F.col("_z")).alias("b"), F.avg(F.col("_z") * F.col("_z")).alias("c"),
    )
    m1, m2, a, b, c, n = (F.col(x) for x in ("m1", "m2", "a", "b", "c", "n"))
    form = m1 * m1 * c - 2 * m1 * m2 * b + m2 * m2 * a
    det = a * c - b * b
    stat = F.when((a == 0) & (c == 0), F.lit(0.0)).otherwise(F.try_divide(n * form, det))
    m = m.withColumn("gw_uncentred", stat)
    m = m.withColumn("gw_stat", F.try_divide(F.col("gw_uncentred"), 1 - F.col("gw_uncentred") / n))
    return m.select(
        *by, "n", "gw_stat", chi2_sf(F.col("gw_stat"), 2).alias("p_value"), "gw_uncentred",
        chi2_sf(F.col("gw_uncentred"), 2).alias("p_uncentred"), F.col("m1").alias("moment_const"), F.col("m2").alias("moment_lag"),
    )


def joint_table(differences: DataFrame, lagged: DataFrame, labels, by=PAIR) -> DataFrame:
    """Pooled test, both conditional tests and where each model wins, one line per pair."""
    dm = diebold_mariano(differences, by).select(*by, F.col("dm_stat").alias("dm_stat_pooled"), F.col("p_value").alias("dm_p_pooled"))
    reg = gw_regime(differences, lagged, len(labels), by)
    moments = [F.col(f"moment{k}") for k in range(len(labels))]
    smallest = F.least(*moments)
    edge = F.lit(None).cast("string")
    for k in reversed(range(len(labels))):
        edge = F.when(moments[k] == smallest, F.lit(labels[k])).otherwise(edge)
    wins = F.concat_ws(", ", *[F.when(moments[k] < 0, F.lit(labels[k])) for k in range(len(labels))])
    reg = reg.select(
        *by, "n", F.col("gw_stat").alias("gw_regime_stat"), F.col("p_value").alias("gw_regime_p"),
        F.col("gw_uncentred").alias("gw_regime_stat_uncentred"), F.col("p_uncentred").alias("gw_regime_p_uncentred"),
        *[m.alias(f"moment_{lab}") for m, lab in zip(moments, labels)],
        edge.alias("a_relative_edge_in"), F.when(wins == "", F.lit("none")).otherwise(wins).alias("a_wins_in"),
    )
    lagdiff = gw_lagged_difference(differences, by).select(
        *by, F.col("gw_stat").alias("gw_lagdiff_stat"), F.col("p_value").alias("gw_lagdiff_p"),
        F.col("gw_uncentred").alias("gw_lagdiff_stat_uncentred"), F.col("p_uncentred").alias("gw_lagdiff_p_uncentred"),
    )
    return reg.join(dm, list(by)).join(lagdiff, list(by))


def per_regime_pairs(differences: DataFrame, lagged: DataFrame, labels, min_n: int = 10, by=PAIR) -> DataFrame:
    """Loss means and the pooled test inside each lagged state; thin states are reported, not scored."""
    keyed = differences.join(lagged, ["asset", "date"]).where(F.col("state").isNotNull())
    key = [*by, "state"]
    means = keyed.groupBy(*key).agg(F.count("*").alias("n"), F.avg("loss_a").alias("qlike_a"), F.avg("loss_b").alias("qlike_b"))
    tests = diebold_mariano(keyed, key).select(*key, "dm_stat", "p_value")
    states = F.explode(F.sequence(F.lit(0), F.lit(len(labels) - 1)))
    grid = keyed.select(*by).distinct().withColumn("state", states)
    joined = grid.join(means, key, "left").join(tests, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= min_n
    gated = {c: F.when(enough, F.col(c)) for c in ("qlike_a", "qlike_b", "dm_stat", "p_value")}
    better = F.when(~enough, F.lit("insufficient n")).when(F.col("qlike_a") < F.col("qlike_b"), F.col("model_a")).otherwise(F.col("model_b"))
    return joined.select(*key, "n", *[c.alias(k) for k, c in gated.items()], better.alias("better")).withColumn(
        "mean_loss_diff", F.col("qlike_a") - F.col("qlike_b")
    )
