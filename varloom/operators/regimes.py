"""Volatility regimes: state moments, transition tables, jump-penalised and hidden Markov fits, causal labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators import recursion as rc, regime_fits as rf
from varloom.operators.features import rank_bins
from varloom.operators.realized import calendar_window
from varloom.operators.timing import run_table
from varloom.session import cut_lineage

VARIANCE_FLOOR = 1e-6


def standardize(panel: DataFrame, col: str, train_end: str | None, name: str = "x") -> DataFrame:
    """Centres and scales by training rows only (all rows when no training end is given)."""
    seen = F.col(col) if train_end is None else F.when(F.col("date") <= F.lit(train_end).cast("date"), F.col(col))
    whole = Window.partitionBy("asset")
    scale = F.stddev_pop(seen).over(whole)
    return panel.withColumn(name, (F.col(col) - F.avg(seen).over(whole)) / F.when(scale < 1e-12, F.lit(1.0)).otherwise(scale))


# ------------------------------------------------------------------------------- tables from a path


def state_moments(panel: DataFrame, states: int, x: str = "x", by=("asset",), sample: bool = False) -> DataFrame:
    """Mean and variance per state; a state with too few days falls back to the pooled moments."""
    variance = F.var_samp if sample else F.var_pop
    need = 2 if sample else 1
    per = panel.groupBy(*by, "state").agg(F.count(x).alias("n"), F.avg(x).alias("m"), variance(x).alias("v"))
    pooled = panel.groupBy(*by).agg(F.avg(x).alias("_pm"), variance(x).alias("_pv"))
    grid = pooled.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(states - 1))))
    own = F.coalesce(F.col("n"), F.lit(0)) >= need
    return grid.join(per, [*by, "state"], "left").select(
        *by, "state", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(own, F.col("m")).otherwise(F.col("_pm")).alias("mean"),
        F.greatest(F.when(own, F.col("v")).otherwise(F.col("_pv")), F.lit(VARIANCE_FLOOR)).alias("variance"),
    )


def transition_table(panel: DataFrame, states: int, prior: float = 0.0, by=("asset",)) -> DataFrame:
    """Counts and row-normalised probabilities for every pair of states, with an optional pseudo-count."""
    w = Window.partitionBy(*by).orderBy("date")
    moves = panel.withColumn("prev", F.lag("state").over(w)).where(F.col("prev").isNotNull()).groupBy(*by, "prev", "state").agg(F.count("*").alias("moves"))
    k = F.sequence(F.lit(0), F.lit(states - 1))
    grid = panel.select(*by).distinct().withColumn("prev", F.explode(k)).withColumn("state", F.explode(k))
    full = grid.join(moves, [*by, "prev", "state"], "left").withColumn("moves", F.coalesce("moves", F.lit(0)))
    weight = F.col("moves") + F.lit(prior)
    row = F.sum(weight).over(Window.partitionBy(*by, "prev"))
    return full.withColumn("p", F.try_divide(weight, row))


def start_distribution(panel: DataFrame, states: int, prior: float = 1.0, by=("asset",)) -> DataFrame:
    counts = panel.groupBy(*by, "state").agg(F.count("*").alias("n"))
    grid = panel.select(*by).distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(states - 1))))
    full = grid.join(counts, [*by, "state"], "left")
    weight = F.coalesce("n", F.lit(0)) + F.lit(prior)
    return full.select(*by, "state", (weight / F.sum(weight).over(Window.partitionBy(*by))).alias("p0"))


def volatility_order(moments: DataFrame, by=("asset",)) -> DataFrame:
    """New label of every state: position by ascending variance, ties by the old label."""
    w = Window.partitionBy(*by).orderBy("variance", "state")
    return moments.withColumn("label", (F.row_number().over(w) - 1).cast("int"))


def relabel(panel: DataFrame, moments: DataFrame, by=("asset",)) -> DataFrame:
    labels = volatility_order(moments, by).select(*by, "state", "label")
    return panel.join(labels, [*by, "state"]).drop("state").withColumnRenamed("label", "state")


def chain_parameters(panel: DataFrame, states: int, x: str = "x", prior: float = 1.0, by=("asset",)) -> DataFrame:
    """Everything a filter needs, one row per key: means, variances, start and transition arrays.

    The labelled path is packed once per key, so moments, start and transitions cost one shuffle and no join;
    ``state_moments`` and ``transition_table`` are the same numbers as tables.
    """
    packed = panel.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("date", F.col(x).alias("x"), "state"))).alias("_s"))
    k = F.lit(states)
    packed = packed.withColumn("m", path_moments(F.col("_s.x"), F.col("_s.state"), k, sample=True))
    length = F.size("_s")
    counts = F.transform(rc.indices(k), lambda i: F.size(F.filter("_s.state", lambda s: s == i)))
    moves = F.zip_with(F.slice("_s.state", 1, F.greatest(length - 1, F.lit(0))), F.slice("_s.state", 2, F.greatest(length - 1, F.lit(0))), lambda a, b: a * states + b)
    matrix = rc.let(moves, lambda mv: F.transform(rc.indices(k), lambda i: rc.let(
        F.transform(rc.indices(k), lambda j: F.size(F.filter(mv, lambda v: v == i * states + j)) + F.lit(prior)),
        lambda row: rc.let(rc._total(row), lambda t: F.transform(row, lambda v: v / t)))))
    return packed.select(
        *by, F.col("m.means").alias("means"), F.col("m.variances").alias("variances"),
        F.transform(counts, lambda c: (c + F.lit(prior)) / (length + F.lit(states * prior))).alias("start"), matrix.alias("matrix"), k.alias("k"))


def _losses(parameters: DataFrame) -> Column:
    """Emission losses of the series ``x``: of vectors where the parameters have covariances."""
    if "covariances" in parameters.columns:
        return rc.vector_losses(F.col("x"), F.col("means"), F.col("covariances"))
    return rc.gaussian_losses(F.col("x"), F.col("means"), F.col("variances"))


def filter_states(series: DataFrame, parameters: DataFrame, by=("asset",)) -> DataFrame:
    """Causal and smoothed probabilities per date, the causal state and the decoded path.

    Parameters may come in several versions per asset (one per penalty, say); ``by`` names their key. Series and
    parameters may be of one column or of several.
    """
    j = series.join(parameters, "asset")
    if "covariances" not in parameters.columns:
        j = j.withColumns({"means": F.transform("means", lambda m: F.array(m)), "covariances": F.transform("variances", lambda v: F.array(F.array(v)))})
    if series.schema["x"].dataType.elementType.typeName() != "array":
        j = j.withColumn("x", F.transform("x", lambda v: F.array(v)))
    return rf.filter_rows(j, list(by))


def chain_likelihood(series: DataFrame, parameters: DataFrame) -> DataFrame:
    """Log likelihood and information criteria of given chain parameters, one row per asset."""
    j = series.join(parameters, "asset").withColumn("losses", _losses(parameters))
    f = rc.forward_filter(F.col("losses"), F.col("start"), rc.transpose(F.col("matrix"), F.col("k")))
    return chain_summary(j.withColumn("loglik", f["loglik"]))


def penalty_sensitivity(panel: DataFrame, fits: DataFrame, headline: float, train_end: str, test_start: str, states: int = 3, x: str = "x", floor_days: float = 15.0) -> DataFrame:
    """Causal labels under every fitted penalty against those under the headline one."""
    by = ["asset", "penalty"]
    paths = path_rows(fits, by)
    labels = filter_states(rc.as_series(panel, x), chain_parameters(paths, states, by=by), by).select(*by, "date", "state")
    labels = cut_lineage(labels)
    head = labels.where(F.col("penalty") == headline).select("asset", "date", F.col("state").alias("_h"))
    w = Window.partitionBy(*by).orderBy("date")
    test = F.col("date") >= F.lit(test_start).cast("date")
    train = F.col("date") <= F.lit(train_end).cast("date")
    rows = labels.join(head, ["asset", "date"]).withColumn("_sw", test & F.lag(test).over(w) & (F.col("state") != F.lag("state").over(w)))
    same = (F.col("state") == F.col("_h")).cast("double")
    agreed = rows.groupBy(*by).agg(
        F.count_if("_sw").alias("test_switches"), F.avg(F.when(test, same)).alias("agreement_test"), F.avg(F.when(train, same)).alias("agreement_train"))
    summary = jump_summary(fits).select(*by, "n_jumps", "mean_duration", (F.col("mean_duration") >= floor_days).alias("clears_floor"))
    return summary.join(agreed, by).withColumn("is_headline", F.col("penalty") == headline)


def persistence(panel: DataFrame, states: int, prior: float = 1.0, steps: int = 200) -> DataFrame:
    """Stay probability, expected and observed durations, stationary and observed shares per state."""
    table = transition_table(panel, states, prior)
    stay = table.where(F.col("prev") == F.col("state")).select("asset", "state", F.col("p").alias("stay"))
    rows = table.groupBy("asset", "prev").agg(F.array_sort(F.collect_list(F.struct("state", "p")))["p"].alias("row"))
    matrix = rows.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("prev", "row")))["row"].alias("matrix"))
    columns = rc.transpose(F.col("matrix"), F.lit(states))
    uniform = F.array(*[F.lit(1.0 / states)] * states)
    power = rc.let(columns, lambda c: F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), uniform, lambda v, _: F.transform(c, lambda col: rc._dot(v, col))))
    stationary = matrix.select("asset", F.posexplode(power).alias("state", "stationary"))
    total = F.count("*").over(Window.partitionBy("asset"))
    observed = panel.withColumn("_n", total).groupBy("asset", "state").agg((F.count("*") / F.max("_n")).alias("share"))
    runs = run_table(panel).groupBy("asset", "state").agg(F.avg("length").alias("mean_run"))
    return (
        stay.join(stationary, ["asset", "state"]).join(observed, ["asset", "state"], "left").join(runs, ["asset", "state"], "left")
        .select("asset", "state", "stay", F.when(F.col("stay") < 1, 1 / F.greatest(1 - F.col("stay"), F.lit(1e-12))).alias("expected_duration"),
                "stationary", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("mean_run", F.lit(0.0)).alias("mean_run"))
    )


def concordance(panel: DataFrame, validator: str, states: int) -> DataFrame:
    """State by validator-quantile counts with row shares, in long form."""
    binned = panel.withColumn("bin", rank_bins(validator, states))
    counts = binned.groupBy("asset", "state", "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("asset", "state")))


def concordance_summary(panel: DataFrame, validator: str, states: int) -> DataFrame:
    from varloom.operators.splicing import average_rank

    w = ("asset",)
    ranked = panel.withColumns({"bin": rank_bins(validator, states), "_rs": average_rank("state", w), "_rv": average_rank(validator, w)})
    return ranked.groupBy("asset").agg(
        F.corr("_rs", "_rv").alias("spearman"), F.avg((F.col("bin") == F.col("state")).cast("double")).alias("diag_share"),
        *[F.avg(F.when(F.col("state") == k, F.col(validator))).alias(f"mean_state{k}") for k in range(states)],
    )


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Share of equal labels and the adjusted Rand index, from the contingency counts."""
    cells = labels.groupBy("asset", a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    margin_a = F.sum("n").over(Window.partitionBy("asset", a))
    margin_b = F.sum("n").over(Window.partitionBy("asset", b))
    marked = cells.withColumns({"_a": margin_a, "_b": margin_b,
                                "_fa": F.row_number().over(Window.partitionBy("asset", a).orderBy(b)) == 1,
                                "_fb": F.row_number().over(Window.partitionBy("asset", b).orderBy(a)) == 1})
    s = marked.groupBy("asset").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("_same"), F.sum(pairs(F.col("n"))).alias("_ij"),
        F.sum(F.when(F.col("_fa"), pairs(F.col("_a")))).alias("_ai"), F.sum(F.when(F.col("_fb"), pairs(F.col("_b")))).alias("_bj"))
    expected = F.col("_ai") * F.col("_bj") / pairs(F.col("n"))
    ceiling = (F.col("_ai") + F.col("_bj")) / 2
    ari = F.coalesce(F.try_divide(F.col("_ij") - expected, ceiling - expected), F.lit(1.0))
    return s.select("asset", "n", (F.col("_same") / F.col("n")).alias("raw_agreement"), ari.alias("adjusted_rand"))


def signal_summary(board: DataFrame, start: str, states: int = 3) -> DataFrame:
    """Switches, durations, certainty, smoothed-against-filtered gap and days per state on evaluated rows.

    ``board`` holds asset, estimator, date, state, p and p_smooth.
    """
    test = board.where(F.col("date") >= F.lit(start).cast("date"))
    w = Window.partitionBy("asset", "estimator").orderBy("date")
    rows = test.withColumn("_sw", (F.col("state") != F.lag("state").over(w)).cast("int"))
    gap = F.abs(F.element_at("p_smooth", states) - F.element_at("p", states))
    out = rows.groupBy("asset", "estimator").agg(
        F.count("*").alias("n_test"), F.coalesce(F.sum("_sw"), F.lit(0)).alias("switches"), F.avg(F.array_max("p")).alias("mean_max_posterior"),
        F.avg(gap).alias("mean_abs_gap"), *[F.count_if(F.col("state") == k).alias(f"days_state{k}") for k in range(states)])
    return out.withColumn("mean_duration", F.col("n_test") / (F.col("switches") + 1))


def soft_membership(losses: Column) -> Column:
    """Softmax of negated losses."""
    return rc.let(F.array_min(losses), lambda m: rc.let(
        F.transform(losses, lambda v: F.exp(m - v)), lambda e: rc.let(rc._total(e), lambda s: F.transform(e, lambda v: v / s))))


def gate(p: Column, states: int) -> Column:
    """Yesterday's posterior as mixing weights: non-finite entries are dropped, then renormalised."""
    uniform = F.array(*[F.lit(1.0 / states)] * states)
    clean = F.transform(p, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v))
    scaled = rc.let(clean, lambda c: rc.let(rc._total(c), lambda s: F.when(s > 0, F.transform(c, lambda v: v / s)).otherwise(uniform)))
    return F.coalesce(scaled, uniform)


def lagged_gate(board: DataFrame, states: int = 3) -> DataFrame:
    return board.withColumn("gate", gate(F.lag("p").over(calendar_window()), states))


# ------------------------------------------------------------------- what is read off a fitted model


def path_moments(x: Column, path: Column, k: Column, sample: bool = False) -> Column:
    """struct(means, variances) of the observations on each state of a path; thin states take the pooled ones."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    grow = lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"))
    mean = lambda a: a["s"] / a["n"]
    scale = (lambda a: F.greatest(a["n"] - 1, F.lit(1.0))) if sample else (lambda a: a["n"])
    var = lambda a: F.greatest((a["q"] - a["s"] * a["s"] / a["n"]) / scale(a), F.lit(VARIANCE_FLOOR))
    pooled = F.aggregate(x, zero, grow)
    zipped = F.zip_with(x, path, lambda v, s: F.struct(v.alias("v"), s.alias("s")))
    own = rc.let(zipped, lambda z: F.transform(rc.indices(k), lambda j: F.aggregate(
        z, zero, lambda a, e: F.when(e["s"] == j, grow(a, e["v"])).otherwise(a))))
    enough = 1 if sample else 0
    filled = rc.let(pooled, lambda p: F.transform(own, lambda a: F.when(a["n"] > enough, a).otherwise(p)))
    return rc.let(filled, lambda f: F.struct(F.transform(f, mean).alias("means"), F.transform(f, var).alias("variances")))


def jump_count(path: Column) -> Column:
    return F.aggregate(
        path, F.struct(F.lit(None).cast("int").alias("p"), F.lit(0).alias("c")),
        lambda a, s: F.struct(s.alias("p"), (a["c"] + F.when(a["p"].isNotNull() & (a["p"] != s), 1).otherwise(0)).alias("c")), lambda a: a["c"])


def _columns() -> Column:
    return F.size(F.element_at("x", 1))


def jump_summary(fit: DataFrame) -> DataFrame:
    """Jumps, mean duration, information criteria and convergence of each fitted path."""
    n = F.size("x").cast("double")
    out = fit.withColumns({"n_jumps": jump_count(F.col("path")), "n_params": (2 * F.col("k") * _columns()).cast("int"), "n": F.size("x")})
    return out.select(
        "asset", "k", "penalty", "n", "n_jumps", (n / (F.col("n_jumps") + 1)).alias("mean_duration"), "objective", "loglik", "n_params",
        information_criterion(F.col("loglik"), F.col("n_params"), F.ln(n)).alias("bic"), information_criterion(F.col("loglik"), F.col("n_params"), F.lit(2.0)).alias("aic"),
        "converged", "n_iter", "restarts_converged")


def information_criterion(loglik: Column, parameters: Column, weight: Column) -> Column:
    return -2.0 * loglik + parameters * weight


def chain_parameter_count(k: Column, features=1) -> Column:
    """Start, transitions, means and full covariances."""
    return (k - 1) + k * (k - 1) + k * features + k * features * (features + 1) / 2


def choose_penalty(summary: DataFrame, floor_days: float = 15.0) -> DataFrame:
    """Smallest penalty whose mean duration reaches the floor, else the largest one."""
    ok = F.when(F.col("mean_duration") >= floor_days, F.col("penalty"))
    return summary.groupBy("asset", "k").agg(F.coalesce(F.min(ok), F.max("penalty")).alias("penalty"), F.max("mean_duration").alias("longest_duration"))


def chain_summary(fit: DataFrame) -> DataFrame:
    """Likelihood, information criteria and, for fitted chains, convergence."""
    n = F.size("x").cast("double")
    columns = _columns() if fit.schema["x"].dataType.elementType.typeName() == "array" else F.lit(1)
    p = chain_parameter_count(F.col("k"), columns)
    return fit.select("asset", "k", F.size("x").alias("n"), "loglik", p.cast("int").alias("n_params"),
                      information_criterion(F.col("loglik"), p, F.ln(n)).alias("bic"), information_criterion(F.col("loglik"), p, F.lit(2.0)).alias("aic"),
                      *[c for c in ("converged", "n_iter", "restarts_converged") if c in fit.columns])


def path_rows(fit: DataFrame, keep, path: str = "path", columns=("x",)) -> DataFrame:
    """One row per date with the state and the columns of the series by name."""
    rows = rc.explode_series(fit, keep, x="_x", state=path) if "_x" in fit.columns else rc.explode_series(fit.withColumnRenamed("x", "_x"), keep, _x="_x", state=path)
    return rows.select(*keep, "date", "state", *[F.col("_x")[i].alias(c) for i, c in enumerate(columns)])


# ------------------------------------------------------------------------------- several columns a day


def vector_parameters(panel: DataFrame, columns, states: int, prior: float = 1.0, by=("asset",)) -> DataFrame:
    """Filter parameters from a labelled path with several columns: means, sample covariances, start and transitions.

    A state of fewer than two days takes the moments of all days.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    moments = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)] + [F.covar_samp(columns[i], columns[j]).alias(f"_c{i}{j}") for i, j in pairs]
    names = [f"_m{i}" for i in range(len(columns))] + [f"_c{i}{j}" for i, j in pairs]
    own = panel.groupBy(*by, "state").agg(F.count("*").alias("_n"), *moments)
    pooled = panel.groupBy(*by).agg(*moments).select(*by, *[F.col(c).alias(f"_p{c}") for c in names])
    grid = pooled.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(states - 1)))).join(own, [*by, "state"], "left")
    pick = {c: F.when(F.col("_n") >= 2, F.col(c)).otherwise(F.col(f"_p{c}")) for c in names}

    def cell(i: int, j: int) -> Column:
        value = pick[f"_c{max(i, j)}{min(i, j)}"]
        return F.greatest(value, F.lit(VARIANCE_FLOOR)) if i == j else value

    size = range(len(columns))
    state = F.struct("state", F.array(*[pick[f"_m{i}"] for i in size]).alias("m"), F.array(*[F.array(*[cell(i, j) for j in size]) for i in size]).alias("c"))
    packed = grid.groupBy(*by).agg(F.array_sort(F.collect_list(state)).alias("_s"))
    start = start_distribution(panel, states, prior, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("state", "p0")))["p0"].alias("start"))
    rows = transition_table(panel, states, prior, by).groupBy(*by, "prev").agg(F.array_sort(F.collect_list(F.struct("state", "p")))["p"].alias("row"))
    matrix = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("prev", "row")))["row"].alias("matrix"))
    return packed.join(start, list(by)).join(matrix, list(by)).select(
        *by, F.col("_s.m").alias("means"), F.col("_s.c").alias("covariances"), "start", "matrix", F.lit(states).alias("k"))
