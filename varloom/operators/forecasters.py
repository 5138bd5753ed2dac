"""Forecasters beyond the lag regression: lookback regressions, regime experts, draws, quantiles, volatility grids.

All are callables over a folded frame (see ``walkforward.assign_folds``) and return long forecasts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, pi, sqrt
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.laws import lognormal_mean
from varloom.functions.math import all_finite
from varloom.operators import recursion as rc
from varloom.operators.linear import added, product_sums, ridge_fit
from varloom.operators.realized import calendar_window
from varloom.session import cut_lineage

HEAD_SHARE = 0.85
WORD = 2.0**32


def hash_uniform(*parts: Column) -> Column:
    """Uniform draw in [0, 1) from a digest of its parts; equal on any cluster and any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(WORD)


def poisson_steps() -> list[float]:
    """Cumulative Poisson(1) probabilities up to the first that is 1 in double precision."""
    out, term = [exp(-1.0)], exp(-1.0)
    while out[-1] < 1.0 and out[-1] + term / len(out) != out[-1]:
        term /= len(out)
        out.append(out[-1] + term)
    return out


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count by inversion; no count is cut off."""
    return sum(((u >= F.lit(c)).cast("double") for c in poisson_steps()), F.lit(0.0))


def draw_weights(draws: int, seed: int) -> Column:
    """Poisson(1) weights of a row in every bootstrap draw, as an array."""
    uniform = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: hash_uniform(F.lit(seed), F.col("asset"), F.col("date"), d))
    return F.transform(uniform, poisson_weight)


def lookback_design(folded: DataFrame, features: dict[str, Column], lookback: int, last_only: dict[str, Column] | None = None) -> tuple[DataFrame, list[str]]:
    """Standardised values of rows t-lookback .. t-1 next to the log target; the constant comes last.

    Scaling uses the rows of the first training window only. The design feeds several branches (extents,
    sums, residuals, forecasts), so it is materialised once instead of being recomputed from raw rows by each.
    """
    w = calendar_window()
    whole = Window.partitionBy("asset")
    first_end = F.min("train_end_pos").over(whole)
    rows = folded.withColumn("_te", first_end).withColumns({f"_f{i}": c for i, c in enumerate(features.values())})
    scaled = {}
    for i in range(len(features)):
        seen = F.when(F.col("pos") <= F.col("_te"), F.col(f"_f{i}"))
        sd = F.stddev_pop(seen).over(whole)
        scaled[f"_f{i}"] = (F.col(f"_f{i}") - F.avg(seen).over(whole)) / F.when(sd < 1e-12, F.lit(1.0)).otherwise(sd)
    rows = rows.withColumns(scaled)
    lags = {f"x{i}_{k}": F.lag(f"_f{i}", k).over(w) for i in range(len(features)) for k in range(1, lookback + 1)}
    extra = {f"e{i}": F.lag(c, 1).over(w) for i, c in enumerate((last_only or {}).values())}
    rows = rows.withColumns({**lags, **extra, "one": F.lit(1.0), "y": F.ln("rv")})
    names = [*lags, *extra, "one"]
    kept = [c for c in ("asset", "date", "pos", "fold_idx", "train_start_pos", "train_end_pos", "rv", "y", *names)]
    return cut_lineage(rows.where(all_finite(*names, "y")).select(*kept)), names


def fit_groups(folded: DataFrame, refit_folds: int = 0) -> Column:
    """Which fit serves a fold: one for all (0), or a new one every ``refit_folds`` folds."""
    return F.lit(0).cast("long") if refit_folds == 0 else (F.floor(F.col("fold_idx") / refit_folds) * refit_folds).cast("long")


def fit_table(design: DataFrame, refit_folds: int = 0) -> DataFrame:
    used = design.where(F.col("fold_idx").isNotNull()).withColumn("fit", fit_groups(design, refit_folds))
    ends = used.groupBy("asset", "fit").agg(F.min("train_end_pos").alias("fit_end"), F.min("train_start_pos").alias("fit_start"))
    head = F.col("fit_start") + F.floor((F.col("fit_end") - F.col("fit_start")) * F.lit(HEAD_SHARE)).cast("long")
    return ends.withColumn("head_end", head)


def linear(beta: Column, names) -> Column:
    return F.aggregate(F.zip_with(beta, F.array(*names), lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)


def training_sums(design: DataFrame, names, refit_folds: int = 0, weights: Column | None = None) -> DataFrame:
    """Partial sums of products of regressors and target, apart for the head and the tail of every training window."""
    rows = design.join(fit_table(design, refit_folds), "asset").where(F.col("pos").between(F.col("fit_start"), F.col("fit_end")))
    weight = [] if weights is None else [weights.alias("w")]
    rows = rows.select("asset", "fit", (F.col("pos") > F.col("head_end")).alias("tail"), F.array(*names, "y").alias("v"), *weight)
    return product_sums(rows, "asset string, fit long, tail boolean", weights is not None)


def window_sums(cells: pd.DataFrame, size: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Head's and tail's matrices of one fit."""
    parts = {bool(tail): added(part["cells"], size) for tail, part in cells.groupby("tail")}
    return parts.get(False), parts.get(True)


def lookback_fits(design: DataFrame, names, refit_folds: int = 0, ridge: float = 1.0, weights: Column | None = None) -> DataFrame:
    """Coefficients from the head of each training window and log-residual variance from its tail.

    ``weights`` is an array column of the design (such as experts or draws): every place (``slot``) of it is a
    weighted fit of its own, and all of them come from one pass and one shuffle of pre-aggregated sums.
    """
    size = len(names) + 1

    def solve(key: tuple[Any, ...], cells: pd.DataFrame) -> pd.DataFrame:
        head, tail = window_sums(cells, size)
        beta, s2 = (None, 0.0) if head is None else ridge_fit(head, tail, list(range(size - 1)), ridge)
        return pd.DataFrame([(*key, None if beta is None else beta.tolist(), s2)], columns=["asset", "fit", "slot", "beta", "s2"])

    sums = training_sums(design, names, refit_folds, weights)
    return sums.groupBy("asset", "fit", "slot").applyInPandas(solve, "asset string, fit long, slot int, beta array<double>, s2 double")


def lookback_forecast(folded: DataFrame, features, lookback: int, refit_folds: int = 0, ridge: float = 1.0, last_only=None) -> DataFrame:
    """Lookback regression forecasts: (asset, date, lin, s2, yhat)."""
    design, names = lookback_design(folded, features, lookback, last_only)
    fits = lookback_fits(design, names, refit_folds, ridge)
    oos = design.where(F.col("fold_idx").isNotNull()).withColumn("fit", fit_groups(design, refit_folds)).join(fits, ["asset", "fit"])
    out = oos.withColumn("lin", linear(F.col("beta"), names))
    return out.select("asset", "date", "fold_idx", F.col("rv").alias("y_true"), "lin", "s2", lognormal_mean(F.col("lin"), F.sqrt("s2")).alias("yhat"))


def expert_forecast(folded: DataFrame, features, lookback: int, gates: DataFrame, states: int = 3, ridge: float = 1.0, draws: int = 0, seed: int = 17) -> DataFrame:
    """One weighted regression per state, mixed by yesterday's posterior; optionally inside bootstrap draws.

    ``gates`` is (asset, date, gate array). Returns (asset, date, draw, yhat, log mixture mean, gate entropy).
    """
    design, names = lookback_design(folded, features, lookback)
    rows = design.join(gates.select("asset", "date", "gate"), ["asset", "date"])
    weights = F.col("gate")
    if draws:
        drawn = draw_weights(draws, seed)
        weights = F.flatten(F.transform("gate", lambda g: F.transform(drawn, lambda w: g * w)))
    fits = lookback_fits(rows, names, 0, ridge, weights)
    slot = F.col("slot")
    fits = fits.withColumns({"expert": F.floor(slot / draws), "draw": slot % draws}) if draws else fits.withColumn("expert", slot)
    packed = fits.groupBy("asset", *(["draw"] if draws else [])).agg(F.array_sort(F.collect_list(F.struct("expert", "beta", "s2"))).alias("experts"))
    oos = rows.where(F.col("fold_idx").isNotNull()).join(packed, "asset")
    x = F.array(*names)
    parts = F.transform("experts", lambda e: F.aggregate(F.zip_with(e["beta"], x, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v) + e["s2"] / 2)
    mixed = F.aggregate(F.zip_with(parts, "gate", lambda p, g: g * F.exp(p)), F.lit(0.0), lambda a, v: a + v)
    spread = F.aggregate(F.zip_with("experts", "gate", lambda e, g: g * e["s2"]), F.lit(0.0), lambda a, v: a + v)
    entropy = -F.aggregate(F.transform("gate", lambda g: g * F.ln(F.greatest(g, F.lit(1e-300)))), F.lit(0.0), lambda a, v: a + v)
    return oos.select("asset", "date", *(["draw"] if draws else []), F.col("rv").alias("y_true"), mixed.alias("yhat"), spread.alias("s2"), entropy.alias("gate_entropy"))


def draw_forecast(folded: DataFrame, features, lookback: int, draws: int = 20, ridge: float = 1.0, seed: int = 17) -> DataFrame:
    """Bootstrap replicates of the lookback regression: (asset, date, draw, lin, s2)."""
    design, names = lookback_design(folded, features, lookback)
    fits = lookback_fits(design, names, 0, ridge, draw_weights(draws, seed)).withColumnRenamed("slot", "draw")
    oos = design.where(F.col("fold_idx").isNotNull()).join(fits, "asset")
    return oos.select("asset", "date", "draw", F.col("rv").alias("y_true"), linear(F.col("beta"), names).alias("lin"), "s2")


def draws_to_law(draws: DataFrame, lin: str = "lin") -> DataFrame:
    """Mean, epistemic spread across draws, aleatoric spread inside them, and the total log-normal law."""
    out = draws.groupBy("asset", "date").agg(
        F.first("y_true").alias("y_true"), F.avg(lin).alias("mu"), F.var_pop(lin).alias("_e"), F.avg("s2").alias("_a"))
    sigma = F.sqrt(F.col("_e") + F.col("_a"))
    return out.select("asset", "date", "y_true", "mu", sigma.alias("sigma"), F.sqrt("_e").alias("sd_epistemic"), F.sqrt("_a").alias("sd_aleatoric"),
                      lognormal_mean(F.col("mu"), sigma).alias("yhat"))


def quantile_forecast(folded: DataFrame, features, lookback: int, taus=(0.05, 0.5, 0.95), ridge: float = 1.0) -> DataFrame:
    """Centre of the lookback regression plus exact quantiles of its training residuals; never crossing."""
    design, names = lookback_design(folded, features, lookback)
    fits = lookback_fits(design, names, 0, ridge)
    scored = design.join(fits.join(fit_table(design), ["asset", "fit"]), "asset").withColumn("lin", linear(F.col("beta"), names))
    train = scored.where(F.col("pos").between(F.col("fit_start"), F.col("fit_end")))
    offsets = train.groupBy("asset").agg(F.percentile(F.col("y") - F.col("lin"), F.array(*[F.lit(t) for t in taus])).alias("_o"))
    oos = scored.where(F.col("fold_idx").isNotNull()).join(offsets, "asset")
    rows = F.arrays_zip(F.array(*[F.lit(t) for t in taus]).alias("tau"), F.col("_o").alias("o"))
    out = oos.select("asset", "date", F.col("rv").alias("y_true"), "lin", F.explode(rows).alias("r"))
    return out.select("asset", "date", "y_true", F.col("r.tau").alias("tau"), F.exp(F.col("lin") + F.col("r.o")).alias("q"))


QUANTILES = (0.05, 0.5, 0.95)


def pinball_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, tau: float, ridge: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Coefficients of the least weighted pinball loss plus ridge/4 times the squared slopes; the constant comes last.

    Each round minimises a quadratic that touches the loss at the present residuals and lies above it elsewhere, so
    the loss never rises. The residuals are smoothed by less and less, in the end by a millionth of their scale.
    """
    penalty = np.diag([float(ridge)] * (x.shape[1] - 1) + [0.0])
    pull = (2 * tau - 1) * (weight @ x)

    def refit(w: np.ndarray, right: np.ndarray | float) -> np.ndarray:
        scaled = x * (weight * w)[:, None]
        return np.linalg.lstsq(scaled.T @ x + penalty, scaled.T @ y + right, rcond=None)[0]

    beta = refit(np.ones(len(y)), 0.0)
    scale = max(float(np.sqrt(np.average((y - x @ beta) ** 2, weights=weight))), 1e-12)

    def loss(b: np.ndarray) -> float:
        r = y - x @ b
        return float(weight @ np.maximum(tau * r, (tau - 1) * r)) + float(ridge) / 4 * float(b[:-1] @ b[:-1])

    for smooth in (1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6):
        last = loss(beta)
        for _ in range(rounds):
            beta = refit(1.0 / (smooth * scale + np.abs(y - x @ beta)), pull)
            now = loss(beta)
            if abs(last - now) <= 1e-9 * max(abs(last), 1e-300):
                break
            last = now
    return beta


def state_quantile_fits(design: DataFrame, names, gates: DataFrame, taus=QUANTILES, ridge: float = 1.0) -> DataFrame:
    """Pinball fits per (asset, fit, state, level), every training day weighted by the posterior of the state.

    ``below`` and ``near`` are the weighted shares of training days under the fitted quantile and within a
    thousandth of the residual scale of it. A group is the training days of an asset in one state, so it is
    bounded by the calendar. States without any weight have no fit.
    """
    rows = design.join(gates.select("asset", "date", "gate"), ["asset", "date"]).join(fit_table(design), "asset")
    rows = rows.where(F.col("pos").between(F.col("fit_start"), F.col("fit_end"))).select("asset", "fit", F.array(*names, "y").alias("v"), F.posexplode("gate").alias("state", "w"))

    def solve(key: tuple[Any, ...], days: pd.DataFrame) -> pd.DataFrame:
        v, w = np.vstack(days["v"].to_numpy()), days["w"].to_numpy()
        order = np.lexsort(v.T)
        v, w = v[order], w[order]
        out = []
        for tau in taus if w.sum() > 0 else ():
            beta = pinball_regression(v[:, :-1], v[:, -1], w, tau, ridge)
            r = v[:, -1] - v[:, :-1] @ beta
            near = 1e-3 * np.sqrt(np.average(r * r, weights=w))
            out.append((*key, tau, beta.tolist(), len(v), float(w @ (r < 0) / w.sum()), float(w @ (np.abs(r) <= near) / w.sum()), float(w.max() / w.sum())))
        return pd.DataFrame(out, columns=["asset", "fit", "state", "tau", "beta", "n", "below", "near", "largest"])

    return rows.groupBy("asset", "fit", "state").applyInPandas(solve, "asset string, fit long, state int, tau double, beta array<double>, n long, below double, near double, largest double")


def state_quantile_forecast(folded: DataFrame, features, lookback: int, gates: DataFrame, taus=QUANTILES, ridge: float = 1.0) -> DataFrame:
    """Quantiles that depend on inputs and state: (asset, date, y_true, tau, q).

    A state's fitted quantiles are put in order at every day, which never raises their pinball loss; the gate
    then averages level by level, which keeps the order. So quantiles can't cross.
    """
    design, names = lookback_design(folded, features, lookback)
    fits = state_quantile_fits(design, names, gates, taus, ridge)
    packed = fits.groupBy("asset", "state").agg(F.array_sort(F.collect_list(F.struct("tau", "beta"))).alias("levels"))
    packed = packed.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("state", "levels"))).alias("states"))
    rows = design.where(F.col("fold_idx").isNotNull()).join(gates.select("asset", "date", "gate"), ["asset", "date"]).join(packed, "asset")
    x = F.array(*names)

    def ordered(state: Column) -> Column:
        return F.array_sort(F.transform(state["levels"], lambda e: F.aggregate(F.zip_with(e["beta"], x, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)))

    placed = F.transform("states", lambda s: F.struct(F.element_at("gate", s["state"] + 1).alias("g"), ordered(s).alias("q")))
    rows = rows.select("asset", "date", F.col("rv").alias("y_true"), placed.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, s: a + s["g"])

    def mixed(place: int) -> Column:
        return F.exp(F.aggregate("p", F.lit(0.0), lambda a, s: a + s["g"] * F.element_at(s["q"], place)) / total)

    levels = [F.struct(F.lit(t).alias("tau"), mixed(k).alias("q")) for k, t in enumerate(sorted(taus), 1)]
    return rows.select("asset", "date", "y_true", F.explode(F.array(*levels)).alias("r")).select("asset", "date", "y_true", "r.tau", "r.q")


# ---------------------------------------------------------------------------------- lookback sweep

def lookback_sweep(folded: DataFrame, inputs: dict[str, Column], input_sets: dict[str, tuple], lookbacks, ridges) -> DataFrame:
    """Every (input set, lookback, ridge) trained once on the first training window, scored on the fold rows.

    One design with the widest lookback serves all points, so all points train on the same days. Its sums of
    products are formed once; a point solves the principal sub-matrix of its columns, and its residual variance
    is a quadratic form of the tail's sums. Nothing is trained or materialised per point. A point without a full
    rank has no forecast. Returns (asset, date, inputs, lookback, ridge, y_true, lin, s2, yhat).
    """
    widest, order = max(lookbacks), list(inputs)
    unknown = sorted({n for chosen in input_sets.values() for n in chosen} - set(order))
    if unknown:
        raise KeyError(f"unknown inputs {unknown}; known: {order}")
    design, names = lookback_design(folded, inputs, widest)
    size = len(names) + 1
    points = []
    for label, chosen in input_sets.items():
        for lookback in lookbacks:
            own = [order.index(n) * widest + k for n in chosen for k in range(lookback)] + [size - 2]
            points += [(label, lookback, float(ridge), own) for ridge in ridges]

    def solve(key: tuple[Any, ...], cells: pd.DataFrame) -> pd.DataFrame:
        head, tail = window_sums(cells, size)
        out = []
        for label, lookback, ridge, own in points if head is not None else []:
            found, s2 = ridge_fit(head, tail, own, ridge)
            if found is not None:
                beta = np.zeros(size - 1)
                beta[own] = found
                out.append((*key, label, lookback, ridge, beta.tolist(), s2))
        return pd.DataFrame(out, columns=["asset", "fit", "inputs", "lookback", "ridge", "beta", "s2"])

    fits = training_sums(design, names).groupBy("asset", "fit").applyInPandas(solve, "asset string, fit long, inputs string, lookback int, ridge double, beta array<double>, s2 double")
    oos = design.where(F.col("fold_idx").isNotNull()).select("asset", "date", F.col("rv").alias("y_true"), F.array(*names).alias("x"))
    dot = F.aggregate(F.zip_with("beta", "x", lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)
    out = oos.join(fits, "asset").withColumn("lin", dot)
    return out.select("asset", "date", "inputs", "lookback", "ridge", "y_true", "lin", "s2", lognormal_mean(F.col("lin"), F.sqrt("s2")).alias("yhat"))


# --------------------------------------------------------------------------------- volatility grids

SCALE = 100.0
GARCH_ALPHAS = (0.02, 0.05, 0.1, 0.15, 0.2)
GARCH_BETAS = (0.7, 0.8, 0.85, 0.9, 0.95)


def fold_series(folded: DataFrame) -> DataFrame:
    """A row per (asset, fold): returns less their training mean from the first training day to the fold's last day.

    ``n`` of them are training days with variance ``s2``. What a row holds is bounded by the calendar; folds are
    spread over the tasks.
    """
    scaled = folded.select("asset", "pos", "fold_idx", "train_start_pos", "train_end_pos", (F.col("log_return") * SCALE).alias("r"))
    series = scaled.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("_s")).select("asset", F.col("_s.r").alias("r"))
    folds = scaled.where(F.col("fold_idx").isNotNull()).groupBy("asset", "fold_idx").agg(
        F.min("train_start_pos").alias("ts"), F.min("train_end_pos").alias("te"), F.max("pos").alias("pe"))
    n = (F.col("te") - F.col("ts") + 1).cast("int")
    window = F.slice("r", (F.col("ts") + 1).cast("int"), (F.col("pe") - F.col("ts") + 1).cast("int"))
    rows = rc.spread(folds.join(series, "asset").select("asset", "fold_idx", "te", n.alias("n"), window.alias("r")), "asset", "fold_idx")

    def mean(x, of):
        return F.aggregate(F.slice(x, 1, F.col("n")), F.lit(0.0), lambda acc, v: acc + of(v)) / F.col("n")

    rows = rows.withColumn("e", rc.let(mean("r", lambda v: v), lambda mu: F.transform("r", lambda v: v - mu)))
    return rows.withColumn("s2", mean("e", lambda v: v * v)).drop("r")


def grid_forecast(folded: DataFrame, grid: dict[str, tuple], start, step, log_likelihood, variance) -> DataFrame:
    """The recursion of every grid point over every fold's own window; the likeliest point forecasts the fold.

    ``start(s2)`` is the first state, ``step(point, s2, h, e)`` the next one, ``log_likelihood(h, e)`` a training
    day's share and ``variance(h)`` the forecast; all take arrays with a column per point. A task handles a fold at
    a time and needs memory for days x points. Ties go to the larger parameters.
    """
    names = list(grid)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = {k: np.array(v) for k, v in grid.items()}
        for batch in batches:
            for fold in batch.to_pylist():
                e, n = np.array(fold["e"]), fold["n"]
                path = np.empty((len(e), len(points[names[0]])))
                h = np.full(path.shape[1], start(fold["s2"]))
                for i, x in enumerate(e):
                    path[i] = h
                    h = step(points, fold["s2"], h, x)
                ll = log_likelihood(path[:n], e[:n, None]).sum(axis=0)
                best = max(range(len(ll)), key=lambda j: (ll[j], *(points[k][j] for k in names)))
                ahead = variance(path[n:, best]) / (SCALE * SCALE)
                k = len(ahead)
                yield pa.RecordBatch.from_pydict(
                    {"asset": [fold["asset"]] * k, "pos": fold["te"] + 1 + np.arange(k), "ll": np.full(k, ll[best]), **{name: np.full(k, points[name][best]) for name in names}, "yhat": ahead})

    schema = f"asset string, pos long, ll double, {', '.join(f'{k} double' for k in names)}, yhat double"
    days = fold_series(folded).select("asset", "te", "n", "e", "s2").mapInArrow(fits, schema)
    return folded.where(F.col("fold_idx").isNotNull()).select("asset", "date", "fold_idx", "pos", F.col("rv").alias("y_true")).join(days, ["asset", "pos"]).drop("pos")


def garch_forecast(folded: DataFrame, alphas=GARCH_ALPHAS, betas=GARCH_BETAS) -> DataFrame:
    """Variance-targeted GARCH(1,1) by quasi-likelihood over a grid, refit at every fold on the fold's own window."""
    alpha, beta = zip(*[(a, b) for a in alphas for b in betas if a + b < 1], strict=True)

    def log_likelihood(h, e):
        h = np.maximum(h, 1e-12)
        return -0.5 * (np.log(h) + e * e / h)

    out = grid_forecast(
        folded, {"alpha": alpha, "beta": beta}, lambda s2: s2, lambda g, s2, h, e: s2 * (1 - g["alpha"] - g["beta"]) + g["alpha"] * (e * e) + g["beta"] * h,
        log_likelihood, lambda h: np.maximum(h, 1e-12))
    return out.withColumn("persistence", F.col("alpha") + F.col("beta"))


EGARCH_ALPHAS, EGARCH_GAMMAS, EGARCH_BETAS = (0.05, 0.1, 0.2), (-0.1, 0.0, 0.1), (0.8, 0.9, 0.95)


def egarch_forecast(folded: DataFrame, alphas=EGARCH_ALPHAS, gammas=EGARCH_GAMMAS, betas=EGARCH_BETAS) -> DataFrame:
    """Log-variance recursion with a sign term over a grid, refit at every fold on the fold's own window."""
    alpha, gamma, beta = zip(*[(a, g, b) for a in alphas for g in gammas for b in betas], strict=True)
    centre = sqrt(2 / pi)

    def step(g, s2, h, e):
        z = e * np.exp(-0.5 * h)
        return (1 - g["beta"]) * np.log(s2) + g["alpha"] * (np.abs(z) - centre) + g["gamma"] * z + g["beta"] * h

    out = grid_forecast(folded, {"alpha": alpha, "gamma": gamma, "beta": beta}, np.log, step, lambda h, e: -0.5 * (h + e * e * np.exp(-h)), np.exp)
    return out.withColumn("persistence", F.col("beta"))


def grid_fit_summary(forecasts: DataFrame, ends: dict[str, tuple[float, float]]) -> DataFrame:
    """Per asset: fits, their mean persistence, and the share whose parameters all lie inside their grids."""
    inside = F.lit(True)
    for name, (lo, hi) in ends.items():
        inside &= (F.col(name) > lo) & (F.col(name) < hi)
    fits = forecasts.groupBy("asset", "fold_idx").agg(F.first("persistence").alias("p"), F.first(inside.cast("double")).alias("inside"))
    return fits.groupBy("asset").agg(F.count("*").alias("n_fits"), F.avg("p").alias("persistence"), F.avg("inside").alias("inside_share"))
