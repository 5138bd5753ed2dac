"""Walk-forward folds and forecasters that read running training moments instead of refitting per fold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.realized import calendar_window

FORECAST_FLOOR = 1e-12


@dataclass(frozen=True)
class SplitPlan:
    """Date bounds (inclusive) and refit cadence of a walk-forward study."""

    train_end: str = "1998-12-31"
    val_start: str = "1999-01-01"
    val_end: str = "1999-12-31"
    test_start: str = "2000-01-01"
    test_end: str = "2099-12-31"
    refit_every: int = 21
    scheme: str = "anchored"
    min_train: int = 252

    def __post_init__(self):
        bounds = [self.train_end, self.val_start, self.val_end, self.test_start, self.test_end]
        if sorted(bounds) != bounds:
            raise ValueError(f"split bounds must not decrease: {bounds}")
        if self.refit_every < 1:
            raise ValueError("refit_every must be at least 1")
        if self.scheme not in ("anchored", "rolling"):
            raise ValueError("scheme must be 'anchored' or 'rolling'")

    def span(self, part: str) -> tuple[str, str]:
        spans = {
            "test": (self.test_start, self.test_end),
            "val": (self.val_start, self.val_end),
            "val+test": (self.val_start, self.test_end),
        }
        if part not in spans:
            raise ValueError(f"unknown segment {part!r}; known: {sorted(spans)}")
        return spans[part]


def assign_folds(frame: DataFrame, plan: SplitPlan, part: str = "test") -> DataFrame:
    """Adds row position and, on out-of-sample rows, fold number and training extent.

    Out-of-sample rows are contiguous in date order, so everything about a fold follows from two positions
    by arithmetic; no range join between rows and folds is needed.
    """
    lo, hi = plan.span(part)
    w = calendar_window()
    oos = F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    out = (
        frame.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
        .withColumn("is_oos", oos)
        .withColumn("oos_pos", F.when(F.col("is_oos"), F.sum(F.col("is_oos").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    )
    initial = F.col("pos") - F.col("oos_pos")
    end_pos = F.col("pos") - F.col("oos_pos") % plan.refit_every - 1
    length = end_pos + 1
    if plan.scheme == "rolling":
        length = F.least(length, initial)
    usable = F.col("is_oos") & (end_pos >= 0) & (length >= plan.min_train)
    return (
        out.withColumn("train_end_pos", F.when(usable, end_pos))
        .withColumn("train_len", F.when(usable, length))
        .withColumn("train_start_pos", F.when(usable, end_pos - length + 1))
        .withColumn("fold_idx", F.when(usable, F.floor(F.col("oos_pos") / plan.refit_every)))
    )


def fold_table(folded: DataFrame) -> DataFrame:
    """One row per asset and fold: training and prediction bounds, all inclusive."""
    dates = folded.select("asset", F.col("pos"), F.col("date").alias("d"))
    folds = (
        folded.where(F.col("fold_idx").isNotNull())
        .groupBy("asset", "fold_idx")
        .agg(
            F.min("date").alias("predict_start"), F.max("date").alias("predict_end"),
            F.min("train_end_pos").alias("train_end_pos"), F.min("train_len").alias("n_train"),
            F.count("*").alias("n_predict"),
        )
        .withColumn("train_start_pos", F.col("train_end_pos") - F.col("n_train") + 1)
    )
    ends = dates.select("asset", F.col("pos").alias("train_end_pos"), F.col("d").alias("train_end"))
    starts = dates.select("asset", F.col("pos").alias("train_start_pos"), F.col("d").alias("train_start"))
    return (
        folds.join(ends, ["asset", "train_end_pos"]).join(starts, ["asset", "train_start_pos"])
        .select("asset", "fold_idx", "train_start", "train_end", "predict_start", "predict_end", "n_train", "n_predict")
    )


def at_train_end(values: dict[str, Column], folded: DataFrame) -> DataFrame:
    """Freezes running values at the end of each fold's training window on the fold's own rows."""
    w = calendar_window()
    with_moments = folded.withColumn("_m", F.struct(*[v.alias(k) for k, v in values.items()]))
    lagged = with_moments.withColumn("_m", F.lag("_m").over(w))
    inside_fold = Window.partitionBy("asset", "fold_idx").orderBy("date")
    frozen = lagged.where(F.col("fold_idx").isNotNull()).withColumn("_m", F.first("_m").over(inside_fold))
    return frozen.select(*[c for c in frozen.columns if c != "_m"], "_m.*")


def _running() -> Window:
    return calendar_window().rowsBetween(Window.unboundedPreceding, 0)


def ols_moments(x, y: str, frame_window=None) -> dict[str, Column]:
    """Centred second moments of regressors and target over everything seen so far."""
    run = frame_window if frame_window is not None else _running()
    out = {"n": F.count(y).over(run), f"m_{y}": F.avg(y).over(run), f"v_{y}": F.var_pop(y).over(run)}
    for i, a in enumerate(x):
        out[f"m_{a}"] = F.avg(a).over(run)
        out[f"c_{a}_{y}"] = F.covar_pop(a, y).over(run)
        for b in x[i:]:
            out[f"c_{a}_{b}"] = F.var_pop(a).over(run) if a == b else F.covar_pop(a, b).over(run)
    return out


def bounded_moments(folded: DataFrame, x, ys, steps=()) -> DataFrame:
    """Moments over each fold's own window, on the fold's rows, merged from summaries of pieces.

    The bounds of all windows cut the calendar into pieces, each summed up once by count, means and centred second
    moments. A window is a run of whole pieces, met by an equality of piece numbers. Pieces are merged about the
    first one's means, so no digits are lost where the level is large against the spread. ``steps`` are columns
    whose standard deviation is wanted.
    """
    names = [*x, *ys, *steps]
    products = [(a, b) for i, a in enumerate(x) for b in (*x[i:], *ys)] + [(v, v) for v in (*ys, *steps)]
    key = ["asset", "fold_idx"]
    folds = folded.where(F.col("fold_idx").isNotNull()).groupBy(*key).agg(F.min("train_start_pos").alias("_ts"), F.min("train_end_pos").alias("_te"))
    cuts = folds.select("asset", F.explode(F.array("_ts", F.col("_te") + 1)).alias("pos")).distinct().withColumn("_cut", F.lit(1))
    cut = F.coalesce("_cut", F.lit(0))
    numbered = folded.select("asset", "date", "pos", *names).join(cuts, ["asset", "pos"], "left").withColumn("_piece", F.sum(cut).over(_running()))
    pieces = numbered.groupBy("asset", "_piece").agg(
        F.min("pos").alias("_ts"), F.max("pos").alias("_te"), F.count(ys[0]).alias("_n"), F.struct(*[F.avg(a).alias(a) for a in names]).alias("_m"),
        F.struct(*[(F.var_pop(a) if a == b else F.covar_pop(a, b)).alias(f"{a}_{b}") for a, b in products]).alias("_c"))
    firsts = pieces.select("asset", "_ts", F.col("_piece").alias("_first"))
    lasts = pieces.select("asset", "_te", F.col("_piece").alias("_last"))
    spans = folds.join(firsts, ["asset", "_ts"]).join(lasts, ["asset", "_te"]).select(*key, F.explode(F.sequence("_first", "_last")).alias("_piece"))
    runs = spans.join(pieces.drop("_ts", "_te"), ["asset", "_piece"]).withColumn("_r", F.first("_m").over(Window.partitionBy(*key).orderBy("_piece")))
    off = {a: F.col(f"_m.{a}") - F.col(f"_r.{a}") for a in names}
    n = F.col("_n")
    sums = runs.groupBy(*key).agg(
        F.sum(n).alias("n"), F.first("_r").alias("_r"),
        *[F.sum(n * off[a]).alias(f"_o_{a}") for a in names],
        *[F.sum(n * (F.col(f"_c.{a}_{b}") + off[a] * off[b])).alias(f"_p_{a}_{b}") for a, b in products])
    mean_off = {a: F.col(f"_o_{a}") / F.col("n") for a in names}
    centred = {(a, b): F.col(f"_p_{a}_{b}") / F.col("n") - mean_off[a] * mean_off[b] for a, b in products}
    named = {(f"v_{a}" if a in ys else f"sd_{a}" if a in steps else f"c_{a}_{b}"): (F.sqrt(F.greatest(v, F.lit(0.0))) if a in steps else v) for (a, b), v in centred.items()}
    moments = sums.select(*key, "n", *[(F.col(f"_r.{a}") + mean_off[a]).alias(f"m_{a}") for a in names], *[v.alias(k) for k, v in named.items()])
    return folded.where(F.col("fold_idx").isNotNull()).join(moments, key)


def solve3(x, y: str) -> dict[str, Column]:
    """Slopes of a three-regressor least squares from its centred moments, in closed form."""
    a, b, c = x
    s = lambda p, q: F.col(f"c_{p}_{q}")
    aa, ab, ac, bb, bc, cc = s(a, a), s(a, b), s(a, c), s(b, b), s(b, c), s(c, c)
    ya, yb, yc = s(a, y), s(b, y), s(c, y)
    det = aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac)
    da = ya * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc)
    db = aa * (yb * cc - bc * yc) - ya * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac)
    dc = aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - bb * ac)
    return {k: F.try_divide(v, det) for k, v in zip(x, (da, db, dc))}


HAR_LAGS = ("rv_d", "rv_w", "rv_m")


def har_fits(folded: DataFrame, scheme: str = "anchored") -> DataFrame:
    """Random-walk, level and log lag-regression forecasts on every out-of-sample row, in one pass.

    Level and log targets share the regressor moments, so both fits cost one Window over the panel. With a
    rolling scheme each fold's moments begin at its own first training row.
    """
    logged = folded.withColumn("log_rv", F.ln(F.greatest("rv", F.lit(FORECAST_FLOOR))))
    logged = logged.withColumn("step", F.ln("rv") - F.ln("rv_d"))
    targets = (("rv", "lev"), ("log_rv", "log"))
    if scheme == "rolling":
        out = bounded_moments(logged, HAR_LAGS, ("rv", "log_rv"), ("step",))
    else:
        values = {**ols_moments(HAR_LAGS, "rv"), **ols_moments(HAR_LAGS, "log_rv")}
        values["sd_step"] = F.stddev_pop("step").over(_running())
        out = at_train_end(values, logged)
    out = out.withColumns({f"{tag}_{k}": v for y, tag in targets for k, v in solve3(HAR_LAGS, y).items()})

    def dot(tag: str, suffix: str) -> Column:
        return sum(F.col(f"{tag}_{n}") * F.col(suffix.format(n)) for n in HAR_LAGS)

    out = out.withColumns(
        {f"{tag}_ex": dot(tag, "c_{}_" + y) for y, tag in targets}
        | {f"{tag}_const": F.col(f"m_{y}") - dot(tag, "m_{}") for y, tag in targets}
    )
    out = out.withColumns(
        {f"{tag}_r2": F.try_divide(F.col(f"{tag}_ex"), F.col(f"v_{y}")) for y, tag in targets}
        | {f"{tag}_s2": F.col("n") * (F.col(f"v_{y}") - F.col(f"{tag}_ex")) / (F.col("n") - 4) for y, tag in targets}
        | {f"{tag}_lin": F.col(f"{tag}_const") + dot(tag, "{}") for y, tag in targets}
    )
    floor = F.lit(FORECAST_FLOOR)
    return out.withColumns({
        "f_rw": F.greatest(F.col("rv_d"), floor),
        "f_har": F.greatest(F.col("lev_lin"), floor),
        "f_loghar": F.greatest(F.exp(F.col("log_lin") + F.col("log_s2") / 2), floor),
        "floored": F.col("lev_lin") < floor,
    })


BASELINES = {"RW-RV": "f_rw", "HAR-RV": "f_har", "HAR-RV-log": "f_loghar"}


def to_board(wide: DataFrame, models: dict[str, str], y: str = "rv", keep=()) -> DataFrame:
    """Wide forecasts to the long board (asset, date, model, yhat, y_true) with the columns named in ``keep``."""
    named = wide.select("asset", "date", *keep, F.col(y).alias("y_true"), *[F.col(c).alias(m) for m, c in models.items()])
    return named.unpivot(["asset", "date", *keep, "y_true"], list(models), "model", "yhat").select(
        "asset", "date", *keep, "model", "yhat", "y_true"
    )


def walk_forward(forecasters: dict, frame: DataFrame, plan: SplitPlan, part: str = "test") -> DataFrame:
    """Runs named forecasters, each a callable (folded frame) -> (asset, date, yhat), into one board.

    Every forecaster contributes one lazily planned branch; nothing loops over folds.
    """
    folded = assign_folds(frame, plan, part)
    actual = folded.where(F.col("fold_idx").isNotNull()).select("asset", "date", F.col("rv").alias("y_true"))
    out = None
    for name, forecaster in forecasters.items():
        branch = forecaster(folded).select("asset", "date", F.lit(name).alias("model"), "yhat")
        out = branch if out is None else out.unionByName(branch)
    return out.join(actual, ["asset", "date"]).select("asset", "date", "model", "yhat", "y_true")


def guard_violations(board: DataFrame, folds: DataFrame) -> DataFrame:
    """Forecasts that their own fold must not have made, with the reason; must come back empty.

    ``board`` says in ``fold_idx`` whose training window each forecast came from. A forecast is at fault if
    that fold doesn't exist, if its date lies outside the fold's prediction window or not after its training
    window, or if it is not the only one of its asset, date and model.
    """
    windows = folds.select("asset", "fold_idx", "train_end", "predict_start", "predict_end")
    twins = Window.partitionBy("asset", "date", "model")
    rows = board.withColumn("_n", F.count("*").over(twins)).join(windows, ["asset", "fold_idx"], "left")
    reason = (
        F.when(F.col("predict_start").isNull(), "no such fold")
        .when(F.col("date") <= F.col("train_end"), "inside training")
        .when(~F.col("date").between(F.col("predict_start"), F.col("predict_end")), "outside window")
        .when(F.col("_n") > 1, "not the only one")
    )
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_n", "train_end", "predict_start", "predict_end")


def coverage_report(board: DataFrame, folded: DataFrame, models) -> DataFrame:
    """Share of out-of-sample dates each of ``models`` has a finite forecast for; a silent model has share 0."""
    days = folded.where("is_oos").select("asset", "date")
    n_days = days.groupBy("asset").agg(F.count("*").alias("n_days")).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    have = board.where(F.col("yhat").isNotNull() & ~F.isnan("yhat")).join(days, ["asset", "date"])
    have = have.groupBy("asset", "model").agg(F.countDistinct("date").alias("n_forecasts"))
    out = n_days.join(have, ["asset", "model"], "left").withColumn("n_forecasts", F.coalesce("n_forecasts", F.lit(0)))
    return out.withColumn("share", F.col("n_forecasts") / F.col("n_days"))
