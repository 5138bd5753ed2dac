"""Leakage-safe daily features, the modelling frame and named feature registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.math import all_finite
from varloom.operators.realized import calendar_window, open_to_close, log_return, yang_zhang

TARGETS = ("yang_zhang", "intraday", "spliced")
HAR_WINDOWS = {"rv_w": 5, "rv_m": 22}


def har_lags(df: DataFrame, col: str = "rv") -> DataFrame:
    """Yesterday's value and its 5 and 22 day means, full windows only, never reading the current day."""
    w = calendar_window()
    out = df.withColumn("rv_d", F.lag(col).over(w))
    for name, n in HAR_WINDOWS.items():
        past = w.rowsBetween(-n, -1)
        out = out.withColumn(name, F.when(F.count(col).over(past) == n, F.avg(col).over(past)))
    return out


def select_target(which: str, ohlc: DataFrame | None = None, intraday: DataFrame | None = None,
                  spliced: DataFrame | None = None, window: int = 21) -> DataFrame:
    """The chosen variance target as (asset, date, rv), positive rows only."""
    if which == "yang_zhang":
        source = yang_zhang(ohlc, window)
    elif which == "intraday":
        source = intraday
    elif which == "spliced":
        source = spliced
    else:
        raise ValueError(f"unknown target {which!r}; known: {TARGETS}")
    return source.where(F.col("rv") > 0).select("asset", "date", "rv")


def daily_returns(ohlc: DataFrame) -> DataFrame:
    return ohlc.select("asset", "date", log_return("close").alias("log_return"), open_to_close().alias("oc_log_return"))


def modelling_frame(ohlc: DataFrame, target: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Calendar inner join of returns, target, lags and an optional market-wide series; incomplete rows go."""
    frame = daily_returns(ohlc).join(har_lags(target), ["asset", "date"], "inner")
    names = ["log_return", "oc_log_return", "rv", "rv_d", "rv_w", "rv_m"]
    if second is not None:
        frame = frame.join(second, ["date"], "inner")
        names = [*names, "vix_close"]
    return frame.where(all_finite(*names)).select("asset", "date", *names)


def ohlc_frame(ohlc: DataFrame, window: int = 21) -> DataFrame:
    """The same frame when the target comes from OHLC itself: one shuffle on asset and no join."""
    names = ["log_return", "oc_log_return", "rv", "rv_d", "rv_w", "rv_m"]
    base = yang_zhang(ohlc, window).select(
        "asset", "date", "rv", log_return("close").alias("log_return"), open_to_close().alias("oc_log_return")
    )
    return har_lags(base.where(F.col("rv") > 0)).where(all_finite(*names)).select("asset", "date", *names)


def attrition(ohlc: DataFrame, target: DataFrame, second: DataFrame | None, warn_share: float = 0.02) -> DataFrame:
    """Rows of the target lost to the calendar join and to warm-up, per asset, from one pass over the join."""
    flagged = har_lags(target).join(
        daily_returns(ohlc).withColumn("_returns", F.lit(1)), ["asset", "date"], "left"
    )
    names = ["log_return", "oc_log_return", "rv", "rv_d", "rv_w", "rv_m"]
    joined = F.col("_returns").isNotNull()
    if second is not None:
        flagged = flagged.join(second.withColumn("_second", F.lit(1)), ["date"], "left")
        joined = joined & F.col("_second").isNotNull()
        names = [*names, "vix_close"]
    counts = flagged.groupBy("asset").agg(
        F.count("*").alias("n_target"),
        F.count_if(joined).alias("n_joined"),
        F.count_if(joined & all_finite(*names)).alias("n_final"),
    )
    lost = F.col("n_target") - F.col("n_joined")
    return counts.select(
        "asset", "n_target", "n_joined", "n_final",
        lost.alias("lost_to_join"),
        (F.col("n_joined") - F.col("n_final")).alias("lost_to_warmup"),
        (lost / F.col("n_target") > warn_share).alias("warn"),
    )


# Named inputs of the lookback regressions and of the regime models.
FORECAST_FEATURES: dict[str, Column] = {}
REGIME_FEATURES: dict[str, Column] = {}


def _registries() -> None:
    c = F.col
    FORECAST_FEATURES.update(
        log_rv=F.ln(c("rv")), rv=c("rv"), log_return=c("log_return"), oc_log_return=c("oc_log_return"),
        abs_log_return=F.abs(c("log_return")), abs_oc_return=F.abs(c("oc_log_return")),
        log_rv_d=F.ln(c("rv_d")), log_rv_w=F.ln(c("rv_w")), log_rv_m=F.ln(c("rv_m")),
        vix_close=c("vix_close"), log_vix=F.ln(c("vix_close")),
        reg_p0=c("reg_p0"), reg_p1=c("reg_p1"), reg_p2=c("reg_p2"),
    )
    REGIME_FEATURES.update(
        ret=c("log_return"), oc_ret=c("oc_log_return"), abs_ret=F.abs(c("log_return")),
        log_rv=F.ln(c("rv")), log_rv_d=F.ln(c("rv_d")),
    )


REGIME_FEATURE_SETS = {"returns": ("ret",), "returns_logrv": ("ret", "log_rv")}


def named_projection(frame: DataFrame, names, registry: dict[str, Column], **extra: Column) -> DataFrame:
    """Project named features (and extra columns) and drop rows where any of them is not finite."""
    if not registry:
        _registries()
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise KeyError(f"unknown features {unknown}; known: {sorted(registry)}")
    out = frame.select(
        "asset", "date", *[registry[n].alias(n) for n in names], *[c.alias(n) for n, c in extra.items()]
    )
    return out.where(all_finite(*names, *extra))


def forecast_features(frame: DataFrame, names, target: Column | None = None) -> DataFrame:
    """Named inputs next to the regression target, by default the log of the variance."""
    return named_projection(frame, names, FORECAST_FEATURES, y=F.ln("rv") if target is None else target)


def regime_features(frame: DataFrame, feature_set: str = "returns") -> DataFrame:
    if feature_set not in REGIME_FEATURE_SETS:
        raise KeyError(f"unknown feature set {feature_set!r}; known: {sorted(REGIME_FEATURE_SETS)}")
    return named_projection(frame, REGIME_FEATURE_SETS[feature_set], REGIME_FEATURES)


def rolling_abs_return(col: str = "log_return", n: int = 21) -> Column:
    full = calendar_window().rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(full) == n, F.avg(F.abs(F.col(col))).over(full))


def short_mean(col: str, n: int) -> Column:
    """Trailing mean that allows partial windows at the start of a series."""
    return F.avg(col).over(calendar_window().rowsBetween(-(n - 1), 0))


def supervised_windows(df: DataFrame, lookback: int, names) -> DataFrame:
    """Rows t-lookback .. t-1 of the named columns as one array; rows without a full window go."""
    past = calendar_window().rowsBetween(-lookback, -1)
    windowed = df.withColumn("x", F.collect_list(F.struct(*names)).over(past))
    return windowed.where(F.size("x") == lookback)


def keep_first(df: DataFrame, keys, order_by) -> DataFrame:
    """One row per key: the first under a total order. A map-side combined minimum, not a sort per key."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*order_by)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("_row")).select(*keys, "_row.*")


def rank_bins(value: str, bins: int, by=("asset",)) -> Column:
    """Equal-count bins floor(rank * bins / n), ties broken by date."""
    ranked = Window.partitionBy(*by).orderBy(value, "date")
    whole = Window.partitionBy(*by)
    return F.least(F.floor((F.row_number().over(ranked) - 1) * bins / F.count("*").over(whole)), F.lit(bins - 1)).cast("int")


def lag_one_correlation(df: DataFrame, col: str = "rv") -> DataFrame:
    lagged = df.withColumn("_prev", F.lag(col).over(calendar_window()))
    return lagged.groupBy("asset").agg(F.corr(col, "_prev").alias("acf1"))


def next_date() -> Column:
    """Trading day the forecast made at this row is for."""
    return F.lead("date").over(calendar_window())


def segment(train_end: str, val_start: str, val_end: str, test_start: str, test_end: str) -> Column:
    d = F.col("date")
    bounds = [train_end, val_start, val_end, test_start, test_end]
    if sorted(bounds) != bounds:
        raise ValueError(f"split bounds must not decrease: {bounds}")
    return (
        F.when(d <= F.lit(train_end).cast("date"), "train")
        .when(d.between(F.lit(val_start).cast("date"), F.lit(val_end).cast("date")), "val")
        .when(d.between(F.lit(test_start).cast("date"), F.lit(test_end).cast("date")), "test")
    )
