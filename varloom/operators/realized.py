"""Realised-variance estimators from intraday rows and from daily OHLC."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS_PER_YEAR = 252
OHLC_COLUMNS = ("open", "high", "low", "close")


def calendar_window() -> Window:
    return Window.partitionBy("asset").orderBy("date")


def require_columns(df: DataFrame, names) -> DataFrame:
    """Case-insensitive check for required columns; returns them lower-cased next to the rest."""
    present = {c.lower(): c for c in df.columns}
    missing = [n for n in names if n not in present]
    if missing:
        raise KeyError(f"missing columns {missing}; present: {sorted(present)}")
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


def log_return(price: str = "close") -> Column:
    w = calendar_window()
    return F.ln(price) - F.ln(F.lag(price).over(w))


def squared_return_variance(price: str = "close", annualize: bool = False) -> Column:
    r = log_return(price)
    return r * r * (TRADING_DAYS_PER_YEAR if annualize else 1)


def parkinson_variance(annualize: bool = False) -> Column:
    hl = F.ln(F.col("high") / F.col("low"))
    return hl * hl / F.lit(4 * log(2.0)) * (TRADING_DAYS_PER_YEAR if annualize else 1)


def rogers_satchell() -> Column:
    hc, ho = F.ln(F.col("high") / F.col("close")), F.ln(F.col("high") / F.col("open"))
    lc, lo = F.ln(F.col("low") / F.col("close")), F.ln(F.col("low") / F.col("open"))
    return hc * ho + lc * lo


def open_to_close() -> Column:
    return F.ln(F.col("close") / F.col("open"))


def volatility_from_variance(rv: str, annualize: bool = False) -> Column:
    return F.sqrt(F.greatest(F.col(rv), F.lit(0.0)) * (TRADING_DAYS_PER_YEAR if annualize else 1))


def yang_zhang(ohlc: DataFrame, window: int = 21, annualize: bool = False, name: str = "rv") -> DataFrame:
    """Rolling overnight + open-to-close + Rogers-Satchell variance over full windows only."""
    if window < 2:
        raise ValueError("window must be at least 2")
    ohlc = require_columns(ohlc, OHLC_COLUMNS)
    full = calendar_window().rowsBetween(-(window - 1), 0)
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    terms = ohlc.select(
        "*",
        F.ln(F.col("open") / F.lag("close").over(calendar_window())).alias("_overnight"),
        open_to_close().alias("_intraday"),
        rogers_satchell().alias("_rs"),
    )
    value = (
        F.var_samp("_overnight").over(full)
        + F.lit(k) * F.var_samp("_intraday").over(full)
        + F.lit(1 - k) * F.avg("_rs").over(full)
    )
    value = F.greatest(value, F.lit(0.0)) * (TRADING_DAYS_PER_YEAR if annualize else 1)
    # greatest() skips nulls, so the full-window gate has to come last.
    gate = F.count("_overnight").over(full) == window
    return terms.withColumn(name, F.when(gate, value)).drop("_overnight", "_intraday", "_rs")


def realized_variance(
    bars: DataFrame, minutes: int | None = 5, grids: int = 1, min_returns: int = 2, annualize: bool = False
) -> DataFrame:
    """Daily sum of squared intraday log returns, averaged over shifted sampling grids.

    Grids are shifted by whole minutes, so raw bars are reduced once, to the last price of every minute, and only
    these are replicated per grid. Bins per day are bounded by the clock, so the lag below never sees more than a
    day of bins however many rows arrive.
    """
    if grids < 1:
        raise ValueError("grids must be at least 1")
    if minutes is None:
        raise ValueError("a sampling frequency is required; use trade_variance for unsampled rows")
    offsets = [int(round(k * minutes / grids)) for k in range(grids)]
    valid = bars.where(F.col("price").isNotNull() & ~F.isnan("price"))
    if grids > 1:
        minute = valid.groupBy("asset", F.window("ts", "1 minute").alias("m")).agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))
        valid = minute.select("asset", F.col("m.start").alias("ts"), F.lit(0).alias("seq"), "price")
    shifted = valid.withColumn("grid", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn(
        "ts", F.col("ts") + F.make_dt_interval(mins=F.col("grid"))
    )
    binned = (
        shifted
        .groupBy("asset", "grid", F.window("ts", f"{minutes} minutes").alias("bin"))
        .agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))
        .select("asset", "grid", F.col("bin.start").alias("bin"), F.to_date("bin.start").alias("date"), "price")
    )
    inside_day = Window.partitionBy("asset", "grid", "date").orderBy("bin")
    returns = binned.withColumn("r", F.ln("price") - F.ln(F.lag("price").over(inside_day)))
    per_grid = returns.groupBy("asset", "date", "grid").agg(
        F.when(F.count("price") - 1 >= min_returns, F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).alias("v"),
        (F.count("price") - 1).alias("n"),
    )
    return (
        per_grid.groupBy("asset", "date")
        .agg((F.avg("v") * (TRADING_DAYS_PER_YEAR if annualize else 1)).alias("rv"), F.max("n").alias("n_returns"))
        .where(F.col("rv").isNotNull())
    )


SLICE_WIDTH = 1 << 22


def day_summary(ticks: DataFrame, order_by, width: int = SLICE_WIDTH) -> DataFrame:
    """Open, high, low, close, trades, returns and squared log returns per asset and day, in trade order.

    One scan and one shuffle of the raw rows serve all of it. One asset and day may hold a large share of all rows,
    so a day is never one task: the first column of the trade order (a whole number) is cut into slices of ``width``,
    which keep its order. Each slice yields its own sums and its first and last price, and only these summaries
    are stitched together.
    """
    slice_of = F.coalesce(F.floor(F.col(order_by[0]) / width), F.lit(-(2**62))).cast("long")
    sliced = ticks.withColumn("_slice", slice_of).withColumn("_lp", F.ln("px"))
    inside = Window.partitionBy("asset", "date", "_slice").orderBy(*order_by)
    steps = sliced.withColumn("_r", F.col("_lp") - F.lag("_lp").over(inside)).withColumn("_i", F.row_number().over(inside))
    slices = steps.groupBy("asset", "date", "_slice").agg(
        F.count("*").alias("_rows"),
        F.count("_lp").alias("_n"),
        F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0)).alias("_ss"),
        F.min_by("px", "_i").alias("_open"),
        F.max_by("px", "_i").alias("_close"),
        F.max("px").alias("_high"),
        F.min("px").alias("_low"),
    )
    across = Window.partitionBy("asset", "date").orderBy("_slice")
    bridged = slices.withColumn("_gap", F.ln("_open") - F.ln(F.lag("_close").over(across)))
    return bridged.groupBy("asset", "date").agg(
        F.min_by("_open", "_slice").alias("open"),
        F.max("_high").alias("high"),
        F.min("_low").alias("low"),
        F.max_by("_close", "_slice").alias("close"),
        F.sum("_rows").alias("n_trades"),
        (F.sum("_n") - 1).alias("n_returns"),
        (F.sum("_ss") + F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0.0))).alias("rv"),
    )


def has_variance(min_returns: int = 2) -> Column:
    """Days of a summary whose realised variance counts."""
    return (F.col("n_returns") >= min_returns) & (F.col("rv") > 0)


def trade_variance(ticks: DataFrame, order_by, min_returns: int = 2, width: int = SLICE_WIDTH) -> DataFrame:
    """Daily sum of squared log returns over every trade of the day, in trade order."""
    return day_summary(ticks, order_by, width).where(has_variance(min_returns)).select("asset", "date", "n_returns", "rv")
