"""Files in and out: the long realised-measure library, intraday bars, panels, result tables, sidecars."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.features import keep_first
from varloom.session import shared_folder

# Column names seen across vintages of the files.
SYMBOL_NAMES = ("symbol", "ticker", "asset")
DATE_NAMES = ("date", "dates", "datetime", "obs_date", "index")
TIME_NAMES = ("timestamp", "datetime", "date", "time", "dt")
PRICE_NAMES = ("close", "price", "last", "adj_close")
PROBE_ROWS, PROBE_SHARE = 50, 0.8


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that driver and executors share."""
    return f"{shared_folder(spark)}/varloom-{name}-{uuid.uuid4().hex}"


def match_column(columns, names, prefix: str | None = None) -> str | None:
    for c in columns:
        if c.lower() in names or (prefix is not None and c.lower().startswith(prefix)):
            return c
    return None


def local_date(c: Column) -> Column:
    """Calendar date as written, before any offset is applied; null where it does not parse."""
    return F.try_to_timestamp(F.substring(c.cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def resolve_library_columns(df: DataFrame) -> tuple[str, str]:
    """(symbol column, date column); an unnamed date column is found by probing a few rows."""
    symbol = match_column(df.columns, SYMBOL_NAMES)
    if symbol is None:
        raise ValueError(f"no symbol column among {df.columns}")
    date = match_column(df.columns, DATE_NAMES, prefix="unnamed") or match_column(df.columns, ("_c0",))
    if date is None:
        others = [c for c in df.columns if c != symbol]
        head = df.select(*others).limit(PROBE_ROWS).agg(*[F.avg(local_date(F.col(f"`{c}`")).isNotNull().cast("double")).alias(c) for c in others]).first()
        date = next((c for c in others if (head[c] or 0) > PROBE_SHARE), None)
    if date is None:
        raise ValueError(f"no date column among {df.columns}")
    return symbol, date


def load_library(spark: SparkSession, path: str, symbols=None) -> DataFrame:
    """The whole library, or some symbols (any case), as a panel: asset, date and the measures; first row per day wins.

    The local calendar date is kept as written. Files carry no row order once they are split, so "first" is
    the smallest raw timestamp.
    """
    raw = spark.read.option("header", "true").csv(path)
    symbol, date = resolve_library_columns(raw)
    measures = [c for c in raw.columns if c not in (symbol, date)]
    panel = raw.select(
        F.col(f"`{symbol}`").alias("asset"), local_date(F.col(f"`{date}`")).alias("date"), F.col(f"`{date}`").alias("_raw"),
        *[F.col(f"`{c}`").try_cast("double").alias(c) for c in measures])
    if symbols is not None:
        panel = panel.where(F.upper("asset").isin([s.upper() for s in symbols]))
    return keep_first(panel.where(F.col("date").isNotNull()), ["asset", "date"], ["_raw", *measures]).drop("_raw")


def require_symbol(panel: DataFrame, symbol: str, named: int = 25) -> DataFrame:
    """The rows of a symbol; an unknown one is an error that lists the first ``named`` that exist."""
    rows = panel.where(F.upper("asset") == symbol.upper())
    if rows.isEmpty():
        known = [r["asset"] for r in panel.select("asset").distinct().orderBy("asset").limit(named).collect()]
        raise ValueError(f"symbol {symbol!r} not found; some that exist: {known}")
    return rows


def load_bars(spark: SparkSession, path: str, ts_col: str | None = None, price_col: str | None = None) -> DataFrame:
    """Intraday rows from CSV or parquet with detected timestamp and price columns; bad timestamps go."""
    raw = spark.read.parquet(path) if path.rstrip("/").lower().endswith(".parquet") else spark.read.option("header", "true").csv(path)
    ts = ts_col or match_column(raw.columns, TIME_NAMES)
    price = price_col or match_column(raw.columns, PRICE_NAMES)
    if ts is None or price is None:
        raise ValueError(f"cannot tell timestamp and price among {raw.columns}")
    asset = match_column(raw.columns, SYMBOL_NAMES)
    parsed = F.col(f"`{ts}`") if dict(raw.dtypes)[ts].startswith("timestamp") else F.try_to_timestamp(F.col(f"`{ts}`"))
    out = raw.select(
        (F.col(f"`{asset}`") if asset else F.lit("series")).alias("asset"), parsed.alias("ts"), F.col(f"`{price}`").try_cast("double").alias("price"))
    return out.where(F.col("ts").isNotNull())


def write_panel(df: DataFrame, path: str, force: bool = False) -> None:
    """Parquet partitioned by asset; an existing artefact stays unless forced."""
    df.write.partitionBy("asset").mode("overwrite" if force else "errorifexists").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def snapshot(df: DataFrame, source: str) -> DataFrame:
    """One JSON record about a table: rows and date span, stamped with the time of writing."""
    facts = df.agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return facts.select(F.to_json(F.struct(F.lit(source).alias("source"), "rows", "first_date", "last_date", F.current_timestamp().alias("written_at"))).alias("value"))


def write_snapshot(df: DataFrame, path: str, source: str) -> None:
    snapshot(df, source).write.text(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, rows long, first_date date, last_date date, written_at timestamp").json(path)
