"""Panel views over the given tables: trades, intraday bars, daily OHLC, second calendar, registry.

Raw rows meet only map-side combined aggregates here. After the daily aggregation there is one row per
asset and date, so every later per-asset window is bounded by the trading calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trade: asset, date, price and the columns that give trades of a day a total order."""
    return (
        read_table(spark, sf_dir, "lineitem")
        .where(F.col("l_quantity") > 0)
        .select(
            F.col("l_returnflag").alias("asset"),
            F.to_date("l_shipdate").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )
    )


def trade_key() -> Column:
    return F.struct(*TRADE_ORDER)


def daily_ohlc(ticks: DataFrame) -> DataFrame:
    """Open, high, low, close per asset and day."""
    return ticks.groupBy("asset", "date").agg(
        F.min_by("px", trade_key()).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", trade_key()).alias("close"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday price observations; non-positive prices have no logarithm and are left out."""
    return (
        read_table(spark, sf_dir, "events")
        .where(F.col("value") > 0)
        .select(F.col("event_type").alias("asset"), "ts", F.col("value").alias("price"), F.col("event_id").alias("seq"))
    )


def second_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market-wide daily series on its own trading calendar."""
    return (
        read_table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(F.avg("o_totalprice").alias("vix_close"))
    )


def asset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset dimension: one row per asset seen in the trades, with session and eligibility flags."""
    region = read_table(spark, sf_dir, "region")
    homes = read_table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    homes = homes.select(F.col("n_nationkey").cast("int").alias("_home"), F.col("r_name").alias("session"))
    assets = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("asset")).distinct()
    return assets.withColumn("_home", F.ascii("asset") % 25).join(homes, "_home", "left").select(
        "asset",
        F.concat(F.lit("^"), F.col("asset")).alias("symbol"),
        F.concat(F.lit("."), F.lower("asset")).alias("measure_symbol"),
        "session",
        (F.col("asset") != "N").alias("vix_feature"),
    )
