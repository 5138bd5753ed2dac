"""Last price per sampling bin as an append-only stream with a watermark.

The bins are what the daily aggregate needs; they are final once the watermark passes, so the batch operator
can turn a stored stream of bins into daily variances without seeing the raw rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_prices(stream: DataFrame, minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """(asset, bin start, last price) per closed bin; rows later than the watermark are not counted."""
    return (
        stream.where(F.col("price") > 0)
        .withWatermark("ts", lateness)
        .groupBy("asset", F.window("ts", f"{minutes} minutes").alias("bin"))
        .agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))
        .select("asset", F.col("bin.start").alias("ts"), "price", F.lit(0).cast("long").alias("seq"))
    )
