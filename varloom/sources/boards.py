"""Reading and reshaping stored boards: forecasts, intervals, result tables, regime series."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: naming of interval columns, <method>_lo<percent> and <method>_hi<percent>.
INTERVAL_COLUMN = re.compile(r"^(?P<method>.+)_(?P<side>lo|hi)(?P<level>\d{1,2})$")
KEYS = ("asset", "date")


def intervals_wide(intervals: DataFrame) -> DataFrame:
    """Long intervals to the wide naming convention, for export."""
    tag = F.concat_ws("", F.col("method"), F.lit("_"), F.col("side"), F.format_string("%02d", F.col("level_pct").cast("int")))
    long = intervals.unpivot([*KEYS, "method", "level_pct", "y_true"], ["lo", "hi"], "side", "v").withColumn("tag", tag)
    return long.groupBy(*KEYS).pivot("tag").agg(F.max("v")).join(
        intervals.groupBy(*KEYS).agg(F.max("y_true").alias("y_true")), list(KEYS)
    )


def discover_intervals(board: DataFrame) -> DataFrame:
    """Wide board to long intervals, for every method and level that has both of its columns."""
    sides: dict[tuple[str, int], dict[str, str]] = {}
    for name in board.columns:
        m = INTERVAL_COLUMN.match(name)
        if m:
            sides.setdefault((m["method"], int(m["level"])), {})[m["side"]] = name
    rows = [
        F.struct(F.lit(method).alias("method"), F.lit(level).alias("level_pct"), F.col(f"`{c['lo']}`").alias("lo"), F.col(f"`{c['hi']}`").alias("hi"))
        for (method, level), c in sorted(sides.items()) if len(c) == 2
    ]
    if not rows:
        raise ValueError("no interval columns found")
    keep = [c for c in ("asset", "date", "y_true") if c in board.columns]
    return board.select(*keep, F.explode(F.array(*rows)).alias("i")).select(*keep, "i.*")


def attach_complete(rows: DataFrame, states: DataFrame, keys=KEYS, required: str = "state") -> DataFrame:
    """Left join that fails the query when a row finds no partner."""
    joined = rows.join(states, list(keys), "left")
    checked = F.when(F.col(required).isNull(), F.raise_error(F.lit(f"no {required} for an evaluated row"))).otherwise(F.col(required))
    return joined.withColumn(required, checked)


def load_boards(spark: SparkSession, glob: str) -> DataFrame:
    """Every matching parquet board as long forecasts with the stem of its source file."""
    raw = spark.read.option("mergeSchema", "true").parquet(glob)
    numeric = [n for n, t in raw.dtypes if t in ("double", "float", "int", "bigint") and n not in (*KEYS, "y_true")]
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.parquet)?/[^/]*$", 1)
    keys = [c for c in (*KEYS, "y_true") if c in raw.columns]
    tagged = raw.select(*keys, stem.alias("source"), *[F.col(f"`{n}`").cast("double").alias(n) for n in numeric])
    return tagged.unpivot([*keys, "source"], numeric, "model", "yhat").where(F.col("yhat").isNotNull())


def load_tables(spark: SparkSession, glob: str, suffix: str) -> DataFrame:
    """Published CSV result tables whose name ends in a suffix, with the table name as a column."""
    raw = spark.read.option("header", "true").csv(glob)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.csv)?/[^/]*$", 1)
    return raw.withColumn("table", name).where(F.col("table").endswith(suffix))


def profile_of(stem, prefixes):
    """Profile part of a file stem: the first matching phase prefix is dropped."""
    out = stem
    for p in reversed(list(prefixes)):
        out = F.when(stem.startswith(p), F.substr(stem, F.lit(len(p) + 1))).otherwise(out)
    return out


def regime_source(stem, prefixes, headline: str, comparator: str, suffix: str = "_hmm"):
    """Which regime series and estimator a board is to be read with."""
    profile = profile_of(stem, prefixes)
    other = profile.endswith(suffix)
    base = F.when(other, F.regexp_replace(profile, f"{suffix}$", "")).otherwise(profile)
    return F.struct(base.alias("profile"), F.when(other, F.lit(comparator)).otherwise(F.lit(headline)).alias("estimator"))
