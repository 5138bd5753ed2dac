"""Gates: re-derive published numbers from boards with formulas stated on their own, and compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Comparison tolerances.
RTOL, ATOL = 1e-9, 1e-15
ITEM = ("asset", "table", "item", "quantity")


def status(published: Column, rederived: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    close = F.abs(published - rederived) <= F.lit(ATOL) + F.lit(RTOL) * F.abs(rederived)
    return F.when(~finite(published) | ~finite(rederived), "SKIP").when(close, "OK").otherwise("MISMATCH")


def compare(published: DataFrame, rederived: DataFrame, keys=ITEM) -> DataFrame:
    """One verdict per published number; a number nothing can be derived for is MISSING."""
    known = rederived.select(*keys, F.col("value").alias("rederived"), F.lit(True).alias("_known"))
    j = published.select(*keys, F.col("value").alias("published")).join(known, list(keys), "left")
    diff = F.abs(F.col("published") - F.col("rederived"))
    verdict = F.when(F.col("_known").isNull(), "MISSING").otherwise(status(F.col("published"), F.col("rederived")))
    return j.select(*keys, "published", "rederived", diff.alias("abs_diff"),
                    F.when(F.col("published") != 0, diff / F.abs("published")).otherwise(diff).alias("rel_diff"), verdict.alias("status"))


def melt(table: DataFrame, name: str, item: Column, quantities) -> DataFrame:
    """A wide result table as (asset, table, item, quantity, value)."""
    typed = table.select("asset", F.lit(name).alias("table"), item.alias("item"), *[F.col(q).cast("double").alias(q) for q in quantities])
    return typed.unpivot(["asset", "table", "item"], list(quantities), "quantity", "value")


def rederive_points(board: DataFrame) -> DataFrame:
    """Point metrics in SQL text, sharing no code with the library's own."""
    return board.sparkSession.sql(
        """
        SELECT asset, 'metrics' AS `table`, model AS item, stack(5,
            'n', CAST(count(1) AS DOUBLE),
            'mse', avg(power(yhat - y_true, 2)),
            'rmse', sqrt(avg(power(yhat - y_true, 2))),
            'mae', avg(greatest(yhat - y_true, y_true - yhat)),
            'qlike', avg(y_true / yhat + ln(yhat) - ln(y_true) - 1)) AS (quantity, value)
        FROM {board} WHERE y_true IS NOT NULL AND yhat IS NOT NULL GROUP BY asset, model
        """, board=board)


def rederive_intervals(intervals: DataFrame) -> DataFrame:
    return intervals.sparkSession.sql(
        """
        SELECT asset, 'calibration' AS `table`, concat(method, '@', level_pct) AS item, stack(4,
            'n', CAST(count(1) AS DOUBLE),
            'picp', CAST(count_if(y_true >= lo AND y_true <= hi) AS DOUBLE) / count(1),
            'mpiw', avg(hi) - avg(lo),
            'winkler', avg(hi) - avg(lo) + sum(greatest(lo - y_true, 0D) + greatest(y_true - hi, 0D)) * 2 / (1 - level_pct / 100) / count(1)) AS (quantity, value)
        FROM {rows} WHERE y_true IS NOT NULL GROUP BY asset, method, level_pct
        """, rows=intervals)


def rederive_per_regime(board: DataFrame, states: DataFrame) -> DataFrame:
    """Per-state QLIKE with the lag taken by row number on the full state history."""
    return board.sparkSession.sql(
        """
        WITH numbered AS (SELECT asset, date, state, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM {states}),
        shifted AS (SELECT n.asset, n.date, p.state FROM numbered n JOIN numbered p ON p.asset = n.asset AND p.i = n.i - 1)
        SELECT b.asset, 'per_regime' AS `table`, concat(b.model, '/', s.state) AS item, stack(2,
            'n', CAST(count(1) AS DOUBLE), 'qlike', avg(y_true / yhat + ln(yhat) - ln(y_true) - 1)) AS (quantity, value)
        FROM {board} b JOIN shifted s ON s.asset = b.asset AND s.date = b.date GROUP BY b.asset, b.model, s.state
        """, board=board, states=states)


SHIFTED = """numbered AS (SELECT asset, date, state, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM {states}),
        shifted AS (SELECT n.asset, n.date, p.state FROM numbered n JOIN numbered p ON p.asset = n.asset AND p.i = n.i - 1)"""


def rederive_per_regime_intervals(intervals: DataFrame, states: DataFrame) -> DataFrame:
    return intervals.sparkSession.sql(
        f"""
        WITH {SHIFTED}
        SELECT r.asset, 'per_regime_intervals' AS `table`, concat(r.method, '@', r.level_pct, '/', s.state) AS item, stack(4,
            'n', CAST(count(1) AS DOUBLE),
            'picp', CAST(count_if(y_true >= lo AND y_true <= hi) AS DOUBLE) / count(1),
            'mpiw', avg(hi) - avg(lo),
            'winkler', avg(hi) - avg(lo) + sum(greatest(lo - y_true, 0D) + greatest(y_true - hi, 0D)) * 2 / (1 - r.level_pct / 100) / count(1)) AS (quantity, value)
        FROM {{rows}} r JOIN shifted s ON s.asset = r.asset AND s.date = r.date WHERE y_true IS NOT NULL GROUP BY r.asset, r.method, r.level_pct, s.state
        """, rows=intervals, states=states)


def rederive_master(points: DataFrame, intervals: DataFrame, states: DataFrame, level_pct: int = 90) -> DataFrame:
    """The master table's point, transitional-state and interval scores; a model without intervals has none."""
    return points.sparkSession.sql(
        f"""
        WITH {SHIFTED},
        p AS (SELECT asset, model, avg(power(yhat - y_true, 2)) AS mse, avg(greatest(yhat - y_true, y_true - yhat)) AS mae,
            avg(y_true / yhat + ln(yhat) - ln(y_true) - 1) AS qlike FROM {{points}} GROUP BY asset, model),
        t AS (SELECT b.asset, b.model, CAST(count(1) AS DOUBLE) AS n_transitional, avg(y_true / yhat + ln(yhat) - ln(y_true) - 1) AS qlike_transitional
            FROM {{points}} b JOIN shifted s ON s.asset = b.asset AND s.date = b.date WHERE s.state = 1 GROUP BY b.asset, b.model),
        i AS (SELECT asset, method AS model, CAST(count_if(y_true >= lo AND y_true <= hi) AS DOUBLE) / count(1) AS picp, avg(hi) - avg(lo) AS mpiw
            FROM {{rows}} WHERE level_pct = {int(level_pct)} AND y_true IS NOT NULL GROUP BY asset, method)
        SELECT p.asset, 'master' AS `table`, p.model AS item, stack(7, 'mse', mse, 'mae', mae, 'qlike', qlike, 'n_transitional', n_transitional,
            'qlike_transitional', qlike_transitional, 'picp', picp, 'mpiw', mpiw) AS (quantity, value)
        FROM p LEFT JOIN t ON t.asset = p.asset AND t.model = p.model LEFT JOIN i ON i.asset = p.asset AND i.model = p.model
        """, points=points, rows=intervals, states=states)


def cross_table(published: DataFrame) -> DataFrame:
    """The same quantity of the same item printed in two tables must agree."""
    a = published.select("asset", "item", "quantity", F.col("table").alias("table_a"), F.col("value").alias("value_a"))
    b = published.select("asset", "item", "quantity", F.col("table").alias("table_b"), F.col("value").alias("value_b"))
    j = a.join(b, ["asset", "item", "quantity"]).where(F.col("table_a") < F.col("table_b"))
    return j.withColumn("status", status(F.col("value_a"), F.col("value_b")))


def status_counts(checks: DataFrame) -> DataFrame:
    names = ("OK", "MISMATCH", "SKIP", "MISSING")
    return checks.groupBy("table").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in names], F.count("*").alias("total"))


def exit_status(checks: DataFrame) -> DataFrame:
    """One row; exit code 1 when anything is MISMATCH or MISSING."""
    failing = F.count_if(F.col("status").isin("MISMATCH", "MISSING"))
    return checks.agg(F.count("*").alias("n_checks"), failing.alias("n_failing")).withColumn("exit_code", (F.col("n_failing") > 0).cast("int"))


def duplicate_scores(table: DataFrame, value: str = "crps", by=("asset",)) -> DataFrame:
    """Groups of methods that share a bit-identical score; must come back empty."""
    return table.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("method")), ", ").alias("methods")).where("n > 1")


def log_agreement(a: DataFrame, b: DataFrame, value: str = "yhat", tolerance: float = 1e-6) -> DataFrame:
    """Largest, typical and worst-day log deviation between two artefacts."""
    j = a.select("asset", "date", F.col(value).alias("_a")).join(b.select("asset", "date", F.col(value).alias("_b")), ["asset", "date"])
    dev = F.abs(F.ln(F.col("_a") / F.col("_b")))
    return j.withColumn("_d", dev).groupBy("asset").agg(
        F.count("*").alias("n"), F.max("_d").alias("max_dev"), F.stddev_pop("_d").alias("sd_dev"), F.max_by("date", F.struct("_d", "date")).alias("worst_day")
    ).withColumn("within", F.col("max_dev") <= tolerance)
