"""Walk-forward forecasts and their leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.sql import QLIKE, TEST_START, define, folds_of, r, rs
from varloom.operators import scoring, walkforward as wf
from varloom.plans import study


@query("A6_leaderboard", f"""
  SELECT asset, model, n, rank() OVER (PARTITION BY asset ORDER BY qlike) AS rank, {rs(mse=8, rmse=8, mae=8, qlike=8)} FROM (
    SELECT asset, model, count(*) AS n, avg((y_true-yhat)*(y_true-yhat)) AS mse, sqrt(avg((y_true-yhat)*(y_true-yhat))) AS rmse,
           avg(abs(y_true-yhat)) AS mae, avg({QLIKE}) AS qlike
    FROM t_board GROUP BY asset, model)""")
def leaderboard(spark, sf_dir):
    out = scoring.leaderboard(study.board(spark, sf_dir))
    return tidy(out, ["asset", "model", "n", "rank"], mse=8, rmse=8, mae=8, qlike=8)
