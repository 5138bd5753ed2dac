"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.plans.study import Study

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, branches: bool = False):
    """Registers a query; ``sql`` may name any shared common table expression of the sql module.

    A query with ``branches`` reads the study several times and gets it materialised instead of the folder name.
    """

    def register(fn):
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")
        QUERIES[name] = (lambda spark, sf_dir: fn(spark, Study(spark, sf_dir))) if branches else fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame, keys=(), **digits: int) -> DataFrame:
    """Keys as they are, then numeric columns rounded so that two engines print the same value."""
    return df.select(*keys, *[F.round(F.col(c).cast("double"), d).alias(c) for c, d in digits.items()])
