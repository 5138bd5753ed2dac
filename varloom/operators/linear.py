"""Least squares from aggregated moments.

Rows are reduced to sums of products by Spark's own partial aggregation; only the small dense systems, one
per key, go through a vectorised solve.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Workers receive these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def gram(df: DataFrame, x, y: str, by, weight: Column | None = None) -> DataFrame:
    """Per key: n, upper triangle of X'X (row by row), X'y and y'y as sums."""
    w = F.lit(1.0) if weight is None else weight
    cols = [c if isinstance(c, Column) else F.col(c) for c in x]
    xx = [F.sum(w * cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    xy = [F.sum(w * c * F.col(y)) for c in cols]
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.sum(w * F.col(y) * F.col(y)).alias("yy"),
        F.array(*[F.max(c) - F.min(c) for c in cols]).alias("spread"),
    )


def _unpack(flat, k: int) -> np.ndarray:
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = flat
    return full + np.triu(full, 1).T


@pandas_udf(DoubleType())
def explained_form(xx: pd.Series, xy: pd.Series) -> pd.Series:
    """y'X (X'X)^-1 X'y per row; null when the design does not have full rank."""

    def one(flat, b):
        if flat is None or b is None:
            return None
        b = np.asarray(b, dtype=float)
        a = _unpack(np.asarray(flat, dtype=float), len(b))
        if not np.isfinite(a).all() or np.linalg.matrix_rank(a, tol=1e-10) < len(b):
            return None
        return float(b @ np.linalg.solve(a, b))

    return pd.Series([one(p, q) for p, q in zip(xx, xy)], dtype="float64")


HELD_BYTES = 64 << 20
ROWS_AT_ONCE = 1024


def product_sums(rows: DataFrame, keys: str, weighted: bool = False) -> DataFrame:
    """Sums of w v v' (upper triangle, row by row) of the array column ``v``: per key and place of the array column ``w``.

    ``keys`` is a schema string whose columns stand next to ``v``. All weights of a row share its products, so many
    weighted fits cost one matrix product. Every task sends a row (keys, slot, cells) per key and place, or
    several once it holds HELD_BYTES; they are still to be added up.
    """
    names = [k.split()[0] for k in keys.split(", ")]

    def rows_of(held: dict) -> Iterator[pa.RecordBatch]:
        for key, total in held.items():
            cols = {n: pa.array([k] * len(total)) for n, k in zip(names, key, strict=True)}
            yield pa.RecordBatch.from_pydict({**cols, "slot": pa.array(np.arange(len(total)), pa.int32()), "cells": pa.array(list(total))})

    def of_part(v: np.ndarray, w: np.ndarray | None) -> np.ndarray:
        at = np.triu_indices(v.shape[1])
        if w is None:
            return (v.T @ v)[at][None, :]
        pieces = range(0, len(v), ROWS_AT_ONCE)
        return sum(w[i : i + ROWS_AT_ONCE].T @ (v[i : i + ROWS_AT_ONCE, at[0]] * v[i : i + ROWS_AT_ONCE, at[1]]) for i in pieces)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for key, part in batch.to_pandas().groupby(names, sort=False):
                new = of_part(np.vstack(part["v"].to_numpy()), np.vstack(part["w"].to_numpy()) if weighted else None)
                size += 0 if key in held else new.nbytes
                held[key] = held[key] + new if key in held else new
            if size >= HELD_BYTES:
                yield from rows_of(held)
                held, size = {}, 0
        yield from rows_of(held)

    return rows.select(*names, "v", *(["w"] if weighted else [])).mapInArrow(sums, f"{keys}, slot int, cells array<double>")


def added(cells: pd.Series, size: int) -> np.ndarray:
    """The whole symmetric matrix of several rows of upper triangles."""
    return _unpack(np.sum(np.vstack(cells.to_numpy()), axis=0), size)


def ridge_fit(head: np.ndarray, tail: np.ndarray | None, own, ridge: float) -> tuple[np.ndarray | None, float]:
    """Coefficients of the columns ``own`` and their residual variance over the tail, from sums of products.

    The last row of the matrices belongs to the target, the last column of ``own`` is the constant, which is not
    penalised. None without a full rank. The variance is a quadratic form of the tail's sums; 0 without a tail.
    """
    left = head[np.ix_(own, own)] + np.diag([float(ridge)] * (len(own) - 1) + [0.0])
    if not np.isfinite(left).all() or np.linalg.matrix_rank(left) < len(own):
        return None, 0.0
    beta = np.linalg.solve(left, head[own, -1])
    if tail is None or tail[own[-1], own[-1]] <= 0:
        return beta, 0.0
    signed = np.append(-beta, 1.0)
    whole = [*own, len(tail) - 1]
    return beta, max(0.0, float(signed @ tail[np.ix_(whole, whole)] @ signed / tail[own[-1], own[-1]]))
