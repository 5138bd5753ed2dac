"""Per-row losses on the variance scale, and their registry by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the floor both arguments of the QLIKE ratio are clipped at.
RATIO_FLOOR = 1e-16


def qlike_loss(y: Column, h: Column) -> Column:
    r = F.greatest(y, F.lit(RATIO_FLOOR)) / F.greatest(h, F.lit(RATIO_FLOOR))
    return r - F.ln(r) - F.lit(1.0)


def squared_error(y: Column, h: Column) -> Column:
    return (y - h) * (y - h)


def absolute_error(y: Column, h: Column) -> Column:
    return F.abs(y - h)


def pinball(y: Column, q: Column, tau) -> Column:
    tau = tau if isinstance(tau, Column) else F.lit(float(tau))
    e = y - q
    return F.greatest(tau * e, (tau - F.lit(1.0)) * e)


def winkler(y: Column, lo: Column, hi: Column, alpha: Column) -> Column:
    penalty = (
        F.when(y < lo, F.lit(2.0) / alpha * (lo - y)).when(y > hi, F.lit(2.0) / alpha * (y - hi)).otherwise(F.lit(0.0))
    )
    return hi - lo + penalty


LOSSES = {"qlike": qlike_loss, "mse": squared_error, "se": squared_error}


def loss_by_name(name: str):
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {sorted(LOSSES)}")
    return LOSSES[name]
