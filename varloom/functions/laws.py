"""Log-normal predictive laws as column expressions."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.functions.math import normal_cdf, normal_quantile

# Floor of a forecast variance, and floor of a log-scale spread.
VARIANCE_FLOOR = 1e-14
SPREAD_FLOOR = 1e-12


def lognormal_quantile(mu: Column, sigma: Column, tau: float) -> Column:
    return F.greatest(F.exp(mu + F.lit(normal_quantile(tau)) * sigma), F.lit(VARIANCE_FLOOR))


def lognormal_interval(mu: Column, sigma: Column, level_pct: int) -> tuple[Column, Column]:
    """Equal-tailed interval; the level is a whole percentage so that tails are exact."""
    if not 0 < level_pct < 100:
        raise ValueError("level must be a percentage between 0 and 100")
    tail = (100 - level_pct) / 200
    return lognormal_quantile(mu, sigma, tail), lognormal_quantile(mu, sigma, 1 - tail)


def lognormal_mean(mu: Column, sigma: Column) -> Column:
    return F.greatest(F.exp(mu + F.lit(0.5) * sigma * sigma), F.lit(VARIANCE_FLOOR))


def lognormal_from_quantiles(lo: Column, mid: Column, hi: Column, lo_tau: float, hi_tau: float) -> tuple[Column, Column]:
    if not 0 < lo_tau < 0.5 < hi_tau < 1:
        raise ValueError("quantile levels must bracket one half")
    spread = normal_quantile(hi_tau) - normal_quantile(lo_tau)
    lo, mid, hi = (F.greatest(c, F.lit(VARIANCE_FLOOR)) for c in (lo, mid, hi))
    sigma = F.greatest((F.ln(hi) - F.ln(lo)) / F.lit(spread), F.lit(SPREAD_FLOOR))
    return F.ln(mid), sigma


def lognormal_mean_from_quantiles(lo, mid, hi, lo_tau: float, hi_tau: float) -> Column:
    mu, sigma = lognormal_from_quantiles(lo, mid, hi, lo_tau, hi_tau)
    return lognormal_mean(mu, sigma)


def lognormal_crps(y: Column, mu: Column, sigma: Column) -> Column:
    """Closed-form CRPS of a log-normal forecast for one observation."""
    s = F.greatest(sigma, F.lit(SPREAD_FLOOR))
    y = F.greatest(y, F.lit(1e-16))
    w = (F.ln(y) - mu) / s
    mean = F.exp(mu + s * s / 2)
    return (
        y * (F.lit(2.0) * normal_cdf(w) - 1)
        - F.lit(2.0) * mean * (normal_cdf(w - s) + normal_cdf(s / F.lit(sqrt(2.0))) - 1)
    )


def gaussian_nll(x: Column, mean: Column, var: Column) -> Column:
    return F.lit(0.5) * ((x - mean) * (x - mean) / var + F.ln(F.lit(2 * pi) * var))
