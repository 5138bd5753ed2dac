import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import laws, losses, math as fm


def values(spark, xs, *columns):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    return df.select("x", *columns).orderBy("x").toPandas()


def test_normal_cdf_matches_erf(spark):
    got = values(spark, np.linspace(-9, 9, 61), fm.normal_cdf(F.col("x")).alias("p"))
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in got.x]
    assert np.allclose(got.p, want, rtol=1e-12, atol=1e-15)


def test_quantile_inverts_cdf():
    assert fm.normal_quantile(NormalDist().cdf(1.3)) == pytest.approx(1.3)


def test_chi_square_known_values(spark):
    got = values(spark, [3.841458820694124, 5.991464547107979], fm.chi2_sf(F.col("x"), 1).alias("one"), fm.chi2_sf(F.col("x"), 2).alias("two"))
    assert got.one[0] == pytest.approx(0.05, abs=1e-12)
    assert got.two[1] == pytest.approx(0.05, abs=1e-12)


def test_chi_square_odd_even_recurrence(spark):
    # sf(k+2) - sf(k) = (x/2)^(k/2) e^(-x/2) / gamma(k/2 + 1)
    got = values(spark, [0.5, 4.0, 11.0], *[fm.chi2_sf(F.col("x"), k).alias(f"k{k}") for k in range(1, 9)])
    for k in range(1, 7):
        step = (got.x / 2) ** (k / 2) * np.exp(-got.x / 2) / math.gamma(k / 2 + 1)
        assert np.allclose(got[f"k{k + 2}"] - got[f"k{k}"], step, atol=1e-13)


def test_student_tail_limits(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (1.96, 100000), (12.706204736432095, 1), (2.2281388519649385, 10)], "t double, v int")
    p = df.select(fm.student_two_sided(F.col("t"), F.col("v")).alias("p")).toPandas().p
    assert p[0] == pytest.approx(0.5, abs=1e-12)
    assert p[1] == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12)
    assert p[2] == pytest.approx(0.0500, abs=1e-4)
    assert p[3] == pytest.approx(0.05, abs=1e-9)
    assert p[4] == pytest.approx(0.05, abs=1e-9)


def test_finite_mask(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (-float("inf"),)], "x double")
    assert df.where(fm.is_finite(F.col("x"))).count() == 1


def test_qlike_is_zero_only_at_truth(spark):
    got = values(spark, [0.5, 1.0, 2.0], losses.qlike_loss(F.lit(1.0), F.col("x")).alias("l"))
    assert got.l[1] == 0 and (got.l[[0, 2]] > 0).all()


def test_unknown_loss_is_an_error():
    with pytest.raises(ValueError):
        losses.loss_by_name("other")


def test_pinball_at_half_is_half_absolute_error(spark):
    got = values(spark, [-1.0, 3.0], losses.pinball(F.col("x"), F.lit(1.0), 0.5).alias("p"))
    assert np.allclose(got.p, np.abs(got.x - 1) / 2)


def test_lognormal_crps_against_numerical_integral(spark):
    mu, s, y = -0.3, 0.7, 1.4
    got = values(spark, [y], laws.lognormal_crps(F.col("x"), F.lit(mu), F.lit(s)).alias("c")).c[0]
    grid = np.linspace(1e-6, 30, 200_001)
    cdf = np.array([0.5 * math.erfc(-(math.log(v) - mu) / s / math.sqrt(2)) for v in grid])
    want = np.trapezoid((cdf - (grid >= y)) ** 2, grid)
    assert got == pytest.approx(want, rel=2e-3)


def test_lognormal_interval_round_trip(spark):
    lo, hi = laws.lognormal_interval(F.lit(0.2), F.lit(0.5), 90)
    mid = laws.lognormal_quantile(F.lit(0.2), F.lit(0.5), 0.5)
    mu, sigma = laws.lognormal_from_quantiles(lo, mid, hi, 0.05, 0.95)
    got = values(spark, [0.0], mu.alias("mu"), sigma.alias("sigma"))
    assert got.mu[0] == pytest.approx(0.2) and got.sigma[0] == pytest.approx(0.5)


def test_bad_levels_are_errors():
    with pytest.raises(ValueError):
        laws.lognormal_interval(None, None, 100)
    with pytest.raises(ValueError):
        laws.lognormal_from_quantiles(None, None, None, 0.6, 0.9)
