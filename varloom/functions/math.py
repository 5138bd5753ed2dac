"""Distribution functions Spark does not ship, as plain column expressions.

All of them stay inside the JVM: the normal distribution function is a rational approximation, chi-square
tails with a literal number of degrees of freedom are finite sums, and the Student tail is the finite
trigonometric series for whole degrees of freedom.
"""

from __future__ import annotations

from math import pi, sqrt
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")

# Hart's double-precision rational approximation of the normal distribution function.
HART_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
HART_SPLIT = 7.07106781186547
HART_LIMIT = 37.0


def is_finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def all_finite(*names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & is_finite(F.col(name).cast("double"))
    return out


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _horner(a, HART_NUMERATOR) / _horner(a, HART_DENOMINATOR)
    fraction = a + F.lit(0.65)
    for k in (4, 3, 2, 1):
        fraction = a + F.lit(float(k)) / fraction
    far = e / fraction / F.lit(sqrt(2 * pi))
    lower = F.when(a > HART_LIMIT, F.lit(0.0)).when(a < HART_SPLIT, near).otherwise(far)
    # Upper half by symmetry; arithmetic on the sign keeps the approximation in the plan once.
    upper = (x > 0).cast("double")
    return upper + (F.lit(1.0) - F.lit(2.0) * upper) * lower


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(sqrt(2 * pi))


def normal_quantile(p: float) -> float:
    """Quantile at a literal level, evaluated while the plan is built."""
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: Column) -> Column:
    return F.lit(2.0) * normal_cdf(-F.abs(z))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of the chi-square distribution for a literal whole number of degrees of freedom."""
    if df < 1:
        raise ValueError("degrees of freedom must be at least 1")
    x = F.greatest(x, F.lit(0.0))
    half = x / 2
    if df % 2 == 0:
        total, term = F.lit(1.0), F.lit(1.0)
        for i in range(1, df // 2):
            term = term * half / F.lit(float(i))
            total = total + term
        return F.exp(-half) * total
    tail = F.lit(2.0) * normal_cdf(-F.sqrt(x))
    if df > 1:
        power, total = F.sqrt(x), F.lit(0.0)
        odd = 1.0
        for i in range(1, (df - 1) // 2 + 1):
            odd *= 2 * i - 1
            total = total + power / F.lit(odd)
            power = power * x
        tail = tail + F.lit(sqrt(2 / pi)) * F.exp(-half) * total
    return tail


def chi2_sf_for(x: Column, df: Column, choices) -> Column:
    """Chi-square tail where the degrees of freedom come from a small set of known values."""
    out = F.lit(None).cast("double")
    for k in choices:
        out = F.when(df == k, chi2_sf(x, k)).otherwise(out)
    return out


def student_two_sided(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value for whole degrees of freedom held in a column."""
    nu = df.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(nu))
    c2 = F.cos(theta) * F.cos(theta)
    even = df % 2 == 0
    # Terms after the first follow a fixed ratio; the offset differs for odd and even degrees of freedom.
    top = F.when(even, F.lit(-1.0)).otherwise(F.lit(0.0))
    first = F.when(even, F.sin(theta)).otherwise(F.sin(theta) * F.cos(theta))
    count = F.when(even, df / 2 - 1).otherwise((df - 1) / 2 - 1).cast("int")
    steps = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(
        steps,
        F.struct(first.alias("term"), first.alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * c2 * (k * 2 + top) / (k * 2 + top + 1)).alias("term"),
            (acc["total"] + acc["term"] * c2 * (k * 2 + top) / (k * 2 + top + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    odd_area = F.lit(2 / pi) * (theta + F.when(df > 1, series).otherwise(F.lit(0.0)))
    area = F.when(even, series).otherwise(odd_area)
    return F.greatest(F.lit(1.0) - area, F.lit(0.0))


def rounded(c: Column, digits: int) -> Column:
    return F.round(c, digits)
