"""Student's t quantile, near enough for the margin of a slope; for columns and for numbers."""

from __future__ import annotations

from math import log, nan, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(p: float) -> float:
    t = sqrt(-2 * log(min(p, 1 - p)))
    # Coefficients of the rational approximation 26.2.23 in Abramowitz and Stegun.
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    return -z if p < 0.5 else z


def two_sided(confidence: float) -> float:
    """The quantile up to which an interval around the middle reaches that holds `confidence`."""
    return 1 - (1 - confidence) / 2


def terms(z: float) -> tuple[float, float]:
    """What is added over the degrees of freedom and over their square. The textbook's second term has powers 5, 3 and 1."""
    return (z**3 + z) / 4, (5 * z**4 + 16 * z**3 + 3 * z**2) / 96


def t_quantile(p: float, dof: Column) -> Column:
    """NaN without freedom."""
    z = normal_quantile(p)
    a, b = terms(z)
    return F.when(dof > 0, z + a / dof + b / (dof * dof)).otherwise(F.lit(nan))


def t_quantile_of(p: float, dof: float) -> float:
    z = normal_quantile(p)
    a, b = terms(z)
    return z + a / dof + b / dof**2 if dof > 0 else nan
