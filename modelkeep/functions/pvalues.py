"""p-values for the drift tests.

Spark has no ``erf`` or incomplete gamma, and no scipy is available, so the
two tail functions are written here from their textbook series / continued
fraction forms.  They run inside an Arrow-batched pandas UDF applied to
frames with one row per feature, never per data row.  The KS tail is a
finite alternating series and is evaluated JVM-side with ``aggregate``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gamma_p_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(10000):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_q_fraction(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        if abs(d) < tiny:
            d = tiny
        c = b + an / c
        if abs(c) < tiny:
            c = tiny
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    if x < a + 1.0:
        return max(0.0, min(1.0, 1.0 - _gamma_p_series(a, x)))
    return max(0.0, min(1.0, _gamma_q_fraction(a, x)))


def chi2_sf(stat: float, dof: float) -> float:
    """P(X >= stat) for a chi-square with ``dof`` degrees of freedom."""
    if stat is None or dof is None or (isinstance(stat, float) and math.isnan(stat)):
        return None
    if dof <= 0:
        return 1.0
    if math.isinf(stat):
        return 0.0
    return gamma_q(dof / 2.0, stat / 2.0)


def normal_two_sided(z: float) -> float:
    """Two-sided normal tail ``erfc(|z| / sqrt(2))``."""
    if z is None or (isinstance(z, float) and math.isnan(z)):
        return None
    return math.erfc(abs(z) / math.sqrt(2.0))


def ks_asymptotic(d: float, n: float, m: float) -> float:
    """Kolmogorov tail for the two-sample statistic (reference Python twin
    of :func:`ks_pvalue_col`, used by tests)."""
    lam = d * math.sqrt(n * m / (n + m))
    if lam < 0.2:
        return 1.0
    s = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))
    return max(0.0, min(1.0, 2.0 * s))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(s), float(k)) if pd.notna(s) and pd.notna(k) else None
                      for s, k in zip(stat, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(float(v)) if pd.notna(v) else None for v in z],
                     dtype="float64")


def ks_pvalue_col(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample KS p-value, JVM-side (100-term series)."""
    lam = d * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0).cast("double"),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1)
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(p)
