"""Two-sided p-values of the normal and Student t distributions.

Student t: P(|T| > t) = I_x(df/2, 1/2) with x = df / (df + t^2), the
regularised incomplete beta function. Normal: P(|Z| > z) = erfc(|z| / sqrt 2).

Spark SQL has no erf or incomplete beta. The JVM path calls the special
functions of Apache Commons Math (a dependency of Spark's ML module, present
in Spark distributions) through the built-in `java_method`, so no Python
worker is involved. Where that class is missing (e.g. a trimmed classpath)
the same functions run as Arrow-batched pandas UDFs, evaluated by the
continued fraction of DLMF 8.17.22 (modified Lentz method). Either path runs
on the per-(segment, cohort) result frame only, never on user rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_EPS = 1e-15
_MAX_TERMS = 10000


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of I_x(a, b) (without the x^a (1-x)^b / (a B) front factor)."""
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    f = d
    for m in range(1, _MAX_TERMS):
        two_m = 2.0 * m
        # even step d_{2m}
        num = m * (b - m) * x / ((a + two_m - 1.0) * (a + two_m))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + num / c
        c = c if abs(c) > _TINY else _TINY
        f *= d * c
        # odd step d_{2m+1}
        num = -(a + m) * (a + b + m) * x / ((a + two_m) * (a + two_m + 1.0))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + num / c
        c = c if abs(c) > _TINY else _TINY
        step = d * c
        f *= step
        if abs(step - 1.0) < _EPS:
            break
    return f


def reg_incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    front = math.exp(log_front)
    # the fraction converges fast for x < (a + 1) / (a + b + 2); use the symmetry otherwise
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def student_t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return min(1.0, max(0.0, reg_incomplete_beta(df / 2.0, 0.5, df / (df + t * t))))


def normal_two_sided(z: float) -> float:
    if z is None or math.isnan(z):
        return float("nan")
    return min(1.0, math.erfc(abs(z) / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_t_two_sided(a, b) for a, b in zip(t.astype("float64"), df.astype("float64"))])


@F.pandas_udf(T.DoubleType())
def _z_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) for a in z.astype("float64")])


_BETA = "org.apache.commons.math3.special.Beta"
_ERF = "org.apache.commons.math3.special.Erf"
_JVM_TAILS: dict[int, bool] = {}


def jvm_tails_available(spark: SparkSession | None = None) -> bool:
    """Whether the JVM special functions can be called (checked once per session)."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return False
    key = id(spark)
    if key not in _JVM_TAILS:
        try:
            spark.range(1).select(F.java_method(F.lit(_ERF), F.lit("erfc"), F.lit(1.0))).collect()
            _JVM_TAILS[key] = True
        except Exception:  # noqa: BLE001 - class not on the classpath
            _JVM_TAILS[key] = False
    return _JVM_TAILS[key]


def _jvm_double(cls: str, method: str, *args: Column) -> Column:
    return F.java_method(F.lit(cls), F.lit(method), *args).cast("double")


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided Student t p-value; NULL when t or df is NULL/undefined."""
    ok = t.isNotNull() & df.isNotNull() & (df > 0)
    if jvm_tails_available():
        x = df / (df + t * t)
        p = F.when(F.isnan(t) | F.isnan(df), F.lit(None).cast("double")).otherwise(
            _jvm_double(_BETA, "regularizedBeta", x, df / 2, F.lit(0.5))
        )
        return F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
    p = _t_p(F.coalesce(t, F.lit(float("nan"))), F.coalesce(df, F.lit(float("nan"))))
    return F.when(ok, F.nanvl(p, F.lit(None).cast("double")))


def z_pvalue(z: Column) -> Column:
    """Two-sided standard normal p-value; NULL when z is NULL."""
    if jvm_tails_available():
        p = _jvm_double(_ERF, "erfc", F.abs(z) / F.lit(math.sqrt(2.0)))
        return F.when(z.isNotNull() & ~F.isnan(z), F.least(F.lit(1.0), p))
    p = _z_p(F.coalesce(z, F.lit(float("nan"))))
    return F.when(z.isNotNull(), F.nanvl(p, F.lit(None).cast("double")))
