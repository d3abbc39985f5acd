"""Tail probabilities as column expressions, through the commons-math classes on Spark's class path.

A reflected call counts as non-deterministic: apply these in a select after the aggregation, not inside one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_BETA, _GAMMA, _ERF = (f"org.apache.commons.math3.special.{x}" for x in ("Beta", "Gamma", "Erf"))


def _num(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def _call(cls: str, method: str, *args: Column | float) -> Column:
    return F.java_method(F.lit(cls), F.lit(method), *[_num(a) for a in args]).cast("double")


def _given(value: Column, *args: Column | float) -> Column:
    """value where no argument is null."""
    ok = F.lit(True)
    for a in args:
        if isinstance(a, Column):
            ok = ok & a.isNotNull()
    return F.when(ok, value)


def beta_inc(x: Column, a: Column | float, b: Column | float) -> Column:
    """Regularised incomplete beta function, x clipped to [0, 1]."""
    x0 = F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    safe = [F.coalesce(p, F.lit(1.0)) if isinstance(p, Column) else p for p in (a, b)]
    return _given(_call(_BETA, "regularizedBeta", x0, *safe), x, a, b)


def t_two_sided(t: Column, df: Column | float) -> Column:
    d = _num(df)
    return beta_inc(d / (d + t * t), d / 2, 0.5)


def f_upper(f: Column, d1: Column | float, d2: Column | float) -> Column:
    a, b = _num(d1), _num(d2)
    return beta_inc(b / (b + a * f), b / 2, a / 2)


def chi2_upper(x: Column, k: Column | float) -> Column:
    return _given(_call(_GAMMA, "regularizedGammaQ", _num(k) / 2, F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)) / 2), x)


def normal_cdf(z: Column) -> Column:
    return _given((F.lit(1.0) + _call(_ERF, "erf", F.coalesce(z, F.lit(0.0)) / math.sqrt(2))) / 2, z)


def r_to_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation; 0 where |r| is 1, null under three observations."""
    df = (n - 2).cast("double")
    t = F.abs(r) * F.sqrt(df / F.greatest(F.lit(1e-300), 1 - r * r))
    return F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(t, df))


def fisher_ci(r: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    half = z / F.sqrt(F.when(n > 3, n - 3))
    inner = F.atanh(F.when(F.abs(r) < 1, r))
    return F.tanh(inner - half), F.tanh(inner + half)
