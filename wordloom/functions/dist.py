"""Normal CDF without ``erf``: the double-precision rational approximation of
Hart (1968) in the form published by G. West, "Better approximations to
cumulative normal functions" (2005); absolute error below 1e-14.

Written once as a tiny expression builder so the same formula renders to a
Spark Column and to DuckDB SQL.
"""

from __future__ import annotations

import math

# ---------------------------------------------------------------------------
# Published coefficients of the approximation, in order.
# ---------------------------------------------------------------------------
NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
       112.079291497871, 221.213596169931, 220.206867912376]
DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
       296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631


def _horner(coefs, x):
    acc = coefs[0]
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def normal_cdf_py(x: float, mean: float = 0.0, std: float = 1.0) -> float:
    """Reference Python version (also used by tests)."""
    z = (x - mean) / std
    a = abs(z)
    if a > 37:
        c = 0.0
    else:
        e = math.exp(-a * a / 2)
        if a < SPLIT:
            c = e * _horner(NUM, a) / _horner(DEN, a)
        else:
            b = a + 0.65
            for k in (4, 3, 2, 1):
                b = a + k / b
            c = e / b / SQRT_2PI
    return 1 - c if z > 0 else c


def normal_cdf(x, mean=0.0, std=1.0):
    """Spark Column version of :func:`normal_cdf_py`."""
    from pyspark.sql import functions as F
    lit = lambda v: v if not isinstance(v, (int, float)) else F.lit(float(v))
    z = (x - lit(mean)) / lit(std)
    a = F.abs(z)
    e = F.exp(-a * a / F.lit(2.0))
    near = e * _horner([F.lit(c) for c in NUM], a) / _horner([F.lit(c) for c in DEN], a)
    b = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + F.lit(k) / b
    far = e / b / F.lit(SQRT_2PI)
    c = F.when(a > 37, F.lit(0.0)).when(a < SPLIT, near).otherwise(far)
    return F.when(z > 0, F.lit(1.0) - c).otherwise(c)


def normal_cdf_sql(x: str, mean: str = "0.0", std: str = "1.0") -> str:
    """DuckDB SQL version of :func:`normal_cdf_py`."""
    z = f"(({x}) - ({mean})) / ({std})"
    a = f"abs({z})"
    e = f"exp(-{a} * {a} / 2.0)"

    def horner(coefs):
        acc = repr(coefs[0])
        for c in coefs[1:]:
            acc = f"({acc}) * {a} + {c!r}"
        return acc
    near = f"{e} * ({horner(NUM)}) / ({horner(DEN)})"
    b = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        b = f"({a} + {k!r} / {b})"
    far = f"{e} / {b} / {SQRT_2PI!r}"
    c = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {SPLIT!r} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} > 0 THEN 1.0 - {c} ELSE {c} END)"
