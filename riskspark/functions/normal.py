"""Standard normal CDF / quantile and seeded uniforms as Column expressions.

Uniforms come from a 64-bit hash of (seed, row key, stream), so a generated
row does not depend on how Spark partitions the work (``rand``/``randn`` do).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO53 = float(2 ** 53)

# Rational approximation of the normal quantile (P. J. Acklam), |rel err| < 1.2e-9.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
_P_LOW = 0.02425

# erfc Chebyshev fit (fractional error < 1.2e-7 everywhere).
_ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807,
         -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _horner(coefs: list[float], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Φ⁻¹(p) for 0 < p < 1."""
    q_low = F.sqrt(-2.0 * F.log(p))
    low = _horner(_C, q_low) / (_horner(_D, q_low) * q_low + 1.0)
    q_high = F.sqrt(-2.0 * F.log(1.0 - p))
    high = -_horner(_C, q_high) / (_horner(_D, q_high) * q_high + 1.0)
    q = p - 0.5
    r = q * q
    mid = _horner(_A, r) * q / (_horner(_B, r) * r + 1.0)
    return F.when(p < _P_LOW, low).when(p > 1.0 - _P_LOW, high).otherwise(mid)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + F.lit(c)
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(2.0 - ans)


def norm_cdf(z: Column) -> Column:
    """Φ(z) = erfc(−z/√2) / 2."""
    return 0.5 * erfc(-z / F.sqrt(F.lit(2.0)))


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A uniform in (0, 1) from xxhash64(seed, keys…): 53 bits, never 0 or 1."""
    h = F.xxhash64(F.lit(seed), *keys)
    bits = F.pmod(h, F.lit(2 ** 53)).cast("double")
    return (bits + 0.5) / F.lit(_TWO53)


def hash_normal(seed: int, *keys: Column) -> Column:
    return norm_ppf(hash_uniform(seed, *keys))
