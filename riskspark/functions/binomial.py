"""Binomial distribution functions as Spark SQL expressions (kernel K4).

The tails use the regularised incomplete beta function,
``P(X <= k) = I_{1-p}(n-k, k+1)`` and ``P(X >= k) = I_p(k, n-k+1)``, evaluated
by the convergents of its continued fraction (NIST Digital Library of
Mathematical Functions, 8.17.22 and 1.12(ii)) inside a SQL ``aggregate`` loop. The
cost is a few hundred steps per row whatever ``n`` is, so a decile of a billion rows costs
the same as one of a thousand. These expressions are meant for aggregated rows
(one per decile / bin), never for raw input rows.

Every function takes SQL expression strings and returns a SQL expression
string; wrap with ``F.expr`` to use as a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stirling series coefficients for ln Gamma (fixed values of the asymptotic series)
_HALF_LN_2PI = "0.9189385332046727"


def _stirling(y: str) -> str:
    return (f"(({y}) - 0.5D) * ln({y}) - ({y}) + {_HALF_LN_2PI}D"
            f" + 1.0D / (12.0D * ({y})) - 1.0D / (360.0D * pow({y}, 3))"
            f" + 1.0D / (1260.0D * pow({y}, 5)) - 1.0D / (1680.0D * pow({y}, 7))")


def lgamma_sql(x: str) -> str:
    """ln Gamma(x) for x > 0; arguments below 15 are shifted up by recurrence."""
    shifted = f"(({x}) + 15.0D)"
    prod = " * ".join(f"(({x}) + {i}.0D)" for i in range(15))
    return (f"(CASE WHEN ({x}) >= 15.0D THEN {_stirling(f'({x})')}"
            f" ELSE {_stirling(shifted)} - ln({prod}) END)")


def _partial_numerator(a: str, b: str, x: str, j: str) -> str:
    """The j-th partial numerator of 1 / (1 + d1 / (1 + d2 / (1 + ...)))."""
    m = f"(cast({j} div 2 AS DOUBLE))"
    return (f"(CASE WHEN {j} % 2 = 0 THEN {m} * (({b}) - {m}) * ({x}) / ((({a}) + 2.0D * {m} - 1.0D) * (({a}) + 2.0D * {m}))"
            f" ELSE -((({a}) + {m}) * (({a}) + ({b}) + {m}) * ({x})) / ((({a}) + 2.0D * {m}) * (({a}) + 2.0D * {m} + 1.0D)) END)")


def _fraction_sql(a: str, b: str, x: str) -> str:
    """The continued fraction of the incomplete beta. Numerators p and denominators q of two
    successive convergents follow one three-term recurrence; both are divided by q at each
    step, so they stay in range, and the loop rests once a convergent repeats the last."""
    q = f"(1.0D + {_partial_numerator(a, b, x, 'j')} * s.q_last)"
    p = f"(s.p + {_partial_numerator(a, b, x, 'j')} * s.p_last)"
    # terms needed grow like sqrt(max(a, b)); the bound keeps the loop finite
    steps = f"cast(2 * (300 + 4 * ceil(sqrt(greatest({a}, {b})))) AS INT)"
    # of the fraction below the leading 1: p / q -> 1 + d1 / (1 + d2 / ...), with q scaled to 1
    return (f"aggregate(sequence(1, {steps}),"
            f" named_struct('p', 1.0D, 'p_last', 1.0D, 'q_last', 0.0D, 'still', false),"
            f" (s, j) -> CASE WHEN s.still THEN s ELSE named_struct("
            f"'p', {p} / {q}, 'p_last', s.p / {q}, 'q_last', 1.0D / {q},"
            f" 'still', abs({p} / {q} - s.p) <= 1e-16D * abs(s.p)) END,"
            f" s -> 1.0D / s.p)")


def betainc_sql(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta I_x(a, b) for a, b > 0 and 0 < x < 1."""
    ln_front = (f"({lgamma_sql(f'(({a}) + ({b}))')} - {lgamma_sql(a)} - {lgamma_sql(b)}"
                f" + ({a}) * ln({x}) + ({b}) * ln(1.0D - ({x})))")
    front = f"exp({ln_front})"
    direct = f"({front} * {_fraction_sql(a, b, x)} / ({a}))"
    mirrored = f"(1.0D - {front} * {_fraction_sql(b, a, f'(1.0D - ({x}))')} / ({b}))"
    return (f"(CASE WHEN ({x}) < (({a}) + 1.0D) / (({a}) + ({b}) + 2.0D)"
            f" THEN {direct} ELSE {mirrored} END)")


def binom_cdf_sql(k: str, n: str, p: str) -> str:
    """P(X <= k) for X ~ Bin(n, p)."""
    kd, nd, pd = f"cast({k} AS DOUBLE)", f"cast({n} AS DOUBLE)", f"cast({p} AS DOUBLE)"
    return (f"(CASE WHEN {kd} < 0 THEN 0.0D WHEN {kd} >= {nd} THEN 1.0D"
            f" WHEN {pd} <= 0.0D THEN 1.0D WHEN {pd} >= 1.0D THEN 0.0D"
            f" ELSE {betainc_sql(f'({nd} - {kd})', f'({kd} + 1.0D)', f'(1.0D - {pd})')} END)")


def binom_sf_ge_sql(k: str, n: str, p: str) -> str:
    """P(X >= k) for X ~ Bin(n, p) (the upper tail including k)."""
    kd, nd, pd = f"cast({k} AS DOUBLE)", f"cast({n} AS DOUBLE)", f"cast({p} AS DOUBLE)"
    return (f"(CASE WHEN {kd} <= 0 THEN 1.0D WHEN {kd} > {nd} THEN 0.0D"
            f" WHEN {pd} <= 0.0D THEN 0.0D WHEN {pd} >= 1.0D THEN 1.0D"
            f" ELSE {betainc_sql(kd, f'({nd} - {kd} + 1.0D)', pd)} END)")


def binom_pmf_sql(k: str, n: str, p: str) -> str:
    """P(X = k) through ln Gamma."""
    kd, nd, pd = f"cast({k} AS DOUBLE)", f"cast({n} AS DOUBLE)", f"cast({p} AS DOUBLE)"
    body = (f"exp({lgamma_sql(f'({nd} + 1.0D)')} - {lgamma_sql(f'({kd} + 1.0D)')}"
            f" - {lgamma_sql(f'({nd} - {kd} + 1.0D)')} + {kd} * ln({pd}) + ({nd} - {kd}) * ln(1.0D - {pd}))")
    return (f"(CASE WHEN {kd} < 0 OR {kd} > {nd} THEN 0.0D"
            f" WHEN {pd} <= 0.0D THEN (CASE WHEN {kd} = 0 THEN 1.0D ELSE 0.0D END)"
            f" WHEN {pd} >= 1.0D THEN (CASE WHEN {kd} = {nd} THEN 1.0D ELSE 0.0D END)"
            f" ELSE {body} END)")


def binom_test_sql(k: str, n: str, p: str, method: str = "double_tail") -> str:
    """p-value of k successes in n trials against rate p.

    ``double_tail``: 2·min(P(X<=k), P(X>=k)), not clamped (can exceed 1);
    ``greater``: P(X>=k); ``less``: P(X<=k).
    """
    if method == "double_tail":
        return f"(2.0D * least({binom_cdf_sql(k, n, p)}, {binom_sf_ge_sql(k, n, p)}))"
    if method == "greater":
        return binom_sf_ge_sql(k, n, p)
    if method == "less":
        return binom_cdf_sql(k, n, p)
    raise ValueError("method must be 'double_tail', 'greater' or 'less'")


def binom_ppf_sql(q: float, n: str, p: str) -> str:
    """Smallest k in [0, n] with P(X <= k) >= q (bisection over k)."""
    iters = f"cast(ceil(log2(cast({n} AS DOUBLE) + 2.0D)) + 1 AS INT)"
    cdf_mid = binom_cdf_sql("((bs.lo + bs.hi) div 2)", n, p)
    return (f"aggregate(sequence(1, {iters}), named_struct('lo', cast(0 AS BIGINT), 'hi', cast({n} AS BIGINT)),"
            f" (bs, bi) -> CASE WHEN bs.lo >= bs.hi THEN bs"
            f" WHEN {cdf_mid} >= {q!r}D THEN named_struct('lo', bs.lo, 'hi', (bs.lo + bs.hi) div 2)"
            f" ELSE named_struct('lo', (bs.lo + bs.hi) div 2 + 1, 'hi', bs.hi) END,"
            f" bs -> bs.hi)")


def binom_interval_sql(confidence: float, n: str, rate: str) -> tuple[str, str]:
    """Equal-tail interval of Bin(n, rate): (ppf((1-c)/2), ppf((1+c)/2))."""
    lo_q = (1.0 - confidence) / 2.0
    hi_q = (1.0 + confidence) / 2.0
    return binom_ppf_sql(lo_q, n, rate), binom_ppf_sql(hi_q, n, rate)


def binom_test(k, n, p, method: str = "double_tail") -> Column:
    return F.expr(binom_test_sql(k, n, p, method))


# ---------------------------------------------------------------------------
# Vectorised path: the same continued fraction in NumPy, run through an Arrow
# pandas UDF. Used by default because the inputs are always aggregated rows
# (a handful per group) and NumPy loops over them far faster than interpreted
# SQL lambdas.
# ---------------------------------------------------------------------------

import math  # noqa: E402

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

_lgamma_vec = np.vectorize(math.lgamma, otypes=[float])


def _fraction_np(a, b, x):
    """``_fraction_sql`` for arrays."""
    value, p_last, q_last = np.ones_like(x), np.ones_like(x), np.zeros_like(x)
    moving = np.ones(x.shape, dtype=bool)
    terms = 2 * int(300 + 4 * math.ceil(math.sqrt(float(np.max(np.maximum(a, b)))))) if x.size else 0
    with np.errstate(all="ignore"):
        for j in range(1, terms + 1):
            m = j // 2
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if j % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            q = 1.0 + d * q_last
            new = (value + d * p_last) / q
            still = np.abs(new - value) <= 1e-16 * np.abs(value)
            p_last, q_last = value / q, 1.0 / q
            value = np.where(moving, new, value)
            moving &= ~still
            if not moving.any():
                break
    return 1.0 / value


def betainc_np(a, b, x):
    """Regularised incomplete beta I_x(a, b) for arrays with a, b > 0, 0 < x < 1."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    if a.size == 0:
        return np.zeros(a.shape)
    swap = x >= (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma_vec(aa + bb) - _lgamma_vec(aa) - _lgamma_vec(bb)
                       + aa * np.log(xx) + bb * np.log1p(-xx))
    val = front * _fraction_np(aa, bb, xx) / aa
    return np.where(swap, 1.0 - val, val)


def binom_cdf_np(k, n, p):
    """P(X <= k), X ~ Bin(n, p), elementwise."""
    k, n, p = (np.asarray(v, dtype=float) for v in (k, n, p))
    k, n, p = np.broadcast_arrays(k, n, p)
    out = np.full(k.shape, np.nan)
    out[k < 0] = 0.0
    out[(k >= n) & ~(k < 0)] = 1.0
    mid = (k >= 0) & (k < n)
    out[mid & (p <= 0)] = 1.0
    out[mid & (p >= 1)] = 0.0
    core = mid & (p > 0) & (p < 1)
    if core.any():
        out[core] = betainc_np(n[core] - k[core], k[core] + 1.0, 1.0 - p[core])
    return out


def binom_sf_ge_np(k, n, p):
    """P(X >= k), X ~ Bin(n, p), elementwise."""
    k, n, p = (np.asarray(v, dtype=float) for v in (k, n, p))
    k, n, p = np.broadcast_arrays(k, n, p)
    out = np.full(k.shape, np.nan)
    out[k <= 0] = 1.0
    out[(k > n) & ~(k <= 0)] = 0.0
    mid = (k > 0) & (k <= n)
    out[mid & (p <= 0)] = 0.0
    out[mid & (p >= 1)] = 1.0
    core = mid & (p > 0) & (p < 1)
    if core.any():
        out[core] = betainc_np(k[core], n[core] - k[core] + 1.0, p[core])
    return out


def binom_pmf_np(k, n, p):
    k, n, p = (np.asarray(v, dtype=float) for v in (k, n, p))
    k, n, p = np.broadcast_arrays(k, n, p)
    with np.errstate(all="ignore"):
        body = np.exp(_lgamma_vec(n + 1.0) - _lgamma_vec(k + 1.0) - _lgamma_vec(n - k + 1.0)
                      + k * np.log(p) + (n - k) * np.log1p(-p))
    body = np.where(p <= 0, (k == 0).astype(float), body)
    body = np.where(p >= 1, (k == n).astype(float), body)
    return np.where((k < 0) | (k > n), 0.0, body)


def binom_ppf_np(q, n, p):
    """Smallest k in [0, n] with P(X <= k) >= q, by bisection."""
    n = np.asarray(n, dtype=float)
    p = np.asarray(p, dtype=float)
    n, p = np.broadcast_arrays(n, p)
    lo = np.zeros(n.shape)
    hi = n.copy()
    while True:
        todo = lo < hi
        if not todo.any():
            return hi
        mid = np.floor((lo + hi) / 2.0)
        ok = binom_cdf_np(mid, n, p) >= q
        hi = np.where(todo & ok, mid, hi)
        lo = np.where(todo & ~ok, mid + 1.0, lo)


def binom_minlike_np(k, n, p):
    """Two-sided p-value summing every outcome no more likely than k (min-likelihood)."""
    k, n, p = (np.asarray(v, dtype=float) for v in (k, n, p))
    k, n, p = np.broadcast_arrays(k, n, p)
    out = np.ones(k.shape)
    rerr = 1.0 + 1e-7
    for i in range(k.size):
        ki, ni, pi = k.flat[i], n.flat[i], p.flat[i]
        d = float(binom_pmf_np(ki, ni, pi))
        mean = pi * ni
        if ki == mean:
            out.flat[i] = 1.0
            continue
        if ki < mean:
            lo_, hi_ = math.ceil(mean), ni           # pmf decreasing on [ceil(mean), n]
            while lo_ < hi_:                          # first j with pmf(j) <= d*rerr
                mid = math.floor((lo_ + hi_) / 2)
                if binom_pmf_np(mid, ni, pi) <= d * rerr:
                    hi_ = mid
                else:
                    lo_ = mid + 1
            j = lo_ if binom_pmf_np(lo_, ni, pi) <= d * rerr else ni + 1
            val = binom_cdf_np(ki, ni, pi) + (binom_sf_ge_np(j, ni, pi) if j <= ni else 0.0)
        else:
            lo_, hi_ = 0, math.floor(mean)           # pmf increasing on [0, floor(mean)]
            while lo_ < hi_:                          # last j with pmf(j) <= d*rerr
                mid = math.ceil((lo_ + hi_) / 2)
                if binom_pmf_np(mid, ni, pi) <= d * rerr:
                    lo_ = mid
                else:
                    hi_ = mid - 1
            j = lo_ if binom_pmf_np(lo_, ni, pi) <= d * rerr else -1
            val = (binom_cdf_np(j, ni, pi) if j >= 0 else 0.0) + binom_sf_ge_np(ki, ni, pi)
        out.flat[i] = min(1.0, float(val))
    return out


_STATS_SCHEMA = T.StructType([
    T.StructField("p_value", T.DoubleType()),
    T.StructField("ci_lo", T.LongType()),
    T.StructField("ci_hi", T.LongType()),
])


def _stats_frame(k: pd.Series, n: pd.Series, p: pd.Series, method: str,
                 confidence: float) -> pd.DataFrame:
    kk, nn, pp = k.to_numpy(float), n.to_numpy(float), p.to_numpy(float)
    if method == "double_tail":
        pv = 2.0 * np.minimum(binom_cdf_np(kk, nn, pp), binom_sf_ge_np(kk, nn, pp))
    elif method == "greater":
        pv = binom_sf_ge_np(kk, nn, pp)
    elif method == "less":
        pv = binom_cdf_np(kk, nn, pp)
    elif method == "minlike":
        pv = binom_minlike_np(kk, nn, pp)
    else:
        raise ValueError(f"unknown method {method!r}")
    with np.errstate(all="ignore"):
        rate = np.where(nn > 0, kk / nn, np.nan)
    lo = binom_ppf_np((1.0 - confidence) / 2.0, nn, rate)
    hi = binom_ppf_np((1.0 + confidence) / 2.0, nn, rate)
    return pd.DataFrame({"p_value": pv, "ci_lo": lo.astype("int64"), "ci_hi": hi.astype("int64")})


def binomial_stats(k, n, p, method: str = "double_tail", confidence: float = 0.95) -> Column:
    """struct(p_value, ci_lo, ci_hi) for k successes of n against rate p.

    ``ci_lo/ci_hi`` bound the equal-tail ``confidence`` interval of
    Bin(n, k/n). Apply only to aggregated rows.
    """

    @F.pandas_udf(_STATS_SCHEMA)
    def _udf(k_: pd.Series, n_: pd.Series, p_: pd.Series) -> pd.DataFrame:
        return _stats_frame(k_, n_, p_, method, confidence)

    return _udf(F.col(k) if isinstance(k, str) else k,
                F.col(n) if isinstance(n, str) else n,
                F.col(p) if isinstance(p, str) else p)
