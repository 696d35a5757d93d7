import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions import binomial as B


def _pmf(i, n, p):
    return math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                    + i * math.log(p) + (n - i) * math.log(1 - p))


def _cdf(k, n, p):
    return sum(_pmf(i, n, p) for i in range(0, k + 1)) if k >= 0 else 0.0


CASES = [(3, 10, 0.3), (0, 10, 0.3), (10, 10, 0.3), (150, 1500, 0.1), (120, 1500, 0.1),
         (450, 1500, 0.2997), (11, 100, 0.2), (2, 5, 0.999), (0, 1, 0.5), (1, 1, 0.5)]


@pytest.mark.parametrize("k,n,p", CASES)
def test_tails_match_pmf_sums(k, n, p):
    assert B.binom_cdf_np(k, n, p) == pytest.approx(_cdf(k, n, p), abs=1e-10)
    assert B.binom_sf_ge_np(k, n, p) == pytest.approx(1 - _cdf(k - 1, n, p), abs=1e-10)


@pytest.mark.parametrize("k,n,p", CASES)
def test_greater_plus_less_is_one_plus_pmf(k, n, p):
    s = B.binom_sf_ge_np(k, n, p) + B.binom_cdf_np(k, n, p)
    assert s == pytest.approx(1 + _pmf(k, n, p), abs=1e-10)


@pytest.mark.parametrize("k,n,p", CASES)
def test_minlike_matches_brute_force(k, n, p):
    d = _pmf(k, n, p)
    want = min(1.0, sum(_pmf(i, n, p) for i in range(n + 1) if _pmf(i, n, p) <= d * (1 + 1e-7)))
    if k == p * n:
        want = 1.0
    assert float(B.binom_minlike_np(k, n, p)) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("n,r", [(10, 0.3), (1500, 0.1), (300, 0.0), (300, 1.0), (7, 3 / 7)])
def test_interval_is_smallest_k_reaching_quantile(n, r):
    for q in (0.025, 0.975):
        got = int(B.binom_ppf_np(q, n, r))
        if 0 < r < 1:
            c, want = 0.0, n
            for k in range(n + 1):
                c += _pmf(k, n, r)
                if c >= q:
                    want = k
                    break
        else:
            want = 0 if r == 0 else n
        assert got == want


def test_sql_expressions_agree_with_numpy(spark):
    df = spark.createDataFrame([(k, n, p) for k, n, p in CASES], "k long, n long, p double")
    rows = df.select("k", "n", "p", F.expr(B.binom_cdf_sql("k", "n", "p")).alias("c"),
                     F.expr(B.binom_sf_ge_sql("k", "n", "p")).alias("s")).collect()
    for r in rows:
        assert r.c == pytest.approx(float(B.binom_cdf_np(r.k, r.n, r.p)), abs=1e-11)
        assert r.s == pytest.approx(float(B.binom_sf_ge_np(r.k, r.n, r.p)), abs=1e-11)


def test_arrow_udf_double_tail_not_clamped(spark):
    df = spark.createDataFrame([(5, 10, 0.5)], "k long, n long, p double")
    r = df.select(B.binomial_stats("k", "n", "p").alias("s")).first().s
    assert r.p_value > 1.0            # 2·min(P(X<=5), P(X>=5)) = 1.246…
    assert r.p_value == pytest.approx(2 * (1 - _cdf(4, 10, 0.5)), abs=1e-10)


def test_large_n_is_finite():
    v = float(B.binom_cdf_np(50_000_000, 1_000_000_000, 0.05))
    assert 0.49 < v < 0.51
    assert np.isfinite(v)
