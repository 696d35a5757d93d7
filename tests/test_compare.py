import numpy as np
import pandas as pd
import pytest

from riskspark.operators import compare as cmp


@pytest.fixture
def pair(spark):
    rng = np.random.default_rng(11)
    real = pd.DataFrame({"x": np.round(rng.normal(0, 1, 400), 1), "z": rng.uniform(size=400),
                         "target": rng.choice(["a", "b"], 400)})
    syn = pd.DataFrame({"x": np.round(rng.normal(0.3, 1.2, 300), 1), "z": rng.uniform(size=300) ** 1.5,
                        "target": rng.choice(["a", "b", "c"], 300)})
    pdf = pd.concat([real.assign(side="real"), syn.assign(side="synthetic")], ignore_index=True)
    return spark.createDataFrame(pdf), real, syn


def _dens(v, bins):
    h, e = np.histogram(v, bins=bins, density=True)
    return h


def test_histogram_metrics_match_numpy(spark, pair):
    df, real, syn = pair
    got = {r.column: r for r in cmp.divergence_scores(cmp.histograms(df)).collect()}
    for c in ("x", "z"):
        r, s = real[c].to_numpy(), syn[c].to_numpy()
        bins = np.linspace(min(r.min(), s.min()), max(r.max(), s.max()), 20)
        hr, hs = _dens(r, bins), _dens(s, bins)
        p, q = (hr + 1e-10) / (hr + 1e-10).sum(), (hs + 1e-10) / (hs + 1e-10).sum()
        is_div = np.sum(p / q - np.log(p / q) - 1)
        assert got[c].kl_divergence_inverse == pytest.approx(1 / (1 + is_div), abs=2e-6)
        cos = hr @ hs / np.sqrt((hr @ hr) * (hs @ hs))
        assert got[c].cosine_similarity == pytest.approx(max(0, cos), abs=2e-6)
        m = (p + q) / 2
        js = -np.sum(m * np.log(m)) + 0.5 * (np.sum(p * np.log(p)) + np.sum(q * np.log(q)))
        assert got[c].jensen_shannon_entropy == pytest.approx(1 - js, abs=2e-6)


def test_chi_squared_rescaled(spark, pair):
    df, real, syn = pair
    got = {r.column: r for r in cmp.chi_squared_score(cmp.histograms(df)).collect()}
    r, s = real["z"].to_numpy(), syn["z"].to_numpy()
    bins = np.linspace(min(r.min(), s.min()), max(r.max(), s.max()), 10)
    hr, hs = np.histogram(r, bins)[0], np.histogram(s, bins)[0] * len(r) / len(s)
    chi = np.sum((hr - hs) ** 2 / hs)
    assert got["z"].chi_squared_score == pytest.approx(1 / (1 + chi / len(r)), abs=2e-6)
    parity = {r.column: r for r in cmp.chi_squared_score(cmp.histograms(df), parity=True).collect()}
    assert parity["z"].chi_squared_score == 0.0          # unequal totals


def test_target_inner_vs_outer(spark, pair):
    df, real, syn = pair
    rs, ss = real["target"].value_counts(normalize=True), syn["target"].value_counts(normalize=True)
    inner = sum(abs(rs[c] - ss[c]) for c in set(rs.index) & set(ss.index))
    outer = sum(abs(rs.get(c, 0) - ss.get(c, 0)) for c in set(rs.index) | set(ss.index))
    assert cmp.target_compare_inner(df).first()[0] == pytest.approx(inner, abs=1e-6)
    assert cmp.target_compare_outer(df).first()[0] == pytest.approx(outer, abs=1e-6)


def test_quality_score_in_unit_interval(spark, pair):
    df, _, _ = pair
    r = cmp.quality_score(df).first()
    # two numeric columns give one correlation pair, whose r is undefined and skipped
    assert 0.0 <= r.overall_score <= 1.0 and r.n_terms == 2
