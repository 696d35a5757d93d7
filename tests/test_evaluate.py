import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators import evaluate as ev


def _scores(spark, n=800, seed=1):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(size=n), 2)
    y = (rng.uniform(size=n) < p).astype("int64")
    pdf = pd.DataFrame({"model": "m", "split": "t", "y": y, "p": p})
    return spark.createDataFrame(pdf), pdf


def _auc_brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _aupr_brute(y, p):
    order = np.argsort(-p, kind="mergesort")
    thr = np.unique(p)[::-1]
    P = y.sum()
    recs, precs = [0.0], [1.0]
    for t in thr:
        sel = p >= t
        tp = (y[sel] == 1).sum()
        recs.append(tp / P)
        precs.append(tp / sel.sum())
    return sum((recs[i] - recs[i - 1]) * (precs[i] + precs[i - 1]) / 2 for i in range(1, len(recs)))


def test_auc_and_pr_match_brute_force(spark):
    df, pdf = _scores(spark)
    r = ev.curve_metrics(df, ["model", "split"]).first()
    y, p = pdf["y"].to_numpy(), pdf["p"].to_numpy()
    assert r.auc_roc == pytest.approx(_auc_brute(y, p), abs=1e-6)
    assert r.auc_pr == pytest.approx(_aupr_brute(y, p), abs=1e-6)
    assert r.gini == pytest.approx(2 * _auc_brute(y, p) - 1, abs=1e-6)


def test_auc_of_flipped_scores(spark):
    df, _ = _scores(spark)
    a = ev.curve_metrics(df, ["model"]).first().auc_roc
    b = ev.curve_metrics(df.withColumn("p", 1 - F.col("p")), ["model"]).first().auc_roc
    assert a + b == pytest.approx(1.0, abs=2e-6)


def test_one_class_group_gives_null(spark):
    df = spark.createDataFrame([("m", 1, 0.2), ("m", 1, 0.4)], "model string, y long, p double")
    assert ev.curve_metrics(df, ["model"]).first().auc_roc is None


def test_ks_properties(spark):
    df, pdf = _scores(spark)
    both = df.withColumn("side", F.lit("expected")).unionByName(df.withColumn("side", F.lit("actual")))
    assert ev.ks_scores(both, ["model"]).first().ks_statistic == 0.0
    a = pdf["p"].to_numpy()
    b = np.sqrt(a)
    tb = spark.createDataFrame(pd.DataFrame({"model": "m", "side": ["expected"] * len(a) + ["actual"] * len(b),
                                             "p": np.concatenate([a, b])}))
    got = ev.ks_scores(tb, ["model"]).first().ks_statistic
    grid = np.unique(np.concatenate([a, b]))
    want = np.max(np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a)
                         - np.searchsorted(np.sort(b), grid, "right") / len(b)))
    assert got == pytest.approx(want, abs=1e-6)


def test_psi_identical_is_zero_and_pooled_matches_numpy(spark):
    df, pdf = _scores(spark)
    same = df.withColumn("split", F.lit("train")).unionByName(df.withColumn("split", F.lit("test")))
    assert ev.psi_pooled(same, ["model"]).first().psi == 0.0
    assert ev.psi_fixed(same, ["model"]).first().psi == 0.0
    rng = np.random.default_rng(9)
    a, b = rng.uniform(size=500), rng.uniform(size=700) ** 2
    tb = spark.createDataFrame(pd.DataFrame({"model": "m", "split": ["train"] * 500 + ["test"] * 700,
                                             "p": np.concatenate([a, b])}))
    bins = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 11)
    e = np.histogram(a, bins)[0] / 500
    t = np.histogram(b, bins)[0] / 700
    e, t = np.where(e == 0, 1e-6, e), np.where(t == 0, 1e-6, t)
    assert ev.psi_pooled(tb, ["model"]).first().psi == pytest.approx(np.sum((t - e) * np.log(t / e)), abs=1e-6)


def test_psi_fixed_empty_actual_bin_is_infinite(spark):
    rows = [("m", "train", 0.05), ("m", "train", 0.95), ("m", "test", 0.95)]
    df = spark.createDataFrame(rows, "model string, split string, p double")
    assert ev.psi_fixed(df, ["model"]).first().psi == float("inf")


def test_weighted_classification_metrics(spark):
    y = [1, 1, 0, 0, 0, 1]
    p = [0.9, 0.2, 0.7, 0.1, 0.3, 0.6]
    df = spark.createDataFrame([("m", a, b) for a, b in zip(y, p)], "model string, y long, p double")
    r = ev.classification_metrics(df, ["model"]).first()
    # tp=2 fp=1 fn=1 tn=2; class 1 P=R=2/3, class 0 P=R=2/3
    assert r.accuracy == pytest.approx(4 / 6, abs=1e-6)
    assert r.precision == pytest.approx(2 / 3, abs=1e-6)
    assert r.f1_score == pytest.approx(2 / 3, abs=1e-6)
