import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskspark.operators import models as md
from riskspark.operators import logistic
from riskspark.operators.logistic import fit_together, fold_auc, probabilities, sigmoid


def frame(spark, n=600):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x = [rng.gauss(2e5, 9e4), rng.gauss(0, 1), rng.gauss(5, 2), 7.0]
        z = (x[0] - 2e5) / 9e4 - 0.5 * x[1]
        rows.append((i % 2, float(rng.random() < 1 / (1 + np.exp(-z))), x))
    rows += [(2, 1.0, [1.0, 2.0, 3.0, 4.0]), (2, 1.0, [2.0, 2.5, 1.0, 0.0])]
    return spark.createDataFrame(rows, "out int, label double, x array<double>").select("out", "label", array_to_vector("x").alias("features"))


def test_fits_done_together_are_mllibs(spark):
    """L1, L2 and mixed penalties, features of unlike scales, a constant one, a fold of one label."""
    df = frame(spark).repartition(5)
    given = [{"regParam": 0.02, "elasticNetParam": 1.0}, {"regParam": 0.3, "elasticNetParam": 0.0}, {"regParam": 0.05, "elasticNetParam": 0.4}, {"regParam": 1e-5}]
    state = fit_together(df, [{f: p for f in range(3)} for p in given], 100)
    for f in (0, 1):
        w, b = state[f].raw()
        for t, p in enumerate(given):
            m = LogisticRegression(standardization=False, maxIter=1000, tol=1e-13, **p).fit(df.where(F.col("out") == f))
            assert w[:, t] == pytest.approx(m.coefficients.toArray(), rel=2e-3, abs=1e-9)
            assert b[t] == pytest.approx(m.intercept, rel=2e-3)
    held = df.withColumn("fold", F.col("out"))
    got = probabilities(held, state)
    assert got.count() == 4 * 602 and {r["p"] for r in got.where("fold = 2").collect()} == {1.0}
    x = np.array([r["features"].toArray() for r in held.where("out = 0").collect()])
    w, b = state[0].raw()
    assert sorted(r["p"] for r in got.where("fold = 0 and trial = 2").collect()) == pytest.approx(sorted(sigmoid(x @ w[:, 2] + b[2])))


def test_logistic_trials_take_a_few_passes(spark, monkeypatch):
    """The whole budget of logistic trials is fitted without a fit of its own for each trial and fold."""
    from riskspark.operators import logistic
    passes, single = [], []
    whole = logistic.sums
    monkeypatch.setattr(logistic, "sums", lambda *a: passes.append(1) or whole(*a))
    monkeypatch.setattr(md, "estimator", lambda family, *a, **k: single.append(family) or LogisticRegression(maxIter=1))
    rows = [(i, float(i % 17), float((i * 7) % 5), int((i % 17 > 8) ^ (i % 11 == 0))) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, z double, y int")
    got = md.param_search(df, ["LogisticRegression"], ["x", "z"], [], "y", "k", k=2).collect()
    assert len(got) == 100 and sorted(r["rank"] for r in got) == list(range(1, 101))
    assert 0 < len(passes) < 40 and len(single) == 2         # one a fold builds the preparing pipeline


def test_scores_are_ranked_a_few_trials_at_a_time(spark, monkeypatch):
    """Exact AUCs over several ranges of a fold's scores and several runs of trials, with ties and a model that scores
    all rows alike: those of ``curve_metrics`` over a stored row a score, without that table."""
    from riskspark.operators.evaluate import curve_metrics
    df = frame(spark, 900).where("out < 2").withColumn("fold", F.col("out")).repartition(5)
    df = df.unionByName(df.where("label = 1").limit(40))          # rows that tie
    state = fit_together(df, [{f: p for f in range(2)} for p in ({"regParam": 0.02, "elasticNetParam": 1.0}, {"regParam": 1e9, "elasticNetParam": 1.0}, {"regParam": 0.1})], 50)
    want = {(r["trial"], r["fold"]): r["auc_roc"] for r in curve_metrics(probabilities(df, state), ["trial", "fold"]).collect()}
    runs, whole = [], logistic.scorer
    monkeypatch.setattr(logistic, "A_RANGE", 50)
    monkeypatch.setattr(logistic, "VALUES", 1)
    monkeypatch.setattr(logistic, "LEAST", 2)
    monkeypatch.setattr(logistic, "scorer", lambda state, trials=None: runs.append(list(trials)) or whole(state, trials))
    held = logistic.arrayed(df).withColumn("fold", F.col("outs")[0])
    assert {(r["trial"], r["fold"]): r["auc_roc"] for r in fold_auc(held, state, 940).collect()} == want
    assert [2] in runs and [0, 1] in runs and want[(1, 0)] == 0.5


def test_a_row_stands_once_for_the_folds_that_prepare_it_alike(spark):
    """A search stores a row once and not a copy for each fold left out; only rows whose fills differ between folds come again."""
    rows = [(i, float(i) if i % 9 else None, "ab"[i % 2], int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, c string, y int")
    folded, fitted = md.fold_pipelines(df, ["x"], ["c"], "y", "k", 3, rates=False)
    got = md.rows_of_folds(folded, fitted, ["x", "c"])
    full = got.select(F.explode("outs").alias("out"), "fold", "label", F.col("x")[0].alias("v"), F.col("x")[1].alias("c"))
    assert got.where(F.size("outs") == 3).count() >= 300 - 34 and full.count() == 900
    for f, model in fitted.items():
        want = sorted((r["fold"], r["label"], *r["features"].toArray()) for r in model.transform(folded).collect())
        assert sorted((r["fold"], r["label"], r["v"], float(r["c"])) for r in full.where(F.col("out") == f).collect()) == want
