import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskspark.operators import boosting
from riskspark.operators import models as md


def frame(spark, n=3000):
    """A feature with zeros, one with many values, a constant one, one of few values."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x = [rng.choice([0.0, 0.0, 1.5, -2.0]), rng.gauss(0, 1), 7.0, float(rng.randrange(12)), rng.random() * 1e5]
        rows.append((i, float(rng.random() < 1 / (1 + np.exp(-x[0] - x[1] * x[1] + x[3] / 6))), x))
    return spark.createDataFrame(rows, "k int, label double, x array<double>").select("k", "label", array_to_vector("x").alias("features"))


def scores(model, df):
    return [r["p"] for r in model.transform(df).select("k", vector_to_array("probability")[1].alias("p")).orderBy("k").collect()]


@pytest.mark.parametrize("params", [{"maxDepth": 4, "maxBins": 32, "minInstancesPerNode": 20}, {"maxDepth": 3, "maxBins": 256, "minInfoGain": 0.01},
                                    {"maxDepth": 2, "maxBins": 1000}])
def test_trees_are_mllibs(spark, monkeypatch, params):
    """Blocks give the trees, their thresholds and the scores of MLlib's own fit."""
    monkeypatch.setattr(boosting, "MANY", 1)
    monkeypatch.setattr(boosting, "BLOCK", 500)
    monkeypatch.setattr(boosting, "AT_A_TIME", 200)
    df = frame(spark).repartition(3, "k").sortWithinPartitions("k").cache()
    given = {"maxIter": 6, "stepSize": 0.3, "seed": 42, **params}
    own, mllib = boosting.Boosted(**given).fit(df), GBTClassifier(**given).fit(df)
    assert type(own) is type(mllib) and own.treeWeights == mllib.treeWeights
    for a, b in zip(own.trees, mllib.trees):
        splits = lambda t: [x.strip() for x in t.toDebugString.splitlines() if x.strip().startswith(("If", "Else"))]
        assert splits(a) == splits(b)
    assert scores(own, df) == pytest.approx(scores(mllib, df), abs=1e-9)
    assert own.featureImportances.toArray() == pytest.approx(mllib.featureImportances.toArray(), abs=1e-9)


def test_sampled_candidates_are_mllibs(spark, monkeypatch):
    """Over 10 000 rows MLlib reads its split candidates off a sample; the same rows are drawn."""
    monkeypatch.setattr(boosting, "MANY", 1)
    df = spark.range(0, 30_000, 1, 4).select(F.col("id").alias("k"), (F.rand(3) < 0.3 + 0.4 * (F.col("id") % 7 > 3).cast("int")).cast("double").alias("label"),
                                             array_to_vector(F.array((F.col("id") % 7).cast("double"), F.rand(4), F.randn(5))).alias("features")).cache()
    df.count()
    given = {"maxIter": 3, "maxDepth": 4, "maxBins": 16, "seed": 7}
    assert scores(boosting.Boosted(**given).fit(df), df) == pytest.approx(scores(GBTClassifier(**given).fit(df), df), abs=1e-9)


def test_presets_use_blocks_from_many_rows_on(spark, monkeypatch, tmp_path):
    """A preset's fit of many rows goes by blocks, its model is saved, loaded and cut to its first trees as MLlib's; drawn rows stay MLlib's."""
    monkeypatch.setattr(boosting, "MANY", 100)
    calls, whole = [], boosting.fit_blocks
    monkeypatch.setattr(boosting, "fit_blocks", lambda *a: calls.append(1) or whole(*a))
    rows = [(i, float(i % 17), "ab"[i % 2], int((i % 17 > 8) ^ (i % 11 == 0))) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, c string, y int").withColumn("split", F.lit("all"))
    models = {"CatBoost": md.fit(df, "CatBoost", ["x"], ["c"], "y", {"iterations": 3, "depth": 2}),
              "XGBoost": md.fit(df, "XGBoost", ["x"], ["c"], "y", {"n_estimators": 3, "max_depth": 2})}
    assert len(calls) == 2
    md.save_models(models, str(tmp_path), {"target": "y"})
    got = lambda m: sorted(map(str, md.score_long(m, df, "k", "y").collect()))
    assert got(md.load_models(str(tmp_path))) == got(models)
    assert len(md.first_trees(models["XGBoost"].stages[-1], 2).trees) == 2
    md.fit(df, "XGBoost", ["x"], ["c"], "y", {"n_estimators": 2, "max_depth": 2, "subsample": 0.5})
    assert len(calls) == 2
