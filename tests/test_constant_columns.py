"""Columns with one value, tied metrics and empty inputs give NULLs, never an aborted job."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators import compare as C
from riskspark.operators import leaderboard as B
from riskspark.operators import profile as P


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    n = 200
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"a": a, "b": a + rng.normal(size=n), "c": rng.normal(size=n), "one": 0.1, "target": rng.integers(0, 2, n)})
    return spark.createDataFrame(pdf), pdf


def both_sides(frame):
    return frame[0].withColumn("side", F.when(F.col("a") < 0.2, "real").otherwise("synthetic"))


def test_profile(frame):
    df, pdf = frame
    m = {(r.feature1, r.feature2): r.correlation for r in P.correlation_matrix(df).collect()}
    want = pdf.corr()
    for (x, y), r in m.items():
        assert (r is None) == ("one" in (x, y))
        assert r is None or r == pytest.approx(want.loc[x, y], abs=1e-12)
    assert P.correlation_summary(df).first()["max_correlation"] == 1.0
    assert P.correlation_summary(df.select("one")).first()["max_correlation"] is None
    t = {r["column"]: r["correlation"] for r in P.target_correlation(df, "target").collect()}
    assert t["one"] is None and t["a"] is not None
    assert P.quality_report(df, "target").count() > 0 and P.correlation_pairs(df).count() >= 0


def test_compare(frame):
    df = both_sides(frame)
    cols = ["a", "b", "c", "one"]
    pdf = df.toPandas()
    gap = (pdf[pdf.side == "real"][cols].corr() - pdf[pdf.side == "synthetic"][cols].corr()).abs()
    got = C.corr_matrix_diff(df, columns=cols).first()["average_correlation_difference"]
    assert got == pytest.approx(gap.mean().mean(), abs=1e-6)
    assert C.corr_structure(df, columns=cols).first()["correlation_correlation"] is not None
    d = {r["column"]: r for r in C.distribution_metrics(df, columns=cols).collect()}
    assert d["one"]["cosine_similarity"] is None and d["a"]["cosine_similarity"] is not None
    assert C.quality_score(df).count() == 1 and C.evaluate_quality(df).count() > 0


def test_tied_metrics(spark):
    wide = spark.createDataFrame([("m1", "test", 0.7, 0.4), ("m2", "test", 0.8, 0.4)], "model string, split string, auc_roc double, gini double")
    assert B.metric_correlations(wide, metrics=["auc_roc", "gini"]).first()["correlation"] is None


def test_empty_inputs(frame):
    empty = frame[0].limit(0)
    assert all(r["missing_percentage"] is None for r in P.missing_profile(empty).collect())
    assert P.duplicate_profile(empty).first()["duplicate_percentage"] is None
    assert all(r["unique_count"] == 0 for r in P.cardinality_profile(empty).collect())


def test_frame_gate_counts_all_rows(frame):
    df, _ = frame
    assert P.frame_gate(df).first()["rows_seen"] == 200 and P.frame_gate(df.limit(3)).first()["status"] == "warning"
    with pytest.raises(ValueError):
        P.frame_gate(df, target=df.limit(5))
