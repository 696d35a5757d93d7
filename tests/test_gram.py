"""Blocked Gram matrix against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.functions import gram
from riskspark.operators import profile as pr


def data(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 10.0 ** rng.integers(0, 6, d)
    x[rng.random((n, d)) < 0.1] = np.nan
    return pd.DataFrame(x, columns=[f"f{k}" for k in range(d)])


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} {'string' if pdf[c].dtype == object else 'double'}" for c in pdf))


@pytest.mark.parametrize("block, partitions", [(128, 1), (3, 7)])
def test_pairs_equal_pandas_with_missing_values(spark, monkeypatch, block, partitions):
    monkeypatch.setattr(gram, "BLOCK", block)
    pdf = data(300, 8)
    pdf["same"], pdf["none"], pdf["half"] = 3.3, np.nan, np.where(np.arange(300) < 150, 1.7, np.nan)
    df = frame(spark, pdf).repartition(partitions)
    want, n = pdf.corr(), pdf.notna().astype(int).T @ pdf.notna().astype(int)
    rows = gram.pair_correlations(df, [F.col(c) for c in pdf]).collect()
    assert len(rows) == 11 * 12 // 2
    for r in rows:
        a, b = pdf.columns[r.i], pdf.columns[r.j]
        assert r.n == n.loc[a, b]
        if {a, b} & {"same", "none", "half"}:
            assert r.r is None
        else:
            assert r.r == pytest.approx(1.0 if a == b else want.loc[a, b], abs=1e-9)


def test_groups_and_constant_groups(spark):
    pdf = data(200, 3, 2)
    pdf["side"] = ["a", "b", None, "c"] * 50
    pdf.loc[pdf.side == "c", "f1"] = 1e6 + 0.1
    rows = {(r["by"], r.i, r.j): r.r for r in gram.pair_correlations(frame(spark, pdf).repartition(5), [F.col(f"f{k}") for k in range(3)], F.col("side")).collect()}
    assert len(rows) == 4 * 6
    for side in ("a", "b"):
        assert rows[side, 0, 2] == pytest.approx(pdf[pdf.side == side][["f0", "f2"]].corr().iloc[0, 1], abs=1e-9)
    assert rows["c", 0, 1] is None and rows["c", 1, 1] is None and rows["c", 0, 2] is not None and rows[None, 0, 1] is not None


def test_five_hundred_columns_are_one_pass_without_an_expression_a_pair(spark, tmp_path):
    pdf = data(400, 500, 3).fillna(0.5)
    path = str(tmp_path / "wide")
    spark.createDataFrame(pdf).repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    out = pr.correlation_matrix(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Aggregate" not in plan
    got = out.toPandas()
    assert len(got) == 500 * 499 // 2
    want = pdf.corr().to_numpy()
    assert np.abs(got["correlation"].to_numpy() - want[got["i"], got["j"]]).max() < 1e-9


def test_no_rows_and_one_column(spark):
    df = frame(spark, data(5, 2)).limit(0)
    assert gram.pair_correlations(df, [F.col("f0"), F.col("f1")]).count() == 0
    one = frame(spark, data(30, 2))
    assert pr.correlation_matrix(one, ["f0"]).count() == 0
    assert pr.correlation_summary(one, ["f0"]).first().max_correlation == 1.0
