import numpy as np
import pandas as pd
import pytest

from riskspark.operators import profile as pr
from riskspark.operators import transform as tr


@pytest.fixture
def dirty(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, np.nan, 4.0, 10.0, 2.0], "b": ["x", None, "y", "y", "z", None],
                        "c": [1, 1, 2, 2, 1, 1], "d": [5, 5, 6, 7, 8, 5]})
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                 "a double, b string, c long, d long"), pdf


def test_missing_and_duplicates(spark, dirty):
    df, _ = dirty
    m = {r.column: r.missing_count for r in pr.missing_profile(df).collect()}
    assert m == {"a": 1, "b": 2, "c": 0, "d": 0, "summary": 3}
    dup = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "k long, s string")
    r = pr.duplicate_profile(dup).first()
    assert r.duplicate_count == 2        # NULLs compare equal, first copy kept


def test_median_imputer_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "v double")
    out = tr.impute(df, "median").toPandas()
    assert out["v"].iloc[4] == 3.0        # pandas / sklearn median, not MLlib's lower middle (2.0)


def test_mode_imputer_smallest_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert tr.impute(df, "median").toPandas()["s"].iloc[4] == "a"


def test_population_std_scaler(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    out = tr.standard_scale(df, ["v"]).toPandas()["v"].to_numpy()
    x = np.array([1, 2, 3, 10.0])
    np.testing.assert_allclose(out, (x - x.mean()) / x.std(ddof=0))


def test_constant_column_divides_by_one(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert tr.standard_scale(df, ["v"]).toPandas()["v"].tolist() == [0.0, 0.0]


def test_label_codes_alphabetical_with_nan(spark, dirty):
    df, _ = dirty
    out = tr.label_encode(df, columns=["b"]).toPandas()
    # sorted texts: nan, x, y, z
    assert out["b"].tolist() == [1, 0, 2, 2, 3, 0]


def test_detect_types_binary(spark, dirty):
    df, _ = dirty
    k = tr.detect_types(df)
    assert k["binary"] == ["c"] and set(k["numeric"]) == {"a", "d"} and k["categorical"] == ["b"]


def test_iqr_outliers_match_pandas(spark, dirty):
    df, pdf = dirty
    got = {r.column: r for r in pr.iqr_outliers(df).collect()}
    s = pdf["a"].dropna()
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert got["a"].lower_bound == pytest.approx(lo)
    assert got["a"].outlier_count == int(((pdf["a"] < lo) | (pdf["a"] > hi)).sum())


def test_preprocess_pipeline_roundtrip(spark, dirty, tmp_path):
    df, _ = dirty
    out, model = tr.preprocess(df, target="c")
    again = model.transform(df)
    assert sorted(out.columns) == sorted(again.columns)
    path = str(tmp_path / "pre")
    model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel
    loaded = PipelineModel.load(path)
    a = loaded.transform(df).toPandas()
    b = again.toPandas()
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(b.columns)])


def test_sample_table_share_and_reproducible(spark):
    from riskspark.sources.io import sample_table
    a = sample_table(spark, 2000, 3, seed=1, partitions=2).toPandas()
    b = sample_table(spark, 2000, 3, seed=1, partitions=7).toPandas()
    assert list(a.columns) == ["feature_0", "feature_1", "feature_2", "default"]
    assert a["default"].sum() == 600                      # top 30 % of an independent score
    assert abs(a["feature_0"].mean()) < 0.1 and abs(a["feature_0"].std() - 1) < 0.1
    pd.testing.assert_frame_equal(a, b)
