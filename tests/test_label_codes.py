"""Label codes as a joined table."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskspark.operators.transform import LabelCoder, label_encode


def test_codes_are_dense_sorted_and_not_in_the_plan(spark):
    df = spark.range(30_000).select("id", F.concat(F.lit("label-"), F.col("id") % 20_000).alias("c"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("d"))
    out = label_encode(df)
    rows = out.join(df.select("id", F.col("c").alias("text")), "id").collect()
    want = {t: i for i, t in enumerate(sorted({r["text"] for r in rows}))}
    assert all(r["c"] == want[r["text"]] for r in rows)
    assert {(r["id"] % 3 > 0, r["d"]) for r in rows} == {(True, 1), (False, 0)}          # 'nan' before 'x'
    assert "label-1" not in out._jdf.queryExecution().toString()
    assert {r["d"] for r in label_encode(df, null_code=-1).collect()} == {0, -1}


def test_model_round_trip_and_unseen_labels(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "c string, n int")
    model = LabelCoder(inputCols=["c"]).fit(df)
    path = f"file://{tmp_path}/m"
    PipelineModel(stages=[model]).write().overwrite().save(path)
    new = spark.createDataFrame([("a", 1), ("zzz", 2), (None, 3), ("b", 4)], "c string, n int")
    for m in (model, PipelineModel.load(path)):
        assert [r["c"] for r in m.transform(new).orderBy("n").collect()] == [0, 3, 2, 1]
