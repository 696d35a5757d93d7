import numpy as np
import pandas as pd
import pytest

from riskspark.operators import split as sp


@pytest.fixture
def frame(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.arange(1001, dtype="int64"), "t": rng.integers(0, 50, 1001),
                        "y": (rng.uniform(size=1001) < 0.3).astype("int64")})
    return spark.createDataFrame(pdf).repartition(7), pdf


def test_split_disjoint_complete_and_stratified(spark, frame):
    df, pdf = frame
    out = sp.stratified_split(df, "k", "y").toPandas()
    assert sorted(out["k"]) == list(range(1001))
    for cls, part in out.groupby("y"):
        n = len(part)
        shares = part["split"].value_counts()
        for name, r in (("train", 0.6), ("validation", 0.2), ("test", 0.2)):
            assert abs(shares.get(name, 0) - r * n) <= 1


def test_folds_balanced(spark, frame):
    df, _ = frame
    out = sp.stratified_folds(df, "k", "y", 5).toPandas()
    for _, part in out.groupby("y"):
        sizes = part["fold"].value_counts()
        assert sizes.max() - sizes.min() <= 1


@pytest.mark.parametrize("n,k", [(1001, 5), (1000, 5)])
def test_time_series_splits_match_loop(spark, n, k):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.arange(n, dtype="int64"), "t": rng.integers(0, 40, n)})
    got = sp.time_series_splits(spark.createDataFrame(pdf), "t", "k", k).toPandas()
    srt = pdf.sort_values(["t", "k"]).reset_index(drop=True)
    s = n // k
    want = []
    for i in range(k):
        end, vend = (i + 1) * s, min((i + 2) * s, n)
        if end >= n:
            break
        want += [(i, "train", kk) for kk in srt["k"][:end]] + [(i, "validation", kk) for kk in srt["k"][end:vend]]
    got_set = sorted(zip(got["fold"], got["role"], got["k"]))
    assert got_set == sorted(want)
    assert got["fold"].nunique() == (k if n % k else k - 1)


def test_split_by_cut_buckets_equals_ranks_of_all_rows(spark):
    """Repeated and null keys and null classes get the splits that the ranks of all rows give."""
    from collections import Counter
    from pyspark.sql import functions as F
    from riskspark.operators.kernels import hash_rank
    rows = [(i % 700 if i % 50 else None, [0, 1, None][i % 3]) for i in range(4000)] + [(5, 1)] * 300
    df = spark.createDataFrame(rows, "k long, y long").repartition(6)
    for strat in ("y", None):
        got = sp.split_assign(df, "k", strat, ("a", "b", "c"), (0.6, 0.2, 0.2))
        assert got.columns == (["y", "k", "split"] if strat else ["k", "y", "split"])
        rank, n = F.col("rank"), F.col("group_n")
        want = hash_rank(df, [strat] if strat else [], "k", sp.DEFAULT_SEED).select("k", *(["y"] if strat else []), F.when(
            rank <= F.floor(n * 0.6 + 0.5), "a").when(rank <= F.floor(n * 0.8 + 0.5), "b").otherwise("c").alias("split"))
        assert Counter(got.select(*want.columns).collect()) == Counter(want.collect())


def test_a_loan_meets_its_split_before_the_scoring_rules(spark, tmp_path):
    """Splits are joined to loans, not to the rows of the rules, and loans are read of the tables once."""
    from riskspark.sources import fixtures as fx
    spark.createDataFrame([(i, i % 3, 1000.0 + 7 * i) for i in range(60)] + [(7, 1, 50000.0)], "o_orderkey long, o_custkey long, o_totalprice double").selectExpr(
        "*", "timestamp_ntz'1998-01-01' AS o_orderdate", "'1' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, "S", 10.0 * i) for i in range(3)], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 2.0, 0.1)], "l_orderkey long, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = fx.scored_split(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Generate explode") < plan.find("Join") and "o_orderkey" not in plan
    assert out.columns == ["loan_id", "model", "as_of", "segment", "y", "p", "split"]
    got = out.groupBy("model", "loan_id").count().collect()
    assert {r["count"] for r in got if r.loan_id == 7} == {4} and {r["count"] for r in got if r.loan_id != 7} == {1} and len(got) == 240
