import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators.kernels import exact_quantiles, hash_rank, value_cumsums


def _values(spark, n=3000, parts=8):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 3, n)
    v = np.round(rng.normal(size=n), 2)          # many ties
    v[:900] = 0.5                                # one value holds ~a third of the rows
    pdf = pd.DataFrame({"g": g.astype("int64"), "v": v})
    return spark.createDataFrame(pdf).repartition(parts), pdf


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_value_cumsums_exact_over_any_ranges(spark, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        _check_cumsums(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def _check_cumsums(spark):
    df, pdf = _values(spark)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = value_cumsums(counts, ["g"], "v", ["n"]).toPandas()
    want = pdf.groupby(["g", "v"]).size().rename("n").reset_index().sort_values(["g", "v"])
    want["cum_n"] = want.groupby("g")["n"].cumsum()
    m = got.merge(want, on=["g", "v"], suffixes=("", "_w"))
    assert len(m) == len(want)
    assert (m["cum_n"] == m["cum_n_w"]).all()


def test_exact_quantiles_match_numpy(spark):
    df, pdf = _values(spark)
    probs = [i * 0.1 for i in range(11)]
    probs[-1] = 1.0
    got = exact_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        want = np.quantile(part["v"].to_numpy(), probs)
        np.testing.assert_allclose(np.array(got.loc[g, "quantiles"]), want, rtol=0, atol=1e-12)


def test_quantiles_ignore_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,), (2.0,), (10.0,)], "v double")
    q = exact_quantiles(df, [], "v", [0.5]).first()
    assert q["quantiles"][0] == pytest.approx(3.0)   # midpoint of 2 and 4, not the lower value


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_hash_rank_is_partition_invariant(spark, parts):
    pdf = pd.DataFrame({"k": np.arange(2000, dtype="int64"), "c": np.arange(2000) % 3})
    df = spark.createDataFrame(pdf).repartition(parts)
    got = hash_rank(df, ["c"], "k", 42).toPandas()
    import hashlib
    pdf["h"] = [hashlib.md5(f"42:{k}".encode()).hexdigest() for k in pdf["k"]]
    pdf["want"] = pdf.sort_values(["h", "k"]).groupby("c").cumcount() + 1
    m = got.merge(pdf, on="k")
    assert (m["rank"] == m["want"]).all()
    assert (m["group_n"] == m.groupby("c_x")["k"].transform("count")).all()


def test_one_hot_group_among_small_and_null_ones(spark):
    rng = np.random.default_rng(3)
    g = np.concatenate([np.zeros(2000), rng.integers(1, 40, 500)]).astype("int64")   # one hot group
    v = np.round(rng.normal(size=len(g)), 3)
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf).withColumn("g", F.when(F.col("g") != 7, F.col("g")))
    got = value_cumsums(df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), ["g"], "v", ["n"]).toPandas().fillna({"g": 7})
    want = pdf.groupby(["g", "v"]).size().rename("n").reset_index().sort_values(["g", "v"])
    want["cum_n"] = want.groupby("g")["n"].cumsum()
    m = got.merge(want, on=["g", "v"], suffixes=("", "_w"))
    assert len(m) == len(want) and (m["cum_n"] == m["cum_n_w"]).all()


def test_exploding_the_input_keeps_the_plan(spark):
    """No size estimate decides on a window over a whole group."""
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("v"))
    for frame in (df, df.select(F.explode(F.array_repeat("v", 50)).alias("v"))):
        plan = value_cumsums(frame.groupBy("v").agg(F.count(F.lit(1)).alias("n")), [], "v", ["n"])._jdf.queryExecution().toString()
        assert "_rs_part" in plan


def test_binary_search_counts_match_linear(spark):
    from riskspark.functions.bins import count_below_sorted
    arr = sorted(np.round(np.random.default_rng(1).normal(size=37), 1).tolist())
    xs = [-5.0, arr[0], arr[5], 0.0, arr[-1], 5.0, float(arr[10]) + 1e-9]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("a", F.array(*[F.lit(v) for v in arr]))
    got = count_below_sorted(df, F.col("x"), "a", 40, "k").select("x", "k").collect()
    for r in got:
        assert r.k == sum(1 for v in arr if v < r.x)
    none = spark.createDataFrame([(1.0,)], "x double").withColumn("a", F.lit(None).cast("array<double>"))
    assert count_below_sorted(none, F.col("x"), "a", 40, "k").first().k == 0


def test_a_row_looks_only_at_the_quantile_levels_about_its_share(spark, monkeypatch):
    """1001 levels over groups of many, few, equal and single values equal NumPy's, and no row's
    expression goes through all levels: those it looks at are a slice of them."""
    import numpy as np
    from pyspark.sql import functions as F
    from riskspark.operators import kernels
    sliced, plain = [], F.slice
    monkeypatch.setattr(kernels.F, "slice", lambda *a: sliced.append(a) or plain(*a))
    rng = np.random.default_rng(5)
    groups = {"many": rng.normal(size=3000), "few": rng.integers(0, 3, 2000).astype(float), "equal": np.full(50, 7.0),
              "one": np.array([2.5]), "two": np.array([1.0, 4.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double")
    for probs in ([i / 1000 for i in range(1001)], [0.5], [0.0, 0.1, 0.9, 0.901, 1.0]):
        got = {r["g"]: (r["n"], r["q"]) for r in kernels.exact_quantiles(rows, ["g"], "v", probs, "q").collect()}
        for g, x in groups.items():
            assert got[g][0] == len(x)
            np.testing.assert_allclose(got[g][1], np.quantile(x, probs), rtol=1e-12)
    assert len(sliced) == 3


def test_running_sums_shuffle_the_placed_rows_once(spark):
    """The rows meet the offsets of their range where they lie; only the window deals them anew."""
    df, _ = _values(spark)
    out = value_cumsums(df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), ["g"], "v", ["n"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_row_of_no_count_comes_before_the_counted_one(spark):
    counts = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 3), ("a", 2.0, 0), ("a", 3.0, 0), (None, 2.0, 0), (None, 2.0, 5)], "g string, v double, n long")
    got = {(r.g, r.v, r.n): (r.cum_n, r.tot_n) for r in value_cumsums(counts, ["g"], "v", ["n"]).collect()}
    assert got == {("a", 1.0, 2): (2, 5), ("a", 2.0, 0): (2, 5), ("a", 2.0, 3): (5, 5), ("a", 3.0, 0): (5, 5),
                   (None, 2.0, 0): (0, 5), (None, 2.0, 5): (5, 5)}
