from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.operators import generate as gen


@pytest.fixture
def imbalanced(spark):
    rng = np.random.default_rng(4)
    n_maj, n_min = 300, 40
    pdf = pd.DataFrame({
        "id": np.arange(n_maj + n_min, dtype="int64"),
        "a": np.concatenate([rng.normal(0, 1, n_maj), rng.normal(2, 0.5, n_min)]),
        "b": np.concatenate([rng.normal(0, 1, n_maj), rng.normal(-1, 0.5, n_min)]),
        "y": [0] * n_maj + [1] * n_min})
    pdf.loc[300:309, ["a", "b"]] = [2.0, -1.0]          # duplicated minority points
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("pivots", [1, 9, None])
def test_knn_exact_vs_brute_force(spark, imbalanced, pivots):
    df, pdf = imbalanced
    pts = df.select("id", F.array("a", "b").alias("f"))
    got = gen.knn(pts, 5, pivots=pivots).toPandas()
    X = pdf[["a", "b"]].to_numpy()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    want = np.sort(D, axis=1)[:, :5]
    for i, part in got.sort_values(["id", "nbr_rank"]).groupby("id"):
        np.testing.assert_allclose(part["dist"].to_numpy(), want[i], atol=1e-9)


def test_smote_reaches_parity_inside_class_box(spark, imbalanced):
    df, pdf = imbalanced
    out = gen.smote(df, ["a", "b"], "y", key="id").toPandas()
    assert len(out) == 300 - 40 and set(out["y"]) == {1}
    mins = pdf[pdf.y == 1]
    for c in ("a", "b"):
        assert out[c].min() >= mins[c].min() - 1e-9 and out[c].max() <= mins[c].max() + 1e-9


def test_smote_is_partition_invariant(spark, imbalanced):
    df, _ = imbalanced
    a = gen.smote(df.repartition(1), ["a", "b"], "y", key="id").toPandas().sort_values(["a", "b"])
    b = gen.smote(df.repartition(13), ["a", "b"], "y", key="id").toPandas().sort_values(["a", "b"])
    np.testing.assert_allclose(a[["a", "b"]].to_numpy(), b[["a", "b"]].to_numpy())


def test_adasyn_and_borderline_only_minority(spark, imbalanced):
    df, _ = imbalanced
    ad = gen.adasyn(df, ["a", "b"], "y", key="id").toPandas()
    assert len(ad) > 0 and set(ad["y"]) == {1}
    assert abs(len(ad) - 260) <= 40                     # rint of quotas, close to the gap
    bl = gen.borderline_smote(df, ["a", "b"], "y", key="id")
    assert bl.count() in (0, 260)


def test_copula_keeps_bounds_and_correlation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    pdf = pd.DataFrame({"x": x, "z": x * 0.8 + rng.normal(size=2000) * 0.6,
                        "k": rng.integers(0, 5, 2000).astype("int64"),
                        "c": rng.choice(["u", "v"], 2000)})
    model = gen.fit_copula(spark.createDataFrame(pdf))
    out = gen.sample_copula(spark, model, 4000, seed=3).toPandas()
    assert out["x"].min() >= pdf["x"].min() and out["x"].max() <= pdf["x"].max()
    assert set(out["k"].unique()) <= set(range(5)) and set(out["c"]) <= {"u", "v"}
    r = np.corrcoef(out["x"], out["z"])[0, 1]
    assert abs(r - np.corrcoef(pdf["x"], pdf["z"])[0, 1]) < 0.05
    again = gen.sample_copula(spark, gen.CopulaModel.from_json(model.to_json(), model.categories), 4000, seed=3, partitions=3)
    pd.testing.assert_frame_equal(out.sort_values("synthetic_id").reset_index(drop=True),
                                  again.toPandas().sort_values("synthetic_id").reset_index(drop=True))


def test_mixes_have_exact_quotas(spark, imbalanced):
    df, _ = imbalanced
    fake = df.withColumnRenamed("id", "sid")
    out = gen.mix_real_synthetic(df, fake, "id", "sid", total=100).groupBy("strategy", "origin").count()
    got = {(r.strategy, r.origin): r["count"] for r in out.collect()}
    assert got[("real70_synth30", "real")] == 70 and got[("real70_synth30", "synthetic")] == 30
    assert got[("real0_synth100", "synthetic")] == 100 and ("real0_synth100", "real") not in got


@pytest.mark.parametrize("d, scaled, share", [(2, True, 0.15), (6, True, 0.5), (10, True, 1.0), (6, False, 0.15)])
def test_knn_meets_a_share_of_the_pairs(spark, monkeypatch, d, scaled, share):
    """Own cells plus probed cells, in pairs, against all of them; one evaluation for each."""
    rng = np.random.default_rng(d)
    n = 1500
    x = rng.normal(size=(12, d))[rng.integers(0, 12, n)] * 3 + rng.normal(size=(n, d)) * 0.6
    x = x if scaled else x * 10.0 ** np.arange(d)
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    seen = {}
    probes = gen._probes

    def counted(bounded, g, tops, cells):
        seen["home"] = [r["cell"] for r in bounded.select("cell").collect()]
        out = probes(bounded, g, tops, cells)
        seen["away"] = [r["cell"] for r in out.select("cell").collect()]
        return out

    monkeypatch.setattr(gen, "_probes", counted)
    got = gen.knn(pts, 5).orderBy("id", "nbr_rank").toPandas()
    size = Counter(seen["home"])
    pairs = sum(size[c] for c in seen["home"]) + sum(size[c] for c in seen["away"])
    D = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    np.testing.assert_allclose(got["dist"].to_numpy().reshape(n, 5), np.sort(D, 1)[:, :5], rtol=1e-9)
    print(d, scaled, pairs / n**2)
    assert pairs <= share * n * n


def test_knn_of_many_equal_points(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(400, [1.0, 2.5]), (401, [None, 1.0])]
    got = gen.knn(spark.createDataFrame(rows, "id long, f array<double>"), 3).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["nbr_rank"], r["nbr_id"], r["dist"]))
    assert sorted(by[0]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)] and sorted(by[399]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]
    assert sorted(by[400]) == [(1, 0, 0.5), (2, 1, 0.5), (3, 2, 0.5)] and 401 not in by


def test_short_mix_is_an_error(spark):
    real, fake = spark.range(100).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "s")
    with pytest.raises(ValueError):
        gen.mix_real_synthetic(real, fake, "k", "s")


def test_copula_of_a_column_of_many_values(spark):
    """30 000 values of uneven shares and NULL: every one can be drawn, shares are kept, no value reaches the driver's plan."""
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 97 == 1, F.lit(None).cast("string"))
                               .otherwise(F.concat(F.lit("v"), (F.col("id") % 30_011).cast("string"))).alias("c"), (F.col("id") % 7).cast("double").alias("x"))
    model = gen.fit_copula(df)
    assert model.n_values["c"] > 19_000 and len(model.to_json()) < 40_000
    out = gen.sample_copula(spark, model, n, seed=5)
    assert out.count() == n
    share = out.agg(F.avg((F.col("c") == "hot").cast("int")), F.avg(F.col("c").isNull().cast("int")), F.countDistinct("c")).first()
    real = df.agg(F.avg((F.col("c") == "hot").cast("int")), F.avg(F.col("c").isNull().cast("int"))).first()
    assert abs(share[0] - real[0]) < 0.01 and abs(share[1] - real[1]) < 0.005 and share[2] > 12_000
    assert out.join(df.select("c").distinct(), "c", "left_anti").where("c is not null").count() == 0


def test_many_classes_need_no_list_of_them(spark):
    """A thousand classes grow to the size of the largest; a class of one row can't."""
    rows = [(i, float(i % 13), float(i % 7), i % 1000) for i in range(3000)] + [(5000 + i, 0.5 * i, 1.0, 0) for i in range(5)] + [(9000, 1.0, 1.0, 4000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = gen.smote(df, ["a", "b"], "y", key="id").groupBy("y").count()
    got = {r["y"]: r["count"] for r in out.collect()}
    assert got == {y: 5 for y in range(1, 1000)}


@pytest.mark.parametrize("kind", ["fit_smote", "fit_adasyn", "fit_borderline_smote", "fit_copula"])
def test_generators_are_saved_and_loaded(spark, imbalanced, tmp_path, kind):
    df, _ = imbalanced
    model = gen.fit_copula(df.select("a", "b", F.col("y").cast("string").alias("y"))) if kind == "fit_copula" else getattr(gen, kind)(df, ["a", "b"], "y", key="id")
    gen.save_generators({"one": model}, str(tmp_path))
    (tmp_path / "other").mkdir()
    failed = {}
    again = gen.load_generators(str(tmp_path), failed=failed)
    assert list(again) == ["one"] and list(failed) == ["other"]
    rows = lambda m: sorted(map(str, gen.sample_generator(m, seed=3).collect()))
    assert rows(again["one"]) == rows(model)
    with pytest.raises(ValueError):
        gen.save_generator(None, str(tmp_path / "none"))
    with pytest.raises(Exception):
        gen.load_generators(str(tmp_path))


def test_knn_holds_one_key_of_pivots_in_a_task(spark, monkeypatch):
    """Pivots of one top or one group's tops meet a bounded batch of points: the largest matrix is
    far below points x pivots, and neighbours within 40 groups equal brute force."""
    monkeypatch.setattr(gen, "CELLS_HELD", 200)
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(1200, 3)), rng.integers(0, 40, 1200)
    pts = spark.createDataFrame([(i, v.tolist(), f"g{c}") for i, (v, c) in enumerate(zip(x, y))], "id long, f array<double>, cls string")
    got = {}
    for r in gen.knn(pts, 4, group="cls").collect():
        got.setdefault(r["id"], []).append((r["nbr_rank"], r["dist"]))
    D = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    D[y[:, None] != y[None]] = np.inf
    np.fill_diagonal(D, np.inf)
    want = np.sort(D, 1)[:, :4]
    for i in range(1200):
        np.testing.assert_allclose([d for _, d in sorted(got[i])], want[i], rtol=1e-9)
    vectors = pts.select(F.lit(0).alias("_kg"), F.col("id").alias("vid"), "f")
    placed, tops, cells = gen._placed(vectors, "_kg", None)
    assert 20 <= cells.count() <= 60 and tops.count() <= 16
    assert cells.groupBy("top").count().agg(F.max("count")).first()[0] < cells.count()


def test_knn_gives_out_no_more_pairs_than_it_keeps(spark, monkeypatch):
    """Points on a grid (many equal distances): a cell gives out k + 1 pairs at most for a point that
    meets it, none beyond the bound, in tasks of a given number; neighbours equal brute force, ids included."""
    monkeypatch.setattr(gen, "ROWS_A_SALT", 16)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (600, 2)).astype(float)
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    meet, met = gen._meet, []

    def watched(pivots, rows, key, kernel, extra, *more):
        out = meet(pivots, rows, key, kernel, extra, *more)
        if "nbr_id" in extra:
            met.append((out.rdd.getNumPartitions(), out.groupBy("vid").count().collect(), dict(map(tuple, rows.groupBy("vid").count().collect()))))
        return out

    monkeypatch.setattr(gen, "_meet", watched)
    got = {}
    for r in gen.knn(pts, 4).collect():
        got.setdefault(r["id"], []).append((r["dist"], r["nbr_id"]))
    assert len(met) == 2
    for tasks, pairs, cells in met:
        assert tasks == 8 and all(r["count"] <= 5 * cells[r["vid"]] for r in pairs)
    for i in range(600):
        want = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(600) if j != i)[:4]
        assert sorted(got[i]) == want
