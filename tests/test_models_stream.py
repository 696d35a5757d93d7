import json

import pytest
from pyspark.sql import functions as F

from riskspark.operators import models as md


def test_param_translation():
    p, ignored = md.mllib_params("gbt", {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.2,
                                         "reg_alpha": 1.0, "subsample": 0.5})
    assert p == {"maxIter": 10, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 0.5}
    assert ignored == ["reg_alpha"]
    p, _ = md.mllib_params("rf", {"n_estimators": 7})
    assert p == {"numTrees": 7}
    p, _ = md.mllib_params("lr", {"C": 2.0, "penalty": "l1"}, n_train=100)
    assert p == {"regParam": 1 / 200, "elasticNetParam": 1.0}


def test_fit_predict_proba(spark):
    rows = [(i, float(i % 17), "a" if i % 3 else "b", int(i % 17 > 8)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, c string, y int")
    m = md.fit(df, "LogisticRegression", ["x"], ["c"], "y")
    out = md.predict_proba(m, df.withColumn("label", F.col("y").cast("double")))
    r = out.agg(F.min("p"), F.max("p")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0


def test_sample_params_reproducible():
    assert md.sample_params("XGBoost", 3, 1) == md.sample_params("XGBoost", 3, 1)

def search_frame(spark):
    rows = [(i, float(i % 17), float((i * 7) % 5), int((i % 17 > 8) ^ (i % 11 == 0))) for i in range(400)]
    return spark.createDataFrame(rows, "k long, x double, z double, y int")


def test_search_and_refit(spark):
    df = search_frame(spark)
    trials, models = md.search_and_refit(df, ["LogisticRegression"], ["x", "z"], [], "y", "k", n_trials=2, k=2)
    assert trials.count() == 2 and trials.where("rank = 1").first()["mean_auc"] >= 0.65
    assert md.score_long(models, df.withColumn("split", F.lit("all")), "k", "y").count() == 400


def test_draws_share_all_but_the_tree_count():
    trials = md.sample_params("XGBoost", 25, 7, share=10)
    fits = md.ensembles("XGBoost", trials)
    assert [len(m) for _, m in fits] == [10, 10, 5]
    assert sorted(i for _, m in fits for i, _ in m) == list(range(25))
    for params, members in fits:
        assert params["n_estimators"] == max(n for _, n in members)
        assert all({**params, "n_estimators": n} == trials[i] for i, n in members)
    assert [len(m) for _, m in md.ensembles("LogisticRegression", md.sample_params("LogisticRegression", 4))] == [1] * 4
    assert len(md.ensembles("CatBoost", md.sample_params("CatBoost", 6, share=1))) == 6


def test_search_equals_fits_done_singly(spark, monkeypatch):
    """Trials scored as the first trees of a shared fit, or concurrently, give the AUC of a fit of their own."""
    monkeypatch.setitem(md.SEARCH_SPACE, "XGBoost", {**md.SEARCH_SPACE["XGBoost"], "n_estimators": ("int", 2, 6), "max_depth": ("int", 2, 3)})
    df = search_frame(spark)
    got = md.param_search(df, ["XGBoost", "LogisticRegression"], ["x", "z"], [], "y", "k", n_trials=3, k=2, share=3).collect()
    assert len(got) == 6
    for r in got:
        cv = md.cross_validate(df, r["model"], ["x", "z"], [], "y", "k", 2, json.loads(r["params"]))
        assert cv.first()["mean_auc"] == pytest.approx(r["mean_auc"], abs=1e-6)


def test_forest_prefix(spark, monkeypatch):
    monkeypatch.setitem(md.SEARCH_SPACE, "RandomForest", {**md.SEARCH_SPACE["RandomForest"], "n_estimators": ("int", 2, 9), "max_depth": ("int", 2, 3)})
    df = search_frame(spark)
    trials, models = md.search_and_refit(df, ["RandomForest"], ["x", "z"], [], "y", "k", n_trials=4, k=2, share=4)
    best = json.loads(trials.where("rank = 1").first()["params"])
    assert len(models["RandomForest"].stages[-1].trees) == best["n_estimators"]
    assert trials.agg(F.min("mean_auc")).first()[0] >= 0.6


def test_param_search_query_asks_for_the_whole_budget():
    """100 trials of each of the five families and 5 folds, by the operator's own defaults."""
    import inspect
    given = inspect.signature(md.param_search).parameters
    assert given["n_trials"].default == 100 and given["k"].default == 5
    assert list(md.SEARCH_SPACE) == ["XGBoost", "LightGBM", "CatBoost", "RandomForest", "LogisticRegression"]
    fits = [md.ensembles(name, md.sample_params(name, 100)) for name in md.SEARCH_SPACE]
    assert [sum(len(m) for _, m in f) for f in fits] == [100] * 5


@pytest.mark.parametrize("preset", list(md.SEARCH_SPACE))
def test_every_trial_is_drawn_apart(preset):
    """By default no two of the 100 trials share a setting of the parameters that are drawn from a
    continuous range, and every trial of an ensemble is a fit of its own."""
    trials = md.sample_params(preset, 100)
    for name, spec in md.SEARCH_SPACE[preset].items():
        if spec[0] in ("float", "log"):
            assert len({t[name] for t in trials}) == 100
    assert [len(m) for _, m in md.ensembles(preset, trials)] == [1] * 100


@pytest.mark.parametrize("preset", list(md.PRESETS))
def test_every_preset_separates(spark, preset):
    """The acceptance floor of an AUC of 0.65, on rows that a model can tell apart."""
    rows = [(i, float(i % 17), float((i * 7) % 5), int((i % 17 > 8) ^ (i % 11 == 0))) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, z double, y int")
    light = {"n_estimators": 5} if preset not in ("CatBoost", "HistGradientBoosting", "LogisticRegression") else {"iterations": 5} if preset == "CatBoost" else {"max_iter": 5 if preset == "HistGradientBoosting" else 100}
    m = md.fit(df, preset, ["x", "z"], [], "y", light)
    from riskspark.operators.evaluate import curve_metrics
    scored = md.predict_proba(m, df.withColumn("label", F.col("y").cast("double"))).select(F.lit(1).alias("g"), "y", "p")
    assert curve_metrics(scored, ["g"]).first()["auc_roc"] >= 0.65


def test_failures_are_raised_or_recorded(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1)], "k long, x double, y int")
    with pytest.raises(Exception):
        md.train_all(df, ["missing"], [], "y", ["LogisticRegression"])
    failed = {}
    assert md.train_all(df, ["missing"], [], "y", ["LogisticRegression"], failed=failed) == {} and "LogisticRegression" in failed


def test_unordered_categories_are_split_by_their_rates(spark):
    """Forty categories whose good ones are scattered over the alphabet: shallow trees over codes need many cuts, over rates one."""
    import random
    rng = random.Random(4)
    good = set(rng.sample(range(40), 20))
    rows = [(i, f"c{c:02d}", rng.random(), int(rng.random() < (0.9 if c in good else 0.1)), "train" if i % 3 else "test")
            for i, c in enumerate(rng.randrange(40) for _ in range(2400))]
    df = spark.createDataFrame(rows, "k long, c string, x double, y int, split string")
    light = {"XGBoost": {"n_estimators": 3, "max_depth": 2}, "CatBoost": {"iterations": 3, "depth": 2}}
    models = md.train_all(df.where("split = 'train'"), ["x"], ["c"], "y", list(light), light)
    from riskspark.operators.evaluate import curve_metrics
    test = df.where("split = 'test'").union(spark.createDataFrame([(9999, "unseen", 0.5, 1, "test"), (9998, None, 0.5, 0, "test")], df.schema))
    auc = {r["model"]: r["auc_roc"] for r in curve_metrics(md.score_long(models, test, "k", "y"), ["model"]).collect()}
    assert auc["CatBoost"] > auc["XGBoost"] + 0.05


def test_folders_of_models(spark, tmp_path):
    df = search_frame(spark).withColumn("split", F.lit("all"))
    fitted = md.train_all(df, ["x", "z"], [], "y", ["LogisticRegression"])
    md.save_models(fitted, str(tmp_path), {"target": "y"})
    (tmp_path / "half_written").mkdir()
    loaded = md.load_models(str(tmp_path))
    rows = lambda m: sorted(map(str, md.score_long(m, df, "k", "y").collect()))
    assert list(loaded) == ["LogisticRegression"] and rows(loaded) == rows(fitted)
    failed = {}
    assert md.load_models(str(tmp_path), ["half_written"], failed) == {} and "half_written" in failed
    with pytest.raises(ValueError):
        md.save_model(None, str(tmp_path / "none"), {})


def test_presets_are_fitted_side_by_side(spark, monkeypatch):
    """Every preset's fit begins before any has ended, each is done once, and the rows keep the order asked for."""
    import threading
    from riskspark.plans import benchmark as bm
    together, done = threading.Barrier(3, timeout=30), []

    def fit(frame, preset, *a):
        together.wait()
        done.append(preset)
        return preset

    rows = spark.createDataFrame([(1, "train", 0), (2, "test", 1)], "loan_id long, split string, target int")
    monkeypatch.setattr(bm, "loan_frame", lambda *a: rows)
    monkeypatch.setattr(bm.fx, "stored_result", lambda s, d, name, build: build())
    monkeypatch.setattr(bm.md, "fit", fit)
    monkeypatch.setattr(bm.md, "score_long", lambda models, df, *a: df.select(F.lit([*models][0]).alias("model"), "loan_id"))
    names = ["XGBoost", "RandomForest", "LogisticRegression"]
    out = bm.predictions(spark, "nowhere", names)
    assert sorted(done) == sorted(names) and [r["model"] for r in out.collect()] == [n for n in names for _ in range(2)]


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """Every fold's fit begins before any has ended, and the scores are those of the left-out rows."""
    import threading
    together, whole = threading.Barrier(3, timeout=60), md.fit

    def fit(*a, **kw):
        together.wait()
        return whole(*a, **kw)

    monkeypatch.setattr(md, "fit", fit)
    got = md.cross_validate(search_frame(spark), "LogisticRegression", ["x", "z"], [], "y", "k", k=3).collect()
    assert sorted(r["fold"] for r in got) == [0, 1, 2] and all(r["auc_roc"] > 0.65 for r in got)


def test_forest_rows_keep_their_nodes():
    assert md.estimator("rf", {"numTrees": 3}).getCacheNodeIds()


def test_presets_share_their_cleaning(spark, monkeypatch):
    """Fits that are given one ``Cleaning`` impute and code their rows by the same fitted stages, and score as fits of their own do."""
    fitted, whole = [], md.ReferenceImputer._fit
    monkeypatch.setattr(md.ReferenceImputer, "_fit", lambda self, df: fitted.append(1) or whole(self, df))
    rows = [(i, float(i % 17) if i % 7 else None, "ab"[i % 2] if i % 5 else None, int((i % 17 > 8) ^ (i % 11 == 0))) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, c string, y int").withColumn("split", F.lit("all"))
    light = {"CatBoost": {"iterations": 2, "depth": 2}, "RandomForest": {"n_estimators": 3, "max_depth": 3}, "LogisticRegression": {}}
    cleaning = md.Cleaning()
    scored = lambda m: sorted(map(str, md.score_long(m, df, "k", "y").collect()))
    together = {p: md.fit(df, p, ["x"], ["c"], "y", o, cleaning) for p, o in light.items()}
    assert len(fitted) == 1
    assert scored(together) == scored({p: md.fit(df, p, ["x"], ["c"], "y", o) for p, o in light.items()}) and len(fitted) == 4
