"""Default-probability classifiers on MLlib.

The reference's six model presets map onto MLlib estimators (boosting
presets -> ``GBTClassifier``, random forest, logistic regression). A model is
a ``Pipeline``: missing-value imputation, label codes for text columns,
``VectorAssembler``, estimator — fitted once on the training split and applied
to any split. Scores land in one long predictions table
``(model, split, key, y, p)`` that every evaluation operator reads.
"""

from __future__ import annotations

import json
import random
import threading
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, TargetEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.operators.boosting import Boosted
from riskspark.operators.evaluate import curve_metrics
from riskspark.operators.kernels import shuffles_dropped, store_table
from riskspark.operators.logistic import fit_together, fold_auc
from riskspark.operators.split import stratified_folds
from riskspark.operators.transform import LabelCoder, ReferenceImputer


@dataclass
class Preset:
    name: str
    family: str
    params: dict = field(default_factory=dict)


# Default hyper-parameters of the reference's presets.
PRESETS = {
    "XGBoost": Preset("XGBoost", "gbt", {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1,
                                         "random_state": 42}),
    "CatBoost": Preset("CatBoost", "gbt", {"iterations": 100, "depth": 6, "learning_rate": 0.1,
                                           "random_state": 42}),
    "LightGBM": Preset("LightGBM", "gbt", {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1,
                                           "random_state": 42, "max_bin": 255}),
    "HistGradientBoosting": Preset("HistGradientBoosting", "gbt", {"max_iter": 100, "max_depth": 6,
                                                                   "learning_rate": 0.1, "random_state": 42,
                                                                   "max_bins": 255}),
    "RandomForest": Preset("RandomForest", "rf", {"n_estimators": 100, "max_depth": 10, "random_state": 42}),
    "LogisticRegression": Preset("LogisticRegression", "lr", {"max_iter": 1000, "C": 1.0, "random_state": 42}),
}

# Defaults of the reference's libraries that have an MLlib counterpart. LightGBM and
# HistGradientBoosting share theirs, so these two presets are one model under two names.
LIBRARY_DEFAULTS = {
    "XGBoost": {"max_bins": 256, "min_samples_leaf": 1},
    "CatBoost": {"max_bins": 254, "min_samples_leaf": 1},
    "LightGBM": {"max_bins": 255, "min_samples_leaf": 20},
    "HistGradientBoosting": {"max_bins": 255, "min_samples_leaf": 20},
}

# reference parameter name -> MLlib parameter name
_NAME_MAP = {
    "n_estimators": "maxIter", "iterations": "maxIter", "max_iter": "maxIter",
    "max_depth": "maxDepth", "depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate", "max_samples": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy", "max_features": "featureSubsetStrategy",
    "min_child_samples": "minInstancesPerNode", "min_data_in_leaf": "minInstancesPerNode",
    "min_samples_leaf": "minInstancesPerNode",
    "gamma": "minInfoGain", "min_split_gain": "minInfoGain",
    "random_state": "seed", "max_bin": "maxBins", "max_bins": "maxBins",
    "l1_ratio": "elasticNetParam", "colsample_bylevel": "featureSubsetStrategy",
}
# accepted but without an MLlib counterpart
IGNORED_PARAMS = {"reg_alpha", "reg_lambda", "l2_leaf_reg", "bootstrap_type", "min_samples_split",
                  "min_child_weight", "eval_metric", "use_label_encoder", "verbose", "n_jobs", "solver",
                  "bootstrap", "num_leaves"}


def mllib_params(family: str, params: dict, n_train: int | None = None) -> tuple[dict, list[str]]:
    """Translate reference hyper-parameters; returns (MLlib params, ignored names)."""
    out, ignored = {}, []
    params = dict(params)
    if family == "lr" and "penalty" in params:
        pen = params.pop("penalty")
        ratio = params.pop("l1_ratio", 0.5)
        params["l1_ratio"] = {"l1": 1.0, "l2": 0.0}.get(pen, ratio)
    elif family == "lr":
        params.pop("l1_ratio", None)
    for k, v in params.items():
        if k == "C" and family == "lr":
            out["regParam"] = 1.0 / (float(v) * max(1, n_train or 1))
            continue
        if k in IGNORED_PARAMS or k not in _NAME_MAP:
            ignored.append(k)
            continue
        name = _NAME_MAP[k]
        if family == "rf" and name == "maxIter":
            name = "numTrees"
        if family == "lr" and name in ("maxDepth", "stepSize", "maxBins", "seed", "numTrees"):
            ignored.append(k)
            continue
        if family in ("gbt", "rf") and name == "featureSubsetStrategy" and isinstance(v, float):
            v = str(v)
        if family == "gbt" and name == "numTrees":
            name = "maxIter"
        out[name] = v
    return out, ignored


def estimator(family: str, params: dict, label: str = "label", features: str = "features"):
    common = {"labelCol": label, "featuresCol": features}
    if family == "gbt":
        return Boosted(**common, **params)
    if family == "rf":
        # rows keep their node of each tree, so that a level does not walk all trees from the root
        return RandomForestClassifier(**common, cacheNodeIds=True, **params)
    if family == "lr":
        return LogisticRegression(**common, standardization=False, elasticNetParam=params.pop("elasticNetParam", 0.0),
                                  **params)
    raise ValueError(f"unknown model family {family!r}")


def build_pipeline(preset: str | Preset, numeric_cols: Sequence[str], categorical_cols: Sequence[str],
                   label: str, overrides: dict | None = None, n_train: int | None = None,
                   impute_cols: Sequence[str] | None = None) -> tuple[Pipeline, list[str]]:
    """Imputer -> label codes -> assembler -> estimator for a preset."""
    p = PRESETS[preset] if isinstance(preset, str) else preset
    params, ignored = mllib_params(p.family, {**LIBRARY_DEFAULTS.get(p.name, {}), **p.params, **(overrides or {})}, n_train)
    stages = []
    to_impute = list(impute_cols) if impute_cols is not None else list(numeric_cols) + list(categorical_cols)
    if to_impute:
        stages.append(ReferenceImputer(inputCols=to_impute, strategy="median"))
    if categorical_cols:
        stages.append(LabelCoder(inputCols=list(categorical_cols)))
    stages += assembled(numeric_cols, categorical_cols, label, p.name in BY_RATE)
    stages.append(estimator(p.family, params, label=label))
    return Pipeline(stages=stages), ignored


# Presets that see a category as the smoothed rate of the target among its rows, so that trees
# split unordered categories by what they say of the target; the others see its label code.
BY_RATE = ("CatBoost",)
SMOOTHING = 1.0          # rows at the overall rate that a category's rate is mixed with


def assembled(numeric_cols: Sequence[str], categorical_cols: Sequence[str], label: str, by_rate: bool, out: str = "features") -> list:
    """The stages that put the coded columns into one vector."""
    cats = list(categorical_cols)
    encoded, rates = [f"{c}__encoded" for c in cats], [f"{c}__rate" for c in cats]
    stages = []
    if by_rate and cats:
        # the encoder's columns still count as nominal; as plain numbers they are split by order
        plain = ", ".join(f"`{a}` + 0D AS `{b}`" for a, b in zip(encoded, rates))
        stages += [TargetEncoder(inputCols=cats, outputCols=encoded, labelCol=label, targetType="binary",
                                 smoothing=SMOOTHING, handleInvalid="keep"),
                   SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__")]
    stages.append(VectorAssembler(inputCols=list(numeric_cols) + (rates if by_rate else cats), outputCol=out, handleInvalid="keep"))
    return stages


def _with_label(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("label", F.col(target).cast("double"))


# ---------------------------------------------------------------- M7
class Cleaning:
    """The fitted stages that impute and code a table, which do not depend on the preset: fitted when the
    first of several fits over the same rows asks for them, and shared by the others."""

    def __init__(self):
        self._lock, self._stages = threading.Lock(), None

    def of(self, pipe: Pipeline, train: DataFrame) -> Pipeline:
        """``pipe`` with its cleaning stages fitted."""
        stages = pipe.getStages()
        k = sum(isinstance(s, (ReferenceImputer, LabelCoder)) for s in stages)
        with self._lock:
            if self._stages is None:
                self._stages = Pipeline(stages=stages[:k]).fit(train).stages
        return Pipeline(stages=[*self._stages, *stages[k:]])


def fit(df: DataFrame, preset: str, numeric_cols: Sequence[str], categorical_cols: Sequence[str],
        target: str, overrides: dict | None = None, cleaning: Cleaning | None = None) -> PipelineModel:
    """Fit one preset's pipeline on ``df`` (binary 0/1 target)."""
    train = _with_label(df, target)
    n = train.count() if PRESETS[preset].family == "lr" else None
    pipe, _ = build_pipeline(preset, numeric_cols, categorical_cols, "label", overrides, n)
    return (cleaning.of(pipe, train) if cleaning else pipe).fit(train)


def train_all(df: DataFrame, numeric_cols: Sequence[str], categorical_cols: Sequence[str], target: str,
              presets: Sequence[str] | None = None, overrides: dict | None = None,
              failed: dict[str, str] | None = None) -> dict[str, PipelineModel]:
    """Fit every preset. One that fails ends the call, unless ``failed`` is given: then it is
    skipped and its error recorded there under its name."""
    out = {}
    for name in presets or PRESETS:
        try:
            out[name] = fit(df, name, numeric_cols, categorical_cols, target, (overrides or {}).get(name))
        except Exception as exc:  # noqa: BLE001 - recorded for the caller
            if failed is None:
                raise
            failed[name] = f"{type(exc).__name__}: {exc}"
    return out


# ---------------------------------------------------------------- M8 / M9
def probability_of_default(scored: DataFrame) -> Column:
    """P(class 1): the probability vector when present, else sigmoid of the raw score."""
    if "probability" in scored.columns:
        return vector_to_array("probability").getItem(1)
    return 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction").getItem(1)))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("prediction", F.col("prediction").cast("int"))


def predict_proba(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn("p", probability_of_default(scored))


# ---------------------------------------------------------------- M10
def score_long(models: dict[str, PipelineModel], df: DataFrame, key: str, target: str,
               split: str = "split") -> DataFrame:
    """(model, split, key, y, p) for every model over every row of ``df``."""
    out = None
    for name, m in models.items():
        s = predict_proba(m, _with_label(df, target)).select(
            F.lit(name).alias("model"), F.col(split), F.col(key), F.col(target).cast("int").alias("y"), "p")
        out = s if out is None else out.unionByName(s)
    return out


# ---------------------------------------------------------------- M11
ROWS_A_TASK = 100_000    # about the rows of a task of a fit: a small job per tree level is mostly its tasks' start


def in_key_order(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """``df`` (of ``n`` rows) dealt to tasks by key and in key order within each, so that estimators
    that draw rows by partition and place draw the same ones however ``df`` came about."""
    n = df.count() if n is None else n
    return df.repartition(max(1, -(-n // ROWS_A_TASK)), key).sortWithinPartitions(key)


def cross_validate(df: DataFrame, preset: str, numeric_cols: Sequence[str], categorical_cols: Sequence[str],
                   target: str, key: str, k: int = 5, overrides: dict | None = None,
                   seed: int = 42, folded: DataFrame | None = None) -> DataFrame:
    """k-fold AUC per fold, with mean and population std, exact AUC.

    Folds are the hash-ranked stratified folds (D4), stored once for all fits and
    scores (or given, as ``folded``, where several searches share them); each
    fold's model is a fresh pipeline fitted on the other folds. The fits are independent,
    and much of one is small jobs, so they run side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    if folded is None:
        folded = store_table(in_key_order(store_table(stratified_folds(df, key, target, k, seed)), key))

    def one(f: int) -> DataFrame:
        m = fit(folded.where(F.col("fold") != f), preset, numeric_cols, categorical_cols, target, overrides)
        return predict_proba(m, _with_label(folded.where(F.col("fold") == f), target)).select(
            "fold", F.col(target).cast("int").alias("y"), "p")

    with ThreadPoolExecutor(CONCURRENT) as pool:
        parts = list(pool.map(one, range(k)))
    scored = parts[0]
    for s in parts[1:]:
        scored = scored.unionByName(s)
    per_fold = curve_metrics(scored, ["fold"]).select("fold", "auc_roc")
    from pyspark.sql import Window
    w = Window.partitionBy()
    return per_fold.select(F.lit(preset).alias("model"), "fold", "auc_roc",
                           F.avg("auc_roc").over(w).alias("mean_auc"),
                           F.stddev_pop("auc_roc").over(w).alias("std_auc"))


# ---------------------------------------------------------------- M12
# Search ranges of the reference's tuning notebook, per family.
# ("int", lo, hi) / ("float", lo, hi) / ("log", lo, hi) / ("choice", [options])
SEARCH_SPACE = {
    "XGBoost": {"n_estimators": ("int", 50, 150), "max_depth": ("int", 2, 8),
                "learning_rate": ("float", 0.01, 0.10), "subsample": ("float", 0.1, 0.5),
                "colsample_bytree": ("float", 0.7, 0.9), "reg_alpha": ("float", 0.1, 125.0),
                "reg_lambda": ("float", 0.1, 125.0), "min_child_weight": ("int", 1, 10),
                "gamma": ("float", 0, 2)},
    "LightGBM": {"n_estimators": ("int", 50, 200), "max_depth": ("int", 2, 10),
                 "learning_rate": ("float", 0.01, 0.15), "subsample": ("float", 0.1, 0.5),
                 "colsample_bytree": ("float", 0.7, 0.9), "reg_alpha": ("float", 0.1, 125.0),
                 "reg_lambda": ("float", 0.1, 125.0), "min_child_samples": ("int", 10, 50),
                 "min_split_gain": ("float", 0, 1)},
    "CatBoost": {"iterations": ("int", 50, 250), "depth": ("int", 2, 6),
                 "learning_rate": ("float", 0.01, 0.1), "l2_leaf_reg": ("float", 1, 100),
                 "bootstrap_type": ("choice", ["Bayesian", "Bernoulli"]), "subsample": ("float", 0.7, 0.9),
                 "colsample_bylevel": ("float", 0.1, 0.5), "min_data_in_leaf": ("int", 10, 50)},
    "RandomForest": {"n_estimators": ("int", 50, 200), "max_depth": ("int", 3, 10),
                     "min_samples_split": ("int", 5, 20), "min_samples_leaf": ("int", 2, 10),
                     "max_features": ("choice", ["sqrt", "log2"]), "max_samples": ("float", 0.7, 0.9)},
    "LogisticRegression": {"C": ("log", 0.01, 10), "penalty": ("choice", ["l1", "l2", "elasticnet"]),
                           "l1_ratio": ("float", 0.1, 0.9)},
}


# The parameter that counts an ensemble's trees, per family.
TREE_COUNT = {"XGBoost": "n_estimators", "LightGBM": "n_estimators", "CatBoost": "iterations", "RandomForest": "n_estimators"}
SHARE = 1           # trials that are the first n trees of one fitted ensemble; 1 draws every trial apart
CONCURRENT = 8      # fits that the driver keeps running at a time


def sample_params(preset: str, n_trials: int, seed: int = 42, share: int = SHARE) -> list[dict]:
    """Seeded random draws from the preset's search space, every trial apart. A ``share`` above 1
    draws ensembles in runs of so many trials that differ in their number of trees alone, so that
    one fit serves a run: a smaller search, for callers that ask for it."""
    import math
    rng = random.Random(f"{seed}:{preset}")
    space, count = SEARCH_SPACE[preset], TREE_COUNT.get(preset)

    def draw(spec):
        kind, lo, hi = (spec[0], spec[1], None) if spec[0] == "choice" else spec
        if kind == "choice":
            return rng.choice(lo)
        if kind == "int":
            return rng.randint(lo, hi)
        return rng.uniform(lo, hi) if kind == "float" else math.exp(rng.uniform(math.log(lo), math.log(hi)))

    out: list[dict] = []
    while len(out) < n_trials:
        d = {k: draw(spec) for k, spec in space.items()}
        out.append(d)
        if count:
            out += [{**d, count: draw(space[count])} for _ in range(min(share - 1, n_trials - len(out)))]
    return out


def ensembles(preset: str, trials: Sequence[dict]) -> list[tuple[dict, list[tuple[int, int | None]]]]:
    """The fits that the trials need: parameters (with the largest tree count) and, for each
    trial that a fit serves, its number and its count of trees (None without trees)."""
    count = TREE_COUNT.get(preset)
    groups: dict[str, list[int]] = {}
    for i, d in enumerate(trials):
        groups.setdefault(json.dumps({k: v for k, v in d.items() if k != count}, sort_keys=True), []).append(i)
    out = []
    for members in groups.values():
        first = trials[members[0]]
        params = first if count is None else {**first, count: max(trials[i][count] for i in members)}
        out.append((params, [(i, trials[i].get(count)) for i in members]))
    return out


def first_trees(model, n: int | None):
    """The model of the first ``n`` trees of a fitted ensemble. Of a boosted one it is the model
    that a fit of ``n`` iterations gives, since trees are added in turn; of a forest, a forest
    of ``n`` of its independent trees."""
    if n is None or n >= len(model.trees):
        return model
    from pyspark import SparkContext
    context, java = SparkContext._active_spark_context, model._java_obj
    ml = context._jvm.org.apache.spark.ml
    boosted = isinstance(model, GBTClassificationModel)
    kept = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel if boosted
                                      else ml.classification.DecisionTreeClassificationModel, n)
    trees = java.trees()
    for i in range(n):
        kept[i] = trees[i]
    if not boosted:
        return RandomForestClassificationModel(ml.classification.RandomForestClassificationModel(
            java.uid(), kept, java.numFeatures(), java.numClasses()))
    weights, given = context._gateway.new_array(context._jvm.double, n), java.treeWeights()
    for i in range(n):
        weights[i] = given[i]
    return GBTClassificationModel(ml.classification.GBTClassificationModel(
        java.uid(), kept, weights, java.numFeatures(), java.numClasses()))


def fold_pipelines(df: DataFrame, numeric_cols: Sequence[str], categorical_cols: Sequence[str], target: str, key: str,
                   k: int = 5, seed: int = 42, rates: bool = True) -> tuple[DataFrame, dict[int, PipelineModel]]:
    """The rows with their ``fold``, stored once, and for each fold left out the stages that impute, code and
    assemble them, fitted on the other folds (with ``rates`` also the target's rates for categories)."""
    from concurrent.futures import ThreadPoolExecutor

    rows = df.select(*dict.fromkeys([key, *numeric_cols, *categorical_cols, target]))
    with shuffles_dropped(df.sparkSession):
        folded = store_table(_with_label(stratified_folds(rows, key, target, k, seed), target))

        def one(f: int) -> PipelineModel:
            pipe, _ = build_pipeline("LogisticRegression", numeric_cols, categorical_cols, "label")
            stages = [*pipe.getStages()[:-1], *(assembled(numeric_cols, categorical_cols, "label", True, "rates") if rates else [])]
            return Pipeline(stages=stages).fit(folded.where(F.col("fold") != f))

        with ThreadPoolExecutor(CONCURRENT) as pool:
            return folded, dict(enumerate(pool.map(one, range(k))))


def prepare_folds(folded: DataFrame, fitted: dict[int, PipelineModel], key: str) -> DataFrame:
    """(out, fold, label, features, rates): for each fold left ``out``, all rows imputed, coded and
    assembled as fitted on the other folds (``rates``: with the target's rates for categories).
    Stored once for every fit of a search, a folder for each fold left out, so that a fit reads
    no other fold's rows."""
    from concurrent.futures import ThreadPoolExecutor
    import uuid

    from riskspark.session import ensure_checkpoint_dir

    n, spark = folded.count(), folded.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored/folds-{uuid.uuid4().hex}"

    def one(f: int):
        rows = fitted[f].transform(folded).select(F.col(key).alias("_rs_key"), "fold", "label", "features", "rates")
        part = in_key_order(rows, "_rs_key", n).drop("_rs_key")
        part.write.parquet(f"{path}/out={f}")
        return part.schema

    with shuffles_dropped(spark), ThreadPoolExecutor(CONCURRENT) as pool:
        schema = list(pool.map(one, fitted))[0]
    return spark.read.schema(schema.add("out", "integer")).parquet(path).select("out", *schema.names[:4])


def rows_of_folds(folded: DataFrame, fitted: dict[int, PipelineModel], cols: Sequence[str]) -> DataFrame:
    """(fold, label, outs, x): all rows imputed, coded and assembled. Folds left out differ in few fill values
    and codes, so a row stands once for all of them (``outs``) that give it the same features. Stored."""
    raw = {c: f"_rs_raw{i}" for i, c in enumerate(cols)}
    rows = folded.select("fold", "label", *[F.col(f"`{c}`").alias(r) for c, r in raw.items()])
    for f, model in fitted.items():
        kept = rows.columns
        done = model.transform(rows.withColumns({c: F.col(r) for c, r in raw.items()}))
        rows = done.select(*kept, vector_to_array("features").alias(f"_rs_x{f}"))
    every = F.array(*[F.struct(F.lit(f).alias("out"), F.col(f"_rs_x{f}").alias("x")) for f in fitted])
    rows = rows.select("fold", "label", every.alias("every"), F.explode(F.array_distinct(F.array(*[F.col(f"_rs_x{f}") for f in fitted]))).alias("x"))
    outs = F.transform(F.filter("every", lambda e: e["x"] == F.col("x")), lambda e: e["out"])
    with shuffles_dropped(folded.sparkSession):
        return store_table(rows.select("fold", "label", outs.alias("outs"), "x"))


def param_search(df: DataFrame, presets: Sequence[str], numeric_cols: Sequence[str], categorical_cols: Sequence[str],
                 target: str, key: str, n_trials: int = 100, k: int = 5, seed: int = 42, share: int = SHARE,
                 concurrent: int = CONCURRENT) -> DataFrame:
    """k-fold AUC of ``n_trials`` seeded random draws of each preset; one row per trial, ranked
    within its preset.

    The folds are prepared once for all presets. Logistic trials are fitted together, a pass over
    the rows for an iteration of all of them, and their scores are ranked a few trials at a time.
    The other fits are independent Spark jobs, ``concurrent`` of them at a time; each scores its
    left-out fold for all trials that it serves and stores the scores, and one grouped exact AUC
    ranks these trials.
    """
    from concurrent.futures import ThreadPoolExecutor
    import uuid

    from pyspark.sql import Window

    from riskspark.session import ensure_checkpoint_dir

    presets = [presets] if isinstance(presets, str) else list(presets)
    alike = [name for name in presets if PRESETS[name].family == "lr"]
    apart = [name for name in presets if name not in alike]
    folded, fitted = fold_pipelines(df, numeric_cols, categorical_cols, target, key, k, seed, rates=bool(apart))
    of_fold = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(of_fold.values())
    sizes = {f: total - of_fold.get(f, 0) for f in range(k)}
    draws = {name: sample_params(name, n_trials, seed, share) for name in presets}
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored/search-{uuid.uuid4().hex}"
    folds = prepare_folds(folded, fitted, key) if apart else None

    def translated(name: str, params: dict, f: int) -> dict:
        p = PRESETS[name]
        return mllib_params(p.family, {**LIBRARY_DEFAULTS.get(name, {}), **p.params, **params}, sizes.get(f, 0))[0]

    def together(name: str) -> DataFrame:
        rows = rows_of_folds(folded, fitted, [*numeric_cols, *categorical_cols])
        train = rows.withColumn("outs", F.array_remove("outs", F.col("fold"))).where(F.size("outs") > 0)
        held = rows.where(F.array_contains("outs", F.col("fold"))).withColumn("outs", F.array("fold"))
        params = [{f: translated(name, d, f) for f in range(k)} for d in draws[name]]
        state = fit_together(train, params, params[0][0]["maxIter"])
        return fold_auc(held.where(F.col("fold").isin(list(state))), state, total).select(F.lit(name).alias("model"), "*")

    def run(job) -> str:
        name, (params, members), number, f = job
        p = PRESETS[name]
        model = estimator(p.family, translated(name, params, f), features="rates" if name in BY_RATE else "features").fit(folds.where((F.col("out") == f) & (F.col("fold") != f)))
        held = folds.where((F.col("out") == f) & (F.col("fold") == f))
        scored = None
        for trial, n in members:
            s = first_trees(model, n).setFeaturesCol(model.getFeaturesCol()).transform(held)
            s = s.select(F.lit(name).alias("model"), F.lit(trial).alias("trial"), "fold", F.col("label").cast("int").alias("y"),
                         probability_of_default(s).alias("p"))
            scored = s if scored is None else scored.unionByName(s)
        part = f"{path}/{name}-{number}-{f}"
        scored.write.parquet(part)
        return part

    jobs = [(name, fit_, number, f) for name in apart for number, fit_ in enumerate(ensembles(name, draws[name])) for f in range(k)]
    with ThreadPoolExecutor(concurrent) as pool:
        parts = list(pool.map(lambda job: together(job) if job in alike else run(job), [*alike, *jobs]))
    spark = df.sparkSession
    aucs = [x for x in parts if not isinstance(x, str)]
    if jobs:
        scored = spark.read.schema("model string, trial int, fold int, y int, p double").parquet(*[x for x in parts if isinstance(x, str)])
        aucs.append(curve_metrics(scored, ["model", "trial", "fold"]).select("model", "trial", "fold", "auc_roc"))
    of_folds = aucs[0]
    for x in aucs[1:]:
        of_folds = of_folds.unionByName(x)
    # AUCs have six decimals: their sum in whole millionths has no rounding, so equal means are equal whatever the folds' order
    millionths = F.sum(F.round(F.col("auc_roc") * 1e6).cast("long"))
    means = of_folds.groupBy("model", "trial").agg((F.try_divide(millionths, F.count("auc_roc")) / F.lit(1e6)).alias("mean_auc"))
    rows = [(name, i, json.dumps(d, sort_keys=True)) for name in presets for i, d in enumerate(draws[name])]
    trials = spark.createDataFrame(rows, "model string, trial int, params string").join(means, ["model", "trial"])
    w = Window.partitionBy("model").orderBy(F.desc("mean_auc"), "trial")
    return trials.withColumn("rank", F.row_number().over(w))


def search_and_refit(df: DataFrame, presets: Sequence[str], numeric_cols: Sequence[str],
                     categorical_cols: Sequence[str], target: str, key: str, n_trials: int = 100,
                     k: int = 5, seed: int = 42, share: int = SHARE,
                     concurrent: int = CONCURRENT) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """The trials of all ``presets`` and, for each, the model refitted on all rows with its best
    trial's parameters; ``score_long`` scores these."""
    trials = store_table(param_search(df, presets, numeric_cols, categorical_cols, target, key, n_trials, k, seed, share, concurrent))
    return trials, refit_best(df, trials, numeric_cols, categorical_cols, target, n_trials, seed, share, concurrent)


def refit_best(df: DataFrame, trials: DataFrame, numeric_cols: Sequence[str], categorical_cols: Sequence[str], target: str,
               n_trials: int = 100, seed: int = 42, share: int = SHARE, concurrent: int = CONCURRENT) -> dict[str, PipelineModel]:
    """For each preset of ``trials`` the model of its best trial, fitted on all of ``df``. The
    draws are those of the search (``n_trials``, ``seed``, ``share``)."""
    from concurrent.futures import ThreadPoolExecutor

    best = {r["model"]: r["trial"] for r in trials.where(F.col("rank") == 1).select("model", "trial").collect()}

    def refit(name: str) -> PipelineModel:
        for params, members in ensembles(name, sample_params(name, n_trials, seed, share)):
            n = dict(members).get(best[name], False)
            if n is not False:
                whole = fit(df, name, numeric_cols, categorical_cols, target, params)
                return PipelineModel(stages=[*whole.stages[:-1], first_trees(whole.stages[-1], n)])
        raise ValueError(f"no trial of {name}")

    with ThreadPoolExecutor(concurrent) as pool:
        return dict(zip(best, pool.map(refit, best)))


# ---------------------------------------------------------------- M13
def feature_importance(model: PipelineModel, feature_names: Sequence[str], top: int | None = None) -> DataFrame:
    """Tree importances, else |coefficients|, sorted descending (top-k report)."""
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    else:
        vals = [abs(x) for x in est.coefficients.toArray().tolist()]
    spark = est.sparkSession if hasattr(est, "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    df = spark.createDataFrame(list(zip(feature_names, [float(v) for v in vals])), "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    return df.limit(top) if top else df


# ---------------------------------------------------------------- S9
def save_model(model: PipelineModel, path: str, meta: dict) -> None:
    """Persist the fitted pipeline plus a side JSON with schema and target, which is written last:
    a folder without it is not a saved model. One that isn't fitted is refused."""
    if not isinstance(model, PipelineModel):
        raise ValueError("the model is not fitted")
    model.write().overwrite().save(path)
    spark = model.stages[-1].sparkSession if hasattr(model.stages[-1], "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(path.rstrip("/") + "_meta")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    model = PipelineModel.load(path)
    meta = json.loads(spark.read.text(path.rstrip("/") + "_meta").first()[0])
    return model, meta


def save_models(models: dict[str, PipelineModel], folder: str, meta: dict) -> None:
    for name, m in models.items():
        save_model(m, f"{folder.rstrip('/')}/{name}", {**meta, "model": name})


def load_models(folder: str, names: Sequence[str] | None = None, failed: dict[str, str] | None = None) -> dict[str, PipelineModel]:
    """The named models of a folder (all of them by default). One that cannot be read ends the
    call, unless ``failed`` is given: then it is skipped and its error recorded there."""
    if names is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = [x.getPath().getName() for x in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
        names = sorted(n for n in found if f"{n}_meta" in found)
    out = {}
    for n in names:
        try:
            out[n] = load_model(f"{folder.rstrip('/')}/{n}")[0]
        except Exception as exc:  # noqa: BLE001 - recorded for the caller
            if failed is None:
                raise
            failed[n] = f"{type(exc).__name__}: {exc}"
    return out
