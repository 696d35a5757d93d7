"""Model leaderboards over the metrics table.

Inputs are the wide per-(model, scope) metrics of ``evaluate_models`` or its
long form ``(model, scope, metric, value)``; ``scope`` is a split, a segment or
a month, so the same plans rank a handful of models or a whole monitoring
history. Rankings are windows partitioned by (scope, metric); nothing is
collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.bins import r6
from riskspark.functions.stats import pearson

# Model families of the reference's model comparison.
MODEL_FAMILIES = {
    "XGBoost": "Gradient Boosting",
    "CatBoost": "Gradient Boosting",
    "LightGBM": "Gradient Boosting",
    "HistGradientBoosting": "Gradient Boosting",
    "RandomForest": "Tree-based",
    "LogisticRegression": "Linear",
}

# Acceptance thresholds.
AUC_EXCELLENT, AUC_ACCEPTABLE = 0.75, 0.65
PSI_STABLE, PSI_WARNING = 0.05, 0.10
GREEN_GOOD = 0.8

TABLE_METRICS = ["auc_roc", "auc_pr", "precision", "recall", "f1_score", "gini", "psi",
                 "traffic_light_green", "overall_score"]


def metrics_long(wide: DataFrame, scope: str = "split", metrics: Sequence[str] | None = None) -> DataFrame:
    """Wide metrics -> (model, scope, metric, value), missing values dropped."""
    ms = list(metrics or [c for c in TABLE_METRICS + ["accuracy", "ks_statistic"] if c in wide.columns])
    return wide.unpivot(["model", scope], ms, "metric", "value").where(F.col("value").isNotNull()) \
        .withColumnRenamed(scope, "scope")


# ---------------------------------------------------------------- B1
def metrics_table(long: DataFrame, metrics: Sequence[str] = tuple(TABLE_METRICS)) -> DataFrame:
    """One row per (model, scope) with one column per metric."""
    return long.groupBy("model", "scope").pivot("metric", list(metrics)).agg(F.first("value"))


# ---------------------------------------------------------------- B2
def rank_models(long: DataFrame) -> DataFrame:
    """Per (scope, metric): models by value, highest first (ties by model name)."""
    w = Window.partitionBy("scope", "metric").orderBy(F.desc("value"), F.asc("model"))
    return long.withColumn("rank", F.row_number().over(w))


# ---------------------------------------------------------------- B3
def best_model(long: DataFrame) -> DataFrame:
    """Arg-max model per (scope, metric); the first name wins ties."""
    return long.groupBy("scope", "metric").agg(
        F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("best_model"),
        F.max("value").alias("best_value"))


# ---------------------------------------------------------------- B4
def top_k_models(wide: DataFrame, scope: str = "split", k: int = 3, metric: str = "overall_score") -> DataFrame:
    """The k best models per scope by ``metric`` (a top-k report)."""
    w = Window.partitionBy(scope).orderBy(F.desc(metric), F.asc("model"))
    return wide.select("model", scope, metric, F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


# ---------------------------------------------------------------- B5
def family_summary(wide: DataFrame, families: dict[str, str] | None = None, scope: str = "split",
                   metric: str = "overall_score") -> DataFrame:
    """Per (scope, family): mean score, best model and score, model count."""
    fam = families or MODEL_FAMILIES
    spark = wide.sparkSession
    # the family map is a literal lookup of a handful of names: broadcast it
    fmap = F.broadcast(spark.createDataFrame(sorted(fam.items()), "model string, family string"))
    j = wide.join(fmap, "model")
    return j.groupBy(scope, "family").agg(
        r6(F.avg(metric)).alias("mean_score"),
        F.min_by("model", F.struct(-F.col(metric), F.col("model"))).alias("best_model"),
        F.max(metric).alias("best_score"),
        F.count(F.lit(1)).alias("n_models"))


# ---------------------------------------------------------------- B6
def threshold_status(wide: DataFrame, scope: str = "split") -> DataFrame:
    auc, psi, green = F.col("auc_roc"), F.col("psi"), F.col("traffic_light_green")
    return wide.select(
        "model", scope, "auc_roc", "psi", "traffic_light_green",
        F.when(auc >= AUC_EXCELLENT, "excellent").when(auc >= AUC_ACCEPTABLE, "acceptable")
        .otherwise("insufficient").alias("auc_status"),
        F.when(psi.isNull(), F.lit(None)).when(psi <= PSI_STABLE, "stable").when(psi <= PSI_WARNING, "warning")
        .otherwise("unstable").alias("psi_status"),
        F.when(green >= GREEN_GOOD, "good").otherwise("insufficient").alias("green_status"))


# ---------------------------------------------------------------- B7
def threshold_compliance(wide: DataFrame, scope: str = "split") -> DataFrame:
    """Count and share of models with AUC >= 0.65, PSI <= 0.10, and both."""
    auc_ok = F.col("auc_roc") >= AUC_ACCEPTABLE
    psi_ok = F.col("psi") <= PSI_WARNING
    n = F.count(F.lit(1))
    return wide.groupBy(scope).agg(
        n.alias("n_models"),
        F.count_if(auc_ok).alias("auc_ok"), F.count_if(psi_ok).alias("psi_ok"),
        F.count_if(auc_ok & psi_ok).alias("both_ok"),
        r6(F.count_if(auc_ok) / n * 100.0).alias("auc_ok_pct"),
        r6(F.count_if(psi_ok) / n * 100.0).alias("psi_ok_pct"),
        r6(F.count_if(auc_ok & psi_ok) / n * 100.0).alias("both_ok_pct"))


# ---------------------------------------------------------------- B8
def score_summary(wide: DataFrame, scope: str = "split", metric: str = "overall_score") -> DataFrame:
    return wide.groupBy(scope).agg(
        F.count(F.lit(1)).alias("n_models"), r6(F.max(metric)).alias("max_score"),
        r6(F.min(metric)).alias("min_score"), r6(F.avg(metric)).alias("mean_score"),
        r6(F.stddev_samp(metric)).alias("std_score"))


# ---------------------------------------------------------------- B9
def metric_correlations(wide: DataFrame, scope: str = "split", metrics: Sequence[str] | None = None,
                        top: int = 10) -> DataFrame:
    """Pearson r between metric columns across models, the ``top`` pairs by |r|."""
    ms = list(metrics or [c for c in TABLE_METRICS if c in wide.columns])
    pairs = [(a, b) for i, a in enumerate(ms) for b in ms[i + 1:]]
    agg = wide.groupBy(scope).agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    long = agg.select(scope, F.explode(F.array(*[
        F.struct(F.lit(a).alias("metric1"), F.lit(b).alias("metric2"),
                 F.when(~F.isnan(F.col(f"{a}__{b}")), F.col(f"{a}__{b}")).alias("r"))
        for a, b in pairs])).alias("x")).select(scope, "x.*")
    # rank on the rounded |r| so equal correlations (e.g. AUC vs Gini) tie exactly
    w = Window.partitionBy(scope).orderBy(F.abs(r6(F.col("r"))).desc_nulls_last(), "metric1", "metric2")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top) \
        .select(scope, "metric1", "metric2", r6(F.col("r")).alias("correlation"), "rank")


# ---------------------------------------------------------------- B10
# Reward weights and gates of the declared strategy search.
QUALITY_WEIGHT, PERFORMANCE_WEIGHT, STABILITY_WEIGHT = 0.4, 0.4, 0.2
KS_GATE = 0.05


def strategy_score(quality: DataFrame, models: DataFrame, scope_value: str = "test") -> DataFrame:
    """Generator × model leaderboard: 0.4 quality + 0.4 AUC + 0.2 stability.

    ``quality``: (generator, overall_score) from Q9; ``models``: wide model
    metrics with a ``generator`` column (metrics of the model trained on that
    generator's data). Stability = 1 − min(1, PSI / 0.10); without a PSI it is 0,
    since nothing shows the model to be stable. Gates: AUC >= 0.65, PSI <= 0.10 (a
    missing PSI fails) and, where ``models`` has a ``ks_statistic``, KS >= 0.05.
    """
    m = models.where(F.col("split") == scope_value)
    j = m.join(quality.select("generator", F.col("overall_score").alias("quality_score")), "generator")
    stability = F.when(F.col("psi").isNull(), 0.0).otherwise(1.0 - F.least(F.lit(1.0), F.col("psi") / PSI_WARNING))
    score = QUALITY_WEIGHT * F.col("quality_score") + PERFORMANCE_WEIGHT * F.col("auc_roc") + \
        STABILITY_WEIGHT * stability
    gates = (F.col("auc_roc") >= AUC_ACCEPTABLE) & (F.col("psi") <= PSI_WARNING)
    if "ks_statistic" in models.columns:
        gates = gates & (F.col("ks_statistic") >= KS_GATE)
    out = j.select("generator", "model", "quality_score", "auc_roc", "psi", r6(stability).alias("stability"),
                   r6(score).alias("strategy_score"), F.coalesce(gates, F.lit(False)).alias("passes_gates"))
    w = Window.orderBy(F.desc("strategy_score"), "generator", "model")
    return out.withColumn("rank", F.row_number().over(w))


# ---------------------------------------------------------------- B11
def ensemble_top_k(predictions: DataFrame, wide: DataFrame, k: int = 3, select_scope: str = "test",
                   scope: str = "split", key: str = "loan_id", metric: str = "overall_score") -> DataFrame:
    """Average probability of the k best models (chosen on ``select_scope``)."""
    top = top_k_models(wide.where(F.col(scope) == select_scope), scope, k, metric).select("model")
    chosen = predictions.join(F.broadcast(top), "model", "left_semi")
    return chosen.groupBy(scope, key).agg(F.avg("p").alias("p"), F.max("y").alias("y"),
                                          F.count(F.lit(1)).alias("n_models"))
