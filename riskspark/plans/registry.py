"""Registered queries: one callable per operator of SURVEY §2, (spark, sf_dir) -> DataFrame.

Each query reads the driver tables through the fixture views and runs the
library operator on the whole input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from riskspark.operators import compare as cmp
from riskspark.functions.bins import r6
from riskspark.operators import evaluate as ev
from riskspark.operators import leaderboard as lb
from riskspark.operators import models as md
from riskspark.operators import generate as gen
from riskspark.plans import benchmark as bm
from riskspark.plans import synthetic as syn
from riskspark.operators import profile as pr
from riskspark.operators import split as sp
from riskspark.operators import transform as tr
from riskspark.operators import traffic_light as tl
from riskspark.sources import fixtures as fx
from riskspark.sources import io as sio
from riskspark.streaming import monitor as mon

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@register("tl_basel")
def q_tl_basel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.tl_basel(fx.stored(spark, sf_dir, "scored_split"), by=["model", "split"])


def _split(spark, sf_dir):
    return fx.stored(spark, sf_dir, "scored_split")


MS = ["model", "split"]


@register("tl_probability_bins")
def q_tl_probability_bins(spark, sf_dir):
    return tl.tl_probability_bins(_split(spark, sf_dir), MS)


@register("tl_probability_summary")
def q_tl_probability_summary(spark, sf_dir):
    return tl.tl_probability_summary(tl.tl_probability_bins(_split(spark, sf_dir), MS), MS)


@register("tl_decile_tolerance")
def q_tl_decile_tolerance(spark, sf_dir):
    return tl.tl_decile_tolerance(_split(spark, sf_dir), MS)


@register("tl_decile_colour_shares")
def q_tl_decile_colour_shares(spark, sf_dir):
    return tl.colour_shares(tl.tl_decile_tolerance(_split(spark, sf_dir), MS), MS)


@register("tl_decile_statistical")
def q_tl_decile_statistical(spark, sf_dir):
    return tl.tl_decile_statistical(_split(spark, sf_dir), MS)


@register("tl_range_midpoint")
def q_tl_range_midpoint(spark, sf_dir):
    return tl.tl_range_midpoint(_split(spark, sf_dir), MS)


@register("basel_verdict")
def q_basel_verdict(spark, sf_dir):
    return tl.basel_verdict(tl.basel_deciles(_split(spark, sf_dir), MS), MS)


@register("binomial_test_table")
def q_binomial_test_table(spark, sf_dir):
    return tl.binomial_table(fx.stored(spark, sf_dir, "scored"), ["model"])


@register("tl_all_models")
def q_tl_all_models(spark, sf_dir):
    return tl.tl_all_models(_split(spark, sf_dir), MS)


@register("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    return ev.classification_metrics(_split(spark, sf_dir), MS)


@register("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(_split(spark, sf_dir), MS)


def _curve(cols):
    def q(spark, sf_dir):
        return ev.curve_metrics(_split(spark, sf_dir), MS).select(*MS, "n_pos", "n_neg", *cols)
    return q


register("auc_roc")(_curve(["auc_roc"]))
register("auc_pr")(_curve(["auc_pr"]))
register("gini")(_curve(["gini"]))
register("ks_good_bad")(_curve(["ks_statistic"]))


@register("psi_pooled")
def q_psi_pooled(spark, sf_dir):
    return ev.psi_pooled(_split(spark, sf_dir), ["model"], "split", "train")


@register("psi_fixed")
def q_psi_fixed(spark, sf_dir):
    return ev.psi_fixed(_split(spark, sf_dir), ["model"], "split", "train")


@register("stability_status")
def q_stability_status(spark, sf_dir):
    return ev.psi_with_status(_split(spark, sf_dir), ["model"], "split", "train")


@register("population_stability")
def q_population_stability(spark, sf_dir):
    return ev.population_stability(fx.stored(spark, sf_dir, "populations"), ["model"])


@register("ks_scores")
def q_ks_scores(spark, sf_dir):
    return ev.ks_scores(fx.stored(spark, sf_dir, "populations"), ["model"])


@register("evaluate_models")
def q_evaluate_models(spark, sf_dir):
    return ev.evaluate_models(_split(spark, sf_dir), ["model"], "split", "train")


@register("out_of_time_eval")
def q_out_of_time_eval(spark, sf_dir):
    return ev.out_of_time_eval(fx.stored(spark, sf_dir, "scored"), "as_of", "1999-01-01", ["model"])


def round_doubles(df: DataFrame) -> DataFrame:
    """Presentation rounding (6 dp) of every DOUBLE column of a query result."""
    from pyspark.sql import types as T

    from riskspark.functions.bins import r6
    return df.select(*[r6(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


# ---------------------------------------------------------------- profiling / transforms
KEYS = ["loan_id", "customer_id"]


def _dirty(spark, sf_dir):
    return fx.stored(spark, sf_dir, "loans_dirty")


def _loans(spark, sf_dir):
    return fx.stored(spark, sf_dir, "loans")


register("basic_info")(lambda spark, d: pr.basic_info(_dirty(spark, d)))
register("missing_profile")(lambda spark, d: pr.missing_profile(_dirty(spark, d)))
register("duplicate_profile")(lambda spark, d: pr.duplicate_profile(_dirty(spark, d)))
register("cardinality_profile")(lambda spark, d: pr.cardinality_profile(_dirty(spark, d)))
register("iqr_outliers")(lambda spark, d: pr.iqr_outliers(_dirty(spark, d)))
register("correlation_pairs")(lambda spark, d: pr.correlation_pairs(_dirty(spark, d)))
register("correlation_summary")(lambda spark, d: pr.correlation_summary(_dirty(spark, d)))
register("target_correlation")(lambda spark, d: pr.target_correlation(_dirty(spark, d), "target"))
register("frame_gate")(lambda spark, d: pr.frame_gate(_dirty(spark, d)))
register("quality_report")(lambda spark, d: pr.quality_report(_dirty(spark, d), "target"))
register("column_metadata")(lambda spark, d: pr.column_metadata(_dirty(spark, d)))


@register("class_distribution")
def q_class_distribution(spark, sf_dir):
    return pr.class_distribution(_split(spark, sf_dir), "split", "y", feature_cols=["segment", "as_of", "p"], by=["model"])


register("detect_types")(lambda spark, d: tr.detect_types_table(_dirty(spark, d)))
register("impute")(lambda spark, d: tr.impute(_dirty(spark, d), "median"))
register("impute_mean")(lambda spark, d: round_doubles(tr.impute(_dirty(spark, d), "mean")))
register("impute_drop")(lambda spark, d: tr.impute(_dirty(spark, d), "drop"))
register("label_encode")(lambda spark, d: tr.label_encode(_dirty(spark, d), "target"))


@register("standard_scale")
def q_standard_scale(spark, sf_dir):
    ln = _loans(spark, sf_dir)
    return round_doubles(tr.standard_scale(ln, tr.detect_types(ln, exclude=KEYS)["numeric"]))


@register("interaction_feature")
def q_interaction_feature(spark, sf_dir):
    out = tr.interaction_feature(_loans(spark, sf_dir), exclude=KEYS)
    return out.select("loan_id", out.columns[-1])


@register("squared_feature")
def q_squared_feature(spark, sf_dir):
    out = tr.squared_feature(_loans(spark, sf_dir), exclude=KEYS)
    return out.select("loan_id", out.columns[-1])


register("preprocess")(lambda spark, d: round_doubles(tr.preprocess(_dirty(spark, d), "target", KEYS)[0]))


@register("binarize_target")
def q_binarize_target(spark, sf_dir):
    ln = _loans(spark, sf_dir).select("loan_id", F.when(F.col("target") == 1, 2).otherwise(1).alias("class"))
    return ln.withColumn("default", tr.binarize_target("class"))


register("select_features")(lambda spark, d: tr.select_features(
    _loans(spark, d).select("loan_id", "amount", "balance", "target")))
register("generator_prepare")(lambda spark, d: tr.generator_prepare(_dirty(spark, d), KEYS))


# ---------------------------------------------------------------- splits
def _loan_keys(spark, sf_dir):
    return _loans(spark, sf_dir).select("loan_id", "as_of", "target")


register("stratified_split")(lambda spark, d: sp.stratified_split(_loan_keys(spark, d), "loan_id", "target"))
register("holdout_split")(lambda spark, d: sp.holdout_split(_loan_keys(spark, d), "loan_id", "target"))
register("synthetic_validation_split")(
    lambda spark, d: sp.synthetic_validation_split(_loan_keys(spark, d), "loan_id", "target"))
register("stratified_folds")(lambda spark, d: sp.stratified_folds(_loan_keys(spark, d), "loan_id", "target", 5))
register("time_series_splits")(
    lambda spark, d: sp.time_series_splits(_loan_keys(spark, d), "as_of", "loan_id", 5))


# ---------------------------------------------------------------- real vs synthetic
def _rvs(spark, sf_dir):
    return fx.stored(spark, sf_dir, "real_vs_synth")


register("shape_compare")(lambda spark, d: cmp.shape_compare(_rvs(spark, d)))
register("basic_comparison")(lambda spark, d: cmp.shape_compare(_rvs(spark, d)))
register("stats_compare")(lambda spark, d: cmp.stats_compare(_rvs(spark, d)))
register("ks_compare")(lambda spark, d: cmp.ks_compare(_rvs(spark, d), drop_null=False))
register("ks_complement")(lambda spark, d: cmp.ks_compare(_rvs(spark, d), drop_null=True).select(
    "column", "ks_complement"))
register("corr_matrix_diff")(lambda spark, d: cmp.corr_matrix_diff(_rvs(spark, d)))
register("corr_structure")(lambda spark, d: cmp.corr_structure(_rvs(spark, d)))
register("target_compare_inner")(lambda spark, d: cmp.target_compare_inner(_rvs(spark, d)))
register("target_compare_outer")(lambda spark, d: cmp.target_compare_outer(_rvs(spark, d)))
register("chi_squared_score")(lambda spark, d: cmp.chi_squared_score(cmp.histograms(_rvs(spark, d))))
register("is_divergence_score")(lambda spark, d: cmp.divergence_scores(cmp.histograms(_rvs(spark, d))).select(
    "column", "kl_divergence_inverse", "kl_divergence"))
register("cosine_similarity")(lambda spark, d: cmp.divergence_scores(cmp.histograms(_rvs(spark, d))).select(
    "column", "cosine_similarity"))
register("js_similarity")(lambda spark, d: cmp.divergence_scores(cmp.histograms(_rvs(spark, d))).select(
    "column", "jensen_shannon_entropy"))
register("quality_score")(lambda spark, d: cmp.quality_score(_rvs(spark, d)))
register("evaluate_quality")(lambda spark, d: cmp.evaluate_quality(_rvs(spark, d)))
register("synthetic_validation")(lambda spark, d: cmp.synthetic_validation(_rvs(spark, d)))


# ---------------------------------------------------------------- leaderboards
def _wide(spark, sf_dir):
    return fx.stored_result(spark, sf_dir, "model_metrics",
                            lambda: ev.evaluate_models(_split(spark, sf_dir), ["model"], "split", "train"))


def _long(spark, sf_dir):
    return lb.metrics_long(_wide(spark, sf_dir))


register("metrics_table")(lambda spark, d: lb.metrics_table(_long(spark, d)))
register("rank_models")(lambda spark, d: lb.rank_models(_long(spark, d)))
register("best_model")(lambda spark, d: lb.best_model(_long(spark, d)))
register("top_k_models")(lambda spark, d: lb.top_k_models(_wide(spark, d)))
register("family_summary")(lambda spark, d: lb.family_summary(_wide(spark, d), fx.FIXTURE_MODEL_FAMILIES))
register("threshold_status")(lambda spark, d: lb.threshold_status(_wide(spark, d)))
register("threshold_compliance")(lambda spark, d: lb.threshold_compliance(_wide(spark, d)))
register("score_summary")(lambda spark, d: lb.score_summary(_wide(spark, d)))
register("metric_correlations")(lambda spark, d: lb.metric_correlations(_wide(spark, d)))


@register("ensemble_top_k")
def q_ensemble_top_k(spark, sf_dir):
    out = lb.ensemble_top_k(_split(spark, sf_dir), _wide(spark, sf_dir), k=3)
    return out.select("split", "loan_id", r6(F.col("p")).alias("p"), "y", "n_models")


# ---------------------------------------------------------------- models (rows-only checks)
def _preset_scores(preset):
    def q(spark, sf_dir):
        return bm.predictions(spark, sf_dir, [preset]).select(
            "model", "split", "loan_id", "y", r6(F.col("p")).alias("p"))
    return q


register("gbt_xgboost_preset")(_preset_scores("XGBoost"))
register("gbt_catboost_preset")(_preset_scores("CatBoost"))
register("gbt_lightgbm_preset")(_preset_scores("LightGBM"))
register("gbt_hist_preset")(_preset_scores("HistGradientBoosting"))
register("random_forest")(_preset_scores("RandomForest"))
register("logistic_regression")(_preset_scores("LogisticRegression"))


@register("score_long")
def q_score_long(spark, sf_dir):
    return bm.predictions(spark, sf_dir, list(md.PRESETS))


@register("predict")
def q_predict(spark, sf_dir):
    frame = bm.loan_frame(spark, sf_dir)
    m = md.fit(frame.where("split = 'train'"), "LogisticRegression", bm.NUMERIC, bm.CATEGORICAL, bm.TARGET)
    return md.predict(m, frame).select("loan_id", "split", "prediction")


@register("cross_validate")
def q_cross_validate(spark, sf_dir):
    frame = bm.loan_frame(spark, sf_dir).where("split = 'train'")
    return md.cross_validate(frame, "LogisticRegression", bm.NUMERIC, bm.CATEGORICAL, bm.TARGET, bm.KEY, k=5)


def _train(spark, sf_dir):
    return bm.loan_frame(spark, sf_dir).where("split = 'train'")


@register("param_search")
def q_param_search(spark, sf_dir):
    return md.param_search(_train(spark, sf_dir), list(md.SEARCH_SPACE), bm.NUMERIC, bm.CATEGORICAL, bm.TARGET, bm.KEY)


@register("param_search_logistic")
def q_param_search_logistic(spark, sf_dir):
    """The whole budget of the quickest family: 100 trials, 5 folds. Searched once per session."""
    return fx.stored_result(spark, sf_dir, "trials-logistic", lambda: md.param_search(
        _train(spark, sf_dir), ["LogisticRegression"], bm.NUMERIC, bm.CATEGORICAL, bm.TARGET, bm.KEY))


@register("tuned_scores")
def q_tuned_scores(spark, sf_dir):
    """Scores of that search's winner, refitted on the training loans, over all loans."""
    models = md.refit_best(_train(spark, sf_dir), q_param_search_logistic(spark, sf_dir), bm.NUMERIC, bm.CATEGORICAL, bm.TARGET)
    return md.score_long(models, bm.loan_frame(spark, sf_dir), bm.KEY, bm.TARGET)


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    frame = bm.loan_frame(spark, sf_dir)
    m = md.fit(frame.where("split = 'train'"), "RandomForest", bm.NUMERIC, bm.CATEGORICAL, bm.TARGET)
    return md.feature_importance(m, bm.NUMERIC + bm.CATEGORICAL, top=10)


register("model_leaderboard")(lambda spark, d: bm.leaderboard(spark, d, list(md.PRESETS)))


# ---------------------------------------------------------------- sources / sinks
def _scratch(spark, name: str) -> str:
    """A path of this call's own: runs at the same time don't meet."""
    import uuid

    from riskspark.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


@register("scan_table")
def q_scan_table(spark, sf_dir):
    return sio.scan_table(spark, f"{sf_dir}/orders.parquet", "parquet")


@register("scan_segment")
def q_scan_segment(spark, sf_dir):
    base = _scratch(spark, "loans_by_segment")
    sio.write_segments(_loans(spark, sf_dir), base)
    return sio.scan_segment(spark, base, "BUILDING").select(
        "loan_id", "customer_id", "amount", "balance", "target", "segment")


@register("scan_catalog")
def q_scan_catalog(spark, sf_dir):
    names = ["customer", "orders", "part", "supplier", "no_such_table"]
    return sio.scan_catalog(spark, {n: f"{sf_dir}/{n}.parquet" for n in names}, failed={})


@register("read_splits")
def q_read_splits(spark, sf_dir):
    base = _scratch(spark, "loan_splits")
    sio.write_splits(sp.holdout_split(_loan_keys(spark, sf_dir), "loan_id", "target"), base)
    return sio.read_splits(spark, base).select("loan_id", "as_of", "target", "split")


@register("write_table")
def q_write_table(spark, sf_dir):
    path = _scratch(spark, "customer_csv")
    sio.write_table(fx.table(spark, sf_dir, "customer"), path, "csv")
    return sio.scan_table(spark, path, "csv", fx.table(spark, sf_dir, "customer").schema)


@register("write_metrics")
def q_write_metrics(spark, sf_dir):
    path = _scratch(spark, "metrics_json")
    sio.write_metrics(ev.classification_metrics(_split(spark, sf_dir), MS), path)
    return spark.read.json(path)


# ---------------------------------------------------------------- streaming
@register("psi_monitor_stream")
def q_psi_monitor_stream(spark, sf_dir):
    run = _scratch(spark, "psi_stream")
    table = mon.CountTable(spark, f"{run}/counts")
    mon.run_count_stream(spark, mon.event_stream(spark, sf_dir), table, f"{run}/checkpoint")
    baseline = mon.baseline_histogram(mon.scored_events(fx.table(spark, sf_dir, "events")))
    return mon.psi_by_window(table.read(), baseline)


@register("score_stream")
def q_score_stream(spark, sf_dir):
    """A stream scored by a pipeline that was saved and loaded."""
    run = _scratch(spark, "score_stream")
    frame = bm.loan_frame(spark, sf_dir)
    fitted = md.fit(frame.where("split = 'train'"), "LogisticRegression", bm.NUMERIC, bm.CATEGORICAL, bm.TARGET)
    md.save_model(fitted, f"{run}/model", {"target": bm.TARGET})
    model, _ = md.load_model(f"{run}/model")
    src = f"{run}/incoming"
    frame.write.parquet(src)
    stream = spark.readStream.schema(frame.schema).parquet(src)
    out = mon.score_stream(model, stream).select("loan_id", "split", "p")
    q = (out.writeStream.format("parquet").option("path", f"{run}/scores")
         .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{run}/scores").select("loan_id", "split", r6(F.col("p")).alias("p"))


@register("load_models")
def q_load_models(spark, sf_dir):
    """Scores of a folder of models, saved and loaded, over all loans."""
    frame = bm.loan_frame(spark, sf_dir)
    fitted = md.train_all(frame.where("split = 'train'"), bm.NUMERIC, bm.CATEGORICAL, bm.TARGET, ["LogisticRegression", "RandomForest"],
                          {"RandomForest": {"n_estimators": 20, "max_depth": 5}})
    folder = _scratch(spark, "models")
    md.save_models(fitted, folder, {"target": bm.TARGET})
    return md.score_long(md.load_models(folder), frame, bm.KEY, bm.TARGET)


# ---------------------------------------------------------------- generators
def _imb(spark, sf_dir):
    return fx.stored(spark, sf_dir, "imbalanced")


@register("knn_minority")
def q_knn_minority(spark, sf_dir):
    pts = _imb(spark, sf_dir).where("target = 1").select(
        F.col("customer_id").alias("id"), F.array(*[F.col(c) for c in syn.FEATURES]).alias("f"))
    return gen.knn(pts, 5).select("id", "nbr_rank", r6(F.col("dist")).alias("dist"))


register("gaussian_copula")(lambda spark, d: gen.gaussian_copula(
    _imb(spark, d).select(*syn.FEATURES, syn.TARGET), seed=42))
register("smote")(lambda spark, d: gen.smote(_imb(spark, d), syn.FEATURES, syn.TARGET, key=syn.KEY))
register("adasyn")(lambda spark, d: gen.adasyn(_imb(spark, d), syn.FEATURES, syn.TARGET, key=syn.KEY))
register("borderline_smote")(lambda spark, d: gen.borderline_smote(_imb(spark, d), syn.FEATURES, syn.TARGET,
                                                                   key=syn.KEY))
register("generate_all")(lambda spark, d: syn.synthetic_rows(spark, d))


@register("mix_real_synthetic")
def q_mix_real_synthetic(spark, sf_dir):
    real = syn.customer_frame(spark, sf_dir).where("split = 'train'").select(syn.KEY, *syn.FEATURES, syn.TARGET)
    fake = gen.gaussian_copula(real.select(*syn.FEATURES, syn.TARGET), columns=[*syn.FEATURES, syn.TARGET], seed=42)
    return gen.mix_real_synthetic(real, fake.checkpoint(eager=True), syn.KEY, "synthetic_id")


@register("mix_quotas")
def q_mix_quotas(spark, sf_dir):
    """Rows of each mix by origin."""
    return q_mix_real_synthetic(spark, sf_dir).groupBy("strategy", "origin").agg(F.count(F.lit(1)).alias("n"))


@register("smote_totals")
def q_smote_totals(spark, sf_dir):
    """Rows of each class, real and new."""
    made = gen.smote(_imb(spark, sf_dir), syn.FEATURES, syn.TARGET, key=syn.KEY).select(syn.TARGET, F.lit("new").alias("origin"))
    rows = _imb(spark, sf_dir).select(syn.TARGET, F.lit("real").alias("origin")).unionByName(made)
    return rows.groupBy(syn.TARGET, "origin").agg(F.count(F.lit(1)).alias("n"))


@register("strategy_rank")
def q_strategy_rank(spark, sf_dir):
    """The strategy score over the fixture models, each with its training score as quality."""
    wide = _wide(spark, sf_dir)
    quality = wide.where("split = 'train'").select(F.col("model").alias("generator"), "overall_score")
    return lb.strategy_score(quality, wide.withColumn("generator", F.col("model")), "test")


@register("save_load_generator")
def q_save_load_generator(spark, sf_dir):
    """Rows of all four generators, fitted, saved as a folder, loaded and sampled."""
    rows, made = _imb(spark, sf_dir), None
    models = {"gaussian_copula": gen.fit_copula(rows.select(*syn.FEATURES, syn.TARGET)),
              "smote": gen.fit_smote(rows, syn.FEATURES, syn.TARGET, key=syn.KEY),
              "adasyn": gen.fit_adasyn(rows, syn.FEATURES, syn.TARGET, key=syn.KEY),
              "borderline_smote": gen.fit_borderline_smote(rows, syn.FEATURES, syn.TARGET, key=syn.KEY)}
    folder = _scratch(spark, "generators")
    gen.save_generators(models, folder)
    for name, model in gen.load_generators(folder).items():
        part = gen.sample_generator(model, seed=7).select(F.lit(name).alias("generator"), *syn.FEATURES, syn.TARGET)
        made = part if made is None else made.unionByName(part)
    return made


register("quality_by_generator")(lambda spark, d: syn.quality_by_generator(spark, d))
register("strategy_score")(lambda spark, d: syn.strategy_board(spark, d))


@register("overall_score")
def q_overall_score(spark, sf_dir):
    return _wide(spark, sf_dir).select("model", "split", "auc_roc", "f1_score", "gini", "traffic_light_green",
                                       "psi_stability", "overall_score")


# ---------------------------------------------------------------- SURVEY slugs served by the same operators
@register("binomial_test")
def q_binomial_test(spark, sf_dir):
    return tl.binomial_table(fx.stored(spark, sf_dir, "scored"), ["model"]).select(
        "model", "decile", "size", "n_success", "predicted_rate", "p_double_tail", "p_greater", "p_less", "p_minlike")


@register("binomial_interval")
def q_binomial_interval(spark, sf_dir):
    return tl.binomial_table(fx.stored(spark, sf_dir, "scored"), ["model"]).select(
        "model", "decile", "size", "n_success", "ci_lo_count", "ci_hi_count")


@register("total_row")
def q_total_row(spark, sf_dir):
    return tl.tl_basel(_split(spark, sf_dir), MS).where(F.col("Decil") == tl.TOTAL_LABEL)


@register("write_splits")
def q_write_splits(spark, sf_dir):
    base = _scratch(spark, "loan_splits_by_split")
    sio.write_splits(sp.holdout_split(_loan_keys(spark, sf_dir), "loan_id", "target"), base)
    parts = [sio.read_splits(spark, base, x) for x in ("train", "test", "holdout")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("loan_id", "as_of", "target", "split")


@register("save_pipeline")
def q_save_pipeline(spark, sf_dir):
    from pyspark.ml import PipelineModel
    df = _dirty(spark, sf_dir)
    _, model = tr.preprocess(df, "target", KEYS)
    path = _scratch(spark, "preprocess_pipeline")
    model.write().overwrite().save(path)
    return round_doubles(PipelineModel.load(path).transform(df))


register("save_generator")(lambda spark, d: QUERIES["save_load_generator"](spark, d))
register("fit")(lambda spark, d: QUERIES["score_long"](spark, d))
register("predict_proba")(lambda spark, d: QUERIES["logistic_regression"](spark, d))
