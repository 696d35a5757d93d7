"""Model evaluation over a long predictions table.

Input rows: one per scored loan, with grouping columns (model, split, …), a
0/1 outcome ``y`` and a score ``p``. The rows are collapsed once to a cumulative
score table (``score_table``) that every metric reads, so all are exact and none
ranks a whole group in one task. Operators that take rows also take such a table,
made once for several of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.bins import count_edges, linspace, r6
from riskspark.operators.kernels import interpolated, materialize_small, value_cumsums
from riskspark.operators.score_table import (ScoreTable, by_list as _by, confusion, curve_columns, curve_sums,
                                             pooled_psi, score_table, table_of, valid as _valid)
from riskspark.operators.traffic_light import tl_probability_bins, tl_probability_summary


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (sklearn's zero_division=0 result)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


# ---------------------------------------------------------------- E13 / E1
def predicted_label(p: str = "p", threshold: float = 0.5) -> Column:
    """Hard label of a binary classifier: class 1 when P(1) > threshold."""
    return (F.col(p) > F.lit(threshold)).cast("int")


def confusion_matrix(df: DataFrame, by=("model", "split"), y: str = "y", p: str = "p",
                     threshold: float = 0.5) -> DataFrame:
    """Counts per (group, actual, predicted)."""
    by = _by(by)
    return (_valid(df, p).withColumn("predicted", predicted_label(p, threshold))
            .groupBy(*by, F.col(y).cast("int").alias("actual"), "predicted")
            .agg(F.count(F.lit(1)).alias("n")))


def classification_columns() -> dict[str, Column]:
    """Accuracy and support-weighted precision, recall and F1 from n, tp, fp, fn, tn."""
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    prec1, rec1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    prec0, rec0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1_1 = F.when(prec1 + rec1 == 0, 0.0).otherwise(2 * prec1 * rec1 / (prec1 + rec1))
    f1_0 = F.when(prec0 + rec0 == 0, 0.0).otherwise(2 * prec0 * rec0 / (prec0 + rec0))
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    nd = n.cast("double")
    return {"accuracy": (tp + tn) / nd, "precision": (prec1 * s1 + prec0 * s0) / nd,
            "recall": (rec1 * s1 + rec0 * s0) / nd, "f1_score": (f1_1 * s1 + f1_0 * s0) / nd}


def classification_metrics(df: DataFrame, by=("model", "split"), y: str = "y", p: str = "p",
                           threshold: float = 0.5) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (binary labels), in one
    aggregation without running sums."""
    by = _by(by)
    yy, yh = F.col(y).cast("int"), predicted_label(p, threshold)
    c = _valid(df, p).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((yy == 1) & (yh == 1)).alias("tp"), F.count_if((yy == 0) & (yh == 1)).alias("fp"),
        F.count_if((yy == 1) & (yh == 0)).alias("fn"), F.count_if((yy == 0) & (yh == 0)).alias("tn"))
    return c.select(*by, "n", *[r6(v).alias(name) for name, v in classification_columns().items()])


# ---------------------------------------------------------------- E2/E3/E4/E12
def curve_metrics(df: DataFrame | ScoreTable, by=("model", "split"), y: str = "y", p: str = "p") -> DataFrame:
    """AUC-ROC (ties count 1/2), AUC-PR (anchored at recall 0, precision 1),
    Gini = 2·AUC − 1 and KS = max |TPR − FPR|, one row per group.

    Metrics are NULL for a group that lacks positives or negatives.
    """
    table = table_of(df, by, y, p)
    agg = table.counted().groupBy(*table.by).agg(*curve_sums())
    return agg.select(*table.by, "n_pos", "n_neg", *[r6(v).alias(name) for name, v in curve_columns().items()])


# ---------------------------------------------------------------- E8 / KS
def ks_two_sample(df: DataFrame, by: Sequence[str], side: str, value: str,
                  side_a: str, side_b: str | None = None, drop_null: bool = True) -> DataFrame:
    """Two-sample Kolmogorov–Smirnov D per group between ``side_a`` and the rest.

    With ``side_b`` set, only rows of those two sides take part. D is the max
    over pooled distinct values of |F_a(x) − F_b(x)|.
    """
    by = _by(by)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value))) if drop_null else df
    if side_b is not None:
        rows = rows.where(F.col(side).isin(side_a, side_b))
    is_a = (F.col(side) == side_a).cast("long")
    counts = rows.groupBy(*by, value).agg(F.sum(is_a).alias("n_a"), F.sum(1 - is_a).alias("n_b"))
    cum = value_cumsums(counts, by, value, ["n_a", "n_b"])
    d = F.abs(F.try_divide(F.col("cum_n_a"), F.col("tot_n_a")) - F.try_divide(F.col("cum_n_b"), F.col("tot_n_b")))
    return cum.groupBy(*by).agg(
        F.first("tot_n_a").alias("n_a"), F.first("tot_n_b").alias("n_b"), F.max(d).alias("ks"))


def ks_scores(df: DataFrame, by=("model",), side: str = "side", p: str = "p",
              expected: str = "expected", actual: str = "actual") -> DataFrame:
    """KS statistic between the expected and actual score distributions."""
    k = ks_two_sample(_valid(df, p), by, side, p, expected, actual)
    return k.select(*_by(by), "n_a", "n_b", r6(F.col("ks")).alias("ks_statistic"))


# ---------------------------------------------------------------- E5
def psi_pooled(df: DataFrame | ScoreTable, by=("model",), side: str = "split", expected: str = "train",
               p: str = "p", n_bins: int = 10, floor_share: float = 1e-6) -> DataFrame:
    """Variant A PSI: equal-width bins over the pooled [min, max] of both sides.

    Bins are [a, b) with the last closed; an empty share becomes ``floor_share``
    (no renormalisation); PSI = Σ (t − e) · ln(t / e). A table given in place of rows
    must hold the marks of ``expected``.
    """
    by = _by(by)
    table = df if isinstance(df, ScoreTable) else score_table(df.where(F.col(side).isNotNull()), by, None, p, side, expected, n_bins, keep=False)
    out = pooled_psi(table, floor_share, n_bins)
    return out.select(*by, F.col("compared").alias(side), r6(F.col("psi")).alias("psi"))


# ---------------------------------------------------------------- E6
PSI_FIXED_INNER = linspace(0.0, 1.0, 11)[1:-1]


def psi_fixed(df: DataFrame, by=("model",), side: str = "split", expected: str = "train",
              p: str = "p", epsilon: float | None = None) -> DataFrame:
    """Variant B PSI: ten bins on [0, 1], right-closed, outer edges ±∞.

    Bins empty in the expected side are skipped; an empty actual bin gives +∞
    (or uses ``epsilon`` when given).
    """
    by = _by(by)
    rows = _valid(df, p).withColumn("_bin", count_edges(F.col(p), PSI_FIXED_INNER, strict=True))
    cnt = materialize_small(rows.groupBy(*by, side, "_bin").agg(F.count(F.lit(1)).alias("c")))
    tot = cnt.groupBy(*by, side).agg(F.sum("c").alias("t"))
    share = cnt.join(tot, [*by, side]).select(*by, side, "_bin", (F.col("c") / F.col("t")).alias("s"))
    exp = share.where(F.col(side) == expected).select(*by, "_bin", F.col("s").alias("e"))
    sides = tot.where(F.col(side) != expected).select(*by, side)
    act = share.where(F.col(side) != expected).select(*by, side, "_bin", F.col("s").alias("a"))
    pairs = sides.join(exp, by).join(act, [*by, side, "_bin"], "left").fillna(0.0, ["a"])
    a, e = F.col("a"), F.col("e")
    if epsilon is not None:
        a = F.when(a == 0, epsilon).otherwise(a)
        term = (a - e) * F.log(a / e)
    else:
        term = F.when(a == 0, F.lit(float("inf"))).otherwise((a - e) * F.log(a / e))
    out = pairs.groupBy(*by, side).agg(F.sum(term).alias("psi"))
    return out.select(*by, side, r6(F.col("psi")).alias("psi"))


# ---------------------------------------------------------------- E9
def stability_status(psi: Column) -> Column:
    return F.when(psi < 0.1, "stable").when(psi < 0.2, "warning").otherwise("unstable")


def psi_with_status(df: DataFrame | ScoreTable, by=("model",), side: str = "split", expected: str = "train",
                    p: str = "p") -> DataFrame:
    out = psi_pooled(df, by, side, expected, p)
    return out.withColumn("psi_stability", stability_status(F.col("psi")))


# ---------------------------------------------------------------- E7
def population_stability(df: DataFrame, by=("model",), side: str = "side",
                         expected: str = "expected", actual: str = "actual",
                         p: str = "p") -> DataFrame:
    """Per group: mean, population std, min, max, median of each side, their
    absolute gaps, KS between the sides, score 1 − min(1, KS) and status."""
    by = _by(by)
    rows = _valid(df, p).where(F.col(side).isin(expected, actual))
    is_e = (F.col(side) == expected).cast("long")
    # one count table for both sides: moments, order statistics and KS are one aggregation of it
    counts = rows.groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.sum(is_e).alias("n_e"), F.sum(1 - is_e).alias("n_a"))
    cum = value_cumsums(counts, by, "p", ["n_e", "n_a"])
    v, aggs = F.col("p"), []
    for w in "ea":
        n, tot, upto = F.col(f"n_{w}"), F.col(f"tot_n_{w}"), F.col(f"cum_n_{w}")
        low = F.floor((tot - 1) * 0.5)
        holds = lambda r, n=n, upto=upto: (n > 0) & (upto - n <= r) & (r < upto)                        # noqa: E731
        aggs += [F.max(tot).alias(f"{w}_n"), F.sum(v * n).alias(f"{w}_s"), F.sum(v * v * n).alias(f"{w}_q"),
                 F.min(F.when(n > 0, v)).alias(f"{w}_min"), F.max(F.when(n > 0, v)).alias(f"{w}_max"),
                 F.max(F.when(holds(low), v)).alias(f"{w}_lo"), F.max(F.when(holds(F.least(low + 1, tot - 1)), v)).alias(f"{w}_hi")]
    gap = F.abs(F.try_divide(F.col("cum_n_e"), F.col("tot_n_e")) - F.try_divide(F.col("cum_n_a"), F.col("tot_n_a")))
    g = cum.groupBy(*by).agg(*aggs, F.max(gap).alias("ks")).where((F.col("e_n") > 0) & (F.col("a_n") > 0))
    for w, name in (("e", "expected"), ("a", "actual")):
        mean = F.col(f"{w}_s") / F.col(f"{w}_n")
        t = (F.col(f"{w}_n") - 1) * 0.5 - F.floor((F.col(f"{w}_n") - 1) * 0.5).cast("double")
        g = g.withColumns({f"{name}_mean": mean, f"{name}_min": F.col(f"{w}_min"), f"{name}_max": F.col(f"{w}_max"),
                           f"{name}_std": F.sqrt(F.greatest(F.col(f"{w}_q") / F.col(f"{w}_n") - mean * mean, F.lit(0.0))),
                           f"{name}_median": interpolated(F.col(f"{w}_lo"), F.col(f"{w}_hi"), t)})
    score = 1.0 - F.least(F.lit(1.0), F.col("ks"))
    stats_cols = [r6(F.col(f"{s}_{c}")).alias(f"{s}_{c}") for s in ("expected", "actual")
                  for c in ("mean", "std", "min", "max", "median")]
    return g.select(
        *by, *stats_cols,
        r6(F.abs(F.col("actual_mean") - F.col("expected_mean"))).alias("mean_difference"),
        r6(F.abs(F.col("actual_std") - F.col("expected_std"))).alias("std_difference"),
        r6(F.abs(F.col("actual_median") - F.col("expected_median"))).alias("median_difference"),
        r6(F.col("ks")).alias("ks_statistic"),
        r6(score).alias("stability_score"),
        F.when(score > 0.8, "stable").when(score > 0.6, "warning").otherwise("unstable").alias("status"))


# ---------------------------------------------------------------- E10 / E11
def overall_score(auc: Column, f1: Column, gini: Column, green_share: Column,
                  psi_status: Column | None = None) -> Column:
    """Mean of the available terms, clamped to [0, 1]."""
    terms = [auc, f1, (gini + 1.0) / 2.0, green_share]
    if psi_status is not None:
        terms.append(F.when(psi_status == "stable", 1.0).when(psi_status == "warning", 0.5)
                     .when(psi_status.isNotNull(), 0.0))
    arr = F.filter(F.array(*[t.cast("double") for t in terms]), lambda x: x.isNotNull())
    mean = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr)
    return F.when(F.size(arr) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))


def evaluate_models(df: DataFrame, by=("model",), split: str = "split", expected: str = "train",
                    y: str = "y", p: str = "p", include_psi: bool = True) -> DataFrame:
    """One wide row per (group, split) with every model metric.

    PSI compares each split with the ``expected`` split (NULL on that split);
    the traffic-light term is the V1 green share. The predictions are read once,
    into a stored score table.
    """
    by = _by(by)
    g = [*by, split]
    table = score_table(df, by, y, p, split, expected)
    agg = table.counted().groupBy(*g).agg(*confusion(), *curve_sums())
    metrics = {**classification_columns(), **curve_columns()}
    wide = agg.select(*g, "n", *[r6(v).alias(name) for name, v in metrics.items()])
    tl = tl_probability_summary(tl_probability_bins(table, g), g).select(
        *g, r6(F.col("green_percentage")).alias("traffic_light_green"),
        F.col("status").alias("traffic_light_status"))
    psi = psi_with_status(table, by, split, expected)
    wide = wide.join(tl, g, "left").join(psi, g, "left")
    score = overall_score(F.col("auc_roc"), F.col("f1_score"), F.col("gini"),
                          F.col("traffic_light_green"),
                          F.col("psi_stability") if include_psi else None)
    return wide.withColumn("overall_score", r6(score))


# ---------------------------------------------------------------- E14
def out_of_time_eval(df: DataFrame, time_col: str, cutoff: str, by=("model",),
                     y: str = "y", p: str = "p") -> DataFrame:
    """Metrics on in-time (before ``cutoff``) and out-of-time rows side by side."""
    by = _by(by)
    period = F.when(F.col(time_col) < F.lit(cutoff).cast("timestamp"), "in_time").otherwise("out_of_time")
    rows = df.withColumn("period", period)
    g = [*by, "period"]
    return classification_metrics(rows, g, y, p).join(curve_metrics(rows, g, y, p), g)
