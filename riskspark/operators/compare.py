"""Real-vs-synthetic comparison (C1–C6) and synthetic-data quality (Q1–Q10).

Input: one DataFrame holding both populations with a ``side`` column
('real' / 'synthetic'). Numeric columns are unpivoted once into
``(column, side, value)``; every per-column statistic (moments, KS, the
histogram metrics) is then a grouped job over that long table, so the number
of columns only adds rows, never extra passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.bins import bin_left, linspace_col, r6
from riskspark.functions.gram import pair_correlations
from riskspark.functions.stats import pearson
from riskspark.operators.evaluate import ks_two_sample
from riskspark.operators.profile import clean_value, numeric_columns

REAL, SYNTH = "real", "synthetic"


def _label(x: Column, a: float = 0.1, b: float = 0.2) -> Column:
    return F.when(x < a, "high").when(x < b, "medium").otherwise("low")


def long_values(df: DataFrame, side: str = "side", columns: Sequence[str] | None = None,
                drop_null: bool = True) -> DataFrame:
    cols = list(columns or numeric_columns(df, exclude=[side]))
    long = df.select(F.col(side).alias("side"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), clean_value(df, c).cast("double").alias("value")) for c in cols
    ])).alias("r")).select("side", "r.*")
    return long.where(F.col("value").isNotNull()) if drop_null else long


def value_counts(df: DataFrame, side: str = "side", columns: Sequence[str] | None = None,
                 drop_null: bool = True) -> DataFrame:
    """(column, value) -> rows per side: the one aggregation KS and the histograms share."""
    long = long_values(df, side, columns, drop_null)
    is_real = (F.col("side") == REAL).cast("long")
    return long.groupBy("column", "value").agg(F.sum(is_real).alias("n_a"),
                                               F.sum(F.lit(1) - is_real).alias("n_b"))


# ---------------------------------------------------------------- C1 / Q1
def shape_compare(df: DataFrame, side: str = "side", real_cols: Sequence[str] | None = None,
                  synth_cols: Sequence[str] | None = None) -> DataFrame:
    """Rows and columns of each side, same column count / set, synth/real row ratio."""
    cols = [c for c in df.columns if c != side]
    rc, sc = list(real_cols or cols), list(synth_cols or cols)
    n = df.agg(F.count_if(F.col(side) == REAL).alias("real_rows"),
               F.count_if(F.col(side) == SYNTH).alias("synthetic_rows"))
    return n.select(
        "real_rows", F.lit(len(rc)).alias("real_cols"), "synthetic_rows", F.lit(len(sc)).alias("synthetic_cols"),
        F.lit(len(rc) == len(sc)).alias("shape_match"), F.lit(set(rc) == set(sc)).alias("column_match"),
        r6(F.when(F.col("real_rows") > 0, F.col("synthetic_rows") / F.col("real_rows")).otherwise(0.0))
        .alias("size_ratio"))


# ---------------------------------------------------------------- C2
def stats_compare(df: DataFrame, side: str = "side", columns: Sequence[str] | None = None) -> DataFrame:
    """Mean and sample std per side and column, with absolute gaps."""
    long = long_values(df, side, columns)
    st = long.groupBy("column").agg(
        F.avg(F.when(F.col("side") == REAL, F.col("value"))).alias("real_mean"),
        F.avg(F.when(F.col("side") == SYNTH, F.col("value"))).alias("synthetic_mean"),
        F.stddev_samp(F.when(F.col("side") == REAL, F.col("value"))).alias("real_std"),
        F.stddev_samp(F.when(F.col("side") == SYNTH, F.col("value"))).alias("synthetic_std"))
    return st.select("column", *[r6(F.col(c)).alias(c) for c in
                                 ("real_mean", "synthetic_mean", "real_std", "synthetic_std")],
                     r6(F.abs(F.col("real_mean") - F.col("synthetic_mean"))).alias("mean_difference"),
                     r6(F.abs(F.col("real_std") - F.col("synthetic_std"))).alias("std_difference"))


# ---------------------------------------------------------------- C3 / Q2
def ks_pvalue(d: Column, n_a: Column, n_b: Column) -> Column:
    """Asymptotic two-sided Kolmogorov p-value, Q(λ) with λ = (√en + 0.12 + 0.11/√en)·D."""
    en = F.sqrt(n_a.cast("double") * n_b.cast("double") / (n_a + n_b).cast("double"))
    lam = (en + 0.12 + 0.11 / en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, j: acc + 2.0 * F.when(j % 2 == 1, 1.0).otherwise(-1.0)
        * F.exp(-2.0 * (j * j).cast("double") * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_from_counts(vc: DataFrame) -> DataFrame:
    """KS D per column from the shared value-count table (running sums per side)."""
    from riskspark.operators.kernels import value_cumsums
    cum = value_cumsums(vc.where(F.col("value").isNotNull()), ["column"], "value", ["n_a", "n_b"])
    d = F.abs(F.try_divide(F.col("cum_n_a"), F.col("tot_n_a")) - F.try_divide(F.col("cum_n_b"), F.col("tot_n_b")))
    return cum.groupBy("column").agg(F.first("tot_n_a").alias("n_a"), F.first("tot_n_b").alias("n_b"),
                                     F.max(d).alias("ks"))


def ks_compare(df: DataFrame, side: str = "side", columns: Sequence[str] | None = None,
               drop_null: bool = True) -> DataFrame:
    """Per column: KS statistic, asymptotic p-value, 1 − D and similarity label."""
    k = ks_from_counts(value_counts(df, side, columns, drop_null))
    return k.select("column", "n_a", "n_b", r6(F.col("ks")).alias("ks_statistic"),
                    r6(ks_pvalue(F.col("ks"), F.col("n_a"), F.col("n_b"))).alias("p_value"),
                    r6(1.0 - F.col("ks")).alias("ks_complement"),
                    _label(F.col("ks")).alias("similarity"))


# ---------------------------------------------------------------- C4 / Q7
def correlation_pairs_by_side(df: DataFrame, side: str = "side",
                              columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs i <= j with r on each side (one pass for both sides); NULL where a column is
    constant on that side."""
    cols = list(columns or numeric_columns(df, exclude=[side]))
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are needed for correlations")
    s = pair_correlations(df, [clean_value(df, c) for c in cols], F.col(side))
    return s.groupBy("i", "j").agg(F.max(F.when(F.col("by") == REAL, F.col("r"))).alias("real_r"),
                                   F.max(F.when(F.col("by") == SYNTH, F.col("r"))).alias("synthetic_r")) \
        .withColumn("d", F.lit(len(cols)))


def _mean_gap(pairs: DataFrame) -> DataFrame:
    """One row, v: the mean over columns of the mean |Δ| of their defined cells."""
    gap = F.when(F.col("i") == F.col("j"), F.when(F.col("real_r").isNotNull() & F.col("synthetic_r").isNotNull(), 0.0)) \
        .otherwise(F.abs(F.col("real_r") - F.col("synthetic_r")))
    cells = pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("column"), gap.alias("gap"))
    return cells.groupBy("column").agg(F.avg("gap").alias("m")).agg(F.avg("m").alias("v"))


def corr_matrix_diff(df: DataFrame, side: str = "side", columns: Sequence[str] | None = None) -> DataFrame:
    """Mean |r_real − r_synth| over the matrix: the mean of its columns' means over defined cells
    (2·Σ_{i<j}|Δ|/d² where all are defined)."""
    out = _mean_gap(correlation_pairs_by_side(df, side, columns))
    return out.select(r6(F.col("v")).alias("average_correlation_difference"),
                      _label(F.col("v")).alias("correlation_similarity"))


def corr_structure(df: DataFrame, side: str = "side", columns: Sequence[str] | None = None) -> DataFrame:
    """C4's mean gap, Pearson r between the two upper triangles, and the label."""
    p = correlation_pairs_by_side(df, side, columns)
    upper = p.where(F.col("i") < F.col("j")).agg(pearson(F.col("real_r"), F.col("synthetic_r")).alias("cc"))
    out = _mean_gap(p).crossJoin(F.broadcast(upper))          # one row each
    return out.select(r6(F.col("v")).alias("average_correlation_difference"),
                      r6(F.col("cc")).alias("correlation_correlation"),
                      _label(F.col("v")).alias("correlation_similarity"))


# ---------------------------------------------------------------- C5 / Q8
def _class_shares(df: DataFrame, side: str, target: str) -> DataFrame:
    c = df.groupBy(F.col(side).alias("side"), F.col(target).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    t = c.groupBy("side").agg(F.sum("n").alias("t"))
    s = c.join(t, "side").select("side", "class", (F.col("n") / F.col("t")).alias("share"))
    r = s.where(F.col("side") == REAL).select("class", F.col("share").alias("real"))
    y = s.where(F.col("side") == SYNTH).select("class", F.col("share").alias("synthetic"))
    return r, y


def target_compare_inner(df: DataFrame, side: str = "side", target: str = "target") -> DataFrame:
    """L1 gap of class shares over classes present on both sides."""
    r, y = _class_shares(df, side, target)
    j = r.join(y, "class", "inner")
    return j.agg(r6(F.coalesce(F.sum(F.abs(F.col("real") - F.col("synthetic"))), F.lit(0.0)))
                 .alias("distribution_difference"))


def target_compare_outer(df: DataFrame, side: str = "side", target: str = "target") -> DataFrame:
    """L1 gap over the union of classes (a missing class counts 0) and its label."""
    r, y = _class_shares(df, side, target)
    j = r.join(y, "class", "full_outer").fillna(0.0, ["real", "synthetic"])
    v = j.agg(F.sum(F.abs(F.col("real") - F.col("synthetic"))).alias("v"))
    return v.select(r6(F.col("v")).alias("distribution_difference"), _label(F.col("v")).alias("distribution_similarity"))


# ---------------------------------------------------------------- K3 histograms
def histograms(df: DataFrame, side: str = "side", columns: Sequence[str] | None = None,
               n_edges: Sequence[int] = (10, 20)) -> DataFrame:
    """Counts per (column, n_edges, side, bin) on pooled [min, max] edges."""
    return histograms_from_counts(value_counts(df, side, columns), n_edges)


def histograms_from_counts(vc: DataFrame, n_edges: Sequence[int] = (10, 20)) -> DataFrame:
    """Histogram counts from the shared value-count table.

    Edges follow ``numpy.linspace(min, max, n_edges)`` (n_edges − 1 bins, left
    closed, last bin closed) over the non-missing values of both sides; empty
    bins are present with count 0. Distinct values are binned (not rows), and
    the edge arrays are built once per (column, n_edges) in the small range
    table.
    """
    rng = vc.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ne = F.explode(F.array(*[F.lit(int(k)) for k in n_edges])).alias("n_edges")
    edge_arr = None
    for k in n_edges:
        arr = linspace_col(F.col("lo"), F.col("hi"), int(k))
        edge_arr = F.when(F.col("n_edges") == int(k), arr) if edge_arr is None else \
            edge_arr.when(F.col("n_edges") == int(k), arr)
    edges = rng.select("column", ne, "lo", "hi").withColumn("edges", edge_arr)
    binned = vc.join(edges.select("column", "n_edges", "edges"), "column").select(
        "column", "n_edges", "n_a", "n_b",
        bin_left(F.col("value"), F.col("edges"), n_max=max(int(k) for k in n_edges)).alias("bin"))
    counts = binned.groupBy("column", "n_edges", "bin").agg(F.sum("n_a").alias("r"), F.sum("n_b").alias("s"))
    counts = counts.select("column", "n_edges", "bin", F.explode(F.array(
        F.struct(F.lit(REAL).alias("side"), F.col("r").alias("count")),
        F.struct(F.lit(SYNTH).alias("side"), F.col("s").alias("count")))).alias("x")) \
        .select("column", "n_edges", "bin", "x.side", "x.count")
    grid = edges.select("column", "n_edges", "edges",
                        F.explode(F.sequence(F.lit(0), F.col("n_edges") - 2)).alias("bin"))
    grid = grid.select("*", F.explode(F.array(F.lit(REAL), F.lit(SYNTH))).alias("side"))
    width = F.element_at(F.col("edges"), F.col("bin") + 2) - F.element_at(F.col("edges"), F.col("bin") + 1)
    return grid.join(counts, ["column", "n_edges", "side", "bin"], "left").select(
        "column", "n_edges", "side", "bin", F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        width.alias("width"))


def _paired_bins(h: DataFrame, n_edges: int) -> DataFrame:
    """One row per (column, bin) with real / synthetic counts, widths and totals."""
    x = h.where(F.col("n_edges") == n_edges).groupBy("column", "bin").agg(
        F.sum(F.when(F.col("side") == REAL, F.col("count"))).alias("r"),
        F.sum(F.when(F.col("side") == SYNTH, F.col("count"))).alias("s"),
        F.first("width").alias("w"))
    from pyspark.sql import Window
    w = Window.partitionBy("column")
    return x.select("*", F.sum("r").over(w).alias("nr"), F.sum("s").over(w).alias("ns"))


def chi_squared_score(h: DataFrame, parity: bool = False) -> DataFrame:
    """Q3: χ² = Σ (r − s')² / s' on 9 pooled bins, score 1 / (1 + χ² / n_real).

    s' is the synthetic count rescaled to the real total. With ``parity`` the
    reference's behaviour is kept instead: unequal totals score 0.0. A bin with
    real rows but no synthetic rows makes χ² infinite (score 0); bins empty on
    both sides are skipped.
    """
    b = _paired_bins(h, 10)
    sp = F.try_divide(F.col("s") * F.col("nr"), F.col("ns"))
    term = F.when((sp == 0) & (F.col("r") == 0), F.lit(None)) \
        .when(sp == 0, F.lit(float("inf"))).otherwise((F.col("r") - sp) * (F.col("r") - sp) / sp)
    g = b.groupBy("column").agg(F.sum(term).alias("chi2"), F.first("nr").alias("nr"), F.first("ns").alias("ns"))
    score = F.lit(1.0) / (F.lit(1.0) + F.try_divide(F.col("chi2"), F.col("nr")))
    if parity:
        score = F.when(F.col("nr") != F.col("ns"), F.lit(0.0)).otherwise(score)
    return g.select("column", r6(F.col("chi2")).alias("chi_squared"), r6(score).alias("chi_squared_score"))


def _densities(h: DataFrame, n_edges: int = 20, smooth: float = 1e-10) -> DataFrame:
    """Per (column, bin): density of each side (+ smoothing) and its normalised form; NULL for a
    constant column, whose bins have no width."""
    b = _paired_bins(h, n_edges)
    dr = F.try_divide(F.col("r"), F.col("nr") * F.col("w"))
    ds = F.try_divide(F.col("s"), F.col("ns") * F.col("w"))
    from pyspark.sql import Window
    w = Window.partitionBy("column")
    x = b.select("column", "bin", dr.alias("dr"), ds.alias("ds"),
                 (dr + smooth).alias("pr"), (ds + smooth).alias("ps"))
    return x.select("*", (F.col("pr") / F.sum("pr").over(w)).alias("p"), (F.col("ps") / F.sum("ps").over(w)).alias("q"))


def divergence_scores(h: DataFrame) -> DataFrame:
    """Q4 (Itakura–Saito score and KL), Q5 (cosine) and Q6 (Jensen–Shannon) per column."""
    d = _densities(h, 20)
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2.0
    g = d.groupBy("column").agg(
        F.sum(p / q - F.log(p / q) - 1.0).alias("is_div"),
        F.sum(p * F.log(p / q)).alias("kl"),
        F.sum(F.col("dr") * F.col("ds")).alias("dot"),
        F.sum(F.col("dr") * F.col("dr")).alias("nr2"),
        F.sum(F.col("ds") * F.col("ds")).alias("ns2"),
        F.sum(-m * F.log(m)).alias("hm"), F.sum(-p * F.log(p)).alias("hp"), F.sum(-q * F.log(q)).alias("hq"))
    cos = F.try_divide(F.col("dot"), F.sqrt(F.col("nr2") * F.col("ns2")))
    return g.select("column",
                    r6(1.0 / (1.0 + F.col("is_div"))).alias("kl_divergence_inverse"),
                    r6(F.col("kl")).alias("kl_divergence"),
                    r6(F.when(cos.isNotNull(), F.greatest(F.lit(0.0), cos))).alias("cosine_similarity"),
                    r6(1.0 - (F.col("hm") - 0.5 * (F.col("hp") + F.col("hq")))).alias("jensen_shannon_entropy"))


# ---------------------------------------------------------------- Q10 / Q9 / C6
def distribution_metrics(df: DataFrame, side: str = "side", columns: Sequence[str] | None = None,
                         parity: bool = False) -> DataFrame:
    """Per column: KS complement, χ² score, IS score, cosine, JS — all from one
    (column, value) count aggregation."""
    vc = value_counts(df, side, columns)
    h = histograms_from_counts(vc)
    ks = ks_from_counts(vc).select("column", r6(1.0 - F.col("ks")).alias("KS_complement"))
    chi = chi_squared_score(h, parity).select("column", F.col("chi_squared_score").alias("chi_squared"))
    div = divergence_scores(h).select("column", "kl_divergence_inverse", "cosine_similarity", "jensen_shannon_entropy")
    return ks.join(chi, "column").join(div, "column")


METRICS = ["KS_complement", "chi_squared", "kl_divergence_inverse", "cosine_similarity", "jensen_shannon_entropy"]


def quality_score(df: DataFrame, side: str = "side", target: str = "target",
                  columns: Sequence[str] | None = None, parity: bool = False,
                  parts: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Q9: mean of {mean over columns of the mean metric; correlation r; 1 − target gap},
    ignoring missing / NaN terms, clamped to [0, 1]. ``parts`` = (distribution
    metrics, correlation structure, target comparison) when already computed."""
    dm, cs, tg = parts or (distribution_metrics(df, side, columns, parity), corr_structure(df, side, columns),
                           target_compare_outer(df, side, target))
    vals = F.filter(F.array(*[F.col(m) for m in METRICS]), lambda x: x.isNotNull() & ~F.isnan(x))
    col_mean = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals)
    dist = dm.select(F.when(F.size(vals) > 0, col_mean).alias("m")).agg(F.avg("m").alias("v"))
    terms = dist.unionByName(cs.select(F.col("correlation_correlation").alias("v"))) \
        .unionByName(tg.select((1.0 - F.col("distribution_difference")).alias("v")))
    terms = terms.where(F.col("v").isNotNull() & ~F.isnan("v"))
    return terms.agg(F.avg("v").alias("s"), F.count(F.lit(1)).alias("n_terms")).select(
        r6(F.when(F.col("n_terms") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s"))))
           .otherwise(F.lit(0.0))).alias("overall_score"), "n_terms")


def evaluate_quality(df: DataFrame, side: str = "side", target: str = "target",
                     columns: Sequence[str] | None = None, parity: bool = False) -> DataFrame:
    """Q10: tidy (section, column, metric, value) table of Q1–Q9 (each part computed once)."""
    dm = distribution_metrics(df, side, columns, parity).checkpoint(eager=True)
    cs_df = corr_structure(df, side, columns).checkpoint(eager=True)
    tg_df = target_compare_outer(df, side, target).checkpoint(eager=True)
    dist = dm.select(F.lit("distribution").alias("section"), "column", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("x")) \
        .select("section", "column", "x.metric", "x.value")
    cs = cs_df.select(
        F.lit("correlation").alias("section"), F.lit(None).cast("string").alias("column"), F.explode(F.array(
            F.struct(F.lit("average_correlation_difference").alias("metric"),
                     F.col("average_correlation_difference").alias("value")),
            F.struct(F.lit("correlation_correlation").alias("metric"),
                     F.col("correlation_correlation").alias("value")))).alias("x")).select(
        "section", "column", "x.metric", "x.value")
    tg = tg_df.select(
        F.lit("target").alias("section"), F.lit(None).cast("string").alias("column"),
        F.lit("distribution_difference").alias("metric"), F.col("distribution_difference").alias("value"))
    shp = shape_compare(df.drop(target), side).select(
        F.lit("basic").alias("section"), F.lit(None).cast("string").alias("column"),
        F.lit("size_ratio").alias("metric"), F.col("size_ratio").alias("value"))
    q = quality_score(df, side, target, columns, parity, parts=(dm, cs_df, tg_df)).select(
        F.lit("overall").alias("section"), F.lit(None).cast("string").alias("column"),
        F.lit("overall_score").alias("metric"), F.col("overall_score").alias("value"))
    return dist.unionByName(cs).unionByName(tg).unionByName(shp).unionByName(q)


def synthetic_validation(df: DataFrame, side: str = "side", target: str = "target",
                         columns: Sequence[str] | None = None) -> DataFrame:
    """C1–C5 as one tidy (check, column, metric, value) table."""
    shp = shape_compare(df, side).select(F.lit("shape").alias("check"), F.lit(None).cast("string").alias("column"),
                                         F.explode(F.array(
                                             F.struct(F.lit("real_rows").alias("metric"),
                                                      F.col("real_rows").cast("double").alias("value")),
                                             F.struct(F.lit("synthetic_rows").alias("metric"),
                                                      F.col("synthetic_rows").cast("double").alias("value")),
                                             F.struct(F.lit("size_ratio").alias("metric"),
                                                      F.col("size_ratio").alias("value")))).alias("x"))
    st = stats_compare(df, side, columns).select(F.lit("statistics").alias("check"), "column", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("real_mean", "synthetic_mean", "real_std", "synthetic_std", "mean_difference", "std_difference")
    ])).alias("x"))
    ks = ks_compare(df, side, columns, drop_null=False).select(F.lit("distribution").alias("check"), "column",
                                                               F.explode(F.array(*[
                                                                   F.struct(F.lit(m).alias("metric"),
                                                                            F.col(m).alias("value"))
                                                                   for m in ("ks_statistic", "p_value",
                                                                             "ks_complement")])).alias("x"))
    cm = corr_matrix_diff(df, side, columns).select(
        F.lit("correlation").alias("check"), F.lit(None).cast("string").alias("column"),
        F.struct(F.lit("average_correlation_difference").alias("metric"),
                 F.col("average_correlation_difference").alias("value")).alias("x"))
    tg = target_compare_inner(df, side, target).select(
        F.lit("target").alias("check"), F.lit(None).cast("string").alias("column"),
        F.struct(F.lit("distribution_difference").alias("metric"),
                 F.col("distribution_difference").alias("value")).alias("x"))
    out = None
    for part in (shp, st, ks, cm, tg):
        p = part.select("check", "column", "x.metric", "x.value")
        out = p if out is None else out.unionByName(p)
    return out
