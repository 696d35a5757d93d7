"""Traffic-light calibration tests.

Every operator takes a scored DataFrame (one row per scored loan with a 0/1
outcome and a probability), or a score table made from one, and grouping columns
``by`` (model, split, segment, month, …). Rows are read once, into counts of
scores; quantile edges and bins come from the counts, and the statistics are
computed on the aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.binomial import binomial_stats
from riskspark.functions.bins import bin_right, linspace, r6, round_half_up
from riskspark.operators.kernels import materialize_small
from riskspark.operators.score_table import (ScoreTable, binned, by_list as _by, decile_edges, deciles, score_counts,
                                             score_table, table_of, valid as _valid)

# Colour and interpretation labels of the Basel five-colour table
# and of the range table, as the reference prints them.
BASEL_GREEN = "Verde"
BASEL_YELLOW = "Amarillo"
BASEL_RED = "Rojo"
BASEL_LIGHT_BLUE = "Azul Claro"
BASEL_DARK_BLUE = "Azul Marino"
BASEL_TEXT_OK = "Preciso"
BASEL_TEXT_UNDER_MILD = "Subestimacion leve"
BASEL_TEXT_UNDER_STRONG = "Subestimacion fuerte"
BASEL_TEXT_OVER_MILD = "Sobrestimacion leve"
BASEL_TEXT_OVER_STRONG = "Sobrestimacion fuerte"
BASEL_TEXT_SUMMARY = "Resumen"
TOTAL_LABEL = "TOTAL"
VERDICT_APPROVED = "APROBADO"
VERDICT_ACCEPTABLE = "ACEPTABLE"
VERDICT_REJECTED = "RECHAZADO"

# The ten probability ranges of the range-midpoint table.
RANGE_BOUNDS = [(0.00, 0.10), (0.11, 0.20), (0.21, 0.30), (0.31, 0.40), (0.41, 0.50),
                (0.51, 0.60), (0.61, 0.70), (0.71, 0.80), (0.81, 0.90), (0.91, 1.00)]
RANGE_EDGES = [0.00, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 1.00]
RANGE_LABELS = [f"{lo:.2f}-{hi:.2f}" for lo, hi in RANGE_BOUNDS]
RANGE_MIDPOINTS = [(lo + hi) / 2 for lo, hi in RANGE_BOUNDS]


def with_total_rows(rows: DataFrame, by: Sequence[str], order_col: str,
                    detail: dict[str, Column], total: dict[str, Column]) -> DataFrame:
    """Emit each detail row and, after the last row of each group, one total row.

    ``total`` expressions may use window aggregates over the group (built with
    ``group_window``); both dicts must give the same column names and types.
    One pass over the (small) per-bin table, no second aggregation branch.
    """
    w = Window.partitionBy(*by)
    staged = rows.select(
        *by, (F.col(order_col) == F.max(order_col).over(w)).alias("_rs_last"),
        *[c.alias(f"_rs_d_{n}") for n, c in detail.items()],
        *[total[n].alias(f"_rs_t_{n}") for n in detail])
    d = F.struct(*[F.col(f"_rs_d_{n}").alias(n) for n in detail])
    t = F.struct(*[F.col(f"_rs_t_{n}").alias(n) for n in detail])
    return staged.select(*by, F.explode(F.when(F.col("_rs_last"), F.array(d, t))
                                        .otherwise(F.array(d))).alias("_r")).select(*by, "_r.*")


def group_sum(c: str, by: Sequence[str]) -> Column:
    return F.sum(c).over(Window.partitionBy(*by))


def assign_deciles(df: DataFrame, by: Sequence[str] | str | None = ("model", "split"),
                   p: str = "p", n_groups: int = 10, out_col: str = "decile") -> DataFrame:
    """Add the ``qcut`` group (1 = lowest scores) to every row with a valid score."""
    by = _by(by)
    rows = _valid(df, p)
    keys = by or ["_rs_all"]
    if not by:
        rows = rows.withColumn("_rs_all", F.lit(1))
    edges = decile_edges(score_table(rows, keys, None, p, keep=False), n_groups)
    out = rows.join(edges, keys).withColumn(
        out_col, bin_right(F.col(p), F.col("edges"), True, n_max=n_groups + 1).cast("int")).drop("edges")
    return out if by else out.drop("_rs_all")


def decile_summary(df: DataFrame | ScoreTable, by: Sequence[str] | str | None = ("model", "split"),
                   y: str = "y", p: str = "p", n_groups: int = 10) -> DataFrame:
    """Per (group, decile): size, successes, mean / min / max score. The counts are stored, as
    edges and bins both read them."""
    return deciles(table_of(df, by, y, p, keep=True), n_groups)


def score_bins(df: DataFrame | ScoreTable, by: Sequence[str], y: str, p: str, bin_col: Column, name: str) -> DataFrame:
    """Per (group, fixed bin of the score): size, successes, rates, least and greatest score."""
    return binned(df.rows if isinstance(df, ScoreTable) else score_counts(df, by, y, p), by, bin_col, name)


# ---------------------------------------------------------------- V1
def tl_probability_bins(df: DataFrame | ScoreTable, by=("model", "split"), y: str = "y", p: str = "p",
                        n_bins: int = 10) -> DataFrame:
    """Fixed equal-width bins on [0, 1]; precision = 1 - |obs - pred| / pred."""
    by = _by(by)
    edges = linspace(0.0, 1.0, n_bins + 1)
    agg = score_bins(df, by, y, p, bin_right(F.col("p"), edges, True) - 1, "group").withColumnRenamed("actual_rate", "observed_rate")
    precision = F.when(F.col("predicted_rate") > 0,
                       1 - F.abs(F.col("observed_rate") - F.col("predicted_rate")) / F.col("predicted_rate")
                       ).otherwise(F.lit(0.0))
    return agg.select(
        *by, "group", r6(F.col("observed_rate")).alias("observed_rate"),
        r6(F.col("predicted_rate")).alias("predicted_rate"), "size", r6(precision).alias("precision"),
        F.when(precision > 0.8, "green").when(precision > 0.6, "yellow").otherwise("red").alias("status"))


def tl_probability_summary(bins: DataFrame, by=("model", "split")) -> DataFrame:
    """Overall green share of V1 and its status (>= 0.8 green, >= 0.6 yellow)."""
    by = _by(by)
    s = bins.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(F.col("precision") > 0.8).alias("green_groups"))
    share = F.col("green_groups") / F.col("total_groups")
    return s.select(*by, "total_groups", "green_groups", r6(share).alias("green_percentage"),
                    F.when(share >= 0.8, "green").when(share >= 0.6, "yellow").otherwise("red").alias("status"))


# ---------------------------------------------------------------- V2
def tl_decile_tolerance(df: DataFrame, by=("model", "split"), y: str = "y", p: str = "p",
                        n_groups: int = 10) -> DataFrame:
    """Deciles; colour by |actual - predicted| (<= 0.05 green, <= 0.10 yellow)."""
    s = decile_summary(df, by, y, p, n_groups)
    diff = F.abs(F.col("actual_rate") - F.col("predicted_rate"))
    return s.select(*_by(by), "decile", r6(F.col("actual_rate")).alias("actual_rate"),
                    r6(F.col("predicted_rate")).alias("predicted_rate"), r6(diff).alias("difference"),
                    F.when(diff <= 0.05, "green").when(diff <= 0.10, "yellow").otherwise("red").alias("color"),
                    "size", r6(F.col("min_prob")).alias("min_prob"), r6(F.col("max_prob")).alias("max_prob"),
                    r6(F.col("predicted_rate")).alias("avg_prob"))


def colour_shares(table: DataFrame, by=("model", "split"), colour_col: str = "color",
                  colours=("green", "yellow", "red")) -> DataFrame:
    """Percentage (x100) of groups per colour and the group count."""
    by = _by(by)
    n = F.count(F.lit(1))
    return table.groupBy(*by).agg(
        n.alias("total_groups"),
        *[r6(F.count_if(F.col(colour_col) == c) / n * 100.0).alias(f"{c}_percentage") for c in colours])


# ---------------------------------------------------------------- V3
def tl_decile_statistical(df: DataFrame, by=("model", "split"), y: str = "y", p: str = "p",
                          n_groups: int = 10, alpha: float = 0.05, method: str = "double_tail",
                          truncate_k: bool = False) -> DataFrame:
    """Deciles; binomial p-value of the successes against the mean score.

    ``truncate_k`` reproduces ``int(rate * n)`` for the success count.
    """
    s = decile_summary(df, by, y, p, n_groups)
    k = (F.floor(F.col("actual_rate") * F.col("size")).cast("long") if truncate_k
         else F.col("n_success"))
    s = s.withColumn("_k", k).withColumn(
        "_st", binomial_stats(F.col("_k"), F.col("size"), F.col("predicted_rate"), method))
    pv = F.col("_st.p_value")
    return s.select(
        *_by(by), "decile", r6(F.col("actual_rate")).alias("actual_rate"),
        r6(F.col("predicted_rate")).alias("predicted_rate"),
        r6(F.abs(F.col("actual_rate") - F.col("predicted_rate"))).alias("difference"),
        r6(pv).alias("p_value"),
        F.when(pv > alpha, "green").when(pv > alpha / 2, "yellow").otherwise("red").alias("color"),
        "size", r6(F.col("min_prob")).alias("min_prob"), r6(F.col("max_prob")).alias("max_prob"),
        r6(F.col("predicted_rate")).alias("avg_prob"),
        r6(F.col("_st.ci_lo") / F.col("size")).alias("ci_lower"),
        r6(F.col("_st.ci_hi") / F.col("size")).alias("ci_upper"),
        (pv < alpha).alias("significant"))


# ---------------------------------------------------------------- V4
def range_midpoint_bins(df: DataFrame | ScoreTable, by=("model", "split"), y: str = "y", p: str = "p") -> DataFrame:
    """Per (group, fixed range): count, successes, label midpoint, rate, p-value."""
    by = _by(by)
    edges = RANGE_EDGES
    labels = F.array(*[F.lit(x) for x in RANGE_LABELS])
    mids = F.array(*[F.lit(float(x)) for x in RANGE_MIDPOINTS])
    agg = score_bins(df, by, y, p, bin_right(F.col("p"), edges, True), "_bin").select(
        *by, "_bin", F.col("size").alias("Total_Registros"), F.col("n_success").alias("Cantidad_1"))
    agg = agg.withColumn("_mid", F.element_at(mids, F.col("_bin"))) \
             .withColumn("_label", F.element_at(labels, F.col("_bin"))) \
             .withColumn("_rate", F.col("Cantidad_1") / F.col("Total_Registros"))
    return agg.withColumn("_st", binomial_stats(F.col("Cantidad_1"), F.col("Total_Registros"), F.col("_mid")))


def tl_range_midpoint(df: DataFrame, by=("model", "split"), y: str = "y", p: str = "p",
                      with_total: bool = True) -> DataFrame:
    """Ten fixed ranges; binomial test against the midpoint of each range label."""
    by = _by(by)
    agg = range_midpoint_bins(df, by, y, p)
    pv = F.col("_st.p_value")
    n, k = F.col("Total_Registros"), F.col("Cantidad_1")
    detail = {
        "Rango_Probabilidad": F.col("_label"),
        "Total_Registros": n, "Cantidad_1": k, "Cantidad_0": n - k,
        "Porcentaje_0": round_half_up((n - k) / n * 100.0, 2),
        "Porcentaje_1": round_half_up(k / n * 100.0, 2),
        "Tasa_Real": round_half_up(F.col("_rate"), 4),
        "Punto_Medio_Rango": round_half_up(F.col("_mid"), 2),
        "Diferencia": round_half_up(F.abs(F.col("_rate") - F.col("_mid")), 4),
        "P_Value": round_half_up(pv, 4),
        "Color": F.when(pv > 0.05, BASEL_GREEN).when(pv > 0.025, BASEL_YELLOW).otherwise(BASEL_RED),
    }
    if not with_total:
        return agg.select(*by, *[c.alias(name) for name, c in detail.items()])
    tn, tk = group_sum("Total_Registros", by), group_sum("Cantidad_1", by)
    total = {
        "Rango_Probabilidad": F.lit(TOTAL_LABEL), "Total_Registros": tn, "Cantidad_1": tk,
        "Cantidad_0": tn - tk,
        "Porcentaje_0": round_half_up((tn - tk) / tn * 100.0, 2),
        "Porcentaje_1": round_half_up(tk / tn * 100.0, 2),
        "Tasa_Real": round_half_up(tk / tn, 4),
        "Punto_Medio_Rango": F.lit(None).cast("double"), "Diferencia": F.lit(None).cast("double"),
        "P_Value": F.lit(None).cast("double"), "Color": F.lit(None).cast("string"),
    }
    return with_total_rows(agg, by, "_bin", detail, total)


# ---------------------------------------------------------------- V5
def _basel_colour(actual: Column, predicted: Column, pv: Column) -> tuple[Column, Column]:
    under = actual > predicted
    colour = (F.when(pv > 0.05, BASEL_GREEN)
              .when(under & (pv > 0.01), BASEL_YELLOW).when(under, BASEL_RED)
              .when(pv > 0.01, BASEL_LIGHT_BLUE).otherwise(BASEL_DARK_BLUE))
    text = (F.when(pv > 0.05, BASEL_TEXT_OK)
            .when(under & (pv > 0.01), BASEL_TEXT_UNDER_MILD).when(under, BASEL_TEXT_UNDER_STRONG)
            .when(pv > 0.01, BASEL_TEXT_OVER_MILD).otherwise(BASEL_TEXT_OVER_STRONG))
    return colour, text


def basel_deciles(df: DataFrame, by=("model", "split"), y: str = "y", p: str = "p",
                  n_groups: int = 10) -> DataFrame:
    """Unrounded Basel decile rows: counts, rates, p-value, colour, interval."""
    return basel_colours(decile_summary(df, by, y, p, n_groups), by)


def basel_colours(summary: DataFrame, by=("model", "split")) -> DataFrame:
    """The Basel columns of a decile summary."""
    by = _by(by)
    s = summary.withColumn("_st", binomial_stats(F.col("n_success"), F.col("size"), F.col("predicted_rate")))
    colour, text = _basel_colour(F.col("actual_rate"), F.col("predicted_rate"), F.col("_st.p_value"))
    return s.select(
        *by, "decile", "size", "n_success", "actual_rate", "predicted_rate", "min_prob", "max_prob",
        F.col("_st.p_value").alias("p_value"), colour.alias("color"), text.alias("interpretation"),
        (F.col("_st.ci_lo") / F.col("size")).alias("ci_lower"),
        (F.col("_st.ci_hi") / F.col("size")).alias("ci_upper"))


def tl_basel(df: DataFrame, by=("model", "split"), y: str = "y", p: str = "p",
             n_groups: int = 10, with_total: bool = True) -> DataFrame:
    """Basel five-colour decile table with the reference's columns and rounding.

    The TOTAL row keeps column types: NULL where the reference prints '-'.
    """
    by = _by(by)
    d = basel_deciles(df, by, y, p, n_groups)
    n, k = F.col("size"), F.col("n_success")
    detail = {
        "Decil": F.col("decile").cast("string"),
        "Rango_Probabilidad": F.format_string("%.3f-%.3f", F.col("min_prob"), F.col("max_prob")),
        "Total_Registros": n, "Cantidad_1": k, "Cantidad_0": n - k,
        "Porcentaje_0": round_half_up((n - k) / n * 100.0, 2),
        "Porcentaje_1": round_half_up(k / n * 100.0, 2),
        "Tasa_Real": round_half_up(F.col("actual_rate"), 4),
        "PD_Predicha": round_half_up(F.col("predicted_rate"), 4),
        "Diferencia": round_half_up(F.abs(F.col("actual_rate") - F.col("predicted_rate")), 4),
        "P_Value": round_half_up(F.col("p_value"), 4),
        "Color": F.col("color"), "Interpretacion": F.col("interpretation"),
        "CI_Lower": round_half_up(F.col("ci_lower"), 4), "CI_Upper": round_half_up(F.col("ci_upper"), 4),
    }
    if not with_total:
        return d.select(*by, *[c.alias(name) for name, c in detail.items()])
    tn, tk = group_sum("size", by), group_sum("n_success", by)
    counts = [F.sum((F.col("color") == c).cast("int")).over(Window.partitionBy(*by))
              for c in (BASEL_GREEN, BASEL_YELLOW, BASEL_RED, BASEL_LIGHT_BLUE, BASEL_DARK_BLUE)]
    total = {
        "Decil": F.lit(TOTAL_LABEL), "Rango_Probabilidad": F.lit(None).cast("string"),
        "Total_Registros": tn, "Cantidad_1": tk, "Cantidad_0": tn - tk,
        "Porcentaje_0": round_half_up((tn - tk) / tn * 100.0, 2),
        "Porcentaje_1": round_half_up(tk / tn * 100.0, 2),
        "Tasa_Real": round_half_up(tk / tn, 4),
        "PD_Predicha": F.lit(None).cast("double"), "Diferencia": F.lit(None).cast("double"),
        "P_Value": F.lit(None).cast("double"),
        "Color": F.format_string("V:%d A:%d R:%d AC:%d AM:%d", *counts),
        "Interpretacion": F.lit(BASEL_TEXT_SUMMARY),
        "CI_Lower": F.lit(None).cast("double"), "CI_Upper": F.lit(None).cast("double"),
    }
    return with_total_rows(d, by, "decile", detail, total)


# ---------------------------------------------------------------- V9
def basel_verdict(deciles: DataFrame, by=("model", "split"), colour_col: str = "color") -> DataFrame:
    """Colour counts and shares per group; >= 7 green approved, >= 5 acceptable."""
    by = _by(by)
    names = [("green", BASEL_GREEN), ("yellow", BASEL_YELLOW), ("red", BASEL_RED),
             ("light_blue", BASEL_LIGHT_BLUE), ("dark_blue", BASEL_DARK_BLUE)]
    t = deciles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_ranges"),
        *[F.count_if(F.col(colour_col) == c).alias(f"{n}_count") for n, c in names])
    shares = [r6(F.col(f"{n}_count") / F.col("total_ranges")).alias(f"{n}_share") for n, _ in names]
    verdict = (F.when(F.col("green_count") >= 7, VERDICT_APPROVED)
               .when(F.col("green_count") >= 5, VERDICT_ACCEPTABLE).otherwise(VERDICT_REJECTED))
    return t.select("*", *shares, verdict.alias("verdict"))


# ---------------------------------------------------------------- V10
def tl_all_models(df: DataFrame | ScoreTable, by=("model", "split"), y: str = "y", p: str = "p") -> DataFrame:
    """V3, V4 and V5 colours for every group, flattened to one long table. The rows are read
    once; V3 and V5 colour the same deciles by the same test."""
    by = _by(by)
    table = table_of(df, by, y, p, keep=True)
    d = materialize_small(basel_colours(deciles(table), by))
    pv = F.col("p_value")
    statistical = F.when(pv > 0.05, "green").when(pv > 0.025, "yellow").otherwise("red")
    methods = F.explode(F.array(F.struct(F.lit("statistical").alias("method"), statistical.alias("color")),
                                F.struct(F.lit("basel").alias("method"), F.col("color").alias("color")))).alias("m")
    both = d.select(methods, *by, F.col("decile").cast("string").alias("bin"), F.col("size").alias("n"), r6(pv).alias("p_value")).select(
        "m.method", *by, "bin", "n", "p_value", "m.color")
    rm = range_midpoint_bins(table, by)
    pv4 = F.col("_st.p_value")
    v4 = rm.select(
        F.lit("range_midpoint").alias("method"), *by, F.col("_label").alias("bin"),
        F.col("Total_Registros").alias("n"), r6(pv4).alias("p_value"),
        F.when(pv4 > 0.05, BASEL_GREEN).when(pv4 > 0.025, BASEL_YELLOW).otherwise(BASEL_RED).alias("color"))
    return both.unionByName(v4)


def binomial_table(df: DataFrame, by=("model",), y: str = "y", p: str = "p",
                   n_groups: int = 10, confidence: float = 0.95) -> DataFrame:
    """V6 + V7 on decile aggregates: p-values for every test method and the interval."""
    by = _by(by)
    s = decile_summary(df, by, y, p, n_groups)
    k, n, r = F.col("n_success"), F.col("size"), F.col("predicted_rate")
    out = s.select(*by, "decile", "size", "n_success", "predicted_rate",
                   binomial_stats(k, n, r, "double_tail", confidence).alias("_dt"),
                   binomial_stats(k, n, r, "greater", confidence).alias("_gt"),
                   binomial_stats(k, n, r, "less", confidence).alias("_lt"),
                   binomial_stats(k, n, r, "minlike", confidence).alias("_ml"))
    return out.select(*by, "decile", "size", "n_success", r6(F.col("predicted_rate")).alias("predicted_rate"),
                      r6(F.col("_dt.p_value")).alias("p_double_tail"),
                      r6(F.col("_gt.p_value")).alias("p_greater"),
                      r6(F.col("_lt.p_value")).alias("p_less"),
                      r6(F.col("_ml.p_value")).alias("p_minlike"),
                      F.col("_dt.ci_lo").alias("ci_lo_count"),
                      F.col("_dt.ci_hi").alias("ci_hi_count"))


