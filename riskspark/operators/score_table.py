"""One cumulative score table for the metrics of scored rows.

A predictions table is read once and collapsed to counts of (group, score): rows, positives,
negatives. Running sums of these (kernel K1) are stored, and confusion counts, ROC and PR
curves, KS, fixed bins, quantile edges, deciles and both PSI variants are grouped aggregates
over the stored table; none of them reads the predictions again.

Edges at which the pooled PSI compares two sides are *marks*: rows of no count that are put
among the counts before the running sums, in the group of the compared side and in that of
the expected side, before a score of the same value. What lies below an edge is then read off its own row, so only edges - nine
a compared side and group - meet both sides, never scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.bins import bin_right, linspace_col
from riskspark.operators.kernels import linear_quantile_probs, quantiles_of_sums, store_table, value_cumsums

SUMS = ["n", "pos", "neg"]


def by_list(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def valid(df: DataFrame, p: str) -> DataFrame:
    return df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p)))


def score_counts(df: DataFrame, by: Sequence[str], y: str | None = "y", p: str = "p") -> DataFrame:
    """(group, score) -> rows, positives, negatives, with map-side combining."""
    yy = F.lit(None).cast("long") if y is None else F.col(y).cast("long")
    return valid(df, p).groupBy(*by, F.col(p).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(yy), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.lit(1) - yy), F.lit(0)).alias("neg"))


def same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` with ``cols`` under names of their own, and a null-safe condition on them."""
    on = F.lit(True)
    for c in cols:
        right = right.withColumnRenamed(c, f"_r_{c}")
    for c in cols:
        on = on & left[c].eqNullSafe(right[f"_r_{c}"])
    return right, on


@dataclass
class ScoreTable:
    """``rows``: group columns, p, n, pos, neg and their running (``cum_``) and whole (``tot_``)
    sums. ``edges``: for the pooled PSI, one row a (group, compared side, k-th inner edge e)."""

    rows: DataFrame
    by: list[str]
    edges: DataFrame | None = None
    side: str | None = None
    expected: str | None = None

    def counted(self) -> DataFrame:
        """Without groups that hold nothing but marks."""
        return self.rows.where(F.col("tot_n") > 0)


def pooled_edges(counts: DataFrame, by: Sequence[str], side: str, expected: str, n_bins: int) -> DataFrame:
    """Inner edges of ``n_bins`` equal bins over the pooled range of each compared side and the
    expected one: by, compared, k, e."""
    ranges = counts.where(F.col(side).isNotNull()).groupBy(*by, F.col(side).alias("compared")).agg(
        F.min("p").alias("lo"), F.max("p").alias("hi"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    own = F.col("compared") == expected
    pooled = ranges.select(
        *by, "compared", F.least("lo", F.max(F.when(own, F.col("lo"))).over(w)).alias("lo"),
        F.greatest("hi", F.max(F.when(own, F.col("hi"))).over(w)).alias("hi")).where(F.col("compared") != expected)
    at = F.posexplode(linspace_col(F.col("lo"), F.col("hi"), n_bins + 1)).alias("k", "e")
    return pooled.select(*by, "compared", at).where((F.col("k") > 0) & (F.col("k") < n_bins))


def score_table(df: DataFrame, by=("model", "split"), y: str | None = "y", p: str = "p", side: str | None = None,
                expected: str | None = None, n_bins: int = 10, keep: bool = True) -> ScoreTable:
    """The cumulative table of ``df`` by ``by`` (with ``side``, a column of its own besides
    ``by``, where given). With ``expected`` it holds the marks of the pooled PSI of every other
    side. ``keep`` stores it; without, it serves one metric and is computed on the way."""
    groups = [*by_list(by), *([side] if side else [])]
    counts = score_counts(df, groups, y, p)
    edges = None
    if expected is not None:
        counts = store_table(counts)
        edges = store_table(pooled_edges(counts, by_list(by), side, expected, n_bins))
        both = F.explode(F.array(F.col("compared"), F.lit(expected))).alias(side)
        marks = edges.select(*by_list(by), both, F.col("e").alias("p"), *[F.lit(0).cast("long").alias(c) for c in SUMS])
        counts = counts.unionByName(marks.distinct())
    rows = value_cumsums(counts, groups, "p", SUMS)
    return ScoreTable(store_table(rows) if keep else rows, groups, edges, side, expected)


def table_of(scores: DataFrame | ScoreTable, by, y: str | None = "y", p: str = "p", keep: bool = False) -> ScoreTable:
    """A table that is given already, or one made from rows. ``by`` must be the table's own."""
    if isinstance(scores, ScoreTable):
        if set(by_list(by)) != set(scores.by):
            raise ValueError(f"the score table is grouped by {scores.by}")
        return scores
    return score_table(scores, by, y, p, keep=keep)


# ---------------------------------------------------------------- read off the table
def confusion(threshold: float = 0.5) -> list[Column]:
    """n, tp, fp, fn, tn as aggregates over the table's rows."""
    over = F.col("p") > F.lit(threshold)
    zero = F.lit(0).cast("long")
    return [F.sum("n").alias("n"),
            *[F.coalesce(F.sum(F.when(cond, F.col(c))), zero).alias(name)
              for name, c, cond in (("tp", "pos", over), ("fp", "neg", over), ("fn", "pos", ~over), ("tn", "neg", ~over))]]


def curve_sums() -> list[Column]:
    """Numerators of AUC (ties count 1/2) and of AUC-PR (anchored at recall 0, precision 1) and
    KS, as aggregates over the table's rows."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    P, N = F.col("tot_pos").cast("double"), F.col("tot_neg").cast("double")
    # strictly-lower negatives for AUC; descending running sums for the PR curve
    neg_below = F.col("cum_neg").cast("double") - neg
    tp_desc = P - F.col("cum_pos").cast("double") + pos
    fp_desc = N - F.col("cum_neg").cast("double") + neg
    tp_prev, fp_prev = tp_desc - pos, fp_desc - neg
    prec = tp_desc / (tp_desc + fp_desc)
    prec_prev = F.when(tp_prev + fp_prev == 0, 1.0).otherwise(tp_prev / (tp_prev + fp_prev))
    return [F.first("tot_pos").alias("n_pos"), F.first("tot_neg").alias("n_neg"),
            F.sum(pos * (neg_below + 0.5 * neg)).alias("_auc_num"),
            F.sum(F.when((pos > 0) & (N > 0), pos * (prec + prec_prev) / 2.0)).alias("_pr_num"),
            F.max(F.abs(F.try_divide(F.col("cum_pos"), P) - F.try_divide(F.col("cum_neg"), N))).alias("_ks")]


def curve_columns() -> dict[str, Column]:
    """Metrics from ``curve_sums``; NULL for a group that lacks positives or negatives."""
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    auc = F.when(ok, F.col("_auc_num") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
    return {"auc_roc": auc, "auc_pr": F.when(ok, F.col("_pr_num") / F.col("n_pos")),
            "gini": F.when(ok, 2.0 * auc - 1.0), "ks_statistic": F.when(ok, F.col("_ks"))}


def binned(rows: DataFrame, by: Sequence[str], bin_col: Column, name: str) -> DataFrame:
    """Per (group, bin): size, successes, rates, least and greatest score."""
    c = rows.where(F.col("n") > 0).select(*by, bin_col.alias(name), "p", "n", "pos", "neg").where(F.col(name).isNotNull())
    return c.groupBy(*by, name).agg(
        F.sum("n").alias("size"), F.sum("pos").alias("n_success"),
        F.try_divide(F.sum("pos").cast("double"), (F.sum("pos") + F.sum("neg")).cast("double")).alias("actual_rate"),
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("predicted_rate"),
        F.min("p").alias("min_prob"), F.max("p").alias("max_prob"))


def decile_edges(table: ScoreTable, n_groups: int = 10) -> DataFrame:
    """``pandas.qcut`` edges per group: exact quantiles, duplicate edges dropped."""
    q = quantiles_of_sums(table.rows, table.by, "p", linear_quantile_probs(n_groups), out_col="edges")
    return q.select(*table.by, F.array_distinct("edges").alias("edges"))


def deciles(table: ScoreTable, n_groups: int = 10) -> DataFrame:
    """``binned`` by ``qcut`` group: the edges of a group meet its counts, not its rows."""
    edges, on = same(table.rows, decile_edges(table, n_groups), table.by)
    rows = table.rows.join(edges, on).select(*[table.rows[c] for c in table.rows.columns], "edges")
    return binned(rows, table.by, bin_right(F.col("p"), F.col("edges"), True, n_max=n_groups + 1).cast("int"), "decile")


def pooled_psi(table: ScoreTable, floor_share: float, n_bins: int = 10) -> DataFrame:
    """by, compared, psi (unrounded): each edge is looked up once on either side."""
    by = [c for c in table.by if c != table.side]
    sides = F.explode(F.array(F.struct(F.lit("a").alias("which"), F.col("compared").alias(table.side)),
                              F.struct(F.lit("e").alias("which"), F.lit(table.expected).alias(table.side)))).alias("s")
    asked = table.edges.select(*by, "compared", "k", F.col("e").alias("p"), sides).select(*by, "compared", "k", "p", "s.*")
    marked, on = same(asked, table.rows.where(F.col("n") == 0).select(*table.by, "p", F.col("cum_n").alias("below"), "tot_n"), [*table.by, "p"])
    found = asked.join(marked, on).select(*[asked[c] for c in asked.columns], "below", "tot_n")
    sums = [F.max(F.when((F.col("which") == w) & (F.col("k") == k), F.col("below"))).alias(f"{w}{k}")
            for w in "ea" for k in range(1, n_bins)]
    wide = found.groupBy(*by, "compared").agg(*sums, *[F.max(F.when(F.col("which") == w, F.col("tot_n"))).alias(f"{w}{n_bins}") for w in "ea"])

    def share(w: str, k: int) -> Column:
        below = F.col(f"{w}{k}") if k else F.lit(0).cast("long")
        s = F.try_divide(F.col(f"{w}{k + 1}") - below, F.col(f"{w}{n_bins}"))
        return F.when(s == 0, floor_share).otherwise(s)

    total = None
    for k in range(n_bins):
        a, e = share("a", k), share("e", k)
        term = (a - e) * F.log(a / e)
        total = term if total is None else total + term
    return wide.select(*by, "compared", total.alias("psi"))
