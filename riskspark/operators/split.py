"""Splits and resampling frames.

Splits are columns, not separate frames: one DataFrame gains a ``split`` (or
``fold``/``role``) column and can be written partitioned by it. Ranks come from
the distributed kernels, so no split ever orders a whole class in one task.
Randomness is a seeded md5 of the key, so the assignment is reproducible and
does not change with partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.operators.kernels import _with_group, bucket_offsets, hash_key, hash_rank, rank_in_bucket, store_table, value_cumsums

DEFAULT_SEED = 42


def split_assign(df: DataFrame, key_col: str, strat_col: str | None,
                 names: Sequence[str], ratios: Sequence[float], seed: int = DEFAULT_SEED,
                 out_col: str = "split") -> DataFrame:
    """Hash-ranked (stratified) split: rank by md5 within class, cut at cumulative ratios.

    Row with rank r (1-based) of class size n goes to the first split i with
    r <= floor(n·(ratio_1+…+ratio_i) + 0.5); per-class counts are within one
    row of the exact ratios, the splits are disjoint and cover every row. Rows are ranked only in
    the hash buckets that hold a cut; all rows of another bucket have one split. ``df`` is
    computed once and stored with its buckets.
    """
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    grouped, g = _with_group(df, [strat_col] if strat_col else [])
    keyed = store_table(grouped.withColumn("_rs_b", F.substring(hash_key(seed, F.col(key_col)), 1, 3)))
    offsets = store_table(bucket_offsets(keyed, g))
    n = F.col("_rs_group_n").cast("double")

    def split_of(rank: Column) -> Column:
        expr, cum = F.lit(names[-1]), 0.0
        conds = []
        for name, r in zip(names[:-1], ratios[:-1]):
            cum += r
            conds.append((rank <= F.floor(n * F.lit(cum) + F.lit(0.5)), name))
        for cond, name in reversed(conds):
            expr = F.when(cond, F.lit(name)).otherwise(expr)
        return expr

    first, last = split_of(F.col("_rs_off") + 1), split_of(F.col("_rs_off") + F.col("_rs_bn"))
    whole = keyed.join(offsets.where(first == last), [*g, "_rs_b"]).withColumn(out_col, first)
    cut = keyed.join(offsets.where(first != last), [*g, "_rs_b"]).withColumn("_rs_h", hash_key(seed, F.col(key_col)))
    ranked = cut.withColumn(out_col, split_of(rank_in_bucket(g, key_col)))
    groups = [strat_col] if strat_col else []
    cols = [*groups, *[c for c in df.columns if c not in groups], out_col]
    return whole.select(cols).unionByName(ranked.select(cols))


def stratified_split(df: DataFrame, key_col: str, target: str, train: float = 0.6,
                     validation: float = 0.2, test: float = 0.2, seed: int = DEFAULT_SEED,
                     stratify: bool = True) -> DataFrame:
    """Train / validation / test."""
    return split_assign(df, key_col, target if stratify else None,
                        ("train", "validation", "test"), (train, validation, test), seed)


def holdout_split(df: DataFrame, key_col: str, target: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """20 % holdout, then a quarter of the rest as test: 60 / 20 / 20."""
    return split_assign(df, key_col, target, ("train", "test", "holdout"), (0.6, 0.2, 0.2), seed)


def synthetic_validation_split(df: DataFrame, key_col: str, target: str, ratio: float = 0.15,
                               seed: int = DEFAULT_SEED) -> DataFrame:
    """D3: stratified train / validation at 85 / 15."""
    return split_assign(df, key_col, target, ("train", "validation"), (1.0 - ratio, ratio), seed)


def stratified_folds(df: DataFrame, key_col: str, target: str, k: int = 5,
                     seed: int = DEFAULT_SEED, out_col: str = "fold") -> DataFrame:
    """fold = (hash rank within class − 1) mod k; per-class fold sizes differ by <= 1."""
    ranked = hash_rank(df, [target], key_col, seed, out_col="_rs_rank")
    return ranked.withColumn(out_col, ((F.col("_rs_rank") - 1) % k).cast("int")).drop("_rs_rank", "group_n")


def time_rank(df: DataFrame, time_col: str, key_col: str, out_col: str = "time_rank") -> DataFrame:
    """Exact 1-based rank over (time, key).

    rank = rows at earlier times (running counts over distinct times) + rank of
    the key among rows sharing the time (running counts within each time).
    """
    per_t = df.groupBy(time_col).agg(F.count(F.lit(1)).alias("_rs_tn"))
    t_cum = value_cumsums(per_t, [], time_col, ["_rs_tn"]).select(
        time_col, (F.col("cum__rs_tn") - F.col("_rs_tn")).alias("_rs_before"), F.col("tot__rs_tn").alias("n_rows"))
    ones = df.select(time_col, key_col).groupBy(time_col, key_col).agg(F.count(F.lit(1)).alias("_rs_one"))
    k_cum = value_cumsums(ones, [time_col], key_col, ["_rs_one"]).select(
        time_col, key_col, F.col("cum__rs_one").alias("_rs_within"))
    return (df.join(t_cum, time_col).join(k_cum, [time_col, key_col])
            .withColumn(out_col, F.col("_rs_before") + F.col("_rs_within"))
            .drop("_rs_before", "_rs_within"))


def time_series_splits(df: DataFrame, time_col: str, key_col: str, n_splits: int = 5) -> DataFrame:
    """Expanding-window folds in (time, key) order.

    s = floor(n / k); fold i trains on ranks 1..(i+1)s and validates on the next
    s ranks (cut at n); folds whose validation would start at or after n are
    skipped. Output: one row per (input row, fold, role), so a row appears in
    the training part of every later fold.
    """
    ranked = time_rank(df, time_col, key_col, "_rs_r")
    n, r = F.col("n_rows"), F.col("_rs_r")
    s = F.floor(n / n_splits)
    last = F.least(F.lit(n_splits - 1), F.when(s > 0, F.ceil(n / s) - 2).otherwise(F.lit(-1)))
    folds = F.sequence(F.lit(0), F.greatest(last, F.lit(-1)))
    entries = F.transform(
        F.filter(folds, lambda i: (i >= 0) & ((i + 1) * s < n)),
        lambda i: F.when(r <= (i + 1) * s, F.lit("train"))
                   .when((r > (i + 1) * s) & (r <= F.least((i + 2) * s, n)), F.lit("validation")))
    tagged = ranked.withColumn("_rs_e", F.arrays_zip(
        F.filter(folds, lambda i: (i >= 0) & ((i + 1) * s < n)).alias("fold"), entries.alias("role")))
    out = tagged.select("*", F.explode("_rs_e").alias("_rs_x")).where(F.col("_rs_x.role").isNotNull())
    return out.select(*df.columns, F.col("_rs_x.fold").cast("int").alias("fold"), F.col("_rs_x.role").alias("role"))
