"""Shared distributed kernels.

* ``value_cumsums`` (K1/K5) — exact running sums over the ascending distinct
  values of a column, per group, without a window that puts a whole group in
  one task. Rows are first collapsed to one row per (group, value), so a value
  that holds a third of the data becomes a single row; the counts are then
  dealt out in ranges of (group, value) and stored once, totals per range (a
  tiny table) give each range its starting offset, and the window runs per
  (group, range). One plan for every size: how many ranges a group spans
  follows from Spark's own sampling.
* ``exact_quantiles`` — linear-interpolated quantiles (NumPy / pandas
  convention) read off the running counts; exact, with bounded memory per task.
* ``hash_rank`` (K1) — exact 1-based row number per group in the order of
  ``md5(seed:key)``; buckets come from the leading hex digits of the hash, which
  are uniform, so a large group spreads over many tasks.
"""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ALL = "_rs_all"

def _with_group(df: DataFrame, group_cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if group_cols:
        return df, list(group_cols)
    return df.withColumn(_ALL, F.lit(1)), [_ALL]


def value_cumsums(counts: DataFrame, group_cols: Sequence[str], value_col: str,
                  sum_cols: Sequence[str]) -> DataFrame:
    """Inclusive ascending running sums of ``sum_cols`` per group.

    ``counts`` must hold one row per (group, value) (aggregate first); a row of no
    count may stand beside it and comes before it. Adds ``cum_<c>`` (sum over values
    <= this one) and ``tot_<c>`` (group total) for every ``c`` in ``sum_cols``.
    """
    counts, g = _with_group(counts, group_cols)
    # ranges of (group, value): a group lies in consecutive ranges, a value in one
    placed = store_table(counts.repartitionByRange(*g, value_col)
                         .withColumn("_rs_part", F.spark_partition_id()))
    totals = placed.groupBy(*g, "_rs_part").agg(*[F.sum(c).alias(f"_rs_bs_{c}") for c in sum_cols])
    before = Window.partitionBy(*g).orderBy("_rs_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    # stored, so that its size is known and the rows need no shuffle to meet it; a (group, range)
    # gets a number, as rows sort faster by a number than by their group columns
    offsets = store_table(totals.select(
        *g, "_rs_part", F.monotonically_increasing_id().alias("_rs_no"),
        *[F.coalesce(F.sum(f"_rs_bs_{c}").over(before), F.lit(0)).alias(f"_rs_off_{c}") for c in sum_cols],
        *[F.sum(f"_rs_bs_{c}").over(whole).alias(f"tot_{c}") for c in sum_cols]))
    within = Window.partitionBy("_rs_no").orderBy(value_col, *sum_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # NULL groups are groups too, so the offsets are matched null-safely
    right = offsets.select(*[F.col(c).alias(f"_rs_r{i}") for i, c in enumerate([*g, "_rs_part"])],
                           *[c for c in offsets.columns if c not in g and c != "_rs_part"])
    on = F.lit(True)
    for i, c in enumerate([*g, "_rs_part"]):
        on = on & placed[c].eqNullSafe(right[f"_rs_r{i}"])
    out = placed.join(right, on).select(
        *counts.columns,
        *[(F.col(f"_rs_off_{c}") + F.sum(c).over(within)).alias(f"cum_{c}") for c in sum_cols],
        *[F.col(f"tot_{c}") for c in sum_cols])
    return out if group_cols else out.drop(_ALL)


def linear_quantile_probs(n_groups: int) -> list[float]:
    """``numpy.linspace(0, 1, n_groups + 1)`` — the levels ``pandas.qcut`` uses."""
    step = 1.0 / n_groups
    out = [i * step for i in range(n_groups + 1)]
    out[-1] = 1.0
    return out


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    probs: Sequence[float], out_col: str = "quantiles") -> DataFrame:
    """Exact linear-interpolated quantiles per group as an array column.

    Same convention as ``numpy.quantile(method='linear')``: position
    ``h = (n-1)·q``, value ``a + (b-a)·t`` (or ``b - (b-a)·(1-t)`` for
    ``t >= 0.5``) between the order statistics at ``floor(h)`` and the next one.
    NULL and NaN values are ignored. Returns one row per group with ``n``.
    """
    df, g = _with_group(df, group_cols)
    v = F.col(value_col)
    valid = df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    counts = valid.groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("n"))
    out = quantiles_of_sums(value_cumsums(counts, g, value_col, ["n"]), g, value_col, probs, out_col)
    return out if group_cols else out.drop(_ALL)


def interpolated(a: Column, b: Column, t: Column) -> Column:
    """Value at share ``t`` between ``a`` and ``b``, in NumPy's two forms."""
    return F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)


def quantiles_of_sums(cum: DataFrame, group_cols: Sequence[str], value_col: str,
                      probs: Sequence[float], out_col: str = "quantiles") -> DataFrame:
    """``exact_quantiles`` read off a table of running counts (``n``, ``cum_n``, ``tot_n``)
    that exists already; rows of no count are passed over."""
    g = list(group_cols)
    probs_arr = F.array(*[F.lit(float(q)) for q in probs])
    nm1 = (F.col("tot_n") - 1).cast("double")
    start = F.col("cum_n") - F.col("n")
    # 0-based order statistics each quantile needs: floor(h) and floor(h) + 1. A row looks only at
    # the levels about its own share of the group, found by a table of where each cell of [0, 1] begins
    levels = sorted({float(q) for q in probs})
    cells = len(levels)
    begins = F.array(*[F.lit(bisect_left(levels, c / cells)) for c in range(cells)], F.lit(cells))
    cell = lambda x: F.least(F.greatest(F.floor(x * float(cells)), F.lit(-1)), F.lit(cells)).cast("int")      # noqa: E731
    at = F.element_at(begins, F.greatest(cell(F.coalesce(F.try_divide((start - 1).cast("double"), nm1), F.lit(0.0))) - 1, F.lit(0)) + 1)
    to = F.element_at(begins, F.least(cell(F.coalesce(F.try_divide(F.col("cum_n").cast("double"), nm1), F.lit(1.0))) + 2, F.lit(cells)) + 1)
    needed = F.array_distinct(F.flatten(F.transform(
        F.slice(F.array(*[F.lit(q) for q in levels]), at + 1, F.greatest(to - at, F.lit(0))),
        lambda q: F.array(F.floor(nm1 * q).cast("long"),
                          F.least(F.floor(nm1 * q).cast("long") + 1, F.col("tot_n") - 1)))))
    hits = cum.select(
        *g, F.col(value_col).cast("double").alias("_rs_v"), F.col("tot_n").alias("_rs_tot"),
        F.explode(F.filter(needed, lambda r: (r >= start) & (r < F.col("cum_n")))).alias("_rs_r"),
    )
    per_group = hits.groupBy(*g).agg(
        F.first("_rs_tot").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("_rs_r", "_rs_v"))).alias("_rs_at"),
    )
    nm1g = (F.col("n") - 1).cast("double")

    def q_value(q: Column) -> Column:
        h = nm1g * q
        lo = F.floor(h).cast("long")
        a = F.element_at(F.col("_rs_at"), lo)
        b = F.element_at(F.col("_rs_at"), F.least(lo + 1, F.col("n") - 1))
        return interpolated(a, b, h - lo.cast("double"))

    return per_group.select(*g, "n", F.transform(probs_arr, q_value).alias(out_col))


def hash_key(seed: int, key: Column) -> Column:
    """md5 of ``'<seed>:<key>'`` — identical in Spark and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_rank(df: DataFrame, group_cols: Sequence[str], key_col: str, seed: int,
              out_col: str = "rank", prefix_digits: int = 3) -> DataFrame:
    """Exact 1-based rank per group ordered by (md5(seed:key), key).

    Leading ``prefix_digits`` hex digits of the hash form 16**digits uniform
    buckets; per-(group, bucket) counts give offsets, and the window only
    spans one bucket.
    """
    df, g = _with_group(df, group_cols)
    keyed = df.withColumn("_rs_h", hash_key(seed, F.col(key_col))).withColumn("_rs_b", F.substring("_rs_h", 1, prefix_digits))
    out = keyed.join(bucket_offsets(keyed, g), [*g, "_rs_b"]).withColumn(
        out_col, rank_in_bucket(g, key_col)
    ).withColumnRenamed("_rs_group_n", "group_n").drop("_rs_h", "_rs_b", "_rs_off", "_rs_bn")
    if not group_cols:
        out = out.drop(_ALL)
    return out


def bucket_offsets(keyed: DataFrame, g: Sequence[str]) -> DataFrame:
    """Per (group, bucket ``_rs_b``): the size ``_rs_bn``, the rows before it ``_rs_off`` and the
    size of the group ``_rs_group_n``."""
    sizes = keyed.groupBy(*g, "_rs_b").agg(F.count(F.lit(1)).alias("_rs_bn"))
    before = Window.partitionBy(*g).orderBy("_rs_b").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*g, "_rs_b", "_rs_bn",
                        F.coalesce(F.sum("_rs_bn").over(before), F.lit(0)).alias("_rs_off"),
                        F.sum("_rs_bn").over(Window.partitionBy(*g)).alias("_rs_group_n"))


def rank_in_bucket(g: Sequence[str], key_col: str) -> Column:
    """The rank in the group of a row that has met its bucket's offset."""
    return F.col("_rs_off") + F.row_number().over(Window.partitionBy(*g, "_rs_b").orderBy("_rs_h", key_col))


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and read by all branches that follow: ``checkpoint()`` writes it
    to the session's shared checkpoint folder, so a lost executor loses nothing of it."""
    return df.checkpoint(eager=True)


materialize_small = materialize      # of aggregated tables


_DROPPING: dict[str, list] = {}          # by application: how many are within, and the setting before
_DROPPING_LOCK = threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it a DataFrame's shuffle files go as soon as its action has ended, and not when the
    driver next collects its garbage. Not for frames that several actions compute."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    app = spark.sparkContext.applicationId
    with _DROPPING_LOCK:
        now = _DROPPING.setdefault(app, [0, spark.conf.get(name)])
        now[0] += 1
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        with _DROPPING_LOCK:
            now[0] -= 1
            if not now[0]:
                spark.conf.set(name, _DROPPING.pop(app)[1])


def store_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet (in the shared folder unless a path is given) and read again:
    Catalyst then knows its size, so joins against a small one need no shuffle of the other side."""
    if path is None:
        import uuid

        from riskspark.session import ensure_checkpoint_dir
        path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
