"""Profiling and data-quality checks.

Each check is one aggregation over the whole table that computes the statistic
for every column at once, followed by an ``unpivot`` into a tidy
``(column, …)`` result. Missing means NULL, or NaN for floating columns (the
pandas ``isnull`` rule).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions.bins import r6, status3
from riskspark.functions.gram import pair_correlations
from riskspark.functions.stats import pearson
from riskspark.operators.kernels import exact_quantiles, materialize_small

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def is_missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, FLOATING):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def clean_value(df: DataFrame, c: str) -> Column:
    """The column with NaN turned into NULL (so NULL alone means missing)."""
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, FLOATING):
        return F.when(~F.isnan(col), col)
    return col


# ---------------------------------------------------------------- P1
def basic_info(df: DataFrame) -> DataFrame:
    """Row count, column count, and one row per column with its position and type."""
    fields = list(enumerate(df.schema.fields))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(fields)).alias("n_cols"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                     F.lit(f.dataType.simpleString()).alias("dtype"))
                            for i, f in fields])).alias("r")).select("r.*", "n_rows", "n_cols")


# ---------------------------------------------------------------- P2
def missing_profile(df: DataFrame) -> DataFrame:
    """Per column missing count, %, status (<5 ok, <20 warning) and a 'summary' row."""
    cols = df.columns
    agg = materialize_small(df.agg(F.count(F.lit(1)).alias("_n"),
                                   *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]))
    stacked = agg.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"m{i}").alias("missing_count"))
        for i, c in enumerate(cols)])).alias("r")).select("_n", "r.*")
    pct = F.try_divide(F.col("missing_count"), F.col("_n")) * 100.0
    per_col = stacked.select("column", "position", "missing_count", r6(pct).alias("missing_percentage"),
                             status3(pct, 5, 20).alias("status"))
    total = stacked.groupBy().agg(F.sum("missing_count").alias("missing_count"), F.first("_n").alias("_n"))
    tpct = F.try_divide(F.col("missing_count"), F.col("_n") * float(len(cols))) * 100.0
    summary = total.select(F.lit("summary").alias("column"), F.lit(-1).alias("position"), "missing_count",
                           r6(tpct).alias("missing_percentage"), status3(tpct, 5, 20).alias("status"))
    return per_col.unionByName(summary)


# ---------------------------------------------------------------- P3
def duplicate_profile(df: DataFrame) -> DataFrame:
    """Extra copies of fully equal rows (first copy kept), %, status (<1 ok, <5 warning)."""
    # 128 bits stand for a row in the shuffle; missing values are hashed by their place as well
    cols = [F.col(f"`{c}`") for c in df.columns]
    missing = [c.isNull() for c in cols]
    groups = df.groupBy(F.xxhash64(*missing, *cols).alias("_h1"), F.xxhash64(F.lit(1), *cols, *missing).alias("_h2")) \
        .agg(F.count(F.lit(1)).alias("_c"))
    t = groups.agg(F.sum("_c").alias("n_rows"), F.sum(F.col("_c") - 1).alias("duplicate_count"))
    pct = F.try_divide(F.col("duplicate_count"), F.col("n_rows")) * 100.0
    return t.select("n_rows", "duplicate_count", r6(pct).alias("duplicate_percentage"),
                    status3(pct, 1, 5).alias("status"))


# ---------------------------------------------------------------- P4
def cardinality_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column type, distinct non-missing count, % of rows, ok if > 1 % else warning.

    Exact counts go over (column, value) rows, so each row is shuffled as its distinct
    values and not once per column; ``approximate`` sketches all columns without a shuffle.
    """
    cols = df.columns
    types = {c: df.schema[c].dataType.simpleString() for c in cols}
    if approximate:
        agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(clean_value(df, c)).alias(f"d{i}")
                                                      for i, c in enumerate(cols)])
        stacked = agg.select("_n", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(types[c]).alias("dtype"),
                     F.col(f"d{i}").alias("unique_count")) for i, c in enumerate(cols)])).alias("r")).select("_n", "r.*")
    else:
        def text(c: str) -> Column:
            v = clean_value(df, c)
            return (F.when(v == 0, 0.0).otherwise(v) if types[c] in ("float", "double") else v).cast("string")

        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), text(c).alias("value"))
                                             for i, c in enumerate(cols)])).alias("r")).select("r.*")
        per = long.groupBy("position", "value").agg(F.count(F.lit(1)).alias("c")).groupBy("position").agg(
            F.sum("c").alias("_n"), F.count("value").alias("unique_count"))
        every = df.sparkSession.createDataFrame([(i, c, types[c]) for i, c in enumerate(cols)],
                                                "position int, column string, dtype string")
        stacked = F.broadcast(every).join(per, "position", "left").select(
            F.coalesce("_n", F.lit(0)).alias("_n"), "column", "position", "dtype",
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"))
    pct = F.try_divide(F.col("unique_count"), F.col("_n")) * 100.0
    return stacked.select("column", "position", "dtype", "unique_count", r6(pct).alias("unique_percentage"),
                          F.when(pct > 1, "ok").otherwise("warning").alias("status"))


# ---------------------------------------------------------------- P5
def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolated Q1/Q3 per numeric column, bounds ±1.5·IQR, strict outliers."""
    cols = list(columns or numeric_columns(df))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), clean_value(df, c).cast("double").alias("v")) for c in cols
    ])).alias("r")).select("r.*")
    q = exact_quantiles(long, ["column"], "v", [0.25, 0.75], out_col="q")
    q = q.select("column", F.element_at("q", 1).alias("q1"), F.element_at("q", 2).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    bounds = q.select("column", "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lower_bound"),
                      (F.col("q3") + 1.5 * iqr).alias("upper_bound"))
    # bounds: one small row per column, read on the driver and inlined as
    # literals so a single pass counts every column's outliers
    b = {r["column"]: (r["lower_bound"], r["upper_bound"]) for r in bounds.collect()}
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if((clean_value(df, c) < F.lit(b[c][0])) | (clean_value(df, c) > F.lit(b[c][1])))
                   .alias(f"o{i}") if c in b else F.lit(0).alias(f"o{i}") for i, c in enumerate(cols)])
    nan = float("nan")
    j = agg.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"o{i}").alias("outlier_count"),
                 F.lit(b.get(c, (nan, nan))[0]).cast("double").alias("lower_bound"),
                 F.lit(b.get(c, (nan, nan))[1]).cast("double").alias("upper_bound"))
        for i, c in enumerate(cols)])).alias("r")).select("_n", "r.*")
    pct = F.try_divide(F.col("outlier_count"), F.col("_n")) * 100.0
    return j.select("column", "position", "outlier_count", r6(pct).alias("outlier_percentage"),
                    r6(F.col("lower_bound")).alias("lower_bound"), r6(F.col("upper_bound")).alias("upper_bound"),
                    status3(pct, 5, 15).alias("status"))


# ---------------------------------------------------------------- P6 / P7
def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r for every pair i < j (pairwise complete rows), one pass."""
    cols = list(columns or numeric_columns(df))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, i int, j int, correlation double")
    names = F.array(*[F.lit(c) for c in cols])
    return pair_correlations(df, [clean_value(df, c) for c in cols]).where(F.col("i") < F.col("j")).select(
        F.element_at(names, F.col("i") + 1).alias("feature1"), F.element_at(names, F.col("j") + 1).alias("feature2"),
        "i", "j", F.col("r").alias("correlation"))


def correlation_pairs(df: DataFrame, threshold: float = 0.8, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs with |r| > threshold."""
    m = correlation_matrix(df, columns)
    return m.where(F.abs(F.col("correlation")) > threshold).select(
        "feature1", "feature2", r6(F.col("correlation")).alias("correlation"))


def correlation_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """max |r| with the diagonal (1 when any column varies, else NULL) and off-diagonal."""
    cols = list(columns or numeric_columns(df))
    if not cols:
        return df.sparkSession.createDataFrame([(None, None)], "max_correlation double, max_offdiagonal_correlation double")
    # the diagonal is 1 for a column that varies and undefined for any other
    pairs = pair_correlations(df, [clean_value(df, c) for c in cols])
    own = F.when((F.col("i") == F.col("j")) & F.col("r").isNotNull(), 1.0)
    off = F.when(F.col("i") < F.col("j"), F.abs("r"))
    return pairs.agg(r6(F.max(F.coalesce(own, off))).alias("max_correlation"),
                     r6(F.max(off)).alias("max_offdiagonal_correlation"))


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    cols = [c for c in (columns or numeric_columns(df)) if c != target]
    agg = df.agg(*[pearson(clean_value(df, c).cast("double"), clean_value(df, target).cast("double"))
                   .alias(f"t{i}") for i, c in enumerate(cols)])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), r6(F.col(f"t{i}")).alias("correlation"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")


# ---------------------------------------------------------------- P8
def frame_gate(df: DataFrame, min_rows: int = 10, target: DataFrame | None = None) -> DataFrame:
    """Input gate over all rows: error on zero columns or zero rows, and where ``target``
    (a frame of the labels) has another number of rows; warning below ``min_rows``."""
    n = df.count()
    if not df.columns:
        raise ValueError("input has no columns")
    if n == 0:
        raise ValueError("input has no rows")
    if target is not None and (labels := target.count()) != n:
        raise ValueError(f"{n} rows of features and {labels} of the target")
    status = "ok" if n >= min_rows else "warning"
    return df.sparkSession.createDataFrame(
        [(len(df.columns), n, status)], "n_cols int, rows_seen long, status string")


# ---------------------------------------------------------------- P9
def quality_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """P1–P7 in one tidy table: (check, column, metric, value, status)."""
    def tidy(frame: DataFrame, check: str, metrics: list[str], status: str | None) -> DataFrame:
        return frame.select(
            F.lit(check).alias("check"), F.col("column"),
            F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in metrics])).alias("r"),
            (F.col(status) if status else F.lit(None).cast("string")).alias("status"),
        ).select("check", "column", "r.metric", "r.value", "status")

    parts = [
        tidy(missing_profile(df), "missing", ["missing_count", "missing_percentage"], "status"),
        tidy(cardinality_profile(df), "cardinality", ["unique_count", "unique_percentage"], "status"),
        tidy(iqr_outliers(df), "outliers", ["outlier_count", "outlier_percentage", "lower_bound", "upper_bound"],
             "status"),
        tidy(duplicate_profile(df).withColumn("column", F.lit(None).cast("string")), "duplicates",
             ["duplicate_count", "duplicate_percentage"], "status"),
        tidy(basic_info(df).where(F.col("position") == 0).withColumn("column", F.lit(None).cast("string")),
             "shape", ["n_rows", "n_cols"], None),
    ]
    if target:
        parts.append(tidy(target_correlation(df, target), "target_correlation", ["correlation"], None))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- P10
def class_distribution(df: DataFrame, split: str = "split", target: str = "target",
                       feature_cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per split (and ``by``): rows, feature count, per-class count and proportion."""
    keys = [*by, split]
    n_features = len(feature_cols) if feature_cols is not None else len(
        [c for c in df.columns if c not in (*keys, target)])
    c = df.groupBy(*keys, target).agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window
    tot = F.sum("count").over(Window.partitionBy(*keys))
    return c.select(*keys, target, "count", tot.alias("n_rows"), F.lit(n_features).alias("n_features"),
                    r6(F.col("count") / tot).alias("proportion"))


# ---------------------------------------------------------------- P11
def column_metadata(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Generator metadata: numeric columns -> (min, max); every other column ->
    one row per distinct value, NULL included (long format, no cap)."""
    num = [c for c in numeric_columns(df) if c not in exclude]
    other = [c for c in df.columns if c not in num and c not in exclude]
    parts = []
    if num:
        agg = df.agg(*[F.min(clean_value(df, c)).cast("double").alias(f"mn{i}") for i, c in enumerate(num)],
                     *[F.max(clean_value(df, c)).cast("double").alias(f"mx{i}") for i, c in enumerate(num)])
        parts.append(agg.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit("numerical").alias("kind"),
                     F.col(f"mn{i}").alias("min"), F.col(f"mx{i}").alias("max"),
                     F.lit(None).cast("string").alias("value"))
            for i, c in enumerate(num)])).alias("r")).select("r.*"))
    if other:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in other
        ])).alias("r")).select("r.*").distinct()
        parts.append(long.select("column", F.lit("categorical").alias("kind"),
                                 F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
                                 "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
