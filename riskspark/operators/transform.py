"""Cleaning and feature transforms.

Fitted steps are ``pyspark.ml`` stages (``Estimator`` -> ``Model``) so they
chain in a ``Pipeline``, refit per training split, and save / load with ML
persistence. Every statistic is computed with one aggregation over all
columns; the fitted model holds only one small row of numbers (or, for label
codes, a stored table that is joined).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators.kernels import exact_quantiles, store_table, value_cumsums
from riskspark.operators.profile import FLOATING, clean_value, numeric_columns


# ---------------------------------------------------------------- T1
def detect_types(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    """numeric / categorical / binary / datetime column lists.

    Binary = numeric with exactly two distinct non-missing values, tested
    without a distinct count: min < max and no value outside {min, max}.
    """
    num = [c for c in numeric_columns(df) if c not in exclude]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    dt = [f.name for f in df.schema.fields
          if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) and f.name not in exclude]
    binary = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType) and f.name not in exclude]
    if num:
        mm = df.agg(*[F.min(clean_value(df, c)).alias(f"a{i}") for i, c in enumerate(num)],
                    *[F.max(clean_value(df, c)).alias(f"b{i}") for i, c in enumerate(num)]).first()
        cand = [(i, c) for i, c in enumerate(num)
                if mm[f"a{i}"] is not None and mm[f"a{i}"] != mm[f"b{i}"]]
        if cand:
            others = df.agg(*[F.count_if(clean_value(df, c).isNotNull() & (clean_value(df, c) != F.lit(mm[f"a{i}"]))
                                         & (clean_value(df, c) != F.lit(mm[f"b{i}"]))).alias(f"o{i}")
                              for i, c in cand]).first()
            binary += [c for i, c in cand if others[f"o{i}"] == 0]
    return {"numeric": [c for c in num if c not in binary], "categorical": cat,
            "binary": binary, "datetime": dt}


def detect_types_table(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    kinds = detect_types(df, exclude)
    rows = [(c, k) for k, cols in kinds.items() for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


# ---------------------------------------------------------------- T2
def _mode_values(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-missing value per column (smallest value among ties).

    One unpivot + one (column, value) count; only the winner per column
    reaches the driver.
    """
    if not cols:
        return {}
    num = set(numeric_columns(df))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), clean_value(df, c).cast("string").alias("v"),
                 (clean_value(df, c).cast("double") if c in num else F.lit(None).cast("double")).alias("d"))
        for c in cols])).alias("r")).select("r.*")
    counts = long.where(F.col("v").isNotNull()).groupBy("column", "v", "d").agg(F.count(F.lit(1)).alias("n"))
    # numeric ties break on the numeric value, strings on the text
    best = counts.groupBy("column").agg(
        F.min_by(F.struct("v", "d"), F.struct(-F.col("n"), F.col("d"), F.col("v"))).alias("w"))
    out = {}
    for r in best.collect():
        out[r["column"]] = r["w"]
    return out


class ReferenceImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fill missing values: numeric by mean / median / mode, strings by mode.

    ``strategy='drop'`` removes rows with a missing value in any input column.
    Median is the midpoint of the two middle values (not the lower one).
    """

    strategy = Param(Params._dummy(), "strategy", "mean | median | mode | drop",
                     typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, strategy="median"):
        super().__init__()
        self._setDefault(strategy="median")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ReferenceImputerModel":
        cols = list(self.getOrDefault(self.inputCols) or df.columns)
        strategy = self.getOrDefault(self.strategy)
        num = [c for c in cols if c in numeric_columns(df)]
        cat = [c for c in cols if c not in num]
        fills: dict[str, str] = {}
        if strategy != "drop":
            if strategy == "mean" and num:
                row = df.agg(*[F.avg(clean_value(df, c)).alias(c) for c in num]).first()
                fills.update({c: repr(float(row[c])) for c in num if row[c] is not None})
            elif strategy == "median" and num:
                long = df.select(F.explode(F.array(*[
                    F.struct(F.lit(c).alias("column"), clean_value(df, c).cast("double").alias("v")) for c in num
                ])).alias("r")).select("r.*")
                for r in exact_quantiles(long, ["column"], "v", [0.5], out_col="q").collect():
                    fills[r["column"]] = repr(float(r["q"][0]))
            elif strategy == "mode" and num:
                fills.update({c: repr(float(w["d"])) for c, w in _mode_values(df, num).items()})
            fills.update({c: w["v"] for c, w in _mode_values(df, cat).items()})
        model = ReferenceImputerModel(inputCols=cols, strategy=strategy,
                                      fillCols=list(fills), fillValues=[fills[c] for c in fills])
        return model


class ReferenceImputerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    strategy = Param(Params._dummy(), "strategy", "strategy", typeConverter=TypeConverters.toString)
    fillCols = Param(Params._dummy(), "fillCols", "columns", typeConverter=TypeConverters.toListString)
    fillValues = Param(Params._dummy(), "fillValues", "values as text", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None, strategy="median", fillCols=None, fillValues=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.inputCols)
        if self.getOrDefault(self.strategy) == "drop":
            cond = None
            for c in cols:
                ok = ~F.isnan(F.col(c)) & F.col(c).isNotNull() if isinstance(df.schema[c].dataType, FLOATING) \
                    else F.col(c).isNotNull()
                cond = ok if cond is None else cond & ok
            return df.where(cond) if cond is not None else df
        fills = dict(zip(self.getOrDefault(self.fillCols), self.getOrDefault(self.fillValues)))
        num = set(numeric_columns(df))
        out = []
        for f in df.schema.fields:
            c = f.name
            if c in fills:
                if c in num:
                    out.append(F.coalesce(clean_value(df, c).cast("double"), F.lit(float(fills[c]))).alias(c))
                else:
                    out.append(F.coalesce(F.col(c), F.lit(fills[c])).alias(c))
            else:
                out.append(F.col(f"`{c}`"))
        return df.select(*out)


def columns_with_missing(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    cols = list(cols or df.columns)
    from riskspark.operators.profile import is_missing
    row = df.agg(*[F.max(is_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"m{i}"]]


def impute(df: DataFrame, strategy: str = "median", columns: Sequence[str] | None = None) -> DataFrame:
    """Fill (or drop) missing values in the columns that have any."""
    cols = columns_with_missing(df, columns)
    if not cols:
        return df
    return ReferenceImputer(inputCols=cols, strategy=strategy).fit(df).transform(df)


# ---------------------------------------------------------------- T3
NULL_TEXT = "nan"   # fixed value: how the reference spells a missing category


def label_encode(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None,
                 null_code: int | None = None) -> DataFrame:
    """Dense 0-based codes in sorted order of the text form of each value.

    A missing category becomes the literal text 'nan' (and so gets a code),
    unless ``null_code`` is given, which is then used for missing values.
    """
    cols = [c for c in (columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
            if c != target]
    if not cols:
        return df
    text = {c: F.col(f"`{c}`").cast("string") if null_code is not None
            else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_TEXT)) for c in cols}
    codes = store_table(label_codes(df, text))
    return with_codes(df, codes, text, {c: null_code for c in cols})


def label_codes(df: DataFrame, text: dict[str, Column]) -> DataFrame:
    """(column, label, code): the distinct labels of each column, numbered in sorted order by
    the running-count kernel, so neither the driver nor the plan holds a label."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), t.alias("label"))
                                         for c, t in text.items()])).alias("r")).select("r.*")
    ones = long.where(F.col("label").isNotNull()).groupBy("column", "label").agg(F.lit(1).cast("long").alias("one"))
    return value_cumsums(ones, ["column"], "label", ["one"]).select(
        "column", "label", (F.col("cum_one") - 1).cast("int").alias("code"))


def with_codes(df: DataFrame, codes: DataFrame, text: dict[str, Column], other: dict[str, int | None]) -> DataFrame:
    """``df`` with the columns of ``text`` replaced by their codes, ``other`` where there is none."""
    out = df
    for i, (c, t) in enumerate(text.items()):
        of = codes.where(F.col("column") == c).select(F.col("label").alias(f"_rs_l{i}"), F.col("code").alias(f"_rs_c{i}"))
        out = out.withColumn(f"_rs_t{i}", t).join(of, F.col(f"_rs_t{i}") == F.col(f"_rs_l{i}"), "left")
    place = {c: i for i, c in enumerate(text)}
    return out.select(*[
        F.coalesce(F.col(f"_rs_c{place[c]}"), F.lit(other[c]).cast("int")).alias(c) if c in place else F.col(f"`{c}`")
        for c in df.columns])


# ---------------------------------------------------------------- T4
class PopulationStandardScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """(x − mean) / std with the population std (ddof 0); zero std divides by 1."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationStandardScalerModel":
        cols = list(self.getOrDefault(self.inputCols))
        row = df.agg(*[F.avg(clean_value(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(clean_value(df, c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i in range(len(cols))]
        stds = [float(row[f"s{i}"]) if row[f"s{i}"] is not None else 1.0 for i in range(len(cols))]
        return PopulationStandardScalerModel(inputCols=cols, means=means, stds=stds)


class PopulationStandardScalerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "column means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population std", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        stats = dict(zip(self.getOrDefault(self.inputCols),
                         zip(self.getOrDefault(self.means), self.getOrDefault(self.stds))))
        out = []
        for f in df.schema.fields:
            c = f.name
            if c in stats:
                m, s = stats[c]
                out.append(((clean_value(df, c).cast("double") - F.lit(m)) / F.lit(s if s != 0 else 1.0)).alias(c))
            else:
                out.append(F.col(f"`{c}`"))
        return df.select(*out)


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return PopulationStandardScaler(inputCols=list(columns)).fit(df).transform(df)


# ---------------------------------------------------------------- T5 / T6
class FeatureEngineer(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Product of the first two input columns and square of the first."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = list(self.getOrDefault(self.inputCols))
        out = df
        if len(cols) >= 2:
            a, b = cols[0], cols[1]
            out = out.withColumn(f"{a}_x_{b}", F.col(a) * F.col(b))
        if cols:
            a = cols[0]
            out = out.withColumn(f"{a}_squared", F.col(a) * F.col(a))
        return out


def interaction_feature(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    cols = numeric_columns(df, exclude)
    return df.withColumn(f"{cols[0]}_x_{cols[1]}", F.col(cols[0]) * F.col(cols[1])) if len(cols) >= 2 else df


def squared_feature(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    cols = numeric_columns(df, exclude)
    return df.withColumn(f"{cols[0]}_squared", F.col(cols[0]) * F.col(cols[0])) if cols else df


# ---------------------------------------------------------------- T7
class LabelCoder(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """T3 as a pipeline stage (text form, 'nan' for missing, alphabetical codes)."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = list(self.getOrDefault(self.inputCols))
        codes = store_table(label_codes(df, _label_texts(cols)))
        return LabelCoderModel(inputCols=cols)._with(codes)


def _label_texts(cols: Sequence[str]) -> dict[str, Column]:
    return {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_TEXT)) for c in cols}


class LabelCoderModel(Model, HasInputCols, MLReadable, MLWritable):
    """Codes as a stored table that is joined; a label unseen at fitting gets the number of labels."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _with(self, codes: DataFrame) -> "LabelCoderModel":
        self.codes = codes
        self.sizes = {r["column"]: r["count"] for r in codes.groupBy("column").count().collect()}    # a row per column
        return self

    def copy(self, extra=None):
        out = super().copy(extra)
        out.codes, out.sizes = self.codes, self.sizes
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = list(self.getOrDefault(self.inputCols))
        return with_codes(df, self.codes, _label_texts(cols), {c: self.sizes.get(c, 0) for c in cols})

    def write(self):
        return _LabelCoderWriter(self)

    @classmethod
    def read(cls):
        return _LabelCoderReader(cls)


class _LabelCoderWriter(MLWriter):
    def __init__(self, instance: LabelCoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.codes.write.mode("overwrite").parquet(f"{path}/codes")


class _LabelCoderReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> LabelCoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._with(self.sparkSession.read.parquet(f"{path}/codes"))


def preprocess(df: DataFrame, target: str | None = None, key_cols: Sequence[str] = (),
               include_target: bool = False, strategy: str = "median") -> tuple[DataFrame, PipelineModel]:
    """T2 → T3 → T4 → T5/T6 as one fitted pipeline.

    Encoded categoricals are scaled (they are numeric once coded); binary
    columns (a 0/1 target included) are not. ``key_cols`` pass through
    untouched. The feature columns come from the schema after each step.
    """
    keep_out = list(key_cols) + ([] if include_target or target is None else [target])
    miss = [c for c in columns_with_missing(df) if c not in key_cols]
    imputer = ReferenceImputer(inputCols=miss, strategy=strategy).fit(df) if miss else None
    step1 = imputer.transform(df) if imputer else df
    cats = [f.name for f in step1.schema.fields if isinstance(f.dataType, T.StringType)
            and f.name != target and f.name not in key_cols]
    coder = LabelCoder(inputCols=cats).fit(step1) if cats else None
    step2 = coder.transform(step1) if coder else step1
    kinds = detect_types(step2, exclude=list(key_cols))
    scaler = PopulationStandardScaler(inputCols=kinds["numeric"]).fit(step2) if kinds["numeric"] else None
    step3 = scaler.transform(step2) if scaler else step2
    fe = FeatureEngineer(inputCols=numeric_columns(step3, keep_out))
    stages = [s for s in (imputer, coder, scaler) if s is not None] + [fe]
    model = PipelineModel(stages=stages)
    return fe.transform(step3), model


def feature_names(df: DataFrame, target: str | None, key_cols: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != target and c not in key_cols]


# ---------------------------------------------------------------- T8 / T9
def binarize_target(col: str = "class", bad_value: int = 2) -> Column:
    """1 for the bad class (``class == 2`` in the German credit data), else 0."""
    return (F.col(col) == bad_value).cast("int")


def resolve_target(df: DataFrame, target: str | None = None) -> str:
    """Explicit target, else 'class', else 'target', else the last column."""
    if target:
        return target
    for c in ("class", "target"):
        if c in df.columns:
            return c
    return df.columns[-1]


def select_features(df: DataFrame, target: str | None = None, key_cols: Sequence[str] = ()) -> DataFrame:
    """X columns then the label (renamed ``label``) in one frame."""
    t = resolve_target(df, target)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != t], F.col(t).alias("label"))


# ---------------------------------------------------------------- T10
def generator_prepare(df: DataFrame, key_cols: Sequence[str] = ()) -> DataFrame:
    """Numeric NULL -> median, then strings -> sorted codes with NULL -> −1."""
    num = [c for c in numeric_columns(df) if c not in key_cols]
    miss = [c for c in columns_with_missing(df, num)] if num else []
    filled = ReferenceImputer(inputCols=miss, strategy="median").fit(df).transform(df) if miss else df
    cats = [f.name for f in filled.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in key_cols]
    return label_encode(filled, None, cats, null_code=-1)
