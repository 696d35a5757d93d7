"""Sources and sinks.

Reads go through ``spark.read`` with explicit formats so column pruning and
filter pushdown reach the files; segment and split tables are written
partitioned by that column so a read of one value prunes the rest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SUPPORTED = ("csv", "parquet", "json")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return bool(fs.globStatus(p)) and len(fs.globStatus(p)) > 0


# ---------------------------------------------------------------- S1
def scan_table(spark: SparkSession, path: str, file_type: str = "csv",
               schema: StructType | str | None = None) -> DataFrame:
    """Read a CSV (with header) or parquet table; a missing path or an unknown
    type is an error."""
    if file_type not in SUPPORTED:
        raise ValueError(f"unsupported file type {file_type!r}; use one of {SUPPORTED}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if file_type == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if file_type == "json":
        return reader.json(path)
    return reader.parquet(path)


# ---------------------------------------------------------------- S2
def write_segments(df: DataFrame, base: str, segment_col: str = "segment") -> None:
    """Store a table partitioned by segment (one folder per value)."""
    df.write.mode("overwrite").partitionBy(segment_col).parquet(base)


def scan_segment(spark: SparkSession, base: str, segment: str, segment_col: str = "segment") -> DataFrame:
    """One segment of a segment-partitioned table (partition pruning: only that
    folder is listed and read)."""
    if not _exists(spark, base):
        raise FileNotFoundError(base)
    return spark.read.parquet(base).where(F.col(segment_col) == segment)


# ---------------------------------------------------------------- S3
def scan_catalog(spark: SparkSession, catalog: Mapping[str, str], file_type: str = "parquet",
                 failed: dict[str, str] | None = None) -> DataFrame:
    """Union of every readable dataset with a ``dataset`` column. An unreadable one ends
    the call, unless ``failed`` is given: then it is skipped and its error recorded there."""
    out = None
    for name, path in catalog.items():
        try:
            df = scan_table(spark, path, file_type).withColumn("dataset", F.lit(name))
        except Exception as exc:  # noqa: BLE001 - recorded for the caller
            if failed is None:
                raise
            failed[name] = f"{type(exc).__name__}: {exc}"
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset of the catalog could be read")
    return out


# ---------------------------------------------------------------- S5 / S6 / S8
def write_table(df: DataFrame, path: str, file_type: str = "parquet", mode: str = "overwrite") -> None:
    """Write CSV (header, no index) or parquet; parent folders are created."""
    if file_type not in SUPPORTED:
        raise ValueError(f"unsupported file type {file_type!r}")
    w = df.write.mode(mode)
    if file_type == "csv":
        w.option("header", True).csv(path)
    elif file_type == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_splits(df: DataFrame, base: str, split_col: str = "split") -> None:
    """One folder per split value under ``base``."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(base)


# ---------------------------------------------------------------- S7
def read_splits(spark: SparkSession, base: str, split: str | None = None) -> DataFrame:
    """Read a split table; the ``split`` column comes back from partition
    discovery, and choosing one split prunes the others."""
    df = spark.read.parquet(base)
    return df.where(F.col("split") == split) if split else df


def write_metrics(df: DataFrame, path: str) -> None:
    """Persist a tidy metrics table as JSON lines (non-JSON values become text)."""
    cols = [F.col(f.name).cast("string").alias(f.name)
            if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date", "binary") else F.col(f.name)
            for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").json(path)


# ---------------------------------------------------------------- S4
def sample_table(spark: SparkSession, n_samples: int = 5000, n_features: int = 20, seed: int = 42,
                 positive_share: float = 0.3, partitions: int | None = None) -> DataFrame:
    """n × k standard normals ``feature_i``, an independent normal score, and
    ``default`` = 1 for scores above their (1 − positive_share) quantile.

    Normals come from seeded hashes of the row id (partitioning does not
    change them); the threshold is the exact quantile of the score column.
    """
    from riskspark.functions.normal import hash_normal
    from riskspark.operators.kernels import exact_quantiles
    rows = spark.range(0, n_samples, numPartitions=partitions or max(1, spark.sparkContext.defaultParallelism))
    feats = [hash_normal(seed, F.col("id"), F.lit(j)).alias(f"feature_{j}") for j in range(n_features)]
    df = rows.select("id", *feats, hash_normal(seed, F.col("id"), F.lit(-1)).alias("_score"))
    cut = exact_quantiles(df, [], "_score", [1.0 - positive_share]).first()["quantiles"][0]
    return df.select(*[f"feature_{j}" for j in range(n_features)],
                     (F.col("_score") > F.lit(cut)).cast("int").alias("default"))
