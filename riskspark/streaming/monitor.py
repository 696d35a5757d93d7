"""Structured Streaming: score-drift monitor (ST1) and stream scoring (ST2).

ST1 keeps per-(day, bin) score counts as streaming state: ``withWatermark`` on
the event time, a tumbling ``window(ts, '1 day')`` and an ``update``-mode
aggregation. Each micro-batch's updated counts are appended to a count table in
``foreachBatch``, in a folder of the stream's run and the epoch, so a batch writes
what it changed and a replayed epoch rewrites its own folder; readers take the
latest row of each key. PSI per day against a fixed baseline histogram is a small
batch query over that table. Rows later than the watermark are dropped, as
event-time aggregation does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.bins import count_edges, r6
from riskspark.operators.evaluate import PSI_FIXED_INNER

SCORE_SCALE = 500.0   # F9: score = value / 500


def score_bin(score) -> F.Column:
    """Bin of the fixed PSI grid: ten bins on [0, 1], right-closed, outer edges ±∞."""
    return count_edges(score, PSI_FIXED_INNER, strict=True)


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the parquet files of ``folder`` matching ``file_glob``."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{file_glob}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def scored_events(events: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP (watermarks reject TIMESTAMP_NTZ) and the score bin."""
    ts = F.col("ts").cast("timestamp")
    score = F.col("value") / F.lit(SCORE_SCALE)
    return events.select(ts.alias("ts"), score.alias("score")).withColumn("bin", score_bin(F.col("score")))


def daily_bin_counts(scored: DataFrame, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """Streaming (or batch) counts per (day window, bin)."""
    return (scored.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "bin")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "bin", "n"))


class CountTable:
    """A (window_start, bin) -> n table on shared storage, written in increments.

    Every stream over the table is a run; runs are numbered in the order in which they begin.
    An epoch's rows are one folder, ``<run>/<epoch>``, complete once Spark has put its _SUCCESS
    there. Of a key's rows that of the latest run, and in it of the latest epoch, holds; so a
    new stream over an old table replaces what it counts anew and keeps the rest. ``compact``
    writes the rows that hold as a run of its own, from which reading then begins.
    """

    WHOLE = "-whole"

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self.run: int | None = None

    def _listed(self, path: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _runs(self) -> list[str]:
        return [r for r in self._listed(self.base) if r[:9].isdigit()]

    def _next(self) -> int:
        runs = self._runs()
        return int(runs[-1][:9]) + 1 if runs else 0

    def _write(self, rows: DataFrame, run: int, epoch: int, mark: str = "") -> None:
        rows.select("window_start", "bin", "n", F.lit(run).alias("_run"), F.lit(epoch).cast("long").alias("_epoch")) \
            .write.mode("overwrite").parquet(f"{self.base}/{run:09d}{mark}/{epoch:012d}")

    def committed(self) -> list[str]:
        """Folders of complete epochs, from the last compaction on."""
        runs = [r for r in self._runs()]
        complete = [f"{self.base}/{r}/{e}" for r in runs for e in self._listed(f"{self.base}/{r}") if "_SUCCESS" in self._listed(f"{self.base}/{r}/{e}")]
        whole = [i for i, path in enumerate(complete) if path.split("/")[-2].endswith(self.WHOLE)]
        return complete[whole[-1]:] if whole else complete

    def merge(self, updates: DataFrame, epoch: int) -> None:
        """Adds the updated keys of an epoch; writes these alone."""
        if self.run is None:
            self.run = self._next()
        self._write(updates, self.run, epoch)

    def compact(self) -> None:
        """One folder for what holds now. Not to be called while a stream writes."""
        self._write(self.read(), self._next(), 0, self.WHOLE)
        self.run = None

    def read(self) -> DataFrame:
        paths = self.committed()
        if not paths:
            raise FileNotFoundError(f"no committed epoch under {self.base}")
        rows = self.spark.read.schema("window_start timestamp, bin int, n long, _run int, _epoch long").parquet(*paths)
        return rows.groupBy("window_start", "bin").agg(F.max_by("n", F.struct("_run", "_epoch")).alias("n"))


def run_count_stream(spark: SparkSession, events: DataFrame, table: CountTable, checkpoint: str,
                     watermark: str = "1 day") -> None:
    """Run the streaming aggregation over everything available, then stop."""
    counts = daily_bin_counts(scored_events(events), watermark)
    query = (counts.writeStream.outputMode("update")
             .foreachBatch(lambda batch, epoch: table.merge(batch, epoch))
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True)
             .start())
    query.awaitTermination()


def baseline_histogram(scored: DataFrame, days: int = 7) -> DataFrame:
    """Expected shares per bin over the first ``days`` days of the (batch) data."""
    d0 = scored.agg(F.min(F.date_trunc("day", "ts")).alias("d0")).first()["d0"]
    first = scored.where(F.col("ts") < F.lit(d0) + F.expr(f"INTERVAL {days} DAYS"))
    c = first.groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql import Window
    return c.select("bin", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias("e"))


def psi_by_window(counts: DataFrame, baseline: DataFrame, epsilon: float | None = None) -> DataFrame:
    """PSI of every window against the baseline shares (variant B rules) and its status."""
    from pyspark.sql import Window
    sh = counts.select("window_start", "bin", "n",
                       (F.col("n") / F.sum("n").over(Window.partitionBy("window_start"))).alias("a"))
    windows = counts.groupBy("window_start").agg(F.sum("n").alias("n_events"))
    # the baseline has at most ten rows (one per fixed bin): inline it and
    # give every window the full list of baseline bins
    base = [(int(r["bin"]), float(r["e"])) for r in baseline.where(F.col("e") > 0).collect()]
    grid = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(e).alias("e")) for b, e in base])
    pairs = windows.select("window_start", "n_events", F.explode(grid).alias("g")).select(
        "window_start", "n_events", "g.bin", "g.e")
    j = pairs.join(sh.select("window_start", "bin", "a"), ["window_start", "bin"], "left").fillna(0.0, ["a"])
    a, e = F.col("a"), F.col("e")
    if epsilon is not None:
        a = F.when(a == 0, epsilon).otherwise(a)
        term = (a - e) * F.log(a / e)
    else:
        term = F.when(a == 0, F.lit(float("inf"))).otherwise((a - e) * F.log(a / e))
    psi = j.groupBy("window_start", "n_events").agg(F.sum(term).alias("psi"))
    # windows come out as TIMESTAMP (event time must be one for watermarks);
    # report them in the input's wall-clock type
    return psi.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_events",
                      r6(F.col("psi")).alias("psi"),
                      F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.2, "warning")
                      .otherwise("unstable").alias("psi_stability"))


def score_stream(model, stream: DataFrame) -> DataFrame:
    """ST2: apply a fitted pipeline to arriving rows (stateless) and keep P(default)."""
    from riskspark.operators.models import probability_of_default
    scored = model.transform(stream)
    return scored.withColumn("p", probability_of_default(scored))
