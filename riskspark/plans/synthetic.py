"""Entry point 2: synthetic data generation, quality scoring and the strategy board.

imbalanced customers -> every generator (failures skipped) -> quality of each
generator's rows against the real ones (Q9) -> for each generator, the mixes of
real and synthetic rows (G6) and all rows together, a logistic model for each of
these training sets, scored on a real holdout -> 0.4 quality + 0.4 AUC +
0.2 stability leaderboard (B10).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import compare as cmp
from riskspark.operators import evaluate as ev
from riskspark.operators import generate as gen
from riskspark.operators import leaderboard as lb
from riskspark.operators import models as md
from riskspark.operators.kernels import store_table
from riskspark.operators.split import split_assign
from riskspark.sources import fixtures as fx

FEATURES = ["n_orders", "sum_amount", "avg_amount", "c_nationkey"]
TARGET, KEY = "target", "customer_id"


def customer_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.stored_result(spark, sf_dir, "customer_frame", lambda: split_assign(
        fx.stored(spark, sf_dir, "imbalanced"), KEY, TARGET, ("train", "holdout"), (0.7, 0.3)))


def synthetic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = customer_frame(spark, sf_dir).where("split = 'train'")
    return fx.stored_result(spark, sf_dir, "synthetic_rows",
                            lambda: gen.generate_all(train, FEATURES, TARGET, key=KEY))


def quality_by_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = customer_frame(spark, sf_dir).where("split = 'train'").select(*FEATURES, TARGET)
    syn = synthetic_rows(spark, sf_dir)
    out = None
    for g in [r[0] for r in syn.select("generator").distinct().collect()]:
        pair = real.withColumn("side", F.lit("real")).unionByName(
            syn.where(F.col("generator") == g).drop("generator").withColumn("side", F.lit("synthetic")))
        q = cmp.quality_score(pair.withColumn(TARGET, F.col(TARGET).cast("string")), "side", TARGET, FEATURES)
        q = q.select(F.lit(g).alias("generator"), "overall_score")
        out = q if out is None else out.unionByName(q)
    return out


ALL_ROWS = "all_rows"


def training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(generator, strategy, features, target): the mixes of every generator, as large as both
    sides allow, and all its rows with all real ones. One stored table."""
    def build() -> DataFrame:
        real = customer_frame(spark, sf_dir).where("split = 'train'").select(KEY, *FEATURES, TARGET)
        made = store_table(synthetic_rows(spark, sf_dir).withColumn("synthetic_id", F.monotonically_increasing_id()))
        n_real = real.count()
        out = None
        for r in made.groupBy("generator").agg(F.count(F.lit(1)).alias("n")).collect():           # a row a generator
            rows = made.where(F.col("generator") == r["generator"]).drop("generator")
            sets = gen.mix_real_synthetic(real, rows, KEY, "synthetic_id", total=min(n_real, r["n"])).select("strategy", *FEATURES, TARGET)
            whole = real.select(F.lit(ALL_ROWS).alias("strategy"), *FEATURES, TARGET).unionByName(rows.select(F.lit(ALL_ROWS).alias("strategy"), *FEATURES, TARGET))
            part = sets.unionByName(whole).withColumn("generator", F.lit(r["generator"]))
            out = part if out is None else out.unionByName(part)
        return out

    return fx.stored_result(spark, sf_dir, "training_sets", build)


def strategy_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each generator and training set (``model``): the models are fitted concurrently
    and scored into one table, which one grouped job evaluates."""
    frame, sets = customer_frame(spark, sf_dir), training_sets(spark, sf_dir)
    pairs = [(r["generator"], r["strategy"]) for r in sets.select("generator", "strategy").distinct().orderBy("generator", "strategy").collect()]

    def fitted(pair):
        rows = sets.where((F.col("generator") == pair[0]) & (F.col("strategy") == pair[1]))
        # SMOTE rows are all of the rare class: a set of these alone teaches nothing
        if rows.select(TARGET).distinct().count() < 2:
            return None
        return md.fit(rows, "LogisticRegression", FEATURES, [], TARGET)

    with ThreadPoolExecutor(md.CONCURRENT) as pool:
        models = {f"{g}|{s}": m for (g, s), m in zip(pairs, pool.map(fitted, pairs)) if m is not None}
    wide = ev.evaluate_models(md.score_long(models, frame, KEY, TARGET), ["model"], "split", "train")
    wide = wide.withColumn("generator", F.element_at(F.split("model", r"\|"), 1)).withColumn("model", F.element_at(F.split("model", r"\|"), 2))
    return lb.strategy_score(quality_by_generator(spark, sf_dir), wide, scope_value="holdout")
