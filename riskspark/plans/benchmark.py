"""Entry point 1: the model benchmark as one Spark plan.

loans -> holdout split (hash-ranked, stratified) -> fit each preset pipeline on
train -> long predictions over every split (persisted once) -> one grouped
evaluation job -> leaderboard.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from riskspark.operators import evaluate as ev
from riskspark.operators import leaderboard as lb
from riskspark.operators import models as md
from riskspark.operators.split import holdout_split
from riskspark.sources import fixtures as fx

NUMERIC = ["amount", "balance", "n_lines", "qty_sum", "avg_discount"]
CATEGORICAL = ["segment", "priority"]
TARGET, KEY = "target", "loan_id"


def loan_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans with the train / test / holdout split column (stored once per session)."""
    return fx.stored_result(spark, sf_dir, "loan_frame", lambda: holdout_split(
        fx.stored(spark, sf_dir, "loans").select(KEY, *NUMERIC, *CATEGORICAL, TARGET), KEY, TARGET))


def predictions(spark: SparkSession, sf_dir: str, presets: Sequence[str]) -> DataFrame:
    """Long predictions of each preset, trained and scored once per session."""
    frame, cleaning = loan_frame(spark, sf_dir), md.Cleaning()

    def one(preset: str) -> DataFrame:
        model = md.fit(frame.where("split = 'train'"), preset, NUMERIC, CATEGORICAL, TARGET, None, cleaning)
        return md.score_long({preset: model}, frame, KEY, TARGET)

    def stored(preset: str) -> DataFrame:
        return fx.stored_result(spark, sf_dir, f"predictions-{preset}", lambda: one(preset))

    # fits are independent: most of one is MLlib's small job per tree level, so they run side by side
    with ThreadPoolExecutor(md.CONCURRENT) as pool:
        parts = list(pool.map(stored, presets))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def leaderboard(spark: SparkSession, sf_dir: str, presets: Sequence[str]) -> DataFrame:
    preds = predictions(spark, sf_dir, presets).checkpoint(eager=True)
    wide = ev.evaluate_models(preds, ["model"], "split", "train")
    return lb.rank_models(lb.metrics_long(wide))
