"""The best of scored pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EPS = 1e-9


def pick_best(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("q").agg(F.max(F.struct(
        "score", (-F.col("live_idx")).alias("order"), "live_url")).alias("best"))
    return best.select(
        "q", F.col("best.score").alias("score"), (-F.col("best.order")).alias("live_idx"),
        F.col("best.live_url").alias("live_url"))
