"""Review of nominations by people, as tables: the queue to look at and the verdicts to apply."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from relinker.config import Settings
from relinker.functions import urls
from relinker.operators.consensus import top_suggestions

# Fixed value: suggestions shown per broken URL.
SHOWN = 5


def review_queue(votes: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Numbered options per broken URL: its top suggestions, then its parent URL if that is live."""
    listed = top_suggestions(votes, SHOWN, cfg).select(
        "url_404", F.col("match_url").alias("option_url"), F.col("rank"), F.lit(False).alias("is_parent"))
    parents = (
        votes.select("url_404").distinct()
        .select("url_404", urls.parent_url("url_404").alias("option_url"))
        .where(F.col("option_url").isNotNull())
        .join(live.select(F.col("url").alias("option_url")), "option_url", "left_semi")
        .join(listed.select("url_404", "option_url"), ["url_404", "option_url"], "left_anti")
        .select("url_404", "option_url", F.lit(SHOWN + 1).alias("rank"), F.lit(True).alias("is_parent"))
    )
    w = Window.partitionBy("url_404").orderBy("rank")
    return listed.unionByName(parents).select(
        "url_404", F.row_number().over(w).alias("option_no"), "option_url", "is_parent")


def verified_pairs(queue: DataFrame, verdicts: DataFrame, live: DataFrame) -> DataFrame:
    """``verdicts(url_404, choice, manual_url)``: an option number, ``m`` with a live URL, or neither."""
    choice = F.lower(F.trim("choice"))
    chosen = verdicts.select("url_404", F.expr("try_cast(trim(choice) AS int)").alias("option_no")).join(
        queue, ["url_404", "option_no"]).select("url_404", F.col("option_url").alias("live_url"))
    manual = (
        verdicts.where(choice == "m").select("url_404", F.trim("manual_url").alias("live_url"))
        .join(queue.select("url_404").distinct(), "url_404", "left_semi")
        .join(live.select(F.col("url").alias("live_url")), "live_url", "left_semi")
        .select("url_404", "live_url")
    )
    return chosen.unionByName(manual)
