"""From votes to one redirect per broken URL: pivot, totals, agreement vote, suggestions.

A broken URL has at most one vote per algorithm, so every group here has at most as many rows as
there are algorithms.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relinker.config import ALGORITHMS, MAPPING_ORDER, Settings


def algo_order(algo: Column, algorithms: tuple[str, ...] = ALGORITHMS) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in algorithms]), F.lower(algo))


def known_votes(votes: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Votes under a known algorithm name, matched without regard to case; others are skipped."""
    return votes.withColumn("algo", F.lower("algo")).where(F.col("algo").isin(*cfg.algorithms))


def pivot_votes(votes: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per broken URL with ``<algo>`` and ``<algo>_score`` for every algorithm.

    Should an algorithm have several votes for a URL, one vote gives both values: that with the larger score, then URL.
    """
    named = known_votes(votes, cfg)
    per_algo = []
    for a in [a for a in MAPPING_ORDER if a in cfg.algorithms]:
        vote = F.max(F.when(F.col("algo") == a, F.struct("score", "match_url")))
        per_algo.append(vote["match_url"].alias(a))
        per_algo.append(F.coalesce(vote["score"], F.lit(0.0)).alias(f"{a}_score"))
    return named.groupBy("url_404").agg(*per_algo)


def candidates(votes: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Distinct nominations with their number of votes, summed score and first algorithm."""
    named = known_votes(votes, cfg).where(F.col("match_url").isNotNull() & (F.col("match_url") != ""))
    order = algo_order(F.col("algo"), cfg.algorithms)
    return named.groupBy("url_404", "match_url").agg(
        F.count("*").alias("votes"), F.sum("score").alias("tot"), F.min("match_idx").alias("match_idx"),
        F.min(order).alias("first_order"), F.min_by("algo", order).alias("algorithm"))


def consensus(votes: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Most nominated URL per broken URL; ties go to the larger summed score, then the earlier URL."""
    totals = known_votes(votes, cfg).groupBy("url_404").agg(F.sum("score").alias("tot_score"))
    # Sums of the same scores in another order may differ in the last digits.
    best = candidates(votes, cfg).groupBy("url_404").agg(F.max(F.struct(
        "votes", F.round("tot", 9).alias("tot"), (-F.col("match_idx")).alias("order"), "match_url")).alias("b"))
    return totals.join(best, "url_404", "left").select(
        "url_404", "tot_score", F.coalesce("b.votes", F.lit(0)).cast("bigint").alias("agreement"),
        F.col("b.match_url").alias("best_redirect"), F.coalesce("b.tot", F.lit(0.0)).alias("best_redirect_tot_score"))


def mapping(votes: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return pivot_votes(votes, cfg).join(consensus(votes, cfg), "url_404")


def redirects(mapping_df: DataFrame) -> DataFrame:
    keep = ["url_404", "tot_score", "agreement", "best_redirect", "best_redirect_tot_score"]
    if "status_code" in mapping_df.columns:
        keep.insert(1, "status_code")
    return mapping_df.select(*keep)


def by_score(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("best_redirect_tot_score"), "url_404")


def agreement_flags(votes: DataFrame, consensus_df: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    same = F.trim("match_url") == F.trim("best_redirect")
    return known_votes(votes, cfg).join(consensus_df.select("url_404", "best_redirect"), "url_404").select(
        "url_404", "algo", "match_url", "score", F.coalesce(same, F.lit(False)).alias("is_best"))


def votes_of(votes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Votes of the broken URLs listed in ``wanted(url_404)``."""
    return votes.join(wanted.select("url_404").distinct(), "url_404", "left_semi")


def vote_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("algo").agg(
        F.count("*").alias("votes"), F.count("match_url").alias("nominations"))


def urls_with_votes(votes: DataFrame) -> DataFrame:
    return votes.agg(F.count_distinct("url_404").alias("urls_with_votes"))


def top_suggestions(votes: DataFrame, top_n: int = 5, cfg: Settings = Settings()) -> DataFrame:
    """The most nominated URLs per broken URL; ties by first appearance in algorithm order."""
    w = Window.partitionBy("url_404").orderBy(F.desc("votes"), "first_order")
    return candidates(votes, cfg).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select(
        "url_404", "match_url", "votes", "rank")
