"""Quality numbers of a run."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relinker.config import Settings


def quality_metrics(mapping_df: DataFrame) -> DataFrame:
    return mapping_df.agg(
        F.count("*").alias("total_urls"),
        F.count_distinct("url_404").alias("unique_404s"),
        F.count_distinct("best_redirect").alias("unique_redirects"),
        F.avg("agreement").alias("avg_agreement"),
        F.avg("tot_score").alias("avg_score"),
        F.count_if(F.col("agreement") >= 3).alias("high_confidence_redirects"),
        F.avg("best_redirect_tot_score").alias("avg_best_redirect_score"),
        F.count_if(F.col("best_redirect_tot_score") >= 0.8).alias("total_high_confidence"),
    )


def algorithm_stats(mapping_df: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """How often each algorithm nominated the chosen redirect; one pass over the mapping table."""
    hits = mapping_df.agg(
        F.count("best_redirect").alias("n"),
        *[F.count_if(F.col(a) == F.col("best_redirect")).alias(a) for a in cfg.algorithms])
    rows = hits.select("n", F.explode(F.array(*[
        F.struct(F.lit(a).alias("algorithm"), F.col(a).alias("best_redirect_matches")) for a in cfg.algorithms
    ])).alias("r")).select("n", "r.*")
    share = F.round(F.col("best_redirect_matches") / F.nullif("n", F.lit(0)) * 100, 2)
    # Prints 50.0%, 33.33%, and 0% when no row has a redirect.
    percentage = F.coalesce(F.concat(share.cast("string"), F.lit("%")), F.lit("0%"))
    return rows.select("algorithm", "best_redirect_matches", percentage.alias("percentage")).orderBy(
        F.desc("best_redirect_matches"), "algorithm")
