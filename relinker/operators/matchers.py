"""The character-level matchers: each nominates one live URL per broken URL.

None has keys that are rare enough for a join: all meet in blocks (``blocks.best_strings``, ``blocks.best_sets``).

Common contract: ``(broken(url, idx), live(url, live_idx), cfg)`` ->
``votes(url_404, algo, match_url, score, match_idx)``, one row per broken URL. With no live URL at
all there are no votes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relinker.config import Settings
from relinker.functions import urls
from relinker.functions.blocks import FAR
from relinker.operators.blocks import best_sets, best_strings


def votes(broken: DataFrame, algo: str, url: str, score: str, idx: str) -> DataFrame:
    return broken.select(
        F.col("url").alias("url_404"), F.lit(algo).alias("algo"), F.col(url).alias("match_url"),
        F.col(score).cast("double").alias("score"), F.col(idx).cast("bigint").alias("match_idx"))


def first_live(live: DataFrame) -> Column:
    """The live URL at the smallest position, as a one-row subquery."""
    return live.select(F.min(F.struct(F.col("live_idx"), F.col("url").alias("live_url"))).alias("f")).scalar()


# ---- sets of characters ---------------------------------------------------------------------

def _match_sets(broken: DataFrame, live: DataFrame, algo: str, alpha: float, beta: float) -> DataFrame:
    """Scores distinct character sets only; a set stands for all its URLs by the first of them."""
    left = broken.withColumn("q", urls.char_set_text("url"))
    targets = live.groupBy(urls.char_set_text("url").alias("t")).agg(
        F.min(F.struct("live_idx", "url")).alias("f")).select("t", "f.live_idx", F.col("f.url").alias("live_url"))
    best = best_sets(left.select("q").distinct(), targets.where("live_idx is not null"), alpha, beta)
    first = first_live(live)
    # Nothing in common with any live URL: score 0, and the first live URL is nominated.
    out = left.join(best, "q", "left").withColumn("first", first).where(F.col("first").isNotNull())
    return votes(
        out.select("url", F.coalesce("live_url", "first.live_url").alias("u"),
                   F.coalesce("score", F.lit(0.0)).alias("s"), F.coalesce("live_idx", "first.live_idx").alias("i")),
        algo, "u", "s", "i")


def jaccard(broken: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return _match_sets(broken, live, "jaccard", 1.0, 1.0)


def tversky(broken: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return _match_sets(broken, live, "tversky", cfg.tversky_alpha, cfg.tversky_beta)


# ---- whole strings --------------------------------------------------------------------------

def _match_strings(broken: DataFrame, live: DataFrame, measure: str) -> DataFrame:
    targets = live.select(F.col("url").alias("t"), "live_idx", F.col("url").alias("live_url"))
    best = best_strings(broken.select(F.col("url").alias("q")), targets, measure)
    return _with_blanks(broken.withColumn("q", F.col("url")), best, live, measure)


def _with_blanks(left: DataFrame, best: DataFrame, live: DataFrame, algo: str, scale: float = 1.0) -> DataFrame:
    """Broken URLs without a positive score get a NULL nomination with score 0."""
    hit = F.col("score") > 0
    out = left.join(best, "q", "left").where(first_live(live).isNotNull())
    return votes(
        out.select("url", F.when(hit, F.col("live_url")).alias("u"),
                   F.when(hit, F.col("score") / scale).otherwise(F.lit(0.0)).alias("s"),
                   F.when(hit, F.col("live_idx")).alias("i")),
        algo, "u", "s", "i")


def levenshtein(broken: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Arg-min of the raw edit distance, reported as 1 - distance / longer length; always votes.

    A live URL without a common character is at distance max(length, length). What it can win
    depends on its length only, so the best of those comes from a per-length table.
    """
    targets = live.where("live_idx is not null").select(F.col("url").alias("t"), "live_idx", F.col("url").alias("live_url"))
    found = best_strings(broken.select(F.col("url").alias("q")), targets, "levenshtein")
    best = found.select("q", (F.col("score") - FAR).alias("score"), "live_idx", "live_url")

    by_length = live.groupBy(F.length("url").alias("len")).agg(F.min(F.struct("live_idx", "url")).alias("f"))
    lengths = by_length.select(F.collect_list(F.struct(
        "len", F.col("f.live_idx").alias("live_idx"), F.col("f.url").alias("live_url"))).alias("ls")).scalar()
    n = F.length("url")
    strangers = F.transform(F.col("ls"), lambda x: F.struct(
        (-F.greatest(x["len"], n)).cast("double").alias("score"), (-x["live_idx"]).alias("order"),
        x["live_url"].alias("live_url")))
    out = (
        broken.withColumn("q", F.col("url")).withColumn("ls", lengths).where(F.size("ls") > 0)
        .withColumn("stranger", F.array_max(strangers))
        .join(best, "q", "left")
        .withColumn("best", F.greatest("stranger", F.when(F.col("score").isNotNull(), F.struct(
            "score", (-F.col("live_idx")).alias("order"), "live_url"))))
    )
    longer = F.greatest(n, F.length("best.live_url"))
    return votes(
        out.select("url", F.col("best.live_url").alias("u"), (-F.col("best.order")).alias("i"),
                   F.when(longer > 0, 1 + F.col("best.score") / longer).otherwise(F.lit(1.0)).alias("s")),
        "levenshtein", "u", "s", "i")


def ratcliff(broken: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return _match_strings(broken, live, "ratcliff")


def fuzzy(broken: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Token-sort ratio. Only distinct token-sort keys are compared."""
    left = broken.withColumn("q", urls.token_sort_key("url"))
    targets = live.groupBy(urls.token_sort_key("url").alias("t")).agg(
        F.min(F.struct("live_idx", "url")).alias("f")).select("t", "f.live_idx", F.col("f.url").alias("live_url"))
    best = best_strings(left.select("q").distinct(), targets, "fuzzy")
    return _with_blanks(left, best, live, "fuzzy", scale=100.0)


def hamming(broken: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return _match_strings(broken, live, "hamming")


def jaro_winkler(broken: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return _match_strings(broken, live, "jaro_winkler")
