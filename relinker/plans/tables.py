"""Input tables of the mapping run, derived from the parquet files of a data folder.

* ``page_checks``: the check log; an event of user u is a check of page u.
* ``broken`` / ``live``: pages whose check, or the retry of a problematic check, failed, and all other pages.
* ``match_history``: one past nomination per event, from page (event id) to page (user id).
* ``token_vectors``, ``page_topics``: vectors and topics given from outside.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relinker.config import Settings
from relinker.functions import urls
from relinker.operators import checks
from relinker.sources import tables
from relinker.sources.stage import settle


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_urls(spark: SparkSession, sf_dir: str, cfg: Settings = Settings()) -> DataFrame:
    return tables.prepare_urls(read(spark, sf_dir, "pages"), "url", F.col("page_id"), cfg.clean)


def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kind = F.col("event_type")
    code = (
        F.when(kind == "signup", 404).when(kind == "purchase", 503)
        .when(kind == "click", 301).when(kind == "view", 200)
    )
    moved = F.concat(F.lit("https://"), F.regexp_replace("url", "^https?://", ""))

    def hop(url, status, location):
        return F.struct(url.alias("url"), status.cast("int").alias("status"), location.cast("string").alias("location"))

    nothing = F.lit(None)
    hops = (
        F.when(kind == "error", F.array().cast("array<struct<url:string,status:int,location:string>>"))
        .when(kind == "click", F.array(hop(F.col("url"), code, moved), hop(moved, F.lit(200), nothing)))
        .otherwise(F.array(hop(F.col("url"), code, nothing)))
    )
    return pages.join(events, F.col("page_id") == F.col("user_id")).select(
        "url", F.col("event_id").alias("attempt"),
        F.coalesce(code.cast("string"), F.lit("httpx error")).alias("status"), hops.alias("hops"),
    )


def broken_and_live(spark: SparkSession, sf_dir: str, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    log = page_checks(spark, sf_dir).select("url", "attempt", "status")
    # A first check that was a problem is replaced by its retry before anything is called broken.
    overlay = checks.retry_overlay(log, cfg).select("url", "status")
    status = settle(page_urls(spark, sf_dir, cfg).join(overlay, "url", "left"))
    failed = checks.is_broken(F.col("status"), cfg)
    broken = status.where(failed).select("url", "idx")
    live = status.where(~failed).select("url", F.col("idx").alias("live_idx"))
    return broken, live


def match_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    events = read(spark, sf_dir, "events")
    source = pages.select(F.col("page_id").alias("event_page"), F.col("url").alias("url_404"))
    target = pages.select(F.col("page_id").alias("user_page"), F.col("url").alias("redirect_url"))
    agreement = F.floor(F.col("value")).cast("bigint") % 12
    return (
        events.join(target, F.col("user_id") == F.col("user_page"))
        .join(source, F.floor(F.col("event_id") / 40) == F.col("event_page"))
        .select(
            F.col("ts").alias("timestamp"), "url_404", "redirect_url",
            agreement.alias("agreement_score"), F.col("value").alias("total_score"),
            F.lit("levenshtein").alias("algorithm"), (agreement >= 8).alias("is_best_match"),
            F.when(F.col("event_type") == "signup", "human").otherwise("auto").alias("source"),
        )
    )


def token_vectors(spark: SparkSession, sf_dir: str, tokens: DataFrame) -> DataFrame:
    """Vector of each token: the embedding row that the token's digest points at."""
    # As they are held: doubles would take twice the room.
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = read(spark, sf_dir, "embeddings").select(F.count("*").alias("n")).scalar()
    slot = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint") % n
    return tokens.withColumn("vec_id", slot).join(vectors, "vec_id").select("token", "vector")


def page_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic per page from its language tag, with the host's share of the URL as probability."""
    url = F.col("url")
    return page_urls(spark, sf_dir).select(
        "url", (F.ascii(urls.url_language(url)) % 4).cast("int").alias("topic"),
        (F.length(urls.url_host(url)) / F.length(url)).alias("prob"),
    )
