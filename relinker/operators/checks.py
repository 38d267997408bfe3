"""Evaluation of the URL check log: effective status, retries, and which URLs stay in the run.

``checks(url, attempt, status, hops)`` is a log, so a busy URL may own a large share of it. Every
per-URL step is therefore a min/max aggregate, which combines before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relinker.config import Settings


def effective_status(hops: Column, url: Column, follow: bool = True) -> Column:
    """Status of the last response, or of the response for the URL itself; 200 if there is none."""
    own = F.try_element_at(F.filter(hops, lambda h: h["url"] == url), F.lit(1))
    last = F.try_element_at(hops, F.lit(-1))
    return F.coalesce((last if follow else own)["status"], F.lit(200))


def redirect_hops(hops: Column) -> Column:
    return F.filter(hops, lambda h: (h["status"] >= 300) & (h["status"] < 400))


def check_status(checks: DataFrame) -> DataFrame:
    hops, url = F.col("hops"), F.col("url")
    return checks.select(
        "url", "attempt",
        effective_status(hops, url, True).alias("status_followed"),
        effective_status(hops, url, False).alias("status_own"),
    )


def redirect_chains(checks: DataFrame) -> DataFrame:
    hops = redirect_hops(F.col("hops"))
    return checks.select(
        "url", "attempt", F.size(hops).alias("n_redirects"),
        F.array_join(F.transform(hops, lambda h: F.concat_ws(" ", h["status"], h["location"])), " > ").alias("chain"),
    )


def last_status(checks: DataFrame) -> DataFrame:
    return checks.groupBy("url").agg(F.max_by("status", "attempt").alias("status"))


def attach_status(urls: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds ``status`` (and ``status_code`` where it is a number); the last result of a URL wins."""
    return urls.join(last_status(checks), "url", "left").withColumn(
        "status_code", F.expr("try_cast(status AS int)"))


def is_problem(status: Column, cfg: Settings) -> Column:
    return status.isin(*cfg.problem_statuses, *cfg.failed_labels)


def problem_checks(checks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return checks.where(is_problem(F.col("status"), cfg))


def retry_overlay(checks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """First result per URL, replaced by the latest retry where the first one was a problem."""
    per_url = checks.groupBy("url").agg(
        F.min_by("status", "attempt").alias("first_status"),
        F.max_by("status", "attempt").alias("latest_status"),
    )
    return per_url.select(
        "url", "first_status",
        F.when(is_problem(F.col("first_status"), cfg), F.col("latest_status"))
        .otherwise(F.col("first_status")).alias("status"),
    )


def is_broken(status: Column, cfg: Settings = Settings()) -> Column:
    return F.coalesce((status == "404") | status.isin(*cfg.failed_labels), F.lit(False))


def broken_only(with_status: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    if not cfg.use_404check:
        return with_status
    return with_status.where(is_broken(F.col("status"), cfg))
