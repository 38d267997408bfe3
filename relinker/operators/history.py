"""Match history: rows to add, and the retention policy."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relinker.config import HUMAN_SCORE, Settings
from relinker.functions import urls
from relinker.operators import consensus
from relinker.operators.spread import spread_by_range
from relinker.sources.stage import settle
from relinker.sources.tables import normalise_source

def newest_first() -> list[Column]:
    """Total order of history rows: by time, then by content, so that a cut is always the same."""
    rest = ("url_404", "redirect_url", "agreement_score", "total_score", "algorithm", "source")
    return [F.desc("timestamp"), *[F.asc(c) for c in rest]]


def auto_rows(votes: DataFrame, run_at: Column | None = None, cfg: Settings = Settings()) -> DataFrame:
    """One row per nomination of the broken URLs with enough agreement."""
    agreed = consensus.consensus(votes, cfg).where(F.col("agreement") >= cfg.agreement_threshold)
    at = F.current_timestamp() if run_at is None else run_at
    return consensus.candidates(votes, cfg).drop("votes", "tot").join(agreed, "url_404").select(
        at.alias("timestamp"), "url_404", F.col("match_url").alias("redirect_url"),
        F.col("agreement").alias("agreement_score"), F.col("tot_score").alias("total_score"), "algorithm",
        (F.col("match_url") == F.col("best_redirect")).alias("is_best_match"), F.lit("auto").alias("source"))


def human_rows(pairs: DataFrame, run_at: Column | None = None) -> DataFrame:
    """History rows of verified pairs ``(url_404, live_url)``; invalid pairs go, duplicates stay."""
    at = F.current_timestamp() if run_at is None else run_at
    valid = (F.col("url_404") != "") & (F.col("live_url") != "")
    return pairs.where(valid).select(
        at.alias("timestamp"), "url_404", F.col("live_url").alias("redirect_url"),
        F.lit(HUMAN_SCORE).cast("bigint").alias("agreement_score"), F.lit(float(HUMAN_SCORE)).alias("total_score"),
        F.lit("human").alias("algorithm"), F.lit(True).alias("is_best_match"), F.lit("human").alias("source"))


def add_rows(history: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name. A column that either side lacks is filled with its neutral value."""
    both = history.unionByName(new, allowMissingColumns=True)
    neutral = {"agreement_score": 0, "total_score": 0.0, "is_best_match": False, "source": "auto"}
    for c, value in neutral.items():
        lacking = (c not in history.columns) or (c not in new.columns)
        if lacking and c in both.columns:
            both = both.fillna({c: value})
    return both


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the 1-based position in a total order, without sorting everything in one task.

    Rows are range-partitioned by the order and counted per partition; a row's position is its
    number within the partition plus the rows of the partitions before it.
    """
    placed = settle(spread_by_range(df, *order).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    # One row per partition.
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    w = Window.partitionBy("part").orderBy(*order)
    return placed.join(F.broadcast(before), "part").withColumn(
        name, F.row_number().over(w) + F.col("before")).drop("part", "before")


def newest(df: DataFrame, n: int) -> DataFrame:
    return numbered(df, newest_first()).where(F.col("position") <= n).drop("position")


def newest_per_language(df: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each language, with a ``language`` column.

    One language may own most rows, so the rank is taken from the position in one distributed
    order by language and time; there are at most 677 language tags.
    """
    tagged = df.withColumn("language", urls.url_language("url_404"))
    placed = numbered(tagged, [F.asc("language"), *newest_first()])
    starts = placed.groupBy("language").agg(F.min("position").alias("start"))
    return placed.join(F.broadcast(starts), "language").where(
        F.col("position") - F.col("start") < n).drop("position", "start")


def retain(history: DataFrame, limit: int | None = None, cfg: Settings = Settings()) -> DataFrame:
    """Cuts a history that has grown over the limit; a shorter one is returned as it is.

    Without a limit, given or in the settings, nothing is cut. Verified rows always stay. What room is left goes to rows with high agreement, newest first,
    and then to the newest rows of each language in equal shares.
    """
    limit = cfg.max_history_size if limit is None else limit
    if limit is None:
        return history
    size = history.count()
    if size <= limit:
        return history
    rows = normalise_source(history).withColumns({
        "timestamp": F.expr("try_cast(timestamp AS timestamp)"),
        "agreement_score": F.expr("try_cast(agreement_score AS bigint)"),
    }).where(F.col("timestamp").isNotNull())
    human = F.col("source") == "human"
    high = ~human & F.coalesce(F.col("agreement_score") >= cfg.high_confidence_threshold, F.lit(False))
    language = urls.url_language("url_404")
    n = rows.agg(
        F.count_if(human).alias("human"), F.count_if(~human).alias("auto"), F.count_if(high).alias("high"),
        F.count_distinct(F.when(~human & ~high, language)).alias("languages"),
    ).first()
    room = limit - n["human"]
    kept = rows.where(human)
    if room <= 0:
        return kept
    if n["auto"] <= room:
        return rows
    if n["high"] >= room:
        return kept.unionByName(newest(rows.where(high), room))
    kept = kept.unionByName(rows.where(high))
    room -= n["high"]
    others = newest_per_language(rows.where(~human & ~high), max(1, room // n["languages"]))
    if n["languages"] > room:
        # One row each and still too many: the first languages by name.
        ranks = others.select("language").distinct().withColumn(
            "place", F.row_number().over(Window.orderBy("language")))
        others = others.join(F.broadcast(ranks), "language").where(F.col("place") <= room).drop("place")
    return kept.unionByName(others.drop("language"))
