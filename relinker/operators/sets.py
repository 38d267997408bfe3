"""Most similar character set, for any ratio model c / (c + alpha (a - c) + beta (b - c)), in rounds of falling thresholds.

c is the number of characters that sets of a and b characters share. A score of f needs a certain c for each pair of sizes, so two
sets that reach it share one of the a - c + 1 rarest characters of one and of the b - c + 1 rarest of the other, in one order
of all characters. Both sides join on those prefixes, with the size of the target in the key. Sets are two words of bits as well:
whether a pair shares enough is counted while it is formed. A query is done once its best score reaches the threshold of a round.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from relinker.functions import urls
from relinker.operators.spread import pair_grid, shared_rows, spread_join
from relinker.sources.stage import settle

ROUNDS = (0.9, 0.75, 0.5, 0.0)
EPS = 1e-9
# Bits of both words; rarer characters of a larger alphabet share bits, which only lets more pairs through.
WORD = 63
# Sizes of sets are few; a longer list of them is joined without a broadcast.
BROADCAST_SIZES = 10_000


def rarity(targets: DataFrame) -> Column:
    """All characters of the target sets, the rarest first, as one string (its length is bounded by the alphabet)."""
    counted = targets.select(F.explode(urls.chars("t")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return counted.select(F.array_join(F.sort_array(F.collect_list(F.struct("n", "c")))["c"], "").alias("order")).scalar()


def needed(a: Column, b: Column, threshold: float, alpha: float, beta: float) -> Column:
    """Least number of shared characters with which sets of a and b characters reach a threshold."""
    share = threshold * (alpha * a + beta * b) / (1 - threshold + threshold * (alpha + beta))
    return F.greatest(F.ceil(share - EPS), F.lit(1)).cast("int")


def prepared(sets: DataFrame, text: str, order: Column, prefix: str) -> DataFrame:
    """Adds the size, the characters in order of rarity (those of no target first) and the bits of a set."""
    placed = F.sort_array(F.transform(urls.chars(text), lambda c: F.struct(F.call_function("locate", c, F.col("order")).alias("at"), c.alias("c"))))

    def bits(word: int) -> Column:
        slot = lambda x: F.pmod(x["at"] - 1, F.lit(2 * WORD))
        mine = F.filter(F.col("placed"), lambda x: (x["at"] > 0) & (F.floor(slot(x) / WORD) == word))
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda got, x: got.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot(x), F.lit(WORD)).cast("int"))))

    # The order is read once a row, not once a character.
    return (
        sets.withColumn("order", order).withColumn("placed", F.when(F.col("order").isNotNull(), placed)).withColumns({
            f"{prefix}_size": F.length(text), f"{prefix}_bits0": bits(0), f"{prefix}_bits1": bits(1)})
        .withColumn(f"{prefix}_unknown", F.size(F.filter("placed", lambda x: x["at"] == 0))).drop("order"))


def probes(queries: DataFrame, largest: int, threshold: float, alpha: float, beta: float) -> DataFrame:
    """(key, b, need, q, ...): the rarest characters of a query for each size that can reach the threshold."""
    a, b = F.col("q_size"), F.col("b")
    sized = queries.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(largest)))).withColumn(
        "need", needed(a, b, threshold, alpha, beta)).where(F.col("need") <= F.least(a, b))
    rarest = F.filter(F.slice("placed", F.lit(1), a - F.col("need") + 1), lambda x: x["at"] > 0)
    return sized.select(
        "q", "q_size", "q_unknown", "q_bits0", "q_bits1", "b", "need", F.explode(F.transform(rarest, lambda x: F.xxhash64(b, x["c"]))).alias("key"))


def postings(targets: DataFrame, limits: DataFrame) -> DataFrame:
    """(key, live_idx, pos, t_size, bits): the rarest characters of a target, as many as any query asks for at its size."""
    return targets.join(limits, F.col("t_size") == F.col("b")).select(
        "live_idx", "t_size", "t_bits0", "t_bits1", F.posexplode(F.transform(
            F.slice("placed", F.lit(1), F.col("most")), lambda x: F.xxhash64(F.col("t_size"), x["c"]))).alias("pos", "key"))


def candidates(queries: DataFrame, targets: DataFrame, largest: int, threshold: float, alpha: float, beta: float, budget: int) -> DataFrame:
    """(q, live_idx) of all pairs that reach the threshold, and of hardly any others; a pair may come more than once."""
    asked = settle(probes(queries, largest, threshold, alpha, beta))
    limits = settle(asked.groupBy("b").agg(F.max(F.col("b") - F.col("need") + 1).alias("most")))
    limits = F.broadcast(limits) if largest <= BROADCAST_SIZES else limits
    held = settle(postings(targets, limits))
    grid = pair_grid(shared_rows(asked, held, "key"), "key", budget)

    def missing(one: str, other: str) -> Column:
        return sum((F.bit_count(F.col(f"{one}_bits{i}").bitwiseAND(F.bitwise_not(F.col(f"{other}_bits{i}")))) for i in range(2)), F.lit(0))

    shared = F.least(F.col("q_size") - F.col("q_unknown") - missing("q", "t"), F.col("t_size") - missing("t", "q"))
    return spread_join(asked, held, "key", "q", "live_idx", grid).where(
        (F.col("pos") <= F.col("t_size") - F.col("need")) & (shared >= F.col("need"))).select("q", "live_idx")


def nearest_sets(queries: DataFrame, targets: DataFrame, score: Callable[[Column, Column], Column], alpha: float, beta: float,
                 budget: int, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """``queries(q)``, ``targets(t, live_idx, live_url)`` -> ``(q, score, live_idx, live_url)``; ties to the smallest ``live_idx``.

    Both sides hold distinct sets as strings. Queries that share no character with any target are absent.
    """
    order = rarity(targets)
    held = settle(prepared(targets.where(F.length("t") > 0), "t", order, "t"))
    rest = settle(prepared(queries, "q", order, "q"))
    largest = held.agg(F.max("t_size")).first()[0]
    found = held.select(F.col("t").alias("q"), F.lit(0.0).alias("score"), "live_idx", "live_url").where("false")
    if largest is None:
        return found
    for threshold in rounds:
        pairs = candidates(rest, held, largest, threshold, alpha, beta, budget).join(held.select("live_idx", "t", "live_url"), "live_idx")
        near = settle(
            pairs.select("q", score(F.col("q"), F.col("t")).alias("score"), "live_idx", "live_url")
            .where(F.col("score") >= threshold - EPS).groupBy("q")
            .agg(F.max(F.struct("score", (-F.col("live_idx")).alias("order"), "live_url")).alias("best"))
            .select("q", "best.score", (-F.col("best.order")).alias("live_idx"), "best.live_url"))
        found = found.unionByName(near)
        rest = settle(rest.join(near.select("q"), "q", "left_anti"))
        if rest.isEmpty():
            break
    return found
