"""Nearest string by edit distance: a partition-based similarity join in rounds of growing distance.

In the round of distance k every target is cut into k + 1 segments. k edits leave one of them whole, and it then stands in the
query at most k places from where it was, so a query joins on its substrings at those places. A query is done when something has
been found within k; the rest goes to the next round, so the joins stay as selective as the distances allow.

* Segments are cut where texts of one length differ: each has the same share of the information (conditional entropy of the
  characters by place), so that a common host is one segment and not half of them.
* A pair meets only if its letter counts allow k edits: two words of bits, up to three of a letter, compared while it is formed.
* Postings are (key, index, bits), without text. Texts are fetched for what is left, and compared exactly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relinker.operators.spread import pair_grid, shared_rows, spread_join
from relinker.sources.stage import settle

ROUNDS = (3, 6, 12)
# Lengths of texts are few; a longer list of them is joined without a broadcast.
BROADCAST_LENGTHS = 10_000
# Letters counted, 21 to a word of 63 bits. Any choice is right, as what is not counted is not compared.
COUNTED = ("0123456789abcdefghijk", "lmnopqrstuvwxyz/-_.?=")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_bits(text: Column) -> list[Column]:
    """Two words: one, two or three bits for a letter that occurs once, twice or more often."""
    low = F.translate(text, UPPER, LOWER)

    def word(letters: str) -> Column:
        bits = F.lit(0).cast("bigint")
        for i, c in enumerate(letters):
            n = F.least(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))), F.lit(3))
            level = F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
            bits = bits.bitwiseOR(F.shiftleft(level, 3 * i))
        return bits
    return [word(x).alias(f"bits{i}") for i, x in enumerate(COUNTED)]


def _missing(side: str, other: str) -> Column:
    """Counted letters of one side that the other lacks; an edit removes one at most."""
    return sum(
        (F.bit_count(F.col(f"{side}{i}").bitwiseAND(F.bitwise_not(F.col(f"{other}{i}")))) for i in range(len(COUNTED))), F.lit(0))


def shape(targets: DataFrame) -> DataFrame:
    """(len, told): how much the places of the texts of one length tell up to each, given the character before it."""
    place = F.sequence(F.lit(1), F.length("t"))
    pairs = targets.where(F.length("t") > 0).select(F.length("t").alias("len"), F.explode(F.transform(place, lambda p: F.struct(
        p.alias("p"), F.substr("t", F.greatest(p - 1, F.lit(1)), F.least(p, F.lit(2))).alias("pair")))).alias("x")).select("len", "x.*")
    counted = pairs.groupBy("len", "p", "pair").agg(F.count("*").alias("n"))
    before = F.when(F.col("p") > 1, F.left("pair", F.lit(1))).otherwise(F.lit(""))
    first = counted.groupBy("len", "p", before.alias("first")).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    told = first.groupBy("len", "p").agg((F.sum(F.col("m") * F.log("m") - F.col("s")) / F.sum("m")).alias("h"))
    by_place = told.groupBy("len").agg(F.sort_array(F.collect_list(F.struct("p", "h")))["h"].alias("h"))
    sums = F.aggregate("h", F.array().cast("array<double>"), lambda got, h: F.concat(got, F.array(
        F.coalesce(F.try_element_at(got, F.lit(-1)), F.lit(0.0)) + F.greatest(h, F.lit(0.0)) + 0.001)))
    return by_place.select("len", sums.alias("told"))


def edges(k: int) -> Column:
    """Where the k + 1 segments (fewer in shorter texts) of equal shares of ``told`` begin, and the length at the end."""
    n = F.size("told")
    parts = F.least(F.lit(k + 1), n)

    def cut(j: Column) -> Column:
        below = F.size(F.filter("told", lambda s: s <= F.element_at("told", -1) * j / parts))
        return F.least(below, n - (parts - j))

    inner = F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), cut)).otherwise(F.array().cast("array<int>"))
    rising = F.aggregate(inner, F.array(F.lit(0)), lambda got, c: F.concat(got, F.array(F.greatest(F.element_at(got, -1) + 1, c))))
    return F.concat(rising, F.array(n))


def _key(length: Column, i: Column, text: Column) -> Column:
    return F.xxhash64(length, i, text)


def postings(targets: DataFrame, cuts: DataFrame) -> DataFrame:
    """(key, live_idx, t_bits0, t_bits1): one row per segment. ``targets`` have their length as ``len``."""
    e = F.col("edges")
    at = F.sequence(F.lit(0), F.size(e) - 2)
    keys = F.transform(at, lambda i: _key(F.col("len"), i, F.substr("t", F.get(e, i) + 1, F.get(e, i + 1) - F.get(e, i))))
    return targets.join(cuts, "len").select("live_idx", "t_bits0", "t_bits1", F.explode(keys).alias("key"))


def probes(queries: DataFrame, cuts: DataFrame, k: int) -> DataFrame:
    """(key, q, q_bits0, q_bits1): substrings of a query where a whole segment of a text of each near length can stand.

    The segment with as many edits before it as there are segments before it at most exists, and the same holds for what comes
    after it; that bounds its place from both ends. Texts of k or fewer characters fall into single characters, whose places
    are bounded by k alone.
    """
    e, n, length = F.col("edges"), F.length("q"), F.col("len")
    near = queries.withColumn("len", F.explode(F.sequence(F.greatest(n - k, F.lit(1)), n + k)))
    last = F.size(e) - 2

    def substrings(i: Column) -> Column:
        a, width = F.get(e, i), F.get(e, i + 1) - F.get(e, i)
        before = F.when(length > k, i).otherwise(F.lit(k))
        after = F.when(length > k, last - i).otherwise(F.lit(k))
        shift = F.when(length > k, n - length).otherwise(F.lit(0))
        low = F.greatest(F.lit(0), a - before, a + shift - after)
        high = F.least(n - width, a + before, a + shift + after)
        found = F.transform(F.sequence(low, F.greatest(low, high)), lambda x: _key(length, i, F.substr("q", x + 1, width)))
        return F.when(low <= high, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    keys = F.flatten(F.transform(F.sequence(F.lit(0), last), substrings))
    return near.join(cuts, "len").select("q", "q_bits0", "q_bits1", F.explode(keys).alias("key"))


def candidates(queries: DataFrame, targets: DataFrame, cuts: DataFrame, k: int, budget: int) -> DataFrame:
    """(q, live_idx) of every pair within k edits and some others; a pair may come more than once."""
    # Both are read twice, for the counts and for the join.
    asked, held = settle(probes(queries, cuts, k)), settle(postings(targets, cuts))
    grid = pair_grid(shared_rows(asked, held, "key"), "key", budget)
    return spread_join(asked, held, "key", "q", "live_idx", grid).where(
        (_missing("q_bits", "t_bits") <= k) & (_missing("t_bits", "q_bits") <= k)).select("q", "live_idx")


def nearest_edits(queries: DataFrame, targets: DataFrame, budget: int, rounds: tuple[int, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``queries(q)``, ``targets(t, live_idx, live_url)`` -> (found, rest); both sides hold distinct strings.

    ``found(q, distance, live_idx, live_url)`` holds the nearest target of each query, ties to the smallest ``live_idx``, where
    one lies within the last round's distance; a target of which no character is kept in place does not count. ``rest(q)`` holds
    the other queries.
    """
    def side(df: DataFrame, text: str, prefix: str) -> DataFrame:
        return df.select("*", *[b.alias(f"{prefix}_bits{i}") for i, b in enumerate(letter_bits(F.col(text)))])

    prepared = settle(side(targets.select("t", "live_idx", "live_url"), "t", "t").withColumn("len", F.length("t")))
    told = settle(shape(prepared))
    rest = settle(side(queries.select("q"), "q", "q"))
    few = told.count() <= BROADCAST_LENGTHS
    found = None
    for k in rounds:
        reached = rest.select(F.explode(F.sequence(F.greatest(F.length("q") - k, F.lit(1)), F.length("q") + k)).alias("len")).distinct()
        cuts = settle(told.join(reached, "len").select("len", edges(k).alias("edges")))
        cuts = F.broadcast(cuts) if few else cuts
        pairs = candidates(rest, prepared, cuts, k, budget).join(prepared.select("live_idx", "t", "live_url"), "live_idx")
        distance = F.call_function("levenshtein", F.col("q"), F.col("t"), F.lit(k))
        near = settle(
            pairs.select("q", distance.alias("distance"), "live_idx", "live_url").where("distance >= 0").groupBy("q")
            .agg(F.min(F.struct("distance", "live_idx", "live_url")).alias("best")).select("q", "best.*"))
        found = near if found is None else found.unionByName(near)
        rest = settle(rest.join(near, "q", "left_anti"))
        if rest.isEmpty():
            break
    return found, rest.select("q")
