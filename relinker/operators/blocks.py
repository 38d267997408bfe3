"""Searches in which every block of queries meets every block of targets.

Some measures have no keys that are rare enough for an equi-join on what two strings share: such a join makes about all pairs, and
moves a row for each. Here the rows that move are the blocks. Each meets the blocks of the other side in an equi-join on the
numbers of both, the pairs of two blocks are compared within a task, and the best target of a query is all that leaves it.

Where rows are long, as vectors are, the copies of the blocks for that join would be most of what is written, and grow with the
product of both sides. Such blocks are written once, a partition each, and read in pairs (a product of partitions, without a shuffle).
Where a vector is made of the words of a text, a block holds the texts, and each of its words once: what is known of a word moves to a
block and not to each of its rows, and vectors are made where two blocks meet.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from relinker.functions import blocks, urls
from relinker.operators.nearest import pick_best
from relinker.operators.spread import PAIR_TASKS, spread
from relinker.sources.stage import settle

# Rows of a block at most, of a block of vectors too, and of a block of queries at least, where there are enough of them.
QUERY_BLOCK, TARGET_BLOCK, VECTOR_BLOCK, LEAST_BLOCK = 16_384, 65_536, 16_384, 256


def _slice(key: str, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def _counts(queries: DataFrame, targets: DataFrame, target_block: int) -> tuple[int, int]:
    """How many blocks each side has."""
    n, m = queries.count(), targets.count()
    right_count = max(ceil(m / target_block), 1)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    enough = min(ceil(n / LEAST_BLOCK), ceil(PAIR_TASKS * cores / right_count))
    return max(ceil(n / QUERY_BLOCK), enough, 1), right_count


def _blocked(df: DataFrame, key: str, side: str, count: int, first: list[Column], columns: tuple[str, ...]) -> DataFrame:
    rows = df.select(_slice(key, count).alias(f"slice_{side}"), F.struct(*first, *columns).alias("row"))
    held = rows.groupBy(f"slice_{side}").agg(F.sort_array(F.collect_list("row"), asc=False).alias("b"))
    return held.select(f"slice_{side}", *[F.col(f"b.{c}").alias(f"{side}_{c}") for c in columns])


def best_in_blocks(queries: DataFrame, targets: DataFrame, nearest: Callable, query_columns: tuple[str, ...] = ("q",),
                   target_columns: tuple[str, ...] = ("t",), long: bool = False) -> DataFrame:
    """``queries(q, ..)``, ``targets(t, live_idx, live_url, ..)`` -> ``(q, score, live_idx, live_url)``; both sides hold distinct strings.

    ``nearest(query columns, target columns)`` gives the best score of each query of two blocks and the place of its target,
    ties to the first, or -1. Targets stand in the order in which ties are decided: the smallest ``live_idx`` first. Queries come
    in as many blocks as keep all cores busy, however many partitions a shuffle has: each more reads all targets once more.
    ``long`` rows are not copied.
    """
    # Both are read for their numbers, for the blocks and for what is found.
    queries = settle(queries.where("q is not null").select(*query_columns))
    targets = settle(targets.where("t is not null").select("live_idx", "live_url", *target_columns))
    # What the best of a block rules out need not be looked at in the rest of it, so blocks of short rows are large.
    left_count, right_count = _counts(queries, targets, min(TARGET_BLOCK, VECTOR_BLOCK) if long else TARGET_BLOCK)
    left = _blocked(queries, "q", "query", left_count, [], query_columns)
    right = _blocked(targets, "t", "target", right_count, [(-F.col("live_idx")).alias("order"), F.col("live_url")], target_columns)
    on = ["slice_query", "slice_target"]
    if long:
        left, right = settle(spread(left, on[0], into=left_count, ranged=True)), settle(spread(right, on[1], into=right_count, ranged=True))
        both = left.crossJoin(right.hint("shuffle_replicate_nl"))
    else:
        # Both sides are copied before the join, so that blocks move once. Tasks are as few as the blocks ask for: most of those that
        # a shuffle has by default would only start a Python worker.
        tasks = PAIR_TASKS * left_count * right_count
        left = spread(left.withColumn("slice_target", F.explode(F.sequence(F.lit(0), F.lit(right_count - 1)))), *on, into=tasks)
        right = spread(right.withColumn("slice_query", F.explode(F.sequence(F.lit(0), F.lit(left_count - 1)))), *on, into=tasks)
        both = left.join(right, on)
    return _compared(both.drop("slice_query", "slice_target"), targets, nearest, query_columns, target_columns)


def _compared(both: DataFrame, targets: DataFrame, nearest: Callable, query_columns: tuple[str, ...], target_columns: tuple[str, ...]) -> DataFrame:
    """The best target of each query over all pairs of blocks, a row each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a = {c: list(row[f"query_{c}"]) for c in query_columns}
                b = {c: list(row[f"target_{c}"]) for c in target_columns}
                score, place = nearest(a, b)
                hit = np.flatnonzero(place >= 0)
                # An empty column has no strings that Arrow would take it for.
                if len(hit):
                    yield pd.DataFrame({
                        "q": [a["q"][i] for i in hit], "t": [b["t"][i] for i in place[hit]], "score": score[hit]},
                        columns=["q", "t", "score"])

    found = both.mapInPandas(run, "q string, t string, score double")
    return pick_best(found.join(targets.select("t", "live_idx", "live_url"), "t"))


def best_in_texts(queries: DataFrame, targets: DataFrame, words: Callable[[Column], Column], lexicon: DataFrame, nearest: Callable) -> DataFrame:
    """``queries(q, text)``, ``targets(t, live_idx, live_url, text)``, ``lexicon(word, value)`` -> as ``best_in_blocks``.

    ``words`` gives the words of the column of texts. ``nearest(texts, words, values, texts, words, values)`` gets the texts of both
    blocks, each with those of its words that the lexicon has.
    """
    queries = settle(queries.where("q is not null").select("q", "text"))
    targets = settle(targets.where("t is not null").select("t", "live_idx", "live_url", "text"))
    left_count, right_count = _counts(queries, targets, min(TARGET_BLOCK, VECTOR_BLOCK))
    none = F.lit(None)
    rows = queries.select(
        F.lit("query").alias("side"), _slice("q", left_count).alias("slice"), none.cast("bigint").alias("order"),
        none.cast("string").alias("live_url"), F.col("q").alias("key"), "text",
    ).union(targets.select(
        F.lit("target").alias("side"), _slice("t", right_count).alias("slice"), (-F.col("live_idx")).alias("order"), "live_url", "t", "text"))
    # In few tasks, as each has the frequent words of all blocks once.
    tasks = PAIR_TASKS * queries.sparkSession.sparkContext.defaultParallelism
    entries = spread(rows, "text", into=tasks).select("side", "slice", F.explode(words(F.col("text"))).alias("word")).distinct().join(
        lexicon.select("word", "value"), "word")
    # A partition holds a block of each side at most, so that those of both sides are made and written at once.
    held = settle(
        rows.select("side", "slice", F.struct("order", "live_url", "key", "text").alias("row"))
        .unionByName(entries.select("side", "slice", F.struct("word", "value").alias("entry")), allowMissingColumns=True)
        .repartitionById(max(left_count, right_count), "slice").groupBy("side", "slice").agg(
            F.sort_array(F.collect_list("row"), asc=False).alias("b"), F.collect_list("entry").alias("e"))
        .select("side", "b.key", "b.text", "e.word", "e.value"))

    def side(name: str, key: str, count: int) -> DataFrame:
        mine = held.where(F.col("side") == name)
        # A single block is in one of the partitions; with the others the product would have as many tasks without a pair.
        return (mine.coalesce(1) if count == 1 else mine).select(
            F.col("key").alias(f"{name}_{key}"), *[F.col(c).alias(f"{name}_{c}") for c in ("text", "word", "value")])

    columns = ("text", "word", "value")
    return _compared(
        side("query", "q", left_count).crossJoin(side("target", "t", right_count).hint("shuffle_replicate_nl")), targets,
        lambda a, b: nearest(*[a[c] for c in columns], *[b[c] for c in columns]), ("q", *columns), ("t", *columns))


def best_strings(queries: DataFrame, targets: DataFrame, measure: str) -> DataFrame:
    """``queries(q)``, ``targets(t, live_idx, live_url)`` -> ``(q, score, live_idx, live_url)`` by a measure of ``functions.blocks``."""
    nearest = blocks.nearest
    return best_in_blocks(queries, targets, lambda a, b: nearest(measure, a["q"], b["t"]))


def best_sets(queries: DataFrame, targets: DataFrame, alpha: float, beta: float) -> DataFrame:
    """The same for sets of characters as strings, by ``functions.blocks.nearest_sets``."""
    nearest = blocks.nearest_sets
    return best_in_blocks(queries, targets, lambda a, b: nearest(a["q"], b["t"], alpha, beta))


def best_directions(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """The same for the inner product of vectors of one length, arrays ``v`` on both sides."""
    nearest = blocks.nearest_directions
    return best_in_blocks(queries, targets, lambda a, b: nearest(a["v"], b["v"]), ("q", "v"), ("t", "v"), long=True)


def best_grams(queries: DataFrame, targets: DataFrame, lexicon: DataFrame, low: int, high: int) -> DataFrame:
    """``best_in_texts`` by the cosine of the n-grams of the texts; ``value`` is the weight of an n-gram."""
    nearest, terms = blocks.nearest_vectors, blocks.unit_terms

    def compare(a, a_grams, a_weights, b, b_grams, b_weights):
        # Texts that stand together in their order have many n-grams in common.
        orders = [np.array(sorted(range(len(x)), key=x.__getitem__), np.int64) for x in (a, b)]
        return nearest(*terms(a, a_grams, a_weights, low, high), *terms(b, b_grams, b_weights, low, high), *orders)

    return best_in_texts(queries, targets, lambda text: urls.ngrams(text, low, high), lexicon, compare)


def best_means(queries: DataFrame, targets: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``best_in_texts`` by the cosine of the mean vectors of the words of the texts, a blank between two; ``value`` is the vector of a word."""
    nearest, means = blocks.nearest_directions, blocks.unit_means
    return best_in_texts(
        queries, targets, lambda text: urls.non_empty(F.split(text, " ")), lexicon,
        lambda a, a_words, a_vectors, b, b_words, b_vectors: nearest(means(a, a_words, a_vectors), means(b, b_words, b_vectors)))
