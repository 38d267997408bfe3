"""Equi-joins whose work must be spread over the whole cluster."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relinker.sources.stage import settle

# Tasks per configured shuffle partition where pairs are scored: work per key is uneven.
PAIR_TASKS = 3
# A list of split keys with at most this many rows is broadcast (below 1 MB); a longer one is joined by key and salt.
BROADCAST_KEYS = 10_000
SALTS = 32


def spread(df: DataFrame, *keys: str, times: int = 1, into: int | None = None, ranged: bool = False) -> DataFrame:
    """Hash-partitions by ``keys`` with a fixed number of partitions, ``into`` where it is given.

    The rows are short and the work per row is long, so partitions must not be merged by size, as
    adaptive execution does with partitions it made itself. ``ranged``, as many rows with a key each as there are partitions
    are a partition each.
    """
    count = into or times * partitions(df)
    return df.repartitionByRange(count, *keys) if ranged else df.repartition(count, *keys)


def spread_by_range(df: DataFrame, *order) -> DataFrame:
    return df.repartitionByRange(partitions(df), *order)


def partitions(df: DataFrame) -> int:
    session = df.sparkSession
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)


def pair_grid(shared: DataFrame, key: str, budget: int) -> DataFrame:
    """Slices of both sides for the keys of ``shared(key, left_rows, right_rows)`` that make more than ``budget`` pairs.

    A slice of the left side meets each slice of the right side in one group. Only the larger side is cut where that is enough;
    where both sides are long, both are cut to the root of the budget.
    """
    left, right = F.col("left_rows"), F.col("right_rows")
    side = budget ** 0.5

    def slices(own: Column, other: Column) -> Column:
        rows = F.when(own <= side, own).when(other <= side, budget / other).otherwise(F.lit(side))
        return F.ceil(own / rows).cast("int")

    return shared.where(left * right > budget).select(key, slices(left, right).alias("n_left"), slices(right, left).alias("n_right"))


def spread_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, grid: DataFrame) -> DataFrame:
    """Inner equi-join in which the pairs of a key that makes too many are cut into a grid of smaller groups.

    Rows of such a key fall into one of n slices of their own side and are copied to each slice of the other side, so each
    pair still meets exactly once. Other keys keep a single group. How many keys are split is counted before it is decided how
    the rows learn of it: by a broadcast, or by a join in which the rows of one key are dealt over ``SALTS`` copies of it.
    """
    grid = settle(grid)
    few = grid.count() <= BROADCAST_KEYS

    def side(df: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        if few:
            sliced = df.join(F.broadcast(grid), key, "left")
        else:
            salted = grid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            dealt = df.withColumn("salt", F.pmod(F.xxhash64(F.col(row_id), F.lit(1)), F.lit(SALTS)).cast("int"))
            sliced = dealt.join(salted, [key, "salt"], "left").drop("salt")
        count = {c: F.coalesce(f"n_{c}", F.lit(1)) for c in (own, other)}
        return (
            sliced.withColumn(f"slice_{own}", F.pmod(F.xxhash64(row_id), count[own]).cast("int"))
            .withColumn(f"slice_{other}", F.explode(F.sequence(F.lit(0), count[other] - 1)))
            .drop("n_left", "n_right")
        )

    on = [key, "slice_left", "slice_right"]
    l = spread(side(left, left_id, "left", "right"), *on, times=PAIR_TASKS)
    r = spread(side(right, right_id, "right", "left"), *on, times=PAIR_TASKS)
    return l.join(r, on).drop("slice_left", "slice_right")


def shared_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_rows, right_rows) of the keys that both sides have."""
    return left.groupBy(key).agg(F.count("*").alias("left_rows")).join(right.groupBy(key).agg(F.count("*").alias("right_rows")), key)
