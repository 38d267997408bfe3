"""Helpers shared by the operators of this package."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from relinker.sources.stage import settle, shared_folder

# Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# A table with at most this many rows of a few plain columns (below 2 MB) may be broadcast.
BROADCAST_ROWS = 10_000


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of the session."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, keeps columns readable one by one."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hints a broadcast where the counted rows are few; otherwise the join shuffles and may split skewed keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def through_pandas(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInPandas`` that hands columns on as they are: whole numbers travel as text.

    pandas turns whole numbers into doubles where one of a batch is null, and those beyond 2^53 into others. Columns of the result
    named as whole-number columns of ``df`` are expected as text, too. What a task held is returned to the system when it ends.
    """
    def freed(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    whole = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, IntegralType)}
    given = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in whole else F.col(f"`{c}`") for c in df.columns])
    out = StructType.fromDDL(schema)
    text = StructType([StructField(f.name, StringType() if f.name in whole else f.dataType) for f in out.fields])
    found = given.mapInPandas(freed, text)
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in whole else F.col(f"`{f.name}`") for f in out.fields])


def give_back() -> None:
    """Returns freed memory to the system at the end of a task, as Python workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Other C libraries have no such call.
        pass


def portions(batches: Iterator[pd.DataFrame], column: str, characters: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Parts of batches of about so many characters, so that what is made of long texts stays small in memory."""
    for batch in batches:
        ends = np.cumsum([len(t) if isinstance(t, str) else 0 for t in batch[column]])
        cut = np.flatnonzero(np.diff(ends // characters)) + 1
        for a, b in zip([0, *cut], [*cut, len(batch)], strict=True):
            if b > a:
                yield batch.iloc[a:b]


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def running_start(df: DataFrame, key: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the same key, as ``name``.

    Rows come in the order of (bucket, order). Only totals of buckets are summed in one window per key; rows are
    summed within their bucket, so a key with a third of all rows is spread over its buckets.
    """
    from pyspark.sql import Window

    totals = df.groupBy(*key, bucket).agg(F.sum(value).alias("_total"))
    by_key = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    before = totals.withColumn(
        "_before", F.coalesce(F.sum("_total").over(by_key.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(before.drop("_total"), [*key, bucket])
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_before"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root); root is some node of the component.

    Every round maps each node to the neighbour with the least hash (or itself) and contracts the edges, so the
    number of rounds grows with the logarithm of the longest chain. Edges, nodes and rounds stay on the cluster;
    the driver sees one count per round. Nodes without edges do not appear.
    """
    # Rounds are cut by written tables: a checkpoint would carry the constraints of its plan into every later round.
    pairs = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "edges")
    # `up` maps the nodes seen so far to nodes of the contracted graph.
    up = None
    salt = 0
    while not pairs.isEmpty():
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("n"))
        least = written(
            both.groupBy("a").agg(F.min(rank("b")).alias("other"))
            .select(F.col("a").alias("node"), F.least(rank("a"), "other")["n"].alias("to")), "least")
        moved = (
            pairs.join(least.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(least.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b"))
        # The edge from a node to its new name stays an edge of the contracted graph, as its ends are mapped too.
        pairs = written(
            moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a != b").distinct(), "edges")
        if up is None:
            up = least.select("node", F.col("to").alias("root"))
        else:
            step = least.select(F.col("node").alias("root"), F.col("to"))
            up = up.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        up = written(up, "roots")
        salt += 1
    if up is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).where(F.lit(False))
    return up
