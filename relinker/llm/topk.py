"""Exact top-k search by inner product: a three-phase uniform threshold over lists of partial scores."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from relinker.llm.common import settle

# Scale of the components, results of a query, which rows are queries.
SCALE = 1024
RESULTS = 10
QUERY_EVERY = 100

PARTS = 2
GROUP_ROWS = 4096
QUERY_ROWS = 512
#: Scaled components are held to this size, partial and whole scores to ``LARGEST_SCORE``; all below is exact.
LARGEST = 1 << 53
LARGEST_SCORE = 1 << 61


def usable(embedding: Column | str) -> Column:
    """Not null, without null or non-finite components."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    return e.isNotNull() & ~F.coalesce(F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def scaled(embedding: Column | str) -> Column:
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    most = F.lit(float(LARGEST))
    return F.transform(e, lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * SCALE))).cast("bigint"))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(rep, code, ids): each distinct vector with its ``most`` least ids; later copies can be no one's result."""
    least = Window.partitionBy("code").orderBy("vec_id")
    first = rows.dropDuplicates(["vec_id", "code"]).withColumn("place", F.row_number().over(least)).where(F.col("place") <= most)
    return first.groupBy("code").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("rep", "code", "ids")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _products(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Integer inner products of two lists of vectors; doubles are used where they are exact. Short vectors end in zeros."""
    width = max([len(v) for v in a] + [len(v) for v in b], default=0)
    x, y = _matrix(a, width), _matrix(b, width)
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(width, 1)
    if bound < 2.0**53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    out = x @ y.T
    if bound >= LARGEST_SCORE:
        # Sums that may not fit in 64 bits, one by one in whole numbers of any length.
        wide = np.abs(x).astype(np.float64) @ np.abs(y).astype(np.float64).T >= LARGEST_SCORE / 2
        for i, j in np.argwhere(wide):
            exact = sum(int(p) * int(q) for p, q in zip(x[i], y[j]))
            out[i, j] = max(-LARGEST_SCORE, min(LARGEST_SCORE, exact))
    return out


def _local_lists(k: int):
    """A node (one part of the components of one group of vectors) sends the k best entries of each query's list."""
    def node(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "rep": [], "part": [], "partial": []})
        partial = _products(queries["slice"], vectors["slice"])
        n = min(k, partial.shape[1])
        best = np.argpartition(-partial, n - 1, axis=1)[:, :n]
        reps = vectors["rep"].to_numpy()
        return pd.DataFrame({
            "query_id": np.repeat(queries["query_id"].to_numpy(), n), "rep": reps[best].ravel(), "part": int(key[0]),
            "partial": np.take_along_axis(partial, best, axis=1).ravel()})
    return node


def _above_cutoff(parts: int):
    """A node sends all entries that reach the cutoff; ``cutoff`` is that of whole scores, null where nothing may be left out."""
    def node(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "rep": [], "partial": []})
        partial = _products(queries["slice"], vectors["slice"])
        cutoff = queries["cutoff"].astype("Float64").fillna(-2.0**62).to_numpy(np.float64).astype(np.int64)
        q, v = np.nonzero(partial * parts >= cutoff[:, None])
        return pd.DataFrame({
            "query_id": queries["query_id"].to_numpy()[q], "rep": vectors["rep"].to_numpy()[v], "partial": partial[q, v]})
    return node


def _slices(code: str, parts: int) -> Column:
    """The parts of a vector: (number, components)."""
    n = F.size(code)
    return F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.slice(code, F.floor(n * p / parts).cast("int") + 1, (F.floor(n * (p + 1) / parts) - F.floor(n * p / parts)).cast("int")).alias("slice"))
        for p in range(parts)]))


def exact_scores(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds the whole score to (query_id, rep)."""
    zero = F.lit(0).cast("bigint")
    product = F.aggregate(F.zip_with("code", "query", lambda x, y: F.coalesce(x * y, zero)), zero, lambda s, x: s + x)
    # Sums that may not fit in 64 bits pass through decimals of 38 digits.
    wide, least, most = "decimal(38,0)", F.lit(-LARGEST_SCORE), F.lit(LARGEST_SCORE)
    exact = F.aggregate(
        F.zip_with("code", "query", lambda x, y: F.coalesce((x.cast("decimal(18,0)") * y.cast("decimal(18,0)")).cast(wide), zero.cast(wide))),
        zero.cast(wide), lambda s, x: (s + x).cast(wide))
    size = lambda c: F.coalesce(F.array_max(F.transform(c, F.abs)), zero).cast("double")
    fits = size("code") * size("query") * F.greatest(F.size("code"), F.lit(1)) < float(LARGEST_SCORE)
    score = F.when(fits, product).otherwise(F.greatest(least, F.least(most, exact)).cast("bigint"))
    return (
        pairs.join(vectors.select("rep", "code"), "rep").join(queries.select("query_id", F.col("code").alias("query")), "query_id")
        .select("query_id", "rep", score.alias("score")))


def top(frame: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def search(table: DataFrame, results: int = RESULTS, every: int = QUERY_EVERY, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``results`` best rows for each row whose vec_id ``every`` divides.

    Scores are inner products of floor(SCALE * component); ties go to the smaller vec_id. A vector that is null or holds
    null or non-finite components takes no part, nor does a row without vec_id; vectors of other lengths count as ending
    in zeros; rows equal in id and vector are one, a query never meets rows of its own id; components beyond 2^43
    and scores (or a list's part of them) beyond 2^61 count as that, all others are exact; fewer candidates give fewer results, an empty table none. Other columns are ignored.

    The components of all vectors are cut into ``parts`` lists of partial scores, each held in groups of rows. Phase one
    gathers every list's best entries; their whole scores give a cutoff that k vectors reach, so it is safe. Phase two hands
    each node the cutoff: a vector below cutoff / parts in all lists is below the cutoff, so the entries sent suffice. Phase
    three adds up what is known, drops vectors whose upper bound is below the cutoff, and resolves the others exactly. The
    queries meet all rows in blocks of bounded size.
    """
    k = results + 1
    rows = table.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", scaled("embedding").alias("code"))
    vectors = settle(distinct_vectors(rows, k))
    # A repeated query id with several vectors is one query for each; results are told apart by the vector.
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "code"]).select(F.col("vec_id").alias("own"), "code")
    queries = settle(queries.withColumn("query_id", F.monotonically_increasing_id()))
    groups = max(1, -(-vectors.count() // GROUP_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nodes = (
        vectors.select("rep", "code", F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int").alias("group"), spread(blocks).alias("block"))
        .select("rep", "group", "block", _slices("code", parts).alias("s")).select("rep", "group", "block", "s.part", "s.slice"))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def sent(asking: DataFrame, columns: list[str]) -> DataFrame:
        return asking.select(*columns, "code", "block", spread(groups).alias("group")).select(
            *columns, "block", "group", _slices("code", parts).alias("s")).select(*columns, "block", "group", "s.part", "s.slice")

    key = ["part", "group", "block"]
    local = nodes.groupBy(*key).cogroup(sent(asked, ["query_id"]).groupBy(*key)).applyInPandas(
        _local_lists(k), "query_id bigint, rep bigint, part int, partial bigint")
    best = top(local, ["query_id", "part"], [F.desc("partial"), "rep"], k).select("query_id", "rep").distinct()
    first = exact_scores(best, vectors, queries)
    cutoffs = top(first, ["query_id"], [F.desc("score"), "rep"], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    asked = settle(asked.join(cutoffs, "query_id", "left"))

    entries = nodes.groupBy(*key).cogroup(sent(asked, ["query_id", "cutoff"]).groupBy(*key)).applyInPandas(
        _above_cutoff(parts), "query_id bigint, rep bigint, partial bigint")
    known = entries.groupBy("query_id", "rep").agg(F.sum("partial").alias("known"), F.count("*").alias("lists"))
    # A list that sent nothing holds less than cutoff / parts.
    most = F.col("known") + (parts - F.col("lists")) * F.floor((F.col("cutoff") - 1) / F.lit(parts))
    open_pairs = known.join(asked.select("query_id", "cutoff"), "query_id").where(F.col("cutoff").isNull() | (most >= F.col("cutoff")))
    scored = exact_scores(open_pairs.select("query_id", "rep"), vectors, queries)

    lead = top(scored, ["query_id"], [F.desc("score"), "rep"], k).drop("rank")
    found = lead.join(vectors.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id"))
    named = found.join(queries.select("query_id", "own"), "query_id").where(F.col("vec_id") != F.col("own"))
    ranked = top(named, ["query_id"], [F.desc("score"), "vec_id"], results)
    return ranked.select(F.col("own").alias("query_id"), "rank", "vec_id", "score")
