"""Near-duplicate vectors by an inverted multi-index: codebooks on both halves, nearest cells first, cosine to verify."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from relinker.llm.common import components, maybe_broadcast, settle
from relinker.llm.topk import usable

# Fixed value: least cosine of a link.
COSINE = 0.98

#: Share of pairs at the threshold whose cells must be visited; vectors the codebooks are fitted on at most; vectors a cell
#: should hold; bounds of the words in a codebook.
TARGET_RECALL = 0.999
SAMPLE = 16_384
CELL_ROWS = 256
WORDS = (2, 1024)
ROUNDS = 12
SLICE = 1024
SALTS = 16


@dataclass(frozen=True)
class Index:
    """Two codebooks for unit vectors of one length, and how far from a vector its cells are visited."""
    dim: int
    halves: tuple[np.ndarray, np.ndarray]
    radius: float

    def split(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit[:, :self.dim // 2], unit[:, self.dim // 2:]

    def bounds(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest word, and the distance to the border of every other word's region."""
        return [_borders(x, words) for x, words in zip(self.split(unit), self.halves, strict=True)]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        (a, _), (b, _) = self.bounds(unit)
        return a * len(self.halves[1]) + b

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own cell of each vector, and (vector, cell) of all cells to visit.

        Multi-sequence order: the words of each half by distance, cells by the squared sum of both; a cell is visited while that
        sum is within the radius. Cells before it in both sequences are nearer, so the visits form a staircase.
        """
        (a, first), (b, second) = self.bounds(unit)
        k = len(self.halves[1])
        own = a * k + b
        limit = self.radius**2
        order_1, order_2 = np.argsort(first, axis=1), np.argsort(second, axis=1)
        near_1, near_2 = np.take_along_axis(first, order_1, 1) ** 2, np.take_along_axis(second, order_2, 1) ** 2
        rows, cells = [], []
        for i in range(near_1.shape[1]):
            open_rows = np.flatnonzero(near_1[:, i] <= limit)
            if not len(open_rows):
                break
            for j in range(near_2.shape[1]):
                open_rows = open_rows[near_1[open_rows, i] + near_2[open_rows, j] <= limit]
                if not len(open_rows):
                    break
                rows.append(open_rows)
                cells.append(order_1[open_rows, i] * k + order_2[open_rows, j])
        return own, np.concatenate(rows), np.concatenate(cells)


def _borders(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)[None]
    nearest = square.argmin(axis=1)
    apart = np.sqrt(np.maximum(((words[nearest][:, None] - words[None]) ** 2).sum(2), 1e-24))
    gap = np.maximum(square - np.take_along_axis(square, nearest[:, None], 1), 0) / (2 * apart)
    np.put_along_axis(gap, nearest[:, None], 0.0, 1)
    return nearest, gap


def _words(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; an empty word moves to the vector farthest from its own."""
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        square = (x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)[None]
        nearest = square.argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(words))
        sums = np.stack([np.bincount(nearest, x[:, d], len(words)) for d in range(x.shape[1])], axis=1) if x.shape[1] else words
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            words[empty] = x[np.argsort(-square.min(axis=1))[:len(empty)]]
    return words


def _index_from(sample: np.ndarray, cells: int, cosine: float, recall: float) -> Index:
    """Fits both codebooks and sets the radius so that pairs exactly at the threshold are found with the target recall.

    Such pairs are made from the sample: each vector is turned by the threshold angle in a random direction.
    """
    rng = np.random.Generator(np.random.PCG64(0))
    dim = sample.shape[1]
    k = int(np.clip(round(np.sqrt(cells)), *WORDS))
    halves = (_words(sample[:, :dim // 2], k, rng), _words(sample[:, dim // 2:], k, rng))
    index = Index(dim, halves, 0.0)
    some = sample[rng.choice(len(sample), 4000)]
    turn = rng.standard_normal(some.shape)
    turn -= (turn * some).sum(1)[:, None] * some
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    other = cosine * some + np.sqrt(1 - cosine**2) * turn
    (_, first), (_, second) = index.bounds(some)
    (a, _), (b, _) = index.bounds(other)
    needed = np.sqrt(np.take_along_axis(first, a[:, None], 1)[:, 0] ** 2 + np.take_along_axis(second, b[:, None], 1)[:, 0] ** 2)
    return Index(dim, halves, float(np.quantile(needed, recall)) + 1e-9)


def fit(vectors: DataFrame, cosine: float = COSINE, recall: float = TARGET_RECALL, sample: int = SAMPLE) -> Index | None:
    """Fits the index on at most ``sample`` vectors of the most common length, chosen by a hash of their ids.

    The number of cells follows the number of vectors, so that a cell of a label holds about ``CELL_ROWS``.
    """
    sizes = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), "dim").first()
    if common is None or common["dim"] < 2:
        return None
    labels = vectors.select(F.approx_count_distinct("label")).first()[0]
    same = vectors.where(F.size("embedding") == common["dim"])
    share = min(1.0, 1.2 * sample / common["n"])
    drawn = same.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    found = drawn.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()
    x = units(found["embedding"], common["dim"])
    return _index_from(x, max(1, common["n"] // (CELL_ROWS * max(1, labels))), cosine, recall)


def units(embeddings: pd.Series, dim: int) -> np.ndarray:
    x = np.stack([np.asarray(e, np.float64) for e in embeddings]) if len(embeddings) else np.zeros((0, dim))
    # A vector is first brought to a size whose square is a double.
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0.0), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep) of copies, and (rep, label, embedding, copies): equal vectors of a label are one.

    Only vectors that occur twice are joined, by a salt as well, so that a vector of a third of all rows is not one task.
    """
    some = table.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))).select("vec_id", "label", "embedding")
    reps = settle(some.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    many = reps.where("copies > 1").select("label", "embedding", "rep", "copies", salts)
    copies = some.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).join(many, ["label", "embedding", "salt"])
    return copies.select("vec_id", "rep", "copies"), reps


def _placed(index: Index | None):
    """Each vector in the cell it lives in (role 0) and in the cells it visits (role 1), of which those before its own are
    left out: the vectors there visit this one's cell. Vectors of another length share one cell."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at:at + 2000]
                fits = part["embedding"].map(len).to_numpy() == (index.dim if index else -1)
                for own, group in ((False, part[~fits]), (True, part[fits])):
                    if not len(group):
                        continue
                    rows = np.arange(len(group))
                    home = np.full(len(group), -1)
                    visitor, cell = rows, home
                    if own:
                        home, visitor, cell = index.visits(units(group["embedding"], index.dim))
                        later = cell >= home[visitor]
                        visitor, cell = visitor[later], cell[later]
                    for role, r, c in ((0, rows, home), (1, visitor, cell)):
                        yield group.iloc[r].assign(role=role, cell=c, home=home[r])
    return run


def _verify(cosine: float):
    """Links between the visitors and the residents of a slice of a cell: how many (copies counted) each vector has, and a
    chain through every group of linked vectors, which is all that components need."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        residents, visitors = group[group["role"] == 0], group[group["role"] == 1]
        empty = pd.DataFrame({"a": [], "b": [], "links": []})
        if not len(residents) or not len(visitors):
            return empty
        dim = len(residents["embedding"].iloc[0])
        r, v = residents["rep"].to_numpy(), visitors["rep"].to_numpy()
        linked = units(visitors["embedding"], dim) @ units(residents["embedding"], dim).T >= cosine
        # Vectors of the same cell meet twice; a pair counts where the visitor has the smaller id.
        at_home = (visitors["home"] == visitors["cell"]).to_numpy()
        linked &= ~at_home[:, None] | (v[:, None] < r[None, :])
        i, j = np.nonzero(linked)
        if not len(i):
            return empty
        many_r, many_v = residents["copies"].to_numpy(), visitors["copies"].to_numpy()
        links_v, links_r = linked @ many_r, linked.T @ many_v
        names = np.unique(np.concatenate([v[i], r[j]]))
        x, y = np.searchsorted(names, v[i]), np.searchsorted(names, r[j])
        root = np.arange(len(names))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        order = np.argsort(root, kind="stable")
        same = root[order][1:] == root[order][:-1]
        chain = pd.DataFrame({"a": names[order][:-1][same], "b": names[order][1:][same], "links": 0})
        counts = pd.DataFrame({"a": np.concatenate([v, r]), "b": np.concatenate([v, r]), "links": np.concatenate([links_v, links_r])})
        return pd.concat([chain, counts[counts["links"] > 0]], ignore_index=True)
    return run


def near_duplicates(table: DataFrame, cosine: float = COSINE, recall: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of the same label are linked at a cosine (in doubles) of ``cosine`` or more. A null label, and a vector that is null,
    zero or holds null or non-finite components link with nothing; vectors of different lengths do not link; repeated rows
    are copies that link; a row without an id is kept and has no component. Other columns are ignored.

    A cell is cut into slices of at most about ``SLICE`` residents and as many visitors, so a cell of any size is dealt out.
    """
    copies, reps = distinct_vectors(table)
    index = fit(reps, cosine, recall)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reps.schema.fields) + ", role int, cell bigint, home bigint"
    key = ["label", "dim", "cell"]
    placed = reps.mapInPandas(_placed(index), schema).withColumn("dim", F.size("embedding"))
    placed = settle(placed)
    counts = placed.groupBy(*key).agg(
        F.ceil(F.sum(1 - F.col("role")) / SLICE).alias("home_slices"), F.ceil(F.sum("role") / SLICE).alias("visit_slices"))
    counts = settle(counts.where("home_slices > 0 and visit_slices > 0"))
    dealt = placed.join(maybe_broadcast(counts, counts.count()), key)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("role") == 0, F.col("home_slices")).otherwise(F.col("visit_slices")))
    other = F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.when(F.col("role") == 0, F.col("visit_slices")).otherwise(F.col("home_slices")) - 1))
    sliced = dealt.withColumn("own", own).withColumn("other", other).withColumns({
        "home_slice": F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")),
        "visit_slice": F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own"))})
    verified = settle(sliced.groupBy(*key, "home_slice", "visit_slice").applyInPandas(_verify(cosine), "a bigint, b bigint, links bigint"))

    links = verified.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(verified.where("links = 0").select("a", "b"))
    least = joined.join(joined.groupBy("root").agg(F.min("node").alias("least")), "root").select(F.col("node").alias("rep"), "least")
    per_rep = settle(reps.select("rep").join(links, "rep", "left").join(least, "rep", "left").where("links is not null or least is not null"))
    # A copy has the links of its representative and one to each other copy; most rows are neither copies nor linked.
    of_copies = copies.join(per_rep, "rep", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", "rep").alias("least"))
    of_single = per_rep.join(copies.select(F.col("rep").alias("of")).distinct(), F.col("rep") == F.col("of"), "left_anti").select(
        F.col("rep").alias("vec_id"), "links", "least")
    named = of_copies.unionByName(of_single).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("least").alias("least"))
    out = table.select("vec_id").join(named, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
