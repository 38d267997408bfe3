"""A Merkle manifest of a dataset: a tree of digests per language, a tree over languages, and proofs of single rows.

The trees are kept as a content-addressed store: per height one table of digest -> digests of the children. A proof is found
by descent: requests start at the root and follow the digits of their rank (base ``FAN``). Requests with the same leading
digits move as one row, so a step joins each node of a height once, whatever the number of requests below it. What a step does
not select are the siblings of the proof; the segments are reversed at the end, as proofs start at the leaf.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from relinker.llm.common import maybe_broadcast, written

# Children of a node, and the columns of a leaf in order.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<digit:int,siblings:array<string>>>"


def digest(parts: Column) -> Column:
    """Lower-case hex SHA-256 of joined texts."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf_digest(text: Column) -> Column:
    """Digest of a row of documents that holds ``text`` as its text: byte count, colon and value of each field, - for null."""
    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in the given order (from 0) as ``name``, and the range piece it lies in as ``piece``.

    Rows are sorted by range and written; only the row counts of the pieces are summed up in one place.
    """
    from pyspark.sql import Window

    placed = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered"
    ).withColumn("piece", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("piece").agg(F.count("*").alias("_n"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per range piece: bounded by the number of tasks.
    return placed.join(F.broadcast(starts), "piece").withColumn(name, F.col("_start") + F.col("_at")).drop("_start", "_at")


@dataclass(frozen=True)
class Trees:
    """``levels[h - 1]``: (digest, children) of height h. ``tops``: (tree, height, digest), one row per tree."""
    levels: list[DataFrame]
    tops: DataFrame


def build(leaves: DataFrame) -> Trees:
    """Trees over ``leaves(tree, n, pos, digest)``: n leaves per tree, at places 0 to n - 1. Every height is written once."""
    level = leaves.select("tree", F.col("n").cast("bigint").alias("n"), F.col("pos").cast("bigint").alias("pos"), "digest")
    largest = level.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []

    def top(height: int) -> DataFrame:
        return level.where("n = 1").select("tree", F.lit(height).alias("height"), "digest")

    while largest > 1:
        tops.append(top(len(levels)))
        # At most FAN children meet in one group.
        above = level.where("n > 1").groupBy("tree", "n", F.floor(F.col("pos") / FAN).alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"].alias("children"))
        level = written(above.select(
            "tree", F.ceil(F.col("n") / FAN).cast("bigint").alias("n"), F.col("up").alias("pos"), digest(F.col("children")).alias("digest"),
            "children"), "nodes")
        # Repeated rows give equal subtrees, of which the store keeps one.
        levels.append(written(level.select("digest", "children").dropDuplicates(["digest"]), "store"))
        largest = -(-largest // FAN)
    tops.append(top(len(levels)))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Trees(levels, written(out, "tops"))


def _segment(digit: Column, children: Column) -> Column:
    return F.array(F.struct(digit.cast("int").alias("digit"), F.filter(children, lambda x, i: i != digit).alias("siblings")))


def descend(trees: Trees, requests: DataFrame, above: DataFrame) -> DataFrame:
    """Adds ``path``, segments from the root down, to ``requests(tree, rank, ...)``.

    ``above(tree, path)`` is what leads to each tree. Each height is joined once, on the digests that requests have reached.
    """
    wanted = {1: written(requests.select("tree", F.floor(F.col("rank") / FAN).alias("pos")).distinct(), "wanted")}
    for h in range(2, len(trees.levels) + 1):
        wanted[h] = written(wanted[h - 1].select("tree", F.floor(F.col("pos") / FAN).alias("pos")).distinct(), "wanted")

    def entering(height: int) -> DataFrame:
        tops = trees.tops.where(F.col("height") == height).drop("height")
        return tops.join(above, "tree").select("tree", F.lit(0).cast("bigint").alias("pos"), "digest", F.col("path").cast(PATH).alias("path"))

    lists = entering(0).select("tree", "pos", "path", F.lit(None).cast("array<string>").alias("children"))
    front = None
    for h in range(len(trees.levels), 0, -1):
        front = entering(h) if front is None else front.unionByName(entering(h))
        # A subtree of repeated rows stands at many places: both sides are plain tables, so that the join can be split there.
        opened = front.join(wanted[h], ["tree", "pos"], "left_semi").join(trees.levels[h - 1], "digest")
        if h == 1:
            lists = lists.unionByName(opened.select("tree", "pos", "path", "children"))
        else:
            # Written at every height, so that plans stay small.
            front = written(opened.select("tree", "pos", "path", "children", F.posexplode("children").alias("digit", "child")).select(
                "tree", (F.col("pos") * FAN + F.col("digit")).alias("pos"), F.col("child").alias("digest"),
                F.concat("path", _segment(F.col("digit"), F.col("children"))).alias("path")), "front")
    digit = F.col("rank") % FAN
    whole = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", _segment(digit, F.col("children"))))
    return (
        requests.withColumn("pos", F.floor(F.col("rank") / FAN)).join(lists, ["tree", "pos"])
        .withColumn("path", whole).drop("pos", "children"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    def up(below: Column, s: Column) -> Column:
        return digest(F.concat(F.slice(s["siblings"], F.lit(1), s["digit"]), F.array(below), F.slice(s["siblings"], s["digit"] + 1, F.lit(FAN))))
    return F.aggregate(F.reverse(path), leaf, up)


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf's to the root's, left to right."""
    return F.flatten(F.transform(F.reverse(path), lambda s: s["siblings"]))


@dataclass(frozen=True)
class Manifest:
    """``rows``: (tree, rank, n, doc_id, leaf, changed); ``by_language``, ``over``: the trees; ``root``: one digest, null without rows."""
    rows: DataFrame
    by_language: Trees
    over: Trees
    root: str | None


def manifest(docs: DataFrame, changed: Column) -> Manifest:
    """Digests of all rows of ``documents`` and their trees. ``changed`` is the text of a changed row, null where it is unchanged."""
    digests = written(docs.select(
        "doc_id", "lang", leaf_digest(F.col("text")).alias("leaf"), F.when(changed.isNotNull(), leaf_digest(changed)).alias("changed"),
        F.monotonically_increasing_id().alias("_row")), "leaves")
    # Equal rows have equal digests, so the last key only cuts large groups of them into several pieces.
    rows = numbered(digests, ["lang", "doc_id", "leaf", "_row"], "_place").drop("_row")
    languages = numbered(
        rows.groupBy("lang").agg(F.min("_place").alias("_first"), F.count("*").alias("n")), ["_first"], "tree").drop("piece")
    # Joined by piece and language, so that a language with many rows is no hot key.
    pieces = rows.select(F.col("piece").alias("_piece"), F.col("lang").alias("_lang")).distinct().join(
        languages.withColumnRenamed("lang", "_its"), F.col("_lang").eqNullSafe(F.col("_its"))).drop("_its")
    pieces = maybe_broadcast(pieces, pieces.count())
    placed = written(rows.join(pieces, (F.col("piece") == F.col("_piece")) & F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "tree", (F.col("_place") - F.col("_first")).alias("rank"), "n", "doc_id", "leaf", "changed"), "placed")
    trees = build(placed.select("tree", "n", F.col("rank").alias("pos"), F.col("leaf").alias("digest")))
    n = trees.tops.count()
    over = build(trees.tops.select(F.lit(0).cast("bigint").alias("tree"), F.lit(n).alias("n"), F.col("tree").alias("pos"), "digest"))
    root = over.tops.first()
    return Manifest(placed, trees, over, root["digest"] if root else None)


def proofs(m: Manifest, requests: DataFrame) -> DataFrame:
    """Adds ``path`` (from the root down) and ``subroot`` to ``requests(tree, rank, ...)``: places of leaves in the manifest."""
    start = m.over.tops.select("tree", F.array().cast(PATH).alias("path"))
    subroots = m.by_language.tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.col("digest").alias("subroot"))
    above = written(
        descend(m.over, subroots, start).select(F.col("rank").alias("tree"), "path", "subroot"), "languages")
    found = descend(m.by_language, requests, above.select("tree", "path"))
    # A key per language: the joined table has one row per language, the large side is split where it is hot.
    return found.join(maybe_broadcast(above.select("tree", "subroot"), above.count()), "tree")


def lower_cased(docs: DataFrame) -> Column:
    """The text with A-Z in lower case where 3 divides the checksum of the decimal doc_id; null for other rows and null texts."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER))


def verified(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``documents``.

    A null field counts as ``-``. Rows are ordered by doc_id (null first), rows of one id by their leaf, so repeated rows are
    leaves of their own with equal results but for their places. Null is a language, the first one. A row with a null doc_id is
    not tampered with. An empty text is a value of 0 bytes; long ones are hashed whole where they are read. An empty table
    gives no rows. Other columns than the five of a leaf are not read.
    """
    m = manifest(docs.select(*FIELDS), lower_cased(docs))
    found = proofs(m, m.rows)
    fold = folded(F.coalesce("changed", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), digest(siblings(F.col("path"))).alias("proof_sha256"),
        fold.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
