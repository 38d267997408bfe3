"""Near-duplicate documents by bottom-k sketches of one hash function, inverted lists of retained values, and exact Jaccard."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from relinker.llm.common import components, portions, settle, through_pandas, written

# Words of a shingle.
SHINGLE = 5

SKETCH = 64
#: Of the ``SKETCH`` least values of a union, a pair at the threshold shares ``SKETCH * threshold`` on average; the search
#: and the estimate both allow for this many standard deviations less (a miss has odds of about 1 in 100,000 at the threshold).
DEVIATIONS = 4.6
#: Lists are matched where a pair meets in this many of them.
AGREE = 4
SALTS = 16
SLICE = 500
#: A document that met a leader without a link is compared with so many of the most typical members of the leader's component
#: before what is still apart is searched by whole sets.
TYPICAL = 24


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ASCII letters in lower case, words between ASCII white space."""
    split = [t.encode().lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for s in split for w in s]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
    with np.errstate(over="ignore"):
        # A shingle of n words depends on their order and on n.
        run = np.zeros(len(h), np.uint64)
        for j in range(SHINGLE):
            n = max(0, len(h) - j)
            run[:n] = run[:n] * np.uint64(0x9E3779B97F4A7C15) + _mix(h[j:] + np.uint64(j))
        run = _mix(run)
    ends = np.cumsum(counts)
    out = []
    for words, end, n in zip(split, ends, counts, strict=True):
        if n == 0:
            out.append(np.zeros(0, np.int64))
        elif n < SHINGLE:
            whole = xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=int(n))
            out.append(np.array([whole], np.uint64).view(np.int64))
        else:
            out.append(np.unique(run[end - n:end - SHINGLE + 1].view(np.int64)))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, first_sum, second_sum, sketch): size of the shingle set, its fingerprint, its ``SKETCH`` least values."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(batches, "text"):
            sets = shingle_sets(part["text"].tolist())
            with np.errstate(over="ignore"):
                second = [int(_mix(s.view(np.uint64)).sum().astype(np.int64)) for s in sets]
            yield pd.DataFrame({
                "doc_id": part["doc_id"].array, "n": [len(s) for s in sets], "first_sum": [int(s.sum()) for s in sets],
                "second_sum": second, "sketch": [s[:SKETCH] for s in sets]})

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return through_pandas(slim, run, "doc_id bigint, n bigint, first_sum bigint, second_sum bigint, sketch array<bigint>")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles): the whole shingle sets of the documents in ``ids``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(batches, "text"):
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "shingles": shingle_sets(part["text"].tolist())})

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    return through_pandas(slim.join(ids.select("doc_id"), "doc_id", "left_semi"), run, "doc_id bigint, shingles array<bigint>")


def representatives(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with equal shingle sets are one: (doc_id, rep) for all documents, and the sketches of representatives.

    The representative has the least id. Only sets that occur twice are joined, by fingerprint and salt, so that a set
    of a third of all documents does not end in one task.
    """
    key = ["n", "first_sum", "second_sum"]
    some = found.where("n > 0 and doc_id is not null")
    groups = settle(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    many = groups.where("copies > 1").select(*key, "rep", salts)
    members = some.select("doc_id", *key, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).join(many, [*key, "salt"])
    return members.select("doc_id", "rep"), groups.select(F.col("rep").alias("doc_id"), "n", "sketch")


def lists(reps: DataFrame, percent: int) -> DataFrame:
    """Inverted lists (value, doc_id, n, agree, lone): each sketch enters the lists of its rarest values.

    Two sketches that share ``need`` of their values share ``agree`` of the size - need + agree rarest of each (by number
    of documents, then value); ``lone`` counts the values that no other sketch has. For sets so small that sketches of all partners are whole, ``need`` is exact; otherwise it is what a pair
    at the threshold shares, less ``DEVIATIONS``. Values of one document only count towards the rarest, as no list has them.
    """
    share = percent / 100
    least = int(np.floor(SKETCH * share - DEVIATIONS * np.sqrt(SKETCH * share * (1 - share))))
    size = F.size("sketch")
    whole = F.ceil(F.col("n") * percent / 100).cast("int")
    need = F.when(F.col("n") <= int(SKETCH * share), whole).otherwise(F.least(F.lit(least), size))
    sized = reps.withColumn("need", need).withColumn("agree", F.least(F.lit(AGREE), "need")).withColumn("rarest", size - F.col("need") + F.col("agree"))
    held = sized.select("doc_id", "n", "agree", "rarest", size.alias("size"), F.explode("sketch").alias("value"))
    common = settle(held.groupBy("value").agg(F.count("*").alias("docs")).where("docs > 1"))
    shared = held.join(common, "value")
    # The rest of a sketch, its lone values, comes first among its rarest.
    by_doc = shared.groupBy("doc_id").agg(
        F.first("n").alias("n"), F.first("agree").alias("agree"), F.first("rarest").alias("rarest"), F.first("size").alias("size"),
        F.sort_array(F.collect_list(F.struct("docs", "value"))).alias("values"))
    lone = F.col("size") - F.size("values")
    left = F.col("rarest") - lone
    return by_doc.where(left > 0).select(
        "doc_id", "n", "agree", lone.alias("lone"), F.explode(F.slice("values", F.lit(1), left)).alias("v")).select(
        "doc_id", "n", "agree", "lone", "v.value")


def _fits(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def leader_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """(a, b): each document with the leaders of its lists, where both meet often enough.

    The leader has the fewest lone values: of a text and its edited copies that is the text or one close to it.
    """
    leader = posts.groupBy("value").agg(F.min(F.struct("lone", F.xxhash64("doc_id").alias("h"), "doc_id", "n", "agree")).alias("lead"))
    both = posts.join(settle(leader.select("value", "lead.doc_id", "lead.n", "lead.agree").toDF("value", "b", "m", "agree_b")), "value")
    met = both.where((F.col("doc_id") != F.col("b")) & _fits(F.col("n"), F.col("m"), percent))
    return met.groupBy(F.col("doc_id").alias("a"), "b").agg(
        F.count("*").alias("met"), F.first(F.least("agree", "agree_b")).alias("agree")).where("met >= agree").select("a", "b")


def _rooted(frame: DataFrame, roots: DataFrame) -> DataFrame:
    placed = frame.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return placed.withColumn("root", F.coalesce("root", "doc_id"))


def _split(placed: DataFrame, group: str) -> DataFrame:
    """(group, main, members): groups of more than one component, with their largest."""
    by_root = placed.groupBy(group, "root").agg(F.count("*").alias("members"))
    return by_root.groupBy(group).agg(
        F.max(F.struct("members", "root")).alias("top"), F.count("*").alias("roots"), F.sum("members").alias("members")
    ).where("roots > 1").select(group, F.col("top.root").alias("main"), "members")


def typical_pairs(met: DataFrame, posts: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents with the ``TYPICAL`` most typical members of components that are not theirs.

    These are the components of leaders they met, and the component that is largest in most of their lists.
    """
    docs = posts.groupBy("doc_id").agg(F.first("n").alias("n"), F.first("lone").alias("lone"))
    placed = settle(_rooted(docs, roots))
    order = Window.partitionBy("root").orderBy("lone", F.xxhash64("doc_id"), "doc_id")
    typical = placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TYPICAL).select(
        "root", F.col("doc_id").alias("b"), F.col("n").alias("m"))
    asked = (
        met.join(placed.select(F.col("doc_id").alias("a"), "n", F.col("root").alias("root_a")), "a")
        .join(placed.select(F.col("doc_id").alias("b"), "root"), "b").where("root_a != root").select("a", "n", "root"))
    listed = _rooted(posts.select("doc_id", "n", "value"), roots)
    often = listed.join(settle(_split(settle(listed), "value")), "value").where("root != main").groupBy("doc_id", "main").agg(
        F.count("*").alias("lists"), F.first("n").alias("n"))
    most = often.groupBy("doc_id").agg(F.max(F.struct("lists", "main", "n")).alias("top"))
    asked = asked.unionByName(most.select(F.col("doc_id").alias("a"), "top.n", F.col("top.main").alias("root"))).distinct()
    return asked.join(typical, "root").where(_fits(F.col("n"), F.col("m"), percent)).select("a", "b")


def whole_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Inverted lists (value, doc_id, n, place) of whole sets: two sets at the threshold share one of the rarest values of each.

    A set of n values shares all but n - ceil(n * percent / 100) with such a partner. Values of one document, as edits make
    them, come first, so a copy with too many edits is in no list.
    """
    n = F.size("shingles")
    sized = sets.select("doc_id", n.alias("n"), (n - F.ceil(n * percent / 100).cast("int") + 1).alias("rarest"), "shingles")
    held = sized.select("doc_id", "n", "rarest", F.explode("shingles").alias("value"))
    common = settle(held.groupBy("value").agg(F.count("*").alias("docs")).where("docs > 1"))
    by_doc = held.join(common, "value").groupBy("doc_id").agg(
        F.first("n").alias("n"), F.first("rarest").alias("rarest"), F.sort_array(F.collect_list(F.struct("docs", "value"))).alias("values"))
    lone = F.col("n") - F.size("values")
    left = F.col("rarest") - lone
    return by_doc.where(left > 0).select("doc_id", "n", lone.alias("lone"), F.posexplode(F.slice("values", F.lit(1), left)).alias("at", "v")).select(
        "doc_id", "n", "v.value", (F.col("lone") + F.col("at")).alias("place"))


def open_documents(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id): documents that share enough lists with another component; no others can have a link between components."""
    placed = settle(_rooted(posts, roots))
    live = placed.join(settle(_split(placed, "value")), "value")
    return live.groupBy("doc_id").agg(F.count("*").alias("lists"), F.first("agree").alias("agree")).where("lists >= agree - 1").select("doc_id")


def other_pairs(posts: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of different components that meet in a list early enough.

    The first value that two sets share stands at some place of each; what they share is at most what follows from there.

    In each list the component with the most documents is not matched with itself, so a group of near copies that is
    joined already makes no pairs. The two sides of a long list are cut into slices that meet one another.
    """
    placed = settle(_rooted(posts, roots))
    open_lists = settle(_split(placed, "value").withColumn("slices", F.ceil(F.col("members") / SLICE)))
    live = settle(placed.join(open_lists, "value").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices"))))
    few = live.where("root != main").select(
        "value", F.col("doc_id").alias("a"), "n", F.col("place").alias("place_a"), F.col("root").alias("root_a"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    all_of = live.select(
        "value", "slice", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("place").alias("place_b"), F.col("root").alias("root_b"),
        (F.col("root") == F.col("main")).alias("in_main"))
    met = few.join(all_of, ["value", "slice"]).where(
        (F.col("root_a") != F.col("root_b")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & _fits(F.col("n"), F.col("m"), percent)
        & (F.least(F.col("n") - F.col("place_a"), F.col("m") - F.col("place_b")) * (100 + percent) >= (F.col("n") + F.col("m")) * percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose Jaccard, estimated from the sketch of the union, is not below the threshold by ``DEVIATIONS``."""
    side = reps.select("doc_id", "sketch")
    both = pairs.join(side.toDF("a", "sketch_a"), "a").join(side.toDF("b", "sketch_b"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    share = percent / 100
    least = share - DEVIATIONS * float(np.sqrt(share * (1 - share) / SKETCH))
    kept = both.withColumn("union", union).withColumn(
        "estimate", F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), "union")) / F.size("union"))
    return kept.where(F.col("estimate") >= least).select("a", "b")


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return written(full_sets(docs, ids).groupBy("doc_id").agg(F.first("shingles").alias("shingles")), "shingles")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    pairs = settle(pairs)
    if pairs.isEmpty():
        return pairs
    if sets is None:
        sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return settle(both.where(shared * 100 >= (F.size("set_a") + F.size("set_b") - shared) * percent).select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked by a Jaccard of their shingle sets of ``percent`` or more.

    A set holds the distinct runs of five words; a text with fewer words is one shingle; a null or blank text has an
    empty set and is linked with nothing. component_id is the least id of the documents reachable by links, kept says
    whether it is the document's own. A repeated doc_id is one document with the links of all its rows; a document without
    an id is linked with nothing, has no component and is kept; other columns are ignored.

    Copies of a set are one representative. Leaders of the lists first join groups of near copies, then typical members of
    their components draw in more. Documents that still share enough lists with another component are searched
    by their whole sets, so every link between components is looked for, without comparing all members of a group.
    """
    found = written(sketches(docs), "sketches")
    members, reps = representatives(found)
    posts = settle(lists(reps, percent))
    met = settle(leader_pairs(posts, percent))
    links = confirmed(likely(met, reps, percent), docs, percent)
    joined = components(links)
    sets = _sets_of(docs, open_documents(posts, joined))
    more = confirmed(likely(typical_pairs(met, posts, joined, percent), reps, percent), docs, percent, sets)
    if not more.isEmpty():
        links = links.unionByName(more)
        joined = components(links)
    rest = confirmed(likely(other_pairs(settle(whole_lists(sets, percent)), joined, percent), reps, percent), docs, percent, sets)
    if not rest.isEmpty():
        joined = components(links.unionByName(rest))
    least = settle(joined.join(joined.groupBy("root").agg(F.min("node").alias("least")), "root").select(F.col("node").alias("rep"), "least"))
    # A repeated id can be in several groups; the least component counts.
    by_copy = members.join(least, "rep", "left").select("doc_id", F.coalesce("least", "rep").alias("component_id"))
    alone = least.select(F.col("rep").alias("doc_id"), F.col("least").alias("component_id"))
    named = by_copy.unionByName(alone).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = found.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, that with the least id; rows with a repeated id are kept once."""
    flags = near_duplicates(docs, percent).where("kept").select("doc_id").where("doc_id is not null").distinct()
    kept = docs.join(flags, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)
