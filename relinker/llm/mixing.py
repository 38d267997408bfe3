"""Mixing sources to target weights by packed blocks, multinomial shard counts and index permutations."""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from relinker.llm.common import give_back, maybe_broadcast, portions, running_start, settle, word_count, written

# Weights of the sources in order, repeating; share of all words; most uses of a word.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_USES = 2

BLOCK_WORDS = 128
LEAST_BLOCKS = 64
SHARD_SLOTS = 8192
BUCKET_ROWS = 2000
SPLIT = 4096
# Characters of the texts that are rebuilt at a time.
PORTION = 1_000_000
WITH_SPACE = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): one row per document; a null text has size 0."""
    return docs.select("doc_id", "source", word_count("text").alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the number of sources.

    Sources in code point order, null last, take ``weights`` in turn. A target is level * weight, at most
    ``MOST_USES`` times the size of its source; the level is raised until all words of the share are dealt out.
    The level is the only number the driver holds.
    """
    totals = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = totals.count()
    ranked = _ranked(totals, n).withColumns({
        "weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"),
        "most": (F.col("source_size") * MOST_USES).cast("double")})
    ranked = settle(ranked)
    level = 0.0
    while n:
        full = F.col("most") < F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        raised = (share * row["all"] - row["fixed"]) / row["open"]
        if raised <= level:
            break
        level = raised
    return ranked.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target")), n


def _ranked(totals: DataFrame, n: int) -> DataFrame:
    """Adds the position of the source in code point order, null last."""
    parts = max(1, n // BUCKET_ROWS)
    if parts == 1:
        return totals.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    cut = settle(totals.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    one = cut.withColumn("one", F.lit(1))
    return running_start(one, [], "part", [F.asc_nulls_last("source")], "one", "rank").drop("part", "one")


def packed(docs: DataFrame) -> DataFrame:
    """Documents with their place in the word stream of their source: start, block length, blocks, slots to fill.

    A source is a stream of all its words, cut into blocks of ``BLOCK_WORDS`` words (fewer in a source that would
    have under ``LEAST_BLOCKS`` blocks). The order of documents is fixed by a hash of their ids.
    """
    sized = settle(sizes(docs))
    targets, n = source_targets(sized)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("bigint")
    targets = targets.withColumn("block_words", block).withColumn(
        "blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("bigint")).withColumn(
        "slots", F.least(F.round(F.col("target") / F.col("block_words")).cast("bigint"), F.col("blocks") * MOST_USES))
    # A source is joined by a number, as a null is no join key.
    targets = settle(targets.withColumn("source_no", F.monotonically_increasing_id()))
    buckets = max(1, sized.count() // BUCKET_ROWS)
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    joined = rows.alias("d").join(
        maybe_broadcast(targets, n).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.*").drop(
        targets["source"])
    return settle(running_start(joined, ["source_no"], "bucket", ["doc_id", "size"], "size", "start").drop("bucket"))


def _generator(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([k & 0xFFFFFFFF for k in key]))


def _split_counts(seed: int, level: int):
    """Deals the slots of a row to its shards by a multinomial draw; a wide range is first dealt to ``SPLIT`` ranges."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                width = r.high - r.low
                parts = min(width, SPLIT) if level == 0 else width
                edges = r.low + np.arange(parts + 1, dtype=np.int64) * width // parts
                draw = _generator(seed, level, r.source_key, int(r.low)).multinomial(r.count, np.diff(edges) / width)
                first = r.first + np.concatenate([[0], np.cumsum(draw)[:-1]])
                some = draw > 0
                yield pd.DataFrame({
                    "source_no": r.source_no, "source_key": r.source_key, "low": edges[:-1][some], "high": edges[1:][some],
                    "count": draw[some], "first": first[some]})
    return split


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network, walked until it falls below size."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64).copy()
    todo = np.ones(len(out), bool)
    limit = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        while todo.any():
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
            left, right = x >> h, x & m
            for r in range(rounds):
                z = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r)) * np.uint64(0xBF58476D1CE4E5B9)
                z ^= z >> np.uint64(29)
                z *= np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(32)
                left, right = right, left ^ (z & m)
            out[todo] = (left << h) | right
            todo = out >= limit
    return out.astype(np.int64)


@pandas_udf(LongType())
def block_of(slot: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    """The block in a slot: every pass over the source has its own permutation of the blocks."""
    n = blocks.to_numpy(np.int64)
    turn, index = np.divmod(slot.to_numpy(np.int64), n)
    return pd.Series(permuted(index, n, key.to_numpy(np.int64) * MOST_USES + turn))


@pandas_udf(LongType())
def source_key(source: pd.Series) -> pd.Series:
    return pd.Series([0 if s is None else zlib.crc32(s.encode()) + 1 for s in source], dtype="int64")


def slots(places: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, source_no, slot, block): which block of which source fills each slot of each output shard."""
    sources = places.where("slots > 0").groupBy("source_no").agg(
        F.first("source").alias("source"), F.first("slots").alias("count"), F.first("blocks").alias("blocks"))
    sources = settle(sources.withColumn("source_key", source_key("source")))
    total = sources.agg(F.sum("count")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    schema = "source_no bigint, source_key bigint, low bigint, high bigint, count bigint, first bigint"
    counts = sources.select(
        "source_no", "source_key", F.lit(0).cast("bigint").alias("low"), F.lit(shards).cast("bigint").alias("high"), "count",
        F.lit(0).cast("bigint").alias("first"))
    counts = counts.mapInPandas(_split_counts(seed, 0), schema)
    if shards > SPLIT:
        counts = counts.repartition("source_no", "low").mapInPandas(_split_counts(seed, 1), schema)
    dealt = counts.select(
        F.col("low").alias("shard"), "source_no", "source_key",
        F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("slot"))
    dealt = dealt.join(maybe_broadcast(sources.select("source_no", "blocks"), sources.count()), "source_no")
    return dealt.select("shard", "source_no", "slot", block_of("slot", "blocks", F.col("source_key") + F.lit(seed)).alias("block"))


def mix(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Mixes documents(doc_id, text, source) and returns (places, mixture).

    ``places`` has one row per document: doc_id, source, size, source_size, target, source_no, start, ...
    ``mixture`` has one row per piece of a document in a slot: shard, source_no, slot, block, start (of its document),
    doc_id, word_from, word_to (exclusive). Each source fills round(target / block length) slots; no block comes
    more than ``MOST_USES`` times. Null and empty texts have no words and no pieces; an empty table gives no rows;
    a repeated row is a document of its own; other columns are ignored. The same input gives the same mixture.
    """
    places = packed(docs)
    block = F.col("block_words")
    pieces = (
        places.where("size > 0")
        .withColumn("block", F.explode(F.sequence(
            F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
        .select(
            "source_no", "block", "doc_id", "start",
            F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("word_from"),
            F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")).alias("word_to")))
    return places, slots(places, seed).join(pieces, ["source_no", "block"])


def taken_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document the mix takes."""
    places, mixture = mix(docs, seed)
    taken = mixture.groupBy("source_no", "start", "doc_id").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    # Only a document with words has pieces; its start is its own.
    key = places.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
    joined = key.join(taken.select("source_no", F.col("start").alias("key"), "taken"), ["source_no", "key"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents with the words that the mix takes as text (in their order, a second use after the first).

    A document of which nothing is taken goes. Columns stay; ``n_chars`` follows the text.
    """
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    keyed = numbered.withColumn("_doc", F.col("doc_id")).withColumn("doc_id", F.col("_row"))
    _, mixture = mix(keyed, seed)
    use = mixture.select(F.col("doc_id").alias("_row"), F.struct("slot", "word_from", "word_to").alias("piece"))
    # The first use of a block has a smaller slot than the second.
    turn = Window.partitionBy("_row", F.col("piece.word_from")).orderBy("piece.slot")
    uses = use.withColumn("turn", F.row_number().over(turn)).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("turn", "piece.word_from", "piece.word_to"))).alias("pieces"))
    has_length = "n_chars" in docs.columns

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches, "text", PORTION):
            batch = batch.assign(text=[taken_text(t, p) for t, p in zip(batch["text"], batch["pieces"], strict=True)]).drop(columns="pieces")
            if has_length:
                batch["n_chars"] = batch["text"].str.len()
            yield batch
        give_back()

    return numbered.join(uses, "_row").select(*docs.columns, "pieces").mapInPandas(build, docs.schema)


def taken_text(text: str, pieces) -> str:
    """The words of the pieces (turn, word_from, word_to) with the white space after them; a gap or a new turn starts a line."""
    words = WITH_SPACE.findall(text)
    out, at = [], None
    for p in pieces:
        if out and at != p["word_from"]:
            out.append("\n")
        out.append("".join(words[p["word_from"]:p["word_to"]]))
        at = p["word_to"]
    return "".join(out)
