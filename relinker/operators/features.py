"""Features of a pair of URLs. ``pairs(url_404, live_url)`` in, seven doubles added."""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from relinker.functions import strings, urls
from relinker.functions.forest import Forest, Live
from relinker.operators.spread import PAIR_TASKS, spread
from relinker.operators.vectors import gram_totals, texts_in_tasks
from relinker.sources.stage import settle

# Feature columns in model order, and the size of the n-gram vocabulary.
FEATURES = (
    "path_similarity", "segment_match_ratio", "len_ratio", "ext_match",
    "param_overlap", "domain_match", "tfidf_similarity",
)
MAX_GRAMS = 100
GRAMS = (2, 4)
# URLs of a block on each side where all pairs are scored, of a broken block at least where there are enough, and of a strip of it.
BROKEN_BLOCK, LIVE_BLOCK, LEAST_BLOCK, STRIP = 1024, 2048, 64, 32
# Pairs of blocks for each core, where there are few of them.
BLOCKS_PER_CORE = 12
# Larger blocks where the best pair is searched: what is found in the first URLs of a block rules out others.
LEADING_BROKEN, LEADING_LIVE = 8192, 16_384
PARTS = ("path", "segments", "length", "ext", "names", "host", "grams", "weights")


def path_similarity(a, b) -> Column:
    return strings.ratcliff_column(urls.url_path(a), urls.url_path(b))


def segment_match_ratio(a, b) -> Column:
    s1, s2 = urls.path_segments(a), urls.path_segments(b)
    hits = F.size(F.filter(s1, lambda s: F.array_contains(s2, s)))
    return F.when((F.size(s1) > 0) & (F.size(s2) > 0), hits / F.greatest(F.size(s1), F.size(s2))).otherwise(F.lit(0.0))


def len_ratio(a, b) -> Column:
    la, lb = F.length(a), F.length(b)
    return F.coalesce(F.try_divide(F.least(la, lb), F.greatest(la, lb)), F.lit(0.0))


def ext_match(a, b) -> Column:
    e = urls.url_extension(a)
    return ((e != "") & (e == urls.url_extension(b))).cast("double")


def param_overlap(a, b) -> Column:
    p1, p2 = urls.query_param_names(a), urls.query_param_names(b)
    return F.size(F.array_intersect(p1, p2)) / F.greatest(F.size(F.array_union(p1, p2)), F.lit(1))


def domain_match(a, b) -> Column:
    return (urls.url_host(a) == urls.url_host(b)).cast("double")


def gram_idf(corpus: DataFrame) -> DataFrame:
    """The 100 most frequent n-grams of ``corpus(url)`` with their inverse document frequency."""
    n = corpus.select(F.count("*").alias("n")).scalar()
    top = gram_totals(corpus, *GRAMS).orderBy(F.desc("total"), "gram").limit(MAX_GRAMS)
    return top.select("gram", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))


def gram_vectors(texts: DataFrame, idf: DataFrame) -> DataFrame:
    """``texts(url)`` -> ``(url, weights)``: gram -> weight, unit length, over the given n-grams; distinct texts in, and only those with one of them out."""
    # At most 100 rows by construction.
    weight = {r["gram"]: r["idf"] for r in idf.collect()}
    low, high = GRAMS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, text in zip(batch["url"], batch["text"]):
                counts = Counter(g for n in range(low, high + 1) for i in range(len(text) - n + 1) if (g := text[i:i + n]) in weight)
                if counts:
                    w = np.array([n * weight[g] for g, n in counts.items()])
                    rows.append((url, list(counts), w / np.sqrt((w * w).sum())))
            if rows:
                yield pd.DataFrame(rows, columns=["url", "grams", "w"])

    found = texts_in_tasks(texts, "url").mapInPandas(run, "url string, grams array<string>, w array<double>")
    return found.select("url", F.map_from_arrays("grams", "w").alias("weights"))


def tfidf_similarity(pairs: DataFrame, idf: DataFrame) -> DataFrame:
    """A pair looks up the n-grams of one URL by number in all weights of the other, not by name among those it has."""
    texts = pairs.select(F.col("url_404").alias("url")).union(pairs.select("live_url")).distinct()
    # Both sides of the pairs read them. At most 100 n-grams by construction.
    vectors = settle(gram_vectors(texts, idf)).withColumn("grams", idf.select(F.collect_list("gram")).scalar())
    named = vectors.select(
        F.col("url").alias("url_404"), F.transform(F.map_keys("weights"), lambda g: (F.array_position("grams", g) - 1).cast("int")).alias("na"),
        F.map_values("weights").alias("wa"))
    full = vectors.select(F.col("url").alias("live_url"), F.transform(
        "grams", lambda g: F.coalesce(F.try_element_at("weights", g), F.lit(0.0))).alias("wb"))
    both = pairs.join(named, "url_404", "left").join(full, "live_url", "left")
    product = F.aggregate(F.zip_with("na", "wa", lambda n, w: w * F.get("wb", n)), F.lit(0.0), lambda acc, x: acc + x)
    return both.withColumn("tfidf_similarity", F.round(F.coalesce(product, F.lit(0.0)), 9)).drop("na", "wa", "wb")


def repaired(c: str) -> Column:
    """NaN and NULL become 0, infinities a large finite number."""
    x = F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.least(x, F.lit(1e9)), F.lit(-1e9)).alias(c)


def pair_features(pairs: DataFrame, corpus: DataFrame | None = None, idf: DataFrame | None = None) -> DataFrame:
    """``corpus(url)`` holds the distinct URLs of the run; the n-gram vocabulary is fitted on it, unless ``idf`` is given.

    A pair with an empty URL has zeros throughout.
    """
    a, b = F.col("url_404"), F.col("live_url")
    named = {
        "path_similarity": path_similarity(a, b), "segment_match_ratio": segment_match_ratio(a, b),
        "len_ratio": len_ratio(a, b), "ext_match": ext_match(a, b), "param_overlap": param_overlap(a, b),
        "domain_match": domain_match(a, b),
    }
    with_basic = pairs.withColumns(named)
    full = tfidf_similarity(with_basic, settle(gram_idf(corpus)) if idf is None else idf)
    usable = (F.col("url_404") != "") & (F.col("live_url") != "")
    others = [c for c in pairs.columns]
    return full.select(*others, *[F.when(usable, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in FEATURES])


def _blocks(urls_of: DataFrame, row_id: str, count: Column, side: str, idf: DataFrame) -> DataFrame:
    """``count`` blocks of URLs with the parts their features are made of."""
    u = F.col("url")
    parts = urls_of.join(gram_vectors(urls_of, idf), "url", "left").select(
        F.pmod(F.xxhash64("url"), count).cast("int").alias(f"slice_{side}"), F.struct(
            F.col(row_id).alias("id"), urls.url_path(u).alias("path"), urls.path_segments(u).alias("segments"),
            F.length(u).alias("length"), urls.url_extension(u).alias("ext"), urls.query_param_names(u).alias("names"),
            urls.url_host(u).alias("host"), F.coalesce(F.map_keys("weights"), F.array().cast("array<string>")).alias("grams"),
            F.coalesce(F.map_values("weights"), F.array().cast("array<double>")).alias("weights")).alias("part"))
    blocks = parts.groupBy(f"slice_{side}").agg(F.sort_array(F.collect_list("part")).alias("b"))
    return blocks.select(f"slice_{side}", *[F.col(f"b.{c}").alias(f"{side}_{c}") for c in ("id", *PARTS)])


def _met(broken: DataFrame, live: DataFrame, idf: DataFrame, broken_block: int, live_block: int, per_core: int) -> DataFrame:
    """Each block of broken URLs with each block of live URLs: an equi-join on the numbers of both."""
    n, m = broken.count(), live.count()
    cores = broken.sparkSession.sparkContext.defaultParallelism
    right_count = max(ceil(m / live_block), 1)
    enough = min(ceil(n / LEAST_BLOCK), ceil(per_core * cores / right_count))
    left_count = max(ceil(n / broken_block), enough, 1)
    on = ["slice_broken", "slice_live"]
    # Tasks are as few as the blocks ask for.
    tasks = PAIR_TASKS * left_count * right_count
    left = _blocks(broken, "url", F.lit(left_count), "broken", idf).withColumn(on[1], F.explode(F.sequence(F.lit(0), F.lit(right_count - 1))))
    right = _blocks(live, "live_idx", F.lit(right_count), "live", idf).withColumn(on[0], F.explode(F.sequence(F.lit(0), F.lit(left_count - 1))))
    both = spread(left, *on, into=tasks).join(spread(right, *on, into=tasks), on)
    return both.drop(*on)


def all_pair_features(broken: DataFrame, live: DataFrame, idf: DataFrame, cell_of: Callable | None = None) -> DataFrame:
    """``broken(url)``, ``live(url, live_idx)`` -> ``(url_404, live_idx)`` and the features of every pair.

    Both sides hold distinct URLs, none of them empty. The pairs of two blocks are computed a strip at a time.

    ``cell_of(feature -> values)`` numbers what a model cannot tell apart. Of the live URLs of a block in one cell of a broken URL only
    that at the smallest position leaves the task.
    """
    both = _met(broken, live, idf, BROKEN_BLOCK, LIVE_BLOCK, BLOCKS_PER_CORE)
    grid, strip = strings.feature_grid, STRIP

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                # Live URLs of a block stand by position.
                a, b = ({c: list(row[f"{side}_{c}"]) for c in ("id", *PARTS)} for side in ("broken", "live"))
                ids = np.asarray(b["id"], dtype=np.int64)
                for start in range(0, len(a["id"]), strip):
                    some = {c: x[start:start + strip] for c, x in a.items()}
                    found = {c: x.ravel() for c, x in grid(some, b).items()}
                    at = np.arange(len(some["id"]) * len(ids))
                    if cell_of is not None:
                        cells = np.unique(cell_of(found), return_inverse=True)[1]
                        at = np.unique(at // len(ids) * (len(at) + 1) + cells, return_index=True)[1]
                    yield pd.DataFrame({
                        "url_404": np.asarray(some["id"], dtype=object)[at // len(ids)], "live_idx": ids[at % len(ids)],
                        **{c: found[c][at] for c in FEATURES}})

    columns = ", ".join(f"{c} double" for c in FEATURES)
    return both.mapInPandas(run, f"url_404 string, live_idx bigint, {columns}")


def leading_pairs(broken: DataFrame, live: DataFrame, idf: DataFrame, forest: Forest) -> DataFrame:
    """As ``all_pair_features``, of each broken URL only the pair with the highest score by the forest in each block of live URLs.

    All pairs are bounded by what is cheap of their features, and paths are compared where a bound is not below the best score.
    """
    block = Live

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a, b = ({c: list(row[f"{side}_{c}"]) for c in ("id", *PARTS)} for side in ("broken", "live"))
                held = block(b, forest)
                place, found = held.best(a)
                yield pd.DataFrame({"url_404": np.asarray(a["id"], dtype=object), "live_idx": held.ids[place], **found})

    columns = ", ".join(f"{c} double" for c in FEATURES)
    return _met(broken, live, idf, LEADING_BROKEN, LEADING_LIVE, PAIR_TASKS).mapInPandas(run, f"url_404 string, live_idx bigint, {columns}")
