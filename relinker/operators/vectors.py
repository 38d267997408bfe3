"""Matchers on vectors: TF-IDF over character n-grams, and mean token vectors."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from relinker.config import Settings
from relinker.functions import urls
from relinker.operators.blocks import best_grams, best_means
from relinker.operators.matchers import first_live, votes
from relinker.operators.nearest import EPS, pick_best
from relinker.operators.spread import PAIR_TASKS, pair_grid, shared_rows, spread, spread_join
from relinker.sources.stage import settle

GRAMS = (2, 3)
SLACK = 1e-8


def gram_counts(docs: DataFrame, doc_id: str, low: int, high: int) -> DataFrame:
    """``docs(doc_id, url)`` -> one row per document and n-gram with its count.

    URLs are short and their n-grams many: as small as a table of URLs is, all tasks share it.
    """
    grams = F.col("grams")
    counted = F.transform(F.array_distinct(grams), lambda g: F.struct(
        g.alias("gram"), (F.size(grams) - F.size(F.array_remove(grams, g))).alias("tf")))
    # Exploded, text and n-grams are columns; as expressions they would be computed anew for each n-gram, or each pair of them.
    return (
        spread(docs.select(doc_id, "url"), "url").select(doc_id, "url", F.explode(F.array(urls.gram_text("url"))).alias("text"))
        .select(doc_id, "url", F.explode(F.array(urls.ngrams("text", low, high))).alias("grams"))
        .select(doc_id, "url", F.explode(counted).alias("g")).select(doc_id, "url", "g.gram", "g.tf")
    )


def gram_totals(docs: DataFrame, low: int, high: int) -> DataFrame:
    """``docs(url)`` -> ``(gram, total, df)``: how often an n-gram stands in all documents, and in how many of them.

    A row of each n-gram and batch of documents leaves a task, not one for each document. Tasks are dealt by a hash of the text: Spark
    drops a repartition by a column that rows are already dealt by, and few tasks would be left.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total, held = Counter(), Counter()
            for text in batch["text"]:
                grams = [text[i:i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]
                total.update(grams)
                held.update(set(grams))
            # An empty column has no strings that Arrow would take it for.
            if total:
                yield pd.DataFrame({"gram": list(total), "total": list(total.values()), "df": [held[g] for g in total]}, columns=["gram", "total", "df"])

    counted = texts_in_tasks(docs).mapInPandas(run, "gram string, total bigint, df bigint")
    return counted.groupBy("gram").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def texts_in_tasks(docs: DataFrame, *columns: str) -> DataFrame:
    """The given columns and the ``text`` of each URL that n-grams are taken of, dealt over a few tasks for each core."""
    dealt = docs.repartition(PAIR_TASKS * docs.sparkSession.sparkContext.defaultParallelism, F.xxhash64("url"))
    return dealt.select(*columns, urls.gram_text("url").alias("text")).where("text is not null")


def _directions(counts: DataFrame, vocabulary: DataFrame, row_id: str) -> DataFrame:
    """(row_id, url, terms): unit TF-IDF vectors, rarest n-grams first, each as its number in the vocabulary.

    A term has its weight, the length of the vector from the term on (``from``), and without it (``after``).
    """
    weighted = counts.join(vocabulary, "gram").withColumn("w", F.col("tf") * F.col("idf")).withColumn("gram", F.col("number"))
    rows = spread(weighted, row_id).groupBy(row_id, "url").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        F.sort_array(F.collect_list(F.struct("right_rows", "gram", "w"))).alias("sorted"))
    term = "array<struct<gram:bigint,w:double,from:double,after:double>>"

    def step(state: Column, x: Column) -> Column:
        w = x["w"] / F.col("norm")
        left = F.greatest(state["left"] - w * w, F.lit(0.0))
        here = F.array(F.struct(x["gram"].alias("gram"), w.alias("w"), F.sqrt(state["left"]).alias("from"), F.sqrt(left).alias("after")))
        return F.struct(left.alias("left"), F.concat(state["terms"], here).cast(term).alias("terms"))

    start = F.struct(F.lit(1.0).alias("left"), F.array().cast(term).alias("terms"))
    return rows.select(row_id, "url", F.aggregate("sorted", start, step, lambda s: s["terms"]).alias("terms"))


def near_directions(queries: DataFrame, documents: DataFrame, budget: int) -> DataFrame:
    """Distinct (idx, live_idx) of all pairs of vectors whose cosine reaches the ``floor`` of the query, and of some others.

    Where a vector goes on with less than the floor, nothing that meets it only there can reach it. So both sides are joined on
    their terms before that, in one order of all terms. At the first term of a pair the rest of their product is at most the
    product of the lengths after it, which is tested while the pair is formed.
    """
    lowest = queries.agg(F.min("floor")).first()[0] or 0.0

    def side(df: DataFrame, row_id: str, name: str, floor: Column, *more: str) -> DataFrame:
        reaching = F.filter("terms", lambda x: x["from"] >= floor - SLACK)
        return df.select(row_id, *more, F.explode(reaching).alias("x")).select(
            row_id, *more, F.col("x.gram").alias("gram"), *[F.col(f"x.{c}").alias(f"{c}_{name}") for c in ("w", "from", "after")])

    asked = settle(side(queries, "idx", "q", F.col("floor"), "floor").drop("from_q"))
    held = settle(side(documents, "live_idx", "t", F.lit(lowest)))
    grid = pair_grid(shared_rows(asked, held, "gram"), "gram", budget)
    most = F.col("w_q") * F.col("w_t") + F.col("after_q") * F.col("after_t")
    return spread_join(asked, held, "gram", "idx", "live_idx", grid).where(
        (F.col("from_t") >= F.col("floor") - SLACK) & (most >= F.col("floor") - SLACK)).select("idx", "live_idx").distinct()


def vector(broken: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """TF-IDF cosine on character 2- and 3-grams fitted on the live URLs; always votes.

    Most pairs share frequent n-grams, so a join on n-grams makes about all of them: the vectors meet in blocks.
    """
    text = urls.gram_text("url").alias("text")
    n = live.select(F.count("*").alias("n")).scalar()
    vocabulary = settle(gram_totals(live, *GRAMS).where("df >= 2").select(
        "gram", F.col("df").alias("right_rows"), (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    best = best_grams(
        broken.select(F.col("url").alias("q"), text).distinct(),
        live.select(F.col("url").alias("t"), "live_idx", F.col("url").alias("live_url"), text),
        vocabulary.select(F.col("gram").alias("word"), F.col("idf").alias("value")), *GRAMS)

    out = (
        broken.withColumn("q", F.col("url")).join(best, "q", "left")
        .withColumn("first", first_live(live))
        .where(vocabulary.select(F.min("gram").alias("g")).scalar().isNotNull())
    )
    return votes(
        out.select("url", F.coalesce("live_url", "first.live_url").alias("u"),
                   F.coalesce("score", F.lit(0.0)).alias("s"), F.coalesce("live_idx", "first.live_idx").alias("i")),
        "vector", "u", "s", "i")


# ---- token vectors --------------------------------------------------------------------------

def tokens_of(*tables: DataFrame) -> DataFrame:
    """Distinct tokens of the ``url`` columns of the given tables."""
    parts = [t.select(F.explode(urls.nlp_tokens("url")).alias("token")).distinct() for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def unit_vectors(docs: DataFrame, doc_id: str, token_vectors: DataFrame) -> DataFrame:
    """Mean token vector per document, scaled to length 1; documents without a vector are absent."""
    tokens = docs.select(doc_id, "url", F.explode(urls.nlp_tokens("url")).alias("token"))
    mean = tokens.join(token_vectors, "token").groupBy(doc_id, "url").agg(
        vector_to_array(Summarizer.mean(array_to_vector("vector"))).alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda acc, x: acc + x * x))
    return mean.withColumn("length", length).where(F.col("length") > 0).select(
        doc_id, "url", F.transform("mean", lambda x: x / F.col("length")).alias("v"))


def token_vector_match(broken: DataFrame, live: DataFrame, token_vectors: DataFrame,
                       cfg: Settings = Settings()) -> DataFrame:
    """Cosine of mean token vectors; a URL whose best cosine is below the threshold has no vote.

    Nearly all pairs are about as far apart as any other in so many dimensions, so cells of a grid hold nearly all of them: the
    vectors meet in blocks.
    """
    text = F.array_join(urls.nlp_tokens("url"), " ").alias("text")
    held = F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull())
    best = best_means(
        broken.select(F.col("url").alias("q"), text).distinct(),
        live.select(F.col("url").alias("t"), "live_idx", F.col("url").alias("live_url"), text),
        token_vectors.select(F.col("token").alias("word"), F.when(held, F.raise_error(F.lit("a token vector is null or holds a null")))
                             .otherwise(F.col("vector")).alias("value")))
    out = broken.withColumn("q", F.col("url")).join(best.where(F.col("score") >= cfg.spacy_threshold), "q")
    return votes(out, "spacy", "live_url", "score", "live_idx")
