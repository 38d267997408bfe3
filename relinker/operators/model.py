"""The learned matcher: training rows, a random forest on pair features, and its nominations."""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from relinker.config import HUMAN_WEIGHT, MAPPING_ORDER, Settings
from relinker.functions.forest import Forest
from relinker.operators import consensus
from relinker.operators.features import FEATURES, gram_idf, leading_pairs, pair_features, repaired
from relinker.operators.matchers import first_live, votes as as_votes
from relinker.sources.stage import settle, shared_folder

# Forest parameters, and copies that a confident positive row counts for.
TREES = 100
DEPTH = 10
MIN_LEAF = 2
SEED = 42
CONFIDENT_COPIES = 3


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline with the n-gram weights its features come from, or the only label seen when training data had a single class."""
    pipeline: PipelineModel | None
    only_label: int | None = None
    idf: DataFrame | None = None


def auto_training_rows(votes: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Every nomination of a broken URL with enough agreement; label 1 for the chosen redirect.

    ``copies`` is how often the row counts: confident positives count three times.
    """
    agreed = consensus.consensus(votes, cfg).where(F.col("agreement") >= cfg.agreement_threshold)
    rows = consensus.candidates(votes, cfg).join(
        agreed.select("url_404", "agreement", "best_redirect"), "url_404")
    label = (F.col("match_url") == F.col("best_redirect")).cast("int")
    confident = (F.col("agreement") >= cfg.high_confidence_threshold) & (label == 1)
    copies = F.when(confident, CONFIDENT_COPIES).otherwise(1)
    return rows.select(
        "url_404", F.col("match_url").alias("live_url"), label.alias("label"),
        copies.cast("double").alias("weight"), copies.alias("copies"), F.lit("auto").alias("source"))


def human_training_rows(history: DataFrame) -> DataFrame:
    return history.where(
        (F.col("source") == "human") & F.col("url_404").isNotNull() & F.col("redirect_url").isNotNull()
    ).select("url_404", F.col("redirect_url").alias("live_url"), F.lit(1).alias("label"),
             F.lit(HUMAN_WEIGHT).alias("weight"), F.lit(1).alias("copies"), F.lit("human").alias("source"))


def training_rows(votes: DataFrame, history: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    return human_training_rows(history).unionByName(auto_training_rows(votes, cfg))


def training_gate(rows: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Training rows counted with their copies, and whether they are enough and of both classes."""
    n, positive = F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("copies"))), F.lit(0))
    return rows.agg(n.alias("n"), positive.alias("positive")).select(
        "n", "positive", (F.col("n") >= cfg.min_training_samples).alias("enough"),
        ((F.col("positive") > 0) & (F.col("positive") < F.col("n"))).alias("both_labels"))


def scaler(columns: tuple[str, ...]) -> list:
    """Stages that give ``features``: the columns less their mean, in units of their standard deviation."""
    return [
        VectorAssembler(inputCols=list(columns), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]


def scaled(data: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns, scaled over all rows; other columns stay."""
    # Read for the scale and for the result.
    data = settle(data)
    found = Pipeline(stages=scaler(columns)).fit(data).transform(data).withColumn("_scaled", vector_to_array("features"))
    others = [c for c in data.columns if c not in columns]
    return found.select(*others, *[F.col("_scaled")[i].alias(c) for i, c in enumerate(columns)])


def fit(rows: DataFrame, corpus: DataFrame, cfg: Settings = Settings()) -> Trained | None:
    """Fits the forest, or returns None while there are too few rows.

    Classes are balanced by n / (2 n_class) on top of the row weights. Repeated pairs, such as one
    verified many times, are merged before their features are computed.
    """
    merged = rows.groupBy("url_404", "live_url", "label").agg(
        F.sum("weight").alias("weight"), F.sum("copies").alias("copies"))
    seen = training_gate(merged, cfg).first()
    n, positive = seen["n"], seen["positive"]
    if not seen["enough"]:
        return None
    if not seen["both_labels"]:
        return Trained(None, int(positive > 0))
    balance = F.when(F.col("label") == 1, n / (2.0 * positive)).otherwise(n / (2.0 * (n - positive)))
    idf = settle(gram_idf(corpus))
    # Read for the scale, for the splits and for the trees: paths are compared once.
    data = settle(pair_features(merged, idf=idf).select(
        *[repaired(c) for c in FEATURES], F.col("label").cast("double").alias("label"),
        (F.col("weight") * balance).alias("weight")))
    pipeline = Pipeline(stages=[
        *scaler(FEATURES),
        RandomForestClassifier(
            labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH,
            minInstancesPerNode=MIN_LEAF, seed=SEED),
    ])
    return Trained(pipeline.fit(data), None, idf)


def confidence(pairs: DataFrame, trained: Trained) -> DataFrame:
    """Adds the positive-class probability of each pair. Its features use the n-gram weights the forest was fitted with."""
    if trained.pipeline is None:
        return pairs.withColumn("confidence", F.lit(float(trained.only_label)))
    repaired_rows = pair_features(pairs, idf=trained.idf).select(*pairs.columns, *[repaired(c) for c in FEATURES])
    return trained.pipeline.transform(repaired_rows).select(
        *pairs.columns, vector_to_array("probability")[1].alias("confidence"))


def _best_candidate(votes: DataFrame, trained: Trained, cfg: Settings) -> DataFrame:
    """Most confident of the other algorithms' nominations; ties go to the first in column order."""
    others = tuple(a for a in MAPPING_ORDER if a != "ml" and a in cfg.algorithms)
    named = votes.where(F.lower("algo").isin(*others) & F.col("match_url").isNotNull() & (F.col("match_url") != ""))
    distinct = named.groupBy("url_404", "match_url").agg(
        F.min(consensus.algo_order(F.col("algo"), others)).alias("place"), F.min("match_idx").alias("match_idx"))
    scored = confidence(distinct.withColumnRenamed("match_url", "live_url"), trained)
    best = scored.groupBy("url_404").agg(F.max(F.struct(
        "confidence", (-F.col("place")).alias("order"), "live_url", "match_idx")).alias("b"))
    return best.select(F.col("url_404").alias("url"), "b.live_url", F.col("b.confidence").alias("score"),
                       F.col("b.match_idx").alias("live_idx"))


def cells(trained: Trained) -> Callable:
    """``feature -> values`` -> a number for each row; rows of one number take the same way through every tree of the forest."""
    scaling, forest = trained.pipeline.stages[1], trained.pipeline.stages[-1]
    asked = re.findall(r"If \(feature (\d+) <= (\S+)\)", forest.toDebugString)
    splits = [np.unique([float(t) for i, t in asked if int(i) == k]) for k in range(len(FEATURES))]
    mean, deviation = scaling.mean.toArray(), scaling.std.toArray()
    scale = [1 / s if s else 0.0 for s in deviation]

    def cell_of(found: dict[str, np.ndarray]) -> np.ndarray:
        number = 0
        for k, name in enumerate(FEATURES):
            side = np.searchsorted(splits[k], (found[name] - mean[k]) * scale[k], side="left")
            number = number * (len(splits[k]) + 1) + side
        return number

    return cell_of


def forest_of(trained: Trained) -> Forest:
    """The trees as plain numbers; their nodes are read from the forest as it is saved, a few thousand rows for each tree at most."""
    scaling, forest = trained.pipeline.stages[1], trained.pipeline.stages[-1]
    mean, deviation = scaling.mean.toArray(), scaling.std.toArray()
    session = trained.idf.sparkSession
    path = f"{shared_folder(session)}/forest-{uuid4().hex}"
    forest.write().save(path)
    nodes = session.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.impurityStats",
        F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    rows = nodes.orderBy("treeID", "id").toPandas()
    inner = rows["leftChild"] >= 0
    splits = [np.unique(rows["threshold"][inner & (rows["feature"] == k)].to_numpy(float)) for k in range(len(FEATURES))]
    trees = []
    for _, tree in rows.groupby("treeID"):
        feature, threshold = tree["feature"].to_numpy(), tree["threshold"].to_numpy(float)
        place = np.array([np.searchsorted(splits[k], x) if k >= 0 else 0 for k, x in zip(feature, threshold)], np.int64)
        classes = np.array(tree["impurityStats"].tolist(), float)
        # Class by class, in the order in which the forest adds them.
        total = classes[:, :1] + classes[:, 1:]
        shares = np.divide(classes, total, out=np.zeros(classes.shape), where=total != 0)
        trees.append((feature, place, tree["leftChild"].to_numpy(), tree["rightChild"].to_numpy(), shares))
    return Forest(splits, mean.tolist(), [1 / s if s else 0.0 for s in deviation], trees)


def _best_live(broken: DataFrame, live: DataFrame, trained: Trained) -> DataFrame:
    """Most confident of all live URLs for each distinct broken URL; ties go to the smallest position."""
    queries = broken.where("url != ''").select("url").distinct()
    targets = live.where("url != ''").groupBy("url").agg(F.min("live_idx").alias("live_idx"))
    if trained.pipeline is None:
        first = queries.withColumn("f", first_live(targets)).where("f is not null")
        return first.select("url", "f.live_url", F.lit(float(trained.only_label)).alias("score"), "f.live_idx")
    queries, targets = settle(queries), settle(targets)
    scored = trained.pipeline.transform(leading_pairs(queries, targets, trained.idf, forest_of(trained)).select(
        "url_404", "live_idx", *[repaired(c) for c in FEATURES]))
    best = scored.groupBy("url_404").agg(F.max(F.struct(
        vector_to_array("probability")[1].alias("score"), (-F.col("live_idx")).alias("order"))).alias("b"))
    found = best.select(F.col("url_404").alias("url"), "b.score", (-F.col("b.order")).alias("live_idx"))
    return found.join(targets.select("live_idx", F.col("url").alias("live_url")), "live_idx").select("url", "live_url", "score", "live_idx")


def ml_first_pass(broken: DataFrame, live: DataFrame, trained: Trained, cfg: Settings = Settings()) -> DataFrame:
    """First pass: the best of all live URLs where its confidence reaches the threshold, else NULL and 0; a row per broken URL."""
    best = broken.select("url").join(_best_live(broken, live, trained), "url", "left")
    return settle(_above_threshold(best, cfg))


def ml_match(votes: DataFrame, trained: Trained, cfg: Settings = Settings()) -> DataFrame:
    """The best of the other matchers' nominations where its confidence reaches the threshold, else NULL and 0."""
    return _above_threshold(_best_candidate(votes, trained, cfg), cfg)


def _above_threshold(best: DataFrame, cfg: Settings) -> DataFrame:
    hit = F.col("score") >= cfg.ml_threshold
    return as_votes(
        best.select("url", F.when(hit, F.col("live_url")).alias("u"),
                    F.when(hit, F.col("score")).otherwise(F.lit(0.0)).alias("s"),
                    F.when(hit, F.col("live_idx")).alias("i")),
        "ml", "u", "s", "i")


def ml_consensus(votes: DataFrame, trained: Trained | None, cfg: Settings = Settings()) -> DataFrame:
    """Second pass: the best candidate, at any confidence, takes the place of the ``ml`` vote."""
    if trained is None:
        return votes
    new = as_votes(_best_candidate(votes, trained, cfg), "ml", "live_url", "score", "live_idx")
    old = votes.where(F.lower("algo") == "ml").join(new.select("url_404"), "url_404", "left_anti")
    return votes.where(F.lower("algo") != "ml").unionByName(old).unionByName(new)


def model_stats(history: DataFrame, trained: Trained | None, cfg: Settings = Settings()) -> DataFrame:
    return history.agg(
        F.lit(trained is not None).alias("model_initialized"), F.count("*").alias("history_records"),
        F.lit(cfg.min_training_samples).alias("min_training_samples"),
        F.lit(len(FEATURES) if trained is not None else 0).alias("model_features"))


def save(trained: Trained, spark: SparkSession, path: str) -> None:
    """Writes the model as one unit: the label, and where there is a forest, its pipeline and n-gram weights."""
    if trained.pipeline is not None:
        trained.pipeline.write().overwrite().save(f"{path}/pipeline")
        trained.idf.write.mode("overwrite").parquet(f"{path}/idf")
    spark.createDataFrame([(trained.only_label,)], "only_label int").write.mode("overwrite").parquet(f"{path}/label")


def load(spark: SparkSession, path: str) -> Trained:
    label = spark.read.parquet(f"{path}/label").first()["only_label"]
    if label is not None:
        return Trained(None, label)
    return Trained(PipelineModel.load(f"{path}/pipeline"), None, spark.read.parquet(f"{path}/idf"))
