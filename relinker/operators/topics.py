"""Topic matcher: same topic scores the live URL's topic probability, another topic 0.3 of it."""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from relinker.config import Settings
from relinker.functions import urls
from relinker.operators.matchers import first_live, votes

# Fixed value: weight of a live URL under another topic.
OTHER_TOPIC = 0.3


def topic_match(broken: DataFrame, live: DataFrame, topics: DataFrame) -> DataFrame:
    """``topics(url, topic, prob)`` covers both sides. No pair of URLs is formed.

    Under a topic only its most probable live URL can win. For another topic only the best URL of
    the other topics can; the two best topics are enough to know it.
    """
    best = (
        live.join(topics, "url")
        .groupBy("topic")
        .agg(F.max(F.struct("prob", (-F.col("live_idx")).alias("order"), "url")).alias("b"))
    )
    # The two best topics, each by a maximum of its own, so no list of topics is gathered.
    entry = F.struct(
        (F.col("b.prob") * OTHER_TOPIC).alias("score"), F.col("b.order").alias("order"), F.col("b.url").alias("url"), "topic")
    first = best.select(F.max(entry).alias("m")).scalar()
    second = best.select(F.when(F.col("topic") != first["topic"], entry).alias("m")).select(F.max("m").alias("m")).scalar()
    out = (
        broken.join(topics.select("url", "topic"), "url")
        .join(best, "topic", "left")
        .withColumn("first", first).withColumn("second", second)
        .withColumn("other", F.when(F.col("first.topic") != F.col("topic"), F.col("first")).otherwise(F.col("second")))
        .withColumn("win", F.greatest(
            F.when(F.col("b").isNotNull(), F.struct(
                F.col("b.prob").alias("score"), F.col("b.order").alias("order"), F.col("b.url").alias("url"))),
            F.when(F.col("other").isNotNull(), F.struct(
                F.col("other.score").alias("score"), F.col("other.order").alias("order"), F.col("other.url").alias("url")))))
        .where(first_live(live).isNotNull())
    )
    hit = F.col("win.score") > 0
    return votes(
        out.select("url", F.when(hit, F.col("win.url")).alias("u"),
                   F.when(hit, F.col("win.score")).otherwise(F.lit(0.0)).alias("s"),
                   F.when(hit, -F.col("win.order")).alias("i")),
        "bertopic", "u", "s", "i")


def fit_topics(broken: DataFrame, live: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Topics of all URLs from one LDA model fitted on broken and live URLs together.

    Every round reads all URLs, and every token counts: tokens are hashed, so there is no vocabulary to cut or collect.
    """
    texts = broken.select("url").union(live.select("url")).distinct().select(
        "url", urls.nlp_tokens(F.lower("url")).alias("tokens"))
    model = Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=cfg.topic_tokens),
        LDA(k=cfg.topics, seed=42, maxIter=cfg.topic_rounds, subsamplingRate=1.0, featuresCol="counts",
            topicDistributionCol="dist"),
    ]).fit(texts)
    dist = model.transform(texts).select("url", vector_to_array("dist").alias("d"))
    return dist.select(
        "url", (F.array_position("d", F.array_max("d")) - 1).cast("int").alias("topic"), F.array_max("d").alias("prob"))
