"""Quality classifier: cumulative-link regression on graded ratings, with one weight vector over hashed text."""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from relinker.llm.common import settle, through_pandas

#: Grades from bad to good, as the labels give them: toxic; not toxic but of low quality; neither.
GRADES = ("toxic", "low", "good")
#: A document is selected if it is at least of this grade with this probability.
SELECT_GRADE = 1
SELECT_PROBABILITY = 0.5

#: Bounds of training: rated documents, documents a feature must occur in, width of the feature space.
TRAIN_DOCS = 4000
LEAST_DOCS = 4
HASHED = 1 << 20
PENALTY = 4e-3

TOKENS = re.compile(r"[^\W_]+|[^\w\s]+")
CACHE = 400_000


@dataclass(frozen=True)
class Ordinal:
    """P(grade > j) = logistic(weights . features - cuts[j]); ``weights`` holds the features that count."""
    weights: dict[int, float]
    cuts: tuple[float, ...]


def feature(token: str) -> int:
    return zlib.crc32(token.encode()) % HASHED


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for toxic, 1 for low and 2 for good quality; the least grade of a document with several rows.

    A null flag counts as not toxic or as low quality; a null doc_id rates nothing.
    """
    toxic, good = F.coalesce(F.col("toxic") != 0, F.lit(False)), F.coalesce(F.col("quality") != 0, F.lit(False))
    grade = F.when(toxic, 0).when(good, 2).otherwise(1)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> list:
    """(grade, feature numbers) of at most ``bound`` rated documents, chosen by a hash of their ids. Whole texts are used."""
    rated = settle(ratings(labels).withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))))
    share = min(1.0, 1.2 * bound / max(rated.count(), 1))
    chosen = rated.where(F.col("draw") < F.lit(int(share * (1 << 30)) + 1)).orderBy("draw", "doc_id").limit(bound)
    joined = F.broadcast(chosen).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted({feature(t) for t in set(TOKENS.findall(x.lower()))}) for x in batch["text"]]
            yield pd.DataFrame({"draw": batch["draw"], "doc_id": batch["doc_id"], "grade": batch["grade"], "features": found})

    schema = "draw bigint, doc_id bigint, grade int, features array<int>"
    rows = joined.mapInPandas(features, schema).orderBy("draw", "doc_id", "features").limit(2 * bound).collect()
    return [(r["grade"], r["features"]) for r in rows]


def fit(rows: list, grades: int = len(GRADES), rounds: int = 300, rate: float = 0.05) -> Ordinal:
    """Maximum likelihood with an L1 penalty by proximal Adam; the cuts stay in order."""
    n = len(rows)
    if not n:
        return Ordinal({}, tuple(float(j) for j in range(grades - 1)))
    flat = np.concatenate([np.asarray(f, np.int64) for _, f in rows]) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(f) for _, f in rows])
    names, index, docs = np.unique(flat, return_inverse=True, return_counts=True)
    common = docs[index] >= LEAST_DOCS
    kept = np.flatnonzero(docs >= LEAST_DOCS)
    place = np.zeros(len(names), np.int64)
    place[kept] = np.arange(len(kept))
    column, row = place[index[common]], owner[common]
    y = np.asarray([g for g, _ in rows])
    above = y[:, None] > np.arange(grades - 1)[None, :]
    # Rare grades weigh as much as common ones.
    counts = np.bincount(y, minlength=grades)
    weigh = (n / (np.count_nonzero(counts) * np.maximum(counts, 1)))[y]
    w, cuts = np.zeros(len(kept)), np.linspace(-1.0, 1.0, grades - 1)
    mw, vw, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)
    for i in range(1, rounds + 1):
        z = np.bincount(row, w[column], n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -30, 30)))
        # P(grade = g) is a difference of neighbouring tails.
        tails = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        own = np.maximum(tails[np.arange(n), y] - tails[np.arange(n), y + 1], 1e-9)
        bend = np.concatenate([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))], axis=1)
        up, down = bend[np.arange(n), y] / own * weigh, bend[np.arange(n), y + 1] / own * weigh
        gw = np.bincount(column, (up - down)[row], len(w)) / n
        gc = np.array([(np.where(y == j, down, 0) - np.where(y == j + 1, up, 0)).sum() for j in range(grades - 1)]) / n
        for value, m, v, g in ((w, mw, vw, gw), (cuts, mc, vc, gc)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
        step = rate / (np.sqrt(vw / (1 - 0.99 ** i)) + 1e-4)
        w += step * mw / (1 - 0.9 ** i)
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        cuts += rate * mc / (1 - 0.9 ** i) / (np.sqrt(vc / (1 - 0.99 ** i)) + 1e-8)
        cuts = np.maximum.accumulate(cuts)
    return Ordinal({int(names[k]): float(x) for k, x in zip(kept, w, strict=True) if x}, tuple(map(float, cuts)))


def predict(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every document.

    The features of a text are its distinct tokens (runs of letters and digits, runs of signs, in lower case), so a text
    of any length is read whole. A null or empty text has none and gets the grade of the cuts alone. Repeated rows get
    equal results; an empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight: dict[str, float] = {}
        cuts = np.asarray(model.cuts)
        for batch in batches:
            scores = []
            for text in batch["text"]:
                tokens = set(TOKENS.findall(text.lower()))
                if len(weight) > CACHE:
                    weight.clear()
                for t in tokens:
                    if t not in weight:
                        weight[t] = model.weights.get(feature(t), 0.0)
                # Tokens that share a feature count once.
                scores.append(sum({feature(t): weight[t] for t in tokens if weight[t]}.values()))
            tail = 1 / (1 + np.exp(-np.clip(np.asarray(scores, float)[:, None] - cuts[None, :], -30, 30)))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "expected_grade": tail.sum(axis=1), "tail_probability": tail[:, SELECT_GRADE - 1],
                "kept": tail[:, SELECT_GRADE - 1] >= SELECT_PROBABILITY})

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return through_pandas(slim, run, "doc_id bigint, expected_grade double, tail_probability double, kept boolean")


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, fit(training_rows(docs, labels)))
