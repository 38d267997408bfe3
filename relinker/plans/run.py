"""The whole run as one lazy plan per table: votes, consensus, learned vote, reports."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame

from relinker.config import Settings
from relinker.operators import consensus, history as hist, matchers, model, reports, topics, vectors
from relinker.sources.stage import settle

Matcher = Callable[..., DataFrame]

# A user adds a matcher by adding an entry here and its name to ``Settings.algorithms``.
MATCHERS: dict[str, Matcher] = {
    "jaccard": matchers.jaccard,
    "tversky": matchers.tversky,
    "hamming": matchers.hamming,
    "ratcliff": matchers.ratcliff,
    "levenshtein": matchers.levenshtein,
    "fuzzy": matchers.fuzzy,
    "jaro_winkler": matchers.jaro_winkler,
    "vector": vectors.vector,
}


def find_votes(broken: DataFrame, live: DataFrame, cfg: Settings = Settings(),
               token_vectors: DataFrame | None = None, page_topics: DataFrame | None = None,
               trained: model.Trained | None = None) -> DataFrame:
    """Votes of all enabled matchers.

    Topics that are not given are fitted. ``spacy`` cannot do without token vectors, so their absence is an error. Only
    ``ml`` may be missing: before the first run has learned from its votes there is no model.
    """
    unknown = [a for a in cfg.algorithms if a not in (*MATCHERS, "bertopic", "spacy", "ml")]
    if unknown:
        raise ValueError(f"unknown matchers: {', '.join(unknown)}")
    if "spacy" in cfg.algorithms and token_vectors is None:
        raise ValueError("the matcher spacy needs token vectors: give them or leave it out of Settings.algorithms")
    parts = [match(broken, live, cfg) for name, match in MATCHERS.items() if name in cfg.algorithms]
    if "bertopic" in cfg.algorithms:
        given = page_topics if page_topics is not None else settle(topics.fit_topics(broken, live, cfg))
        parts.append(topics.topic_match(broken, live, given))
    if "spacy" in cfg.algorithms:
        parts.append(vectors.token_vector_match(broken, live, token_vectors, cfg))
    votes = settle(reduce(DataFrame.unionByName, parts))
    if "ml" in cfg.algorithms and trained is not None:
        votes = votes.unionByName(model.ml_first_pass(broken, live, trained, cfg))
    return votes


def corpus_of(broken: DataFrame, live: DataFrame) -> DataFrame:
    return broken.select("url").union(live.select("url")).distinct()


@dataclass(frozen=True)
class Outcome:
    mapping: DataFrame
    redirects: DataFrame
    algorithm_stats: DataFrame
    quality_metrics: DataFrame
    votes: DataFrame
    history: DataFrame
    trained: model.Trained | None


def run(broken: DataFrame, live: DataFrame, history: DataFrame, cfg: Settings = Settings(),
        token_vectors: DataFrame | None = None, page_topics: DataFrame | None = None,
        trained: model.Trained | None = None, run_at: Column | None = None, votes: DataFrame | None = None) -> Outcome:
    """Votes, agreement, learned vote, agreement again, then learning from this run's agreement.

    ``votes`` are those of an earlier round over the same URLs; only the model votes anew.
    """
    learned = trained is not None and "ml" in cfg.algorithms
    if votes is None:
        votes = find_votes(broken, live, cfg, token_vectors, page_topics, trained)
    elif learned:
        votes = votes.where("lower(algo) != 'ml'").unionByName(model.ml_first_pass(broken, live, trained, cfg))
    corpus = corpus_of(broken, live)
    final_votes = settle(model.ml_consensus(votes, trained, cfg)) if learned else votes
    table = consensus.mapping(final_votes, cfg)
    refit = model.fit(model.training_rows(final_votes, history, cfg), corpus, cfg)
    grown = hist.retain(hist.add_rows(history, hist.auto_rows(final_votes, run_at, cfg)), cfg=cfg)
    return Outcome(
        mapping=table, redirects=consensus.redirects(table), algorithm_stats=reports.algorithm_stats(table, cfg),
        quality_metrics=reports.quality_metrics(table), votes=final_votes, history=grown,
        trained=refit or trained)


def two_rounds(broken: DataFrame, live: DataFrame, history: DataFrame, cfg: Settings = Settings(),
               token_vectors: DataFrame | None = None, page_topics: DataFrame | None = None) -> Outcome:
    """A first round without a model, then a second over its votes with the model it has learned, if there was enough to learn."""
    first = run(broken, live, history, cfg, token_vectors, page_topics)
    if first.trained is None:
        return first
    return run(broken, live, history, cfg, trained=first.trained, votes=first.votes)
