"""Settings of a mapping run."""
from __future__ import annotations

from dataclasses import dataclass

# Algorithm names in vote order.
ALGORITHMS = (
    "jaccard", "tversky", "hamming", "ratcliff", "levenshtein", "fuzzy",
    "jaro_winkler", "vector", "bertopic", "ml", "spacy",
)

# Algorithm names in the column order of the mapping table.
MAPPING_ORDER = (
    "fuzzy", "levenshtein", "jaccard", "hamming", "ratcliff", "tversky",
    "spacy", "vector", "jaro_winkler", "bertopic", "ml",
)

# Status labels that call for a second check.
PROBLEM_STATUSES = (
    "403", "430", "500", "501", "502", "503", "504", "timeout", "error", "invalid",
)

# Thresholds, sample gate, weights and history limits.
TVERSKY_ALPHA = 0.5
TVERSKY_BETA = 0.5
SPACY_THRESHOLD = 0.4
ML_THRESHOLD = 0.7
MIN_TRAINING_SAMPLES = 100
AGREEMENT_THRESHOLD = 8
HIGH_CONFIDENCE_THRESHOLD = 10
MAX_HISTORY_SIZE = 1_000_000
HUMAN_SCORE = 999
HUMAN_WEIGHT = 10.0


@dataclass(frozen=True)
class Settings:
    algorithms: tuple[str, ...] = ALGORITHMS
    use_404check: bool = True
    clean: bool = False
    failed_labels: tuple[str, ...] = ("httpx error",)
    problem_statuses: tuple[str, ...] = PROBLEM_STATUSES
    tversky_alpha: float = TVERSKY_ALPHA
    tversky_beta: float = TVERSKY_BETA
    spacy_threshold: float = SPACY_THRESHOLD
    ml_threshold: float = ML_THRESHOLD
    min_training_samples: int = MIN_TRAINING_SAMPLES
    agreement_threshold: int = AGREEMENT_THRESHOLD
    high_confidence_threshold: int = HIGH_CONFIDENCE_THRESHOLD
    # No cut unless asked for; MAX_HISTORY_SIZE is the size to ask for.
    max_history_size: int | None = None
    topics: int = 10
    # Width of the hashed token space of fitted topics; every token has a place in it.
    topic_tokens: int = 1 << 18
    topic_rounds: int = 10
    # A join key that makes more pairs than this is split over several tasks.
    pair_budget: int = 250_000
