"""Linear-chain conditional random fields in numpy: forward-backward, Viterbi and training over batches of chains.

Chains lie behind each other in one array of words; ``lengths`` gives the words of each. All chains of a batch move one
word at a time together, the longest first, so the cost of a step is shared by all chains that are still running.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Field:
    """``weights``: features x labels; ``trans``: from label x to label."""
    labels: tuple[str, ...]
    weights: np.ndarray
    trans: np.ndarray


@dataclass(frozen=True)
class Steps:
    """The words that every step visits: step t is ``order[bounds[t]:bounds[t + 1]]``."""
    order: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> "Steps":
        lengths = np.asarray(lengths, np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        rank = np.argsort(-lengths, kind="stable")
        total = int(lengths.sum())
        place = np.arange(total) - np.repeat(starts, lengths)
        by_rank = np.empty(len(lengths), np.int64)
        by_rank[rank] = np.arange(len(lengths))
        order = np.lexsort((np.repeat(by_rank, lengths), place)) if total else np.zeros(0, np.int64)
        counts = np.bincount(place, minlength=1) if total else np.zeros(1, np.int64)
        return Steps(order, np.concatenate([[0], np.cumsum(counts)]))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def at(self, t: int) -> np.ndarray:
        return self.order[self.bounds[t]:self.bounds[t + 1]]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Marginals of the labels of each word; with ``pairs`` also the expected transitions and the log partition sum."""
    n, k = scores.shape
    steps = Steps.of(lengths)
    top = scores.max(axis=1, keepdims=True) if n else scores
    emit = np.exp(scores - top)
    move = np.exp(trans)
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    norm = np.empty(n)
    for t in range(len(steps) if n else 0):
        now = steps.at(t)
        a = emit[now] if t == 0 else (a[:len(now)] @ move) * emit[now]
        s = a.sum(axis=1)
        norm[now] = s
        a = a / s[:, None]
        alpha[now] = a
    for t in range(len(steps) - 1 if n else 0, 0, -1):
        now, before = steps.at(t), steps.at(t - 1)[:steps.bounds[t + 1] - steps.bounds[t]]
        beta[before] = ((emit[now] * beta[now]) @ move.T) / norm[now][:, None]
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    if not pairs:
        return post
    first = np.zeros(n, bool)
    first[steps.at(0)] = True
    right = np.flatnonzero(~first)
    both = alpha[right - 1][:, :, None] * move[None] * (emit[right] * beta[right] / norm[right][:, None])[:, None, :]
    return post, both.sum(axis=0), float(np.log(norm).sum() + top.sum())


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label sequence of every chain; a tie goes to the earlier label."""
    n, k = scores.shape
    steps = Steps.of(lengths)
    back = np.zeros((n, k), np.int8)
    best = np.empty(n, np.int64)
    ends: list[np.ndarray] = []
    for t in range(len(steps) if n else 0):
        now = steps.at(t)
        if t == 0:
            v = scores[now]
        else:
            ends.append(v[len(now):])
            step = v[:len(now), :, None] + trans[None]
            back[now] = step.argmax(axis=1)
            v = step.max(axis=1) + scores[now]
    if not n:
        return best
    state = v.argmax(axis=1)
    best[steps.at(len(steps) - 1)] = state
    for t in range(len(steps) - 1, 0, -1):
        now = steps.at(t)
        before = steps.at(t - 1)
        came = back[now, state]
        ended = ends[t - 1].argmax(axis=1) if len(ends[t - 1]) else np.zeros(0, np.int64)
        state = np.concatenate([came, ended])
        best[before] = state
    return best


def train(
        labels: tuple[str, ...], features: np.ndarray, owner: np.ndarray, words: np.ndarray, gold: np.ndarray,
        lengths: np.ndarray, n_features: int, rounds: int = 40, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Fits a field by full-batch Adam on the log-likelihood with an L2 penalty.

    ``features``/``owner``: feature number and distinct word of each occurrence; ``words``: the distinct word of each
    word of the chains; ``gold``: its label. Nothing is random.
    """
    k, n = len(labels), len(words)
    distinct = int(words.max()) + 1 if n else 0
    weights, trans = np.zeros((n_features, k)), np.zeros((k, k))
    first = np.zeros(n, bool)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    first[starts] = True
    right = np.flatnonzero(~first)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[right - 1], gold[right]), 1.0)
    hot = np.zeros((n, k))
    hot[np.arange(n), gold] = 1.0
    state = [(weights, np.zeros_like(weights), np.zeros_like(weights)), (trans, np.zeros_like(trans), np.zeros_like(trans))]
    for i in range(1, rounds + 1 if n else 0):
        base = np.stack([np.bincount(owner, weights[features, j], distinct) for j in range(k)], axis=1)
        post, moved, _ = forward_backward(base[words], lengths, trans, pairs=True)
        lack = hot - post
        by_word = np.stack([np.bincount(words, lack[:, j], distinct) for j in range(k)], axis=1)
        slope = np.stack([np.bincount(features, by_word[owner, j], n_features) for j in range(k)], axis=1) / n
        for (value, m, v), g in zip(state, (slope - decay * weights, (seen - moved) / n - decay * trans), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-8)
    return Field(labels, weights.astype(np.float32), trans.astype(np.float32))
