"""Pair similarities with no built-in counterpart, as Arrow-batched helpers.

The searches in ``functions.blocks`` score with them what their bounds leave.
"""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# The helpers travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Cells of the tables that a batch of string pairs is matched in.
MATCH_CELLS = 1 << 17
# In a second string of this length or more, characters in over 1% of the places (and one more) start no block.
LONG, RARE_PER = 200, 100


def _codes(texts: list[str], fill: int) -> np.ndarray:
    """Code points of the strings, one row each, filled up."""
    out = np.full((len(texts), max(map(len, texts), default=0)), fill, np.int32)
    for i, text in enumerate(texts):
        out[i, :len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _window(codes: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, fill) -> np.ndarray:
    place = low[:, None] + np.arange(int((high - low).max()))
    cut = codes[row[:, None], np.minimum(place, codes.shape[1] - 1)]
    cut[place >= high[:, None]] = fill
    return cut


def _longest_blocks(a: np.ndarray, b: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of the first longest common run of each row; rows come highest first.

    One step takes the next character of every row of a: a run that ends at a place of b is one longer than the run that ended
    a place before.
    """
    n, width = b.shape
    runs = np.zeros((n, width + 1), np.int32)
    size, at_a, at_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        k = int(np.searchsorted(-heights, -i, side="left"))
        new = (runs[:k, :-1] + 1) * (b[:k] == a[:k, i, None])
        runs[:k, 1:] = new
        end = new.argmax(axis=1)
        length = new[np.arange(k), end]
        better = np.flatnonzero(length > size[:k])
        size[better] = length[better]
        at_a[better], at_b[better] = i - length[better] + 1, end[better] - length[better] + 1
    return at_a, at_b, size


def _matched(a_texts: list[str], b_texts: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair: the longest common block, then the same on both sides of it.

    All open stretches of all pairs are searched together, round by round.
    """
    a, b = _codes(a_texts, -1), _codes(b_texts, -2)
    starts = b.copy()
    for i, text in enumerate(b_texts):
        if len(text) >= LONG:
            seen, at, count = np.unique(b[i, :len(text)], return_inverse=True, return_counts=True)
            starts[i, :len(text)][(count > len(text) // RARE_PER + 1)[at]] = -2
    frequent = bool((starts != b).any())
    out = np.zeros(len(a_texts), np.int64)
    row = np.arange(len(a_texts))
    low_a, low_b = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    high_a, high_b = np.array([len(x) for x in a_texts]), np.array([len(x) for x in b_texts])
    while True:
        order = np.argsort(low_a - high_a, kind="stable")
        order = order[((low_a < high_a) & (low_b < high_b))[order]]
        if not len(order):
            return out
        row, low_a, high_a, low_b, high_b = (x[order] for x in (row, low_a, high_a, low_b, high_b))
        at_a, at_b, size = _longest_blocks(
            _window(a, row, low_a, high_a, -1), _window(starts, row, low_b, high_b, -2), high_a - low_a)
        at_a, at_b = low_a + at_a, low_b + at_b
        if frequent:
            # A block goes on over characters that start none.
            for step in (-1, 1):
                open_rows = np.arange(len(row))
                while len(open_rows):
                    x = at_a[open_rows] - 1 if step < 0 else at_a[open_rows] + size[open_rows]
                    y = at_b[open_rows] - 1 if step < 0 else at_b[open_rows] + size[open_rows]
                    inside = (x >= low_a[open_rows]) & (x < high_a[open_rows]) & (y >= low_b[open_rows]) & (y < high_b[open_rows])
                    open_rows, x, y = open_rows[inside], x[inside], y[inside]
                    open_rows = open_rows[a[row[open_rows], x] == b[row[open_rows], y]]
                    size[open_rows] += 1
                    if step < 0:
                        at_a[open_rows] -= 1
                        at_b[open_rows] -= 1
        np.add.at(out, row, size)
        hit = size > 0
        row, size, at_a, at_b, low_a, high_a, low_b, high_b = (x[hit] for x in (row, size, at_a, at_b, low_a, high_a, low_b, high_b))
        row = np.concatenate([row, row])
        low_a, high_a = np.concatenate([low_a, at_a + size]), np.concatenate([at_a, high_a])
        low_b, high_b = np.concatenate([low_b, at_b + size]), np.concatenate([at_b, high_b])


def ratcliff_ratios(a: list, b: list) -> np.ndarray:
    """Ratcliff/Obershelp ratio of each pair: twice the characters in matching blocks by those of both strings; 1 for two empty ones."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    matched = np.zeros(len(total), np.int64)
    # Pairs of about one length share a batch, so little of it is filling.
    order = np.argsort(total, kind="stable")
    start = 0
    while start < len(order):
        stop = min(len(order), start + MATCH_CELLS)
        while stop > start + 1 and (stop - start) * int(total[order[stop - 1]]) > MATCH_CELLS:
            stop = start + (stop - start) // 2
        some = order[start:stop]
        matched[some] = _matched([a[i] for i in some], [b[i] for i in some])
        start = stop
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word style row per character of b."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with 0.1 per common leading character (at most 4) when Jaro is above 0.7."""
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    taken = [False] * lb
    in_a = []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), i + reach + 1)
        while j >= 0 and taken[j]:
            j = b.find(ch, j + 1, i + reach + 1)
        if j >= 0:
            taken[j] = True
            in_a.append(ch)
    m = len(in_a)
    if not m:
        return 0.0
    in_b = [ch for ch, used in zip(b, taken) if used]
    swaps = sum(x != y for x, y in zip(in_a, in_b)) // 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    lead = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        lead += 1
    return jaro + 0.1 * lead * (1 - jaro)


def ratcliff_column(q: Column, t: Column) -> Column:
    # Made where it is used: a function that has been used holds a part of the session, which cannot travel with this module.
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratcliff_ratios(a.tolist(), b.tolist()), dtype="float64")
    return F.pandas_udf(ratios, DoubleType())(q, t)


def ratcliff_grid(a: list, b: list) -> np.ndarray:
    """Ratio of every string of a with every string of b."""
    a_at, a_texts = pd.factorize(np.asarray(a, dtype=object))
    b_at, b_texts = pd.factorize(np.asarray(b, dtype=object))
    grid = ratcliff_ratios(np.repeat(a_texts, len(b_texts)).tolist(), np.tile(b_texts, len(a_texts)).tolist())
    return grid.reshape(len(a_texts), len(b_texts))[np.ix_(a_at, b_at)]


def contained_grid(a: list, b: list) -> np.ndarray:
    """How many items of every list of a are in every list of b."""
    where: dict[str, list[int]] = {}
    for j, items in enumerate(b):
        for x in set(items):
            where.setdefault(x, []).append(j)
    out = np.zeros((len(a), len(b)))
    for i, items in enumerate(a):
        for x in items:
            if x in where:
                out[i, where[x]] += 1
    return out


def _weight_rows(grams: list, weights: list, column: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(grams), len(column)))
    for i, (names, values) in enumerate(zip(grams, weights)):
        out[i, [column[g] for g in names]] = values
    return out


def feature_grid(a: dict[str, list], b: dict[str, list]) -> dict[str, np.ndarray]:
    """The features of every pair of a URL of a and a URL of b, from the parts of each URL."""
    def outer(name: str, step) -> np.ndarray:
        return step(np.asarray(a[name])[:, None], np.asarray(b[name])[None, :])

    def sizes(name: str, step) -> np.ndarray:
        return step(np.array([[len(x)] for x in a[name]]), np.array([[len(x) for x in b[name]]]))

    shared = contained_grid(a["names"], b["names"])
    column = {g: i for i, g in enumerate(sorted({g for side in (a, b) for names in side["grams"] for g in names}))}
    return {
        "path_similarity": ratcliff_grid(a["path"], b["path"]),
        "segment_match_ratio": contained_grid(a["segments"], b["segments"]) / np.maximum(sizes("segments", np.maximum), 1),
        "len_ratio": outer("length", np.minimum) / outer("length", np.maximum),
        "ext_match": (outer("ext", np.equal) & (np.asarray(a["ext"]) != "")[:, None]).astype(float),
        "param_overlap": shared / np.maximum(sizes("names", np.add) - shared, 1),
        "domain_match": outer("host", np.equal).astype(float),
        "tfidf_similarity": np.round(
            _weight_rows(a["grams"], a["weights"], column) @ _weight_rows(b["grams"], b["weights"], column).T, 9),
    }


def common_chars(a: Column, b: Column) -> Column:
    """Number of characters shared by two strings of distinct characters."""
    return F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))
