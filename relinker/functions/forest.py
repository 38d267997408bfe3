"""The best pairs of two blocks of URLs by a forest of their features, without computing all features of all pairs.

A forest compares each feature with a few numbers, so pairs with every feature in the same of the ranges between them (a cell) have one
score. All features but the similarity of paths are cheap: their cell bounds the score over all ranges of that similarity, and only pairs
whose bound reaches the best score so far have their paths compared.
"""
from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from relinker.functions import blocks, strings

# The helpers travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Broken URLs that meet a block of live ones at a time, and pairs of each whose paths are compared first.
TOGETHER, LEADERS = 64, 16
# Ranges of products that a table gives the cell of, how far off single precision may be, and the most cells that have a table.
BINS, OFF, CELLS = 1 << 14, 2e-5, 1 << 24
UNKNOWN = 255
# Scores made at a time.
SCORED = 1 << 14


class Forest:
    """Trees over cells: ``splits`` are the numbers that each feature, less its mean and times its scale, is compared with.

    A tree is (feature, place among its splits, left, right, share of either class) of each node, -1 for the children of a leaf. It is held
    as the leaves that each range of each feature leaves open, a bit each; all features together leave one.
    """

    def __init__(self, splits: list, mean: list, scale: list, trees: list):
        self.splits, self.mean, self.scale = splits, mean, scale
        self.trees = [self._leaves(*tree) for tree in trees]

    def _leaves(self, feature, split, left, right, shares) -> tuple[list, np.ndarray]:
        order, spans = [], {}
        todo = [(0, False)]
        while todo:
            node, done = todo.pop()
            if left[node] < 0:
                spans[node] = len(order), len(order) + 1
                order.append(node)
            elif done:
                spans[node] = spans[left[node]][0], spans[right[node]][1]
            else:
                todo += [(node, True), (right[node], False), (left[node], False)]
        opened = [np.ones((self.ranges(k), -(-len(order) // 64) * 64), bool) for k in range(len(self.splits))]
        for node in spans:
            if left[node] >= 0:
                (low, middle), (_, high) = spans[left[node]], spans[right[node]]
                opened[feature[node]][split[node] + 1:, low:middle] = False
                opened[feature[node]][:split[node] + 1, middle:high] = False
        for x in opened:
            x[:, len(order):] = False
        return [np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in opened], np.asarray(shares)[order]

    def cell(self, k: int, values) -> np.ndarray:
        return np.searchsorted(self.splits[k], (values - self.mean[k]) * self.scale[k], side="left")

    def ranges(self, k: int) -> int:
        return len(self.splits[k]) + 1

    def scores(self, cells: np.ndarray) -> np.ndarray:
        """The probability of the positive class for rows of cells of all features but the first, a column for each range of the first.

        Shares are summed in the order of the trees.
        """
        out = np.empty((len(cells), self.ranges(0)))
        step = max(1, SCORED // self.ranges(0))
        for start in range(0, len(cells), step):
            some = cells[start:start + step]
            negative, positive = np.zeros((2, len(some), self.ranges(0)))
            for opened, shares in self.trees:
                leaf = np.zeros(negative.shape, np.int64)
                for w in range(opened[0].shape[1]):
                    rest = opened[1][some[:, 0], w]
                    for k in range(2, len(opened)):
                        rest = rest & opened[k][some[:, k - 1], w]
                    one = rest[:, None] & opened[0][:, w]
                    leaf += np.where(one != 0, 64 * w + np.bitwise_count(one - np.uint64(1)).astype(np.int64), 0)
                negative += shares[leaf, 0]
                positive += shares[leaf, 1]
            total = negative + positive
            out[start:start + step] = np.divide(positive, total, out=positive.copy(), where=total != 0)
        return out


class Live:
    """A block of live URLs by position, beside a forest. ``parts`` are those of ``strings.feature_grid``."""

    def __init__(self, parts: dict[str, list], forest: Forest):
        self.forest, self.parts = forest, parts
        self.ids = np.asarray(parts["id"], dtype=np.int64)
        self.places = np.arange(len(self.ids))
        # What stands for many URLs is looked at once: lengths, extensions, names of parameters and hosts together.
        number: dict = {}
        self.common = np.array([number.setdefault((n, e, tuple(x), h), len(number)) for n, e, x, h in zip(
            parts["length"], parts["ext"], parts["names"], parts["host"])], np.int64)
        self.lengths = np.array([c[0] for c in number], float)
        self.exts, self.hosts = (np.array([c[i] for c in number], dtype=object) for i in (1, 3))
        self.names_at, self.names = _numbered([c[2] for c in number])
        self.name_counts = np.array([len(x) for x in self.names], float)
        self.sizes = np.array([len(x) for x in parts["segments"]], np.int64)
        where: dict[str, list[int]] = {}
        for j, items in enumerate(parts["segments"]):
            for x in set(items):
                where.setdefault(x, []).append(j)
        self.where = {x: np.array(v, np.int64) for x, v in where.items()}
        self.grams = {g: i for i, g in enumerate(sorted({g for names in parts["grams"] for g in names}))}
        self.weights = self.table(parts["grams"], parts["weights"])
        self.single = np.ascontiguousarray(self.weights.T.astype(np.float32))
        self.path_at, self.paths = _numbered(parts["path"])
        self.strip = blocks.Strip(self.paths)
        # Cells of the cheap features as one number, the similarity of paths left out.
        self.ranges = [forest.ranges(k) for k in range(1, 7)]
        self.radix = np.cumprod([1, *self.ranges[:-1]])
        self.space = int(np.prod(np.array(self.ranges, float)))
        self.dense = self.space <= CELLS
        self.row_of = np.full(self.space, -1, np.int64) if self.dense else {}
        # The score in each range of the similarity of paths, the highest of it and of those below, of each cell that was met.
        self.scores = np.zeros((0, forest.ranges(0)))
        self.most = self.scores
        # Products in single precision, by ranges none of which holds a split.
        self.product_cells = self._product_cells()

    def table(self, grams: list, weights: list) -> np.ndarray:
        out = np.zeros((len(grams), len(self.grams)))
        for i, (names, values) in enumerate(zip(grams, weights)):
            for g, w in zip(names, values):
                if g in self.grams:
                    out[i, self.grams[g]] = w
        return out

    def _product_cells(self) -> np.ndarray:
        edges = (np.arange(BINS + 1) - 1) / (BINS - 2)
        low, high = self.forest.cell(6, edges[:-1] - OFF), self.forest.cell(6, edges[1:] + OFF)
        out = np.where((low == high) & (low < UNKNOWN), low, UNKNOWN).astype(np.uint8)
        # All that is out of range.
        out[[0, -1]] = UNKNOWN
        return out

    def rows_of(self, code: np.ndarray) -> np.ndarray:
        """The rows of ``scores`` of some cells; those not met before are scored."""
        if not self.dense:
            codes, at = np.unique(code, return_inverse=True)
            found = np.array([self.row_of.get(int(c), -1) for c in codes], np.int64)
            new = codes[found < 0]
            self.row_of.update(zip(new.tolist(), range(len(self.scores), len(self.scores) + len(new))))
            self._score(new)
            return np.array([self.row_of[int(c)] for c in codes], np.int64)[at].reshape(code.shape)
        found = self.row_of[code]
        if found.size and found.min() < 0:
            new = np.unique(code[found < 0])
            self.row_of[new] = len(self.scores) + np.arange(len(new))
            self._score(new)
            found = self.row_of[code]
        return found

    def _score(self, new: np.ndarray) -> None:
        scores = self.forest.scores(new[:, None] // self.radix % self.ranges)
        self.scores = np.concatenate([self.scores, scores])
        self.most = np.concatenate([self.most, np.maximum.accumulate(scores, axis=1)])

    def common_values(self, a: dict, i: int) -> tuple[np.ndarray, ...]:
        """Four features of a broken URL with what stands for many live ones."""
        names = list(a["names"][i])
        shared = np.array([float(sum(x in held for x in names)) for held in self.names])
        overlap = shared / np.maximum(len(names) + self.name_counts - shared, 1)
        n = a["length"][i]
        ext = a["ext"][i]
        return (
            np.minimum(n, self.lengths) / np.maximum(n, self.lengths),
            ((self.exts == ext) & (ext != "")).astype(float),
            overlap[self.names_at],
            (self.hosts == a["host"][i]).astype(float))

    def hits(self, a: dict, i: int) -> np.ndarray:
        out = np.zeros(len(self.ids), np.int64)
        for x in a["segments"][i]:
            if x in self.where:
                out[self.where[x]] += 1
        return out

    def codes(self, a: dict, i: int, weights: np.ndarray, products: np.ndarray) -> np.ndarray:
        """The cheap cell of a broken URL with each live one."""
        forest = self.forest
        common = sum(forest.cell(k, v) * self.radix[k - 1] for k, v in zip((2, 3, 4, 5), self.common_values(a, i)))
        hits, own = self.hits(a, i), len(a["segments"][i])
        sizes = np.arange(int(self.sizes.max()) + 1)
        table = forest.cell(1, np.arange(own + 1)[:, None] / np.maximum(np.maximum(own, sizes), 1)) * self.radix[0]
        out = common[self.common] + table.ravel()[hits * len(sizes) + self.sizes]
        at = np.clip(products * np.float32(BINS - 2) + 1, 0, BINS - 1).astype(np.int32)
        cell = self.product_cells[at].astype(np.int64)
        unknown = np.flatnonzero(cell == UNKNOWN)
        if len(unknown):
            cell[unknown] = forest.cell(6, np.round(self.weights[unknown] @ weights, 9))
        return out + cell * self.radix[5]

    def best(self, a: dict[str, list]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Of each broken URL the first live URL with the highest score, and the features of this pair, by name."""
        forest = self.forest
        found = np.zeros(len(a["id"]), np.int64)
        values: list[tuple] = []
        similar: list[float] = []
        weights = self.table(a["grams"], a["weights"])
        for start in range(0, len(found), TOGETHER):
            some = np.arange(start, min(start + TOGETHER, len(found)))
            products = weights[some].astype(np.float32) @ self.single
            rows = self.rows_of(np.stack([self.codes(a, i, weights[i], products[i - start]) for i in some]))
            bound = self.most[:, -1][rows]
            asked = self.strip.asked([a["path"][i] for i in some])
            score, place = np.full(len(some), -1.0), np.full(len(some), len(self.ids), np.int64)
            ratio = np.zeros(len(some))

            def compare(x: np.ndarray, y: np.ndarray) -> None:
                """Paths of pairs (x of the broken URLs, y of the live ones)."""
                pairs, at = np.unique(x * len(self.paths) + self.path_at[y], return_inverse=True)
                px, py = np.divmod(pairs, len(self.paths))
                ratios = strings.ratcliff_ratios([asked.texts[i] for i in px], [self.paths[j] for j in py])[at]
                got = self.scores[rows[x, y], forest.cell(0, ratios)]
                order = np.lexsort((y, -got, x))
                first = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(order) else order
                i, s, p = x[first], got[first], y[first]
                better = (s > score[i]) | (s == score[i]) & (p < place[i])
                score[i[better]], place[i[better]], ratio[i[better]] = s[better], p[better], ratios[first][better]

            highest = bound.max(axis=1)
            leaders = [np.flatnonzero(bound[i] == highest[i])[:LEADERS] for i in range(len(some))]
            x, y = np.repeat(np.arange(len(some)), [len(v) for v in leaders]), np.concatenate(leaders)
            compare(x, y)
            seen = np.zeros(bound.shape, bool)
            seen[x, y] = True
            x, y = np.nonzero(((bound > score[:, None]) | (bound == score[:, None]) & (self.places < place[:, None])) & ~seen)
            # What paths may have in common, from their letters: ranges of similarity above that are out.
            total = asked.lengths[x] + self.strip.lengths[self.path_at[y]]
            upper = np.where(total > 0, 2.0 * self.shared(asked, x, self.path_at[y]) / np.maximum(total, 1), 1.0)
            reached = self.most[rows[x, y], forest.cell(0, upper)]
            size = LEADERS
            while len(x):
                open_pairs = (reached > score[x]) | (reached == score[x]) & (y < place[x])
                x, y, reached = x[open_pairs], y[open_pairs], reached[open_pairs]
                order = np.lexsort((y, -reached, x))
                x, y, reached = x[order], y[order], reached[order]
                now = np.arange(len(x)) - np.searchsorted(x, x) < size
                compare(x[now], y[now])
                x, y, reached = x[~now], y[~now], reached[~now]
                size *= 2
            found[some] = place
            similar.extend(ratio.tolist())
            for i, j in zip(some, place):
                common = self.common_values(a, i)
                own = len(a["segments"][i])
                values.append((self.hits(a, i)[j] / max(own, self.sizes[j], 1), *[v[self.common[j]] for v in common],
                               np.round(self.weights[j] @ weights[i], 9)))
        columns = np.array(values).reshape(len(found), 6).T
        return found, dict(zip(
            ("path_similarity", "segment_match_ratio", "len_ratio", "ext_match", "param_overlap", "domain_match", "tfidf_similarity"),
            (np.array(similar), *columns)))

    def shared(self, asked: blocks.Queries, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """At least as many letters as each pair of paths shares."""
        out = np.minimum(self.strip.rest[y], asked.rest[x]).astype(np.int64)
        for mine, other in zip(asked.words, self.strip.words):
            out += np.bitwise_count(mine[x] & other[y])
        return out


def _numbered(items: list) -> tuple[np.ndarray, list]:
    """The number of each item and the distinct items."""
    number: dict = {}
    return np.array([number.setdefault(x, len(number)) for x in items], np.int64), list(number)
