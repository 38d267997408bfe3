"""The best pairs of two blocks by a forest: as if all features of all pairs were computed, though few paths are compared."""
import random
from urllib.parse import urlsplit

import numpy as np
import pytest

from relinker.functions import forest as found_in, strings

FEATURES = ("path_similarity", "segment_match_ratio", "len_ratio", "ext_match", "param_overlap", "domain_match", "tfidf_similarity")


def parts(rng, texts):
    out = {c: [] for c in ("id", "path", "segments", "length", "ext", "names", "host", "grams", "weights")}
    for i, text in enumerate(texts):
        url = urlsplit(text)
        grams = sorted({text[k:k + 2] for k in range(0, len(text) - 1, 3)} & {"ab", "bc", "/a", "a/", "aa", "ba"})
        weights = np.array([rng.random() for _ in grams])
        values = (3 * i + 5, url.path, [x for x in url.path.split("/") if x], len(text), url.path[url.path.rfind("."):] if "." in url.path else "",
                  list(dict.fromkeys(x.split("=")[0] for x in url.query.split("&") if x)), url.netloc, grams,
                  list(weights / np.sqrt((weights * weights).sum()) if grams else weights))
        for c, value in zip(out, values):
            out[c].append(value)
    return out


def addresses(rng, n):
    def word():
        return "".join(rng.choices("abc", k=rng.randint(0, 5)))
    return list(dict.fromkeys(
        f"http://{rng.choice('xyz')}.org/{word()}/{word()}{rng.choice(['', '.html', '/', '.a'])}{rng.choice(['', '?a=1', '?b=2&a=3'])}" for _ in range(n)))


def trees(rng, splits, count, depth):
    """Random trees, as lists of nodes, and the same as a function of cells."""
    made = []
    for _ in range(count):
        rows = []

        def grow(left_depth):
            at = len(rows)
            rows.append([0, 0, -1, -1, (rng.random(), rng.random())])
            if left_depth and rng.random() < 0.9:
                k = rng.randrange(7)
                rows[at][:2] = k, rng.randrange(len(splits[k]))
                rows[at][2] = grow(left_depth - 1)
                rows[at][3] = grow(left_depth - 1)
            return at

        grow(depth)
        made.append(tuple(np.array([r[i] for r in rows]) for i in range(5)))

    def score(cell):
        sums = [0.0, 0.0]
        for feature, split, left, right, shares in made:
            node = 0
            while left[node] >= 0:
                node = left[node] if cell[feature[node]] <= split[node] else right[node]
            sums = [s + x for s, x in zip(sums, shares[node])]
        return sums[1] / (sums[0] + sums[1])

    return made, score


@pytest.mark.parametrize("depth", [2, 7])
def test_best_of_a_block(monkeypatch, depth):
    rng = random.Random(depth)
    for cells in (1 << 24, 10):
        monkeypatch.setattr(found_in, "CELLS", cells)
        monkeypatch.setattr(found_in, "TOGETHER", 7)
        splits = [np.array(sorted({round(rng.uniform(-0.5, 1), 3) for _ in range(n)})) for n in (6, 4, 5, 1, 2, 1, 5)]
        mean, scale = [0.1] * 7, [1.3, 1.0, 0.9, 1.0, 0.0, 1.0, 1.1]
        nodes, score = trees(rng, splits, 8, depth)
        forest = found_in.Forest(splits, mean, scale, nodes)
        a, b = parts(rng, addresses(rng, 20)), parts(rng, addresses(rng, 120))
        grid = strings.feature_grid(a, b)
        cell = np.stack([forest.cell(k, grid[c]) for k, c in enumerate(FEATURES)], axis=2)
        want = np.array([[score(x) for x in row] for row in cell])
        place, found = found_in.Live(b, forest).best(a)
        assert [*place] == [*want.argmax(axis=1)]
        for c in FEATURES:
            assert found[c] == pytest.approx(grid[c][np.arange(len(place)), place], abs=1e-9)


def test_few_paths_are_compared(monkeypatch):
    """The score is bounded by all other features; before, the paths of all pairs were compared."""
    rng = random.Random(3)
    splits = [np.array([0.5])] * 7
    # The host decides, and then the path.
    leaf = (0, 0, -1, -1)
    rows = [(5, 0, 1, 2, (1, 0)), (*leaf, (0.9, 0.1)), (0, 0, 3, 4, (1, 0)), (*leaf, (0.5, 0.5)), (*leaf, (0.2, 0.8))]
    forest = found_in.Forest(splits, [0.0] * 7, [1.0] * 7, [tuple(np.array([r[i] for r in rows]) for i in range(5))])
    a, b = parts(rng, addresses(rng, 60)), parts(rng, addresses(rng, 900))
    compared = []
    plain = strings.ratcliff_ratios
    monkeypatch.setattr(strings, "ratcliff_ratios", lambda x, y: (compared.append(len(x)), plain(x, y))[1])
    place, found = found_in.Live(b, forest).best(a)
    assert sum(compared) < 0.2 * len(a["id"]) * len(b["id"])
    for i, j in enumerate(place):
        same = [k for k, host in enumerate(b["host"]) if host == a["host"][i]]
        near = [k for k in same if plain([a["path"][i]], [b["path"][k]])[0] > 0.5]
        assert j == (near or same)[0] and found["domain_match"][i] == 1
