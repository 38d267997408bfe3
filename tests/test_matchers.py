"""Every matcher against a brute-force scan of all pairs, on URLs from a seeded generator."""
import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from relinker.config import Settings
from relinker.functions import strings
from relinker.operators import matchers, topics, vectors

ALPHABET = "abcde-/._1é"


def make_urls(seed: int, n: int, hot: str) -> list[str]:
    rng = random.Random(seed)
    out = ["", "z", "qqqq", "日本", hot + "x" * 210]
    while len(out) < n:
        # A third of the URLs share a host.
        host = hot if rng.random() < 0.34 else f"http://{''.join(rng.choices('fghij', k=4))}.org/"
        out.append(host + "".join(rng.choices(ALPHABET, k=rng.randrange(0, 18))))
    return list(dict.fromkeys(out))


BROKEN = make_urls(1, 45, "https://hot.example.com/en/")
LIVE = [u for u in make_urls(2, 90, "https://hot.example.com/en/") if u != "日本"]


@pytest.fixture(scope="module")
def tables(spark):
    broken = spark.createDataFrame([(u, i) for i, u in enumerate(BROKEN)], "url string, idx bigint")
    live = spark.createDataFrame([(u, i) for i, u in enumerate(LIVE)], "url string, live_idx bigint")
    return broken.repartition(3), live.repartition(5)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b, 1):
            new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
        row = new
    return row[-1]


def sort_key(u):
    words = re.sub(r"[^A-Za-z0-9_]+", " ", u.encode("ascii", "ignore").decode()).lower().split()
    return " ".join(sorted(words))


def jaccard(a, b):
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def dice(a, b):
    x, y = set(a), set(b)
    c = len(x & y)
    below = c + 0.5 * len(x - y) + 0.5 * len(y - x)
    return c / below if below else 0.0


def hamming(a, b):
    short, long = min(len(a), len(b)), max(len(a), len(b))
    if not short:
        return 0.0
    wrong = sum(x != y for x, y in zip(a, b))
    return (1 - wrong / short) * (1 - 0.5 * ((long - short) / long))


def token_sort(a, b):
    x, y = sort_key(a), sort_key(b)
    return 1.0 if x == y else round(100 * (2 * longest_common(x, y) / (len(x) + len(y)))) / 100


BRUTE = {
    "jaccard": (jaccard, True), "tversky": (dice, True), "hamming": (hamming, False),
    "ratcliff": (lambda a, b: SequenceMatcher(None, a, b).ratio(), False),
    "levenshtein": (lambda a, b: -edit_distance(a, b), True), "fuzzy": (token_sort, False),
    "jaro_winkler": (lambda a, b: round(strings.jaro_winkler(a, b), 9), False),
}


def expected(name):
    score, always = BRUTE[name]
    out = {}
    for u in BROKEN:
        scores = [score(u, v) for v in LIVE]
        i = max(range(len(LIVE)), key=lambda k: (scores[k], -k))
        if name == "levenshtein":
            longer = max(len(u), len(LIVE[i]))
            out[u] = (LIVE[i], 1 + scores[i] / longer if longer else 1.0, i)
        else:
            out[u] = (LIVE[i], scores[i], i) if always or scores[i] > 0 else (None, 0.0, None)
    return out


# With a budget of 20 pairs most shared keys are split over several tasks.
@pytest.mark.parametrize("pair_budget", [250_000, 20])
@pytest.mark.parametrize("name", list(BRUTE))
def test_best_match_equals_brute_force(tables, name, pair_budget):
    got = getattr(matchers, name)(*tables, Settings(pair_budget=pair_budget)).collect()
    want = expected(name)
    assert len(got) == len(BROKEN)
    for r in got:
        url, score, idx = want[r["url_404"]]
        assert (r["match_url"], r["match_idx"]) == (url, idx), (r, want[r["url_404"]])
        assert r["score"] == pytest.approx(score, abs=1e-8)


@pytest.mark.parametrize("alpha, beta", [(0.0, 1.0), (1.0, 0.0), (0.2, 0.9), (0.0, 0.0), (3.0, 0.1)])
def test_tversky_weights(tables, alpha, beta):
    def score(a, b):
        x, y = set(a), set(b)
        c = len(x & y)
        below = c + alpha * len(x - y) + beta * len(y - x)
        return c / below if below else 0.0

    got = matchers.tversky(*tables, Settings(tversky_alpha=alpha, tversky_beta=beta)).collect()
    for r in got:
        scores = [score(r["url_404"], v) for v in LIVE]
        best = max(scores)
        assert r["score"] == pytest.approx(best) and scores[r["match_idx"]] == pytest.approx(best)


def grams(text, low, high):
    text = re.sub(r"\s\s+", " ", text.lower())
    return Counter(text[i:i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1))


@pytest.mark.parametrize("pair_budget", [250_000, 20])
def test_vector_equals_dictionary_tfidf(tables, pair_budget):
    docs = [grams(u, 2, 3) for u in LIVE]
    df = Counter(g for d in docs for g in d)
    idf = {g: math.log((1 + len(LIVE)) / (1 + c)) + 1 for g, c in df.items() if c >= 2}

    def unit(counts):
        v = {g: c * idf[g] for g, c in counts.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()} if norm else {}

    units = [unit(d) for d in docs]
    for r in vectors.vector(*tables, Settings(pair_budget=pair_budget)).collect():
        q = unit(grams(r["url_404"], 2, 3))
        scores = [round(sum(w * u.get(g, 0.0) for g, w in q.items()), 9) for u in units]
        assert r["score"] == pytest.approx(max(scores), abs=2e-9)
        assert scores[r["match_idx"]] == pytest.approx(max(scores), abs=2e-9)


def test_token_vectors_equal_brute_force(spark, tables):
    rng = random.Random(5)
    tokens = sorted({t for u in BROKEN + LIVE for t in u.translate(str.maketrans("/-_.", "    ")).split()})
    vecs = {t: [rng.gauss(0, 1) for _ in range(6)] for t in tokens[::2] + tokens[1::3]}
    given = spark.createDataFrame(list(vecs.items()), "token string, vector array<double>")

    def mean(u):
        rows = [vecs[t] for t in u.translate(str.maketrans("/-_.", "    ")).split() if t in vecs]
        if not rows:
            return None
        v = [sum(x) for x in zip(*rows)]
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v]

    live_vectors = [mean(u) for u in LIVE]
    want = {}
    for u in BROKEN:
        q = mean(u)
        if q is None:
            continue
        scores = [round(sum(a * b for a, b in zip(q, v)), 9) if v else 0.0 for v in live_vectors]
        if max(scores) >= 0.4:
            want[u] = max(scores)
    got = {r["url_404"]: r["score"] for r in vectors.token_vector_match(*tables, given).collect()}
    assert got.keys() == want.keys()
    assert all(got[u] == pytest.approx(want[u], abs=1e-8) for u in want)


def test_topic_match(spark):
    broken = spark.createDataFrame([("b", 0), ("c", 1)], "url string, idx bigint")
    live = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "url string, live_idx bigint")
    given = spark.createDataFrame(
        [("b", 1, 0.5), ("c", 7, 0.5), ("x", 1, 0.2), ("y", 2, 0.9), ("z", 1, 0.25)], "url string, topic int, prob double")
    got = {r["url_404"]: (r["match_url"], round(r["score"], 6)) for r in topics.topic_match(broken, live, given).collect()}
    assert got == {"b": ("y", 0.27), "c": ("y", 0.27)}


def test_sample_votes(sample):
    want = {
        "jaccard": [(0, 0.954545), (3, 0.818182), (1, 0.894737)], "tversky": [(0, 0.976744), (3, 0.9), (1, 0.944444)],
        "hamming": [(0, 0.930233), (2, 0.895349), (4, 0.824324)],
        "ratcliff": [(0, 0.930233), (2, 0.883117), (1, 0.811594)],
        "levenshtein": [(0, 0.930233), (2, 0.790698), (1, 0.72973)], "fuzzy": [(0, 0.93), (2, 0.88), (1, 0.77)],
        "jaro_winkler": [(0, 0.962093), (2, 0.95814), (4, 0.92973)],
    }
    broken, live = sample
    order = [r["url"] for r in broken.orderBy("idx").collect()]
    for name, rows in want.items():
        got = {r["url_404"]: (r["match_idx"], round(r["score"], 6)) for r in getattr(matchers, name)(broken, live).collect()}
        assert [got[u] for u in order] == rows, name
    got = {r["url_404"]: (r["match_idx"], round(r["score"], 6)) for r in vectors.vector(broken, live).collect()}
    assert [got[u] for u in order] == [(0, 1.0), (2, 0.993937), (4, 0.853055)]


def test_no_live_urls_no_votes(sample):
    broken, live = sample
    assert matchers.jaccard(broken, live.where("false")).count() == 0
    assert matchers.levenshtein(broken, live.where("false")).count() == 0


def test_no_cross_join_in_a_matcher_plan(tables):
    for name in ("jaccard", "levenshtein", "fuzzy"):
        plan = getattr(matchers, name)(*tables)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_matching_blocks_are_those_of_the_standard_library():
    rng = random.Random(3)
    pairs = [("", ""), ("", "a"), ("a", ""), ("x" * 250, "x" * 250), ("ab" * 150, "ba" * 130), ("/a/" + "x" * 300, "/a/" + "x" * 299 + "y")]
    for i in range(10_000):
        letters = rng.choice(["ab", "abc/", "abcdefghij/-.", "aé🙂\ud800"])
        longest = 260 if i % 10 == 0 else 50
        a = "".join(rng.choices(letters, k=rng.randint(0, longest)))
        b = list(a) if rng.random() < 0.6 else rng.choices(letters, k=rng.randint(0, longest))
        for _ in range(rng.randint(0, 10) if b else 0):
            b[rng.randrange(len(b))] = rng.choice(letters)
        pairs.append((a, "".join(b)))
    got = strings.ratcliff_ratios(*map(list, zip(*pairs)))
    assert got.tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert len(strings.ratcliff_ratios([], [])) == 0


def test_grams_of_few_urls_are_counted_by_all_tasks(spark):
    """A small table of URLs is one partition; its n-grams are many."""
    texts = [f"http://a.org/AbAb  {i}/aaa" for i in range(300)] + ["", "x"]
    docs = spark.createDataFrame([(u, i) for i, u in enumerate(texts)] + [(None, 999)], "url string, idx bigint").coalesce(1)
    counts = vectors.gram_counts(docs, "idx", 2, 4)
    got = {(r["idx"], r["gram"]): r["tf"] for r in counts.collect()}
    low = [" ".join(u.lower().split("  ")) for u in texts]
    want = Counter((i, u[k:k + n]) for i, u in enumerate(low) for n in (2, 3, 4) for k in range(len(u) - n + 1))
    assert got == want
    assert counts.select(F.spark_partition_id()).distinct().count() > 1


def test_ngrams_of_distinct_urls_are_counted_by_all_tasks(spark):
    """Rows that are dealt by URL already stayed in the few tasks that they were merged to."""
    made = ["http://a.org/aaa", "HTTP://B.org/é🙂é🙂", "", "x", "a  \t b"]
    docs = spark.createDataFrame([(u,) for u in [*made, None, made[0]]], "url string").distinct()
    assert vectors.texts_in_tasks(docs).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    texts = [u.lower().replace("  \t ", " ") for u in made]
    grams = [[t[i:i + n] for n in (2, 3) for i in range(len(t) - n + 1)] for t in texts]
    want = {(g, sum(x.count(g) for x in grams), sum(g in x for x in grams)) for x in grams for g in x}
    assert {tuple(r) for r in vectors.gram_totals(docs, 2, 3).collect()} == want
