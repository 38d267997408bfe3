"""Searches by blocks: exact against all pairs, for blocks and strips of any size, and little leaves a pair of blocks."""
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from relinker.functions import blocks as found_in, strings
from relinker.operators import blocks, matchers, vectors

from test_matchers import hamming, longest_common

LETTERS = ("ab", "abc/.-1", "abcdefghijklmnopqrstuvwxyz0123456789/.:-", "aé🙂日本\ud800")


def percent(a, b):
    return 100 if a == b else round(100 * (2 * longest_common(a, b) / (len(a) + len(b))))


BRUTE = {
    "ratcliff": lambda a, b: SequenceMatcher(None, a, b).ratio(), "fuzzy": percent, "hamming": hamming,
    "jaro_winkler": lambda a, b: round(strings.jaro_winkler(a, b), 9)}


def texts(rng, letters, longest, n):
    made = ["".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(n)]
    return list(dict.fromkeys([*made, *rng.choice([[], ["", "x" * 210]])]))


@pytest.mark.parametrize("name", list(BRUTE))
def test_nearest_of_a_block(monkeypatch, name):
    rng = random.Random(name)
    for letters in LETTERS:
        for longest in (3, 20, 66):
            monkeypatch.setattr(found_in, "STRIP_CELLS", rng.choice([200, 1 << 21]))
            monkeypatch.setattr(found_in, "QUERIES", rng.choice([3, 256]))
            monkeypatch.setattr(found_in, "LETTERS", rng.choice([2, 64]))
            queries, targets = texts(rng, letters, longest, 25), texts(rng, letters, longest, 60)
            queries = list(dict.fromkeys([*queries, *targets[:3], "zzz"]))
            rng.shuffle(targets)
            score, place = found_in.nearest(name, queries, targets)
            for i, q in enumerate(queries):
                all_scores = [BRUTE[name](q, t) for t in targets]
                best = max(range(len(targets)), key=lambda k: (all_scores[k], -k))
                assert (score[i], place[i]) == ((all_scores[best], best) if all_scores[best] > 0 else (0, -1)), (q, targets[best])


def test_nearest_vectors(monkeypatch):
    rng = np.random.default_rng(2)
    for dense in (0, 3, 128):
        monkeypatch.setattr(found_in, "DENSE", dense)

        def rows(n):
            terms = [rng.choice(40, size=rng.integers(0, 12), replace=False) for _ in range(n)]
            return terms, [rng.random(len(x)) for x in terms]

        (qt, qw), (tt, tw) = rows(70), rows(90)
        score, place = found_in.nearest_vectors([x * (1 << 33) for x in qt], qw, [x * (1 << 33) for x in tt], tw)
        for i, (x, w) in enumerate(zip(qt, qw)):
            products = [round(sum(w[x == k][0] * v[y == k][0] for k in set(x) & set(y)), 9) for y, v in zip(tt, tw)]
            assert score[i] == pytest.approx(max(products), abs=2e-9)
            assert place[i] == -1 if max(products) == 0 else products[place[i]] == pytest.approx(max(products), abs=2e-9)


def test_one_row_of_a_query_leaves_two_blocks(spark, monkeypatch):
    """A join on letters would make a row of every pair here."""
    monkeypatch.setattr(blocks, "TARGET_BLOCK", 100)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 20)
    rows = {}
    plain = blocks.pick_best
    monkeypatch.setattr(blocks, "pick_best", lambda df: plain(rows.setdefault("found", df)))
    queries = spark.createDataFrame([(f"http://a.org/{i}/x",) for i in range(60)], "q string")
    targets = spark.createDataFrame([(f"http://a.org/{i}/y", i, f"u{i}") for i in range(400)], "t string, live_idx bigint, live_url string")
    got = {r["q"]: (r["live_idx"], r["live_url"]) for r in blocks.best_strings(queries, targets, "ratcliff").collect()}
    assert got == {f"http://a.org/{i}/x": (i, f"u{i}") for i in range(60)}
    assert 60 < rows["found"].count() <= 60 * 4


def test_ties_in_blocks_go_to_the_first_position(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TARGET_BLOCK", 2)
    queries = spark.createDataFrame([("abc",), (None,)], "q string")
    targets = spark.createDataFrame(
        [("abd", None, "z"), ("abe", 7, "y"), ("abf", 5, "x"), ("abg", 6, "w"), (None, 1, "v")], "t string, live_idx bigint, live_url string")
    for name in BRUTE:
        assert [tuple(r)[2:] for r in blocks.best_strings(queries, targets, name).collect()] == [(5, "x")], name


def test_nearest_directions():
    rng = np.random.default_rng(3)
    queries, targets = rng.normal(size=(70, 5)), rng.normal(size=(90, 5))
    queries[3], targets[7] = -targets.sum(axis=0), targets[4]
    targets[8, 2] = np.nan
    queries[4] = targets[7]
    score, place = found_in.nearest_directions(list(map(list, queries)), list(targets))
    for i, q in enumerate(queries):
        products = [round(float(q @ t), 9) if np.isfinite(t).all() else 0 for t in targets]
        best = max(range(len(targets)), key=lambda k: (products[k], -k))
        assert score[i] == pytest.approx(max(products[best], 0), abs=2e-9)
        assert place[i] == (best if products[best] > 0 else -1)


def test_token_vectors_copy_no_row_to_every_pair(spark, monkeypatch):
    """Cells of a grid hold all of these, as all are about as far apart."""
    rows = {}
    plain = blocks.pick_best
    monkeypatch.setattr(blocks, "pick_best", lambda df: plain(rows.setdefault("found", df)))
    rng = random.Random(4)
    given = spark.createDataFrame([(f"t{i}", [rng.gauss(0, 1) for _ in range(16)]) for i in range(160)], "token string, vector array<double>")
    broken = spark.createDataFrame([(f"t{i}/t{i + 1}", i) for i in range(60)], "url string, idx bigint")
    live = spark.createDataFrame([(f"t{i}/t{i + 1}/t{i + 2}", i) for i in range(100)], "url string, live_idx bigint")
    got = {r["url_404"]: r["match_idx"] for r in vectors.token_vector_match(broken, live, given).collect()}
    assert len(got) == 60 and rows["found"].count() == 60


def test_blocks_of_queries_follow_the_cores(spark, monkeypatch):
    """Each block of queries copies all targets: their number must not grow with the partitions of a shuffle."""
    counts = {}
    plain = blocks.spread
    monkeypatch.setattr(blocks, "spread", lambda df, *keys, **more: (counts.setdefault("left", df), plain(df, *keys, **more))[1])
    queries = spark.createDataFrame([(f"http://a.org/{i}/x",) for i in range(3000)], "q string")
    targets = spark.createDataFrame([(f"http://a.org/{i}/y", i, f"u{i}") for i in range(20)], "t string, live_idx bigint, live_url string")
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        blocks.best_strings(queries, targets, "hamming")
        assert counts["left"].count() <= blocks.PAIR_TASKS * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_travel_after_a_ratio_was_a_column(spark):
    """A function that has been used holds the session, and must not travel with the helpers."""
    assert spark.range(1).select(strings.ratcliff_column(F.lit("ab"), F.lit("ab"))).first()[0] == 1.0
    queries = spark.createDataFrame([("abc",)], "q string")
    targets = spark.createDataFrame([("abd", 1, "x")], "t string, live_idx bigint, live_url string")
    assert blocks.best_strings(queries, targets, "hamming").first()["live_idx"] == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_nearest_edits_of_a_block(monkeypatch):
    """Words of bits carry from one to the next: strings of up to 210 characters beside short ones."""
    rng = random.Random(7)
    for letters in LETTERS:
        for longest in (3, 20, 66, 140):
            monkeypatch.setattr(found_in, "STRIP_CELLS", rng.choice([200, 1 << 21]))
            monkeypatch.setattr(found_in, "PAIRS", rng.choice([7, 1 << 14]))
            queries, targets = texts(rng, letters, longest, 12), texts(rng, letters, longest, 40)
            near = ["".join(c for c in t if rng.random() < 0.9) + "b" for t in targets[:4]]
            queries = list(dict.fromkeys([*queries, *near, *targets[:3], "zzz", "x" * 64, "x" * 65, "x" * 128]))
            rng.shuffle(targets)
            score, place = found_in.nearest("levenshtein", queries, targets)
            for i, q in enumerate(queries):
                filled = [k for k, t in enumerate(targets) if bool(t) == bool(q)]
                if not filled:
                    assert place[i] == -1
                    continue
                best = min(filled, key=lambda k: (edits(q, targets[k]), k)) if q else filled[0]
                assert (found_in.FAR - score[i], place[i]) == (edits(q, targets[best]), best), (q, targets[best])


@pytest.mark.parametrize("alpha, beta", [(1.0, 1.0), (0.5, 0.5), (0.0, 1.0), (3.0, 0.1), (0.0, 0.0)])
def test_nearest_sets_of_a_block(monkeypatch, alpha, beta):
    rng = random.Random(8)
    for letters in LETTERS:
        monkeypatch.setattr(found_in, "DENSE", rng.choice([0, 3, 128]))
        queries, targets = texts(rng, letters, 20, 70), texts(rng, letters, 20, 50)
        score, place = found_in.nearest_sets(queries, targets, alpha, beta)
        for i, q in enumerate(queries):
            scores = []
            for t in targets:
                a, b, c = len(set(q)), len(set(t)), len(set(q) & set(t))
                below = c + alpha * (a - c) + beta * (b - c)
                scores.append(c / below if below > 0 else 0.0)
            best = max(range(len(targets)), key=lambda k: (scores[k], -k))
            assert (score[i], place[i]) == ((scores[best], best) if scores[best] > 0 else (0, -1)), (q, targets[best])


@pytest.mark.parametrize("name", ["levenshtein", "jaccard", "tversky"])
def test_no_near_pair_leaves_two_blocks(spark, monkeypatch, name):
    """Nearly all of these are near one another: a join on what they share would make a row of every pair."""
    monkeypatch.setattr(blocks, "TARGET_BLOCK", 100)
    rows = []
    plain = blocks.pick_best
    monkeypatch.setattr(blocks, "pick_best", lambda df: (rows.append(df), plain(df))[1])
    broken = spark.createDataFrame([(f"http://a.org/{i:03}/x", i) for i in range(60)], "url string, idx bigint")
    live = spark.createDataFrame([(f"http://a.org/{i:03}/y", i) for i in range(400)], "url string, live_idx bigint")
    got = {r["url_404"]: r["match_idx"] for r in getattr(matchers, name)(broken, live).collect()}
    assert len(got) == 60 and rows[0].count() <= 60 * 4
    if name == "levenshtein":
        assert got == {f"http://a.org/{i:03}/x": i for i in range(60)}


def test_blocks_of_vectors_are_not_copied(spark, monkeypatch):
    """Copies of a block for each block of the other side grow with the product of both sides."""
    monkeypatch.setattr(blocks, "TARGET_BLOCK", 50)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 20)
    held = []
    plain = blocks.settle
    monkeypatch.setattr(blocks, "settle", lambda df: (held.append(plain(df)), held[-1])[1])
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    queries = spark.createDataFrame([(f"q{i}", vector()) for i in range(100)], "q string, v array<double>")
    targets = spark.createDataFrame([(f"t{i}", i, f"u{i}", vector()) for i in range(300)], "t string, live_idx bigint, live_url string, v array<double>")
    assert blocks.best_directions(queries, targets).count() == 100
    left, right = [df for df in held if df.columns[0].startswith("slice_")]
    assert sum(len(r["query_q"]) for r in left.collect()) == 100 and sum(len(r["target_t"]) for r in right.collect()) == 300
    assert 1 < left.count() == left.rdd.getNumPartitions() and 1 < right.count() == right.rdd.getNumPartitions()


def test_tasks_follow_the_blocks(spark, monkeypatch):
    """A few blocks must not start as many tasks as a shuffle has partitions."""
    made = []
    spread = blocks.spread
    monkeypatch.setattr(blocks, "spread", lambda df, *keys, **more: (made.append(spread(df, *keys, **more)), made[-1])[1])
    queries = spark.createDataFrame([(f"http://a.org/{i}/x",) for i in range(30)], "q string")
    targets = spark.createDataFrame([(f"http://a.org/{i}/y", i, f"u{i}") for i in range(20)], "t string, live_idx bigint, live_url string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        blocks.best_strings(queries, targets, "hamming")
        assert [df.rdd.getNumPartitions() for df in made] == [blocks.PAIR_TASKS] * 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_vectors_of_texts_are_those_of_their_words(monkeypatch):
    rng = random.Random(8)
    made = [x for letters in LETTERS for x in texts(rng, letters, 9, 20)]
    grams = lambda x: [x[i:i + n] for n in (2, 3) for i in range(len(x) - n + 1)]
    idf = {g: rng.uniform(1, 3) for x in made for g in grams(x) if rng.random() < 0.6}
    terms, weights = found_in.unit_terms(made, list(idf), list(idf.values()), 2, 3)
    for x, own, w in zip(made, terms, weights, strict=True):
        want = {g: grams(x).count(g) * idf[g] for g in {*grams(x)} & {*idf}}
        length = sum(v * v for v in want.values()) ** 0.5
        assert len(own) == len({*own.tolist()}) and np.allclose(sorted(w), sorted(v / length for v in want.values()))
    words = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [0.0, 3.0]), ("z", [0.0, 0.0])]
    got = found_in.unit_means(["a a b", "b c", "", "z", "c"], [w for w, _ in words], [v for _, v in words])
    assert np.allclose(got, [[2 / 20 ** 0.5, 4 / 20 ** 0.5], [0, 1], [0, 0], [0, 0], [0, 0]])


def test_vectors_do_not_move_with_every_row(spark, monkeypatch):
    """What is known of a word moves to a block once, not with each row of the block that has the word, and blocks of both sides are written once."""
    monkeypatch.setattr(blocks, "TARGET_BLOCK", 50)
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 20)
    held = []
    plain = blocks.settle
    monkeypatch.setattr(blocks, "settle", lambda df: (held.append(plain(df)), held[-1])[1])
    broken = spark.createDataFrame([(f"com/{i % 7}/{i}x", i) for i in range(60)], "url string, idx bigint")
    live = spark.createDataFrame([(f"com/{i % 7}/{i}y", i) for i in range(120)], "url string, live_idx bigint")
    rng = random.Random(2)
    names = ["com", *map(str, range(7))]
    given = spark.createDataFrame([(t, [rng.gauss(0, 1) for _ in range(8)]) for t in names], "token string, vector array<float>")
    got = vectors.token_vector_match(broken, live, given)
    assert {r["url_404"]: r["match_idx"] for r in got.collect()} == {f"com/{i % 7}/{i}x": i % 7 for i in range(60)}
    [made] = [df for df in held if "side" in df.columns]
    rows = made.collect()
    assert sum(len(r["key"]) for r in rows) == 180 and len(rows) > 4
    assert all(len({*r["word"]}) == len(r["word"]) == len(r["value"]) <= 8 for r in rows)
    assert sum(len(r["value"]) for r in rows) < 180
    assert made.rdd.getNumPartitions() == max(sum(r["side"] == s for r in rows) for s in ("query", "target"))


def addresses(n, seed=4):
    rng = random.Random(seed)
    hosts = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(40)]
    return list(dict.fromkeys(f"http://{rng.choice(hosts)}.org/{rng.choice(['en', 'fr'])}/{rng.randint(0, 9999)}" for _ in range(n)))


@pytest.mark.parametrize("name", ["hamming", "levenshtein", "fuzzy", "ratcliff"])
def test_few_pairs_of_a_block_are_scored(monkeypatch, name):
    """Neighbours by text give a floor, so that common bits rule out nearly all pairs, of places too."""
    reach, scored = found_in.MEASURES[name]
    pairs = []
    monkeypatch.setitem(found_in.MEASURES, name, (reach, lambda q, strip, a, b, floor: (pairs.append(len(a)), scored(q, strip, a, b, floor))[1]))
    made = addresses(3500)
    queries, targets = made[:300], made[300:]
    score, place = found_in.nearest(name, queries, targets)
    assert sum(pairs) < 0.04 * len(queries) * len(targets)
    for i in range(0, 300, 60):
        if name in BRUTE:
            all_scores = [BRUTE[name](queries[i], t) for t in targets]
            assert (score[i], place[i]) == (max(all_scores), all_scores.index(max(all_scores)))


def test_few_groups_of_vectors_are_multiplied(monkeypatch):
    """A bound for a group of vectors that stand together decides; all products are not made."""
    monkeypatch.setattr(found_in, "COLUMNS", 512)
    made = addresses(3500)
    queries, targets = made[:200], made[200:]
    grams = sorted({g for t in targets for n in (2, 3) for g in (t[i:i + n] for i in range(len(t) - n + 1))})
    weights = [1.0 + len(g) + i % 7 for i, g in enumerate(grams)]
    sides = [*found_in.unit_terms(queries, grams, weights, 2, 3), *found_in.unit_terms(targets, grams, weights, 2, 3)]
    expected = found_in._nearest_vectors_in_pairs(*sides)
    monkeypatch.setattr(found_in, "_products", None)
    met = []
    table = found_in.Groups.table
    monkeypatch.setattr(found_in.Groups, "table", lambda self, g: (met.append(g), table(self, g))[1])
    order = np.argsort(np.array(targets))
    # One query at a time, so that each group it is multiplied with is counted.
    for i in range(0, 200, 40):
        met.clear()
        score, place = found_in.nearest_vectors(sides[0][i:i + 1], sides[1][i:i + 1], *sides[2:], None, order)
        assert (score[0], place[0]) == (expected[0][i], expected[1][i])
        assert len(met) < 0.5 * len(targets) / found_in.GROUP


def test_vectors_with_negative_weights_or_no_terms():
    one, two = [np.array([1, 2]), np.array([], int)], [np.array([-1.0, 0.5]), np.array([])]
    score, place = found_in.nearest_vectors(one, two, one[::-1], two[::-1])
    assert list(place) == [1, -1] and score[0] == 1.25
    score, place = found_in.nearest_vectors(one[1:], two[1:], one, two)
    assert list(place) == [-1]


def test_sets_are_compared_as_bits(monkeypatch):
    """No product of every pair is made."""
    monkeypatch.setattr(found_in, "_products", None)
    score, place = found_in.nearest_sets(["abc", "", "xyz"], ["bcd", "abcd", "abcd", "", "é"], 1.0, 1.0)
    assert list(place) == [1, -1, -1] and score[0] == 0.75


def test_directions_beyond_single_precision():
    """Scores that single precision cannot tell apart, or hold, are those of double precision."""
    targets = [[1.0, 1e-9], [1.0, 2e-8], [1.0, 0.0]]
    score, place = found_in.nearest_directions([[1.0, 1.0], [1e30, 0.0]], targets)
    assert place[0] == 1 and score[0] == pytest.approx(1 + 2e-8, abs=1e-12)
    assert place[1] == 0 and score[1] == pytest.approx(1e30)


def test_blocks_without_any_match(spark):
    queries = spark.createDataFrame([("abc",)], "q string")
    targets = spark.createDataFrame([("xyz", 0, "u")], "t string, live_idx bigint, live_url string")
    assert blocks.best_strings(queries, targets, "ratcliff").count() == 0


def test_a_single_block_is_one_partition_of_a_product(spark, monkeypatch):
    """A product with partitions that hold no block has as many tasks without a pair."""
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 10)
    found = []
    plain = blocks._compared
    monkeypatch.setattr(blocks, "_compared", lambda both, *rest: (found.append(both.rdd.getNumPartitions()), plain(both, *rest))[1])
    live = spark.createDataFrame([(f"http://a.org/{i}", i) for i in range(30)], "url string, live_idx bigint")
    broken = spark.createDataFrame([(f"http://a.org/{i}/x", i) for i in range(40)], "url string, idx bigint")
    assert vectors.vector(broken, live).count() == 40 and found == [4]
