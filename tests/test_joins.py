"""The joins below the matchers: sizes of their groups, rows they let through, and exactness of the segment search."""
import random

import pytest
from pyspark.sql import functions as F

from relinker.operators import segments, sets, spread, vectors

from test_matchers import edit_distance


def sides(spark, n, m, keys=4):
    """Every row has the same few keys and one of its own."""
    def side(rows, name):
        return spark.range(rows).select(F.col("id").alias(name), F.explode(F.concat(
            F.array(*[F.lit(f"common {i}") for i in range(keys)]), F.array(F.concat(F.lit(f"{name} "), F.col("id"))))).alias("key"))
    return side(n, "l"), side(m, "r")


@pytest.mark.parametrize("n, m", [(2000, 3000), (3, 9000), (9000, 3)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_groups_of_a_split_join_are_bounded(spark, monkeypatch, n, m, broadcast):
    budget = 10_000
    if not broadcast:
        monkeypatch.setattr(spread, "BROADCAST_KEYS", 0)
    seen = {}
    plain = spread.spread

    def watched(df, *keys, times=1):
        if len(keys) == 3:
            seen["l" if "l" in df.columns else "r"] = df.groupBy(*keys).count()
        return plain(df, *keys, times=times)

    monkeypatch.setattr(spread, "spread", watched)
    left, right = sides(spark, n, m)
    grid = spread.pair_grid(spread.shared_rows(left, right, "key"), "key", budget)
    joined = spread.spread_join(left, right, "key", "l", "r", grid)
    assert joined.count() == joined.distinct().count() == 4 * n * m
    on = ["key", "slice_left", "slice_right"]
    groups = seen["l"].withColumnRenamed("count", "a").join(seen["r"].withColumnRenamed("count", "b"), on)
    # Slices are dealt by hash, so they vary about their mean.
    assert groups.select(F.max(F.col("a") * F.col("b"))).first()[0] <= 1.5 * budget
    assert spread.pair_grid(spread.shared_rows(left, right, "key"), "key", n * m).isEmpty()


def urls(rng, n):
    hosts = [f"https://{w}.example.org/en/" for w in ("www.alpha", "blog.beta", "m.gamma", "delta", "www.epsilon", "zeta", "blog.eta", "m.theta")]
    return sorted({rng.choice(hosts) + str(rng.randrange(10_000)) + rng.choice(["", "/", ".html", "?page=2"]) for _ in range(n)})


def test_segments_find_the_nearest(spark):
    rng = random.Random(4)
    short = ["", "a", "ab", "ba", "abc", "zzzz", "日本", "日本語x", "A" * 300, "İstanbul", "ab" * 20]
    broken = sorted({*urls(rng, 60), *("".join(rng.choices("ab1", k=rng.randrange(12))) for _ in range(40)), *short, "qqqqqqqqqqqqqqqqqqqqqqqqqqqq"})
    live = sorted({*urls(rng, 150), *("".join(rng.choices("ab1", k=rng.randrange(12))) for _ in range(60)), *short[3:]} - {""})
    rng.shuffle(live)
    found, rest = segments.nearest_edits(
        spark.createDataFrame([(x,) for x in broken], "q string"),
        spark.createDataFrame([(x, i, x) for i, x in enumerate(live)], "t string, live_idx bigint, live_url string"), 1000)
    got = {r["q"]: (r["distance"], r["live_idx"]) for r in found.collect()}
    left = {r["q"] for r in rest.collect()}
    assert got.keys() | left == set(broken) and not got.keys() & left
    for q in broken:
        best = min((edit_distance(q, t), i) for i, t in enumerate(live))
        if q in got and got[q] != best:
            # Only a target that keeps no character in place may be nearer or earlier.
            assert best[0] == max(len(q), len(live[best[1]]))
        elif q in left:
            assert best[0] > segments.ROUNDS[-1] or best[0] == max(len(q), len(live[best[1]]))
    assert sum(q in got for q in broken) > 100


def test_segment_join_lets_few_pairs_through(spark):
    rng = random.Random(6)
    broken, live = urls(rng, 300), urls(rng, 700)

    def prepared(texts, text, prefix):
        df = spark.createDataFrame([(x, i) for i, x in enumerate(texts)], f"{text} string, live_idx bigint")
        return df.select("*", *[b.alias(f"{prefix}_bits{i}") for i, b in enumerate(segments.letter_bits(F.col(text)))])

    targets = prepared(live, "t", "t").withColumn("len", F.length("t"))
    queries = prepared(broken, "q", "q").drop("live_idx")
    cuts = segments.shape(targets).select("len", segments.edges(3).alias("edges"))
    rows = segments.candidates(queries, targets, cuts, 3, 10_000)
    assert rows.count() <= 0.1 * len(broken) * len(live)
    held = segments.postings(targets, cuts)
    # Key, index and two words of bits to a posting.
    assert 32 * held.count() <= 10 * sum(map(len, live))
    pairs = {(r["q"], live[r["live_idx"]]) for r in rows.collect()}
    near = {(q, t) for q in broken for t in live if q[8:12] == t[8:12] and edit_distance(q, t) <= 3}
    assert near and near <= pairs


@pytest.mark.parametrize("alpha, beta", [(1.0, 1.0), (0.5, 0.5), (0.1, 2.0)])
def test_set_join_keeps_all_near_pairs_and_few_others(spark, alpha, beta):
    rng = random.Random(8)
    broken, live = (sorted({"".join(sorted(set(u + "".join(rng.choices("XYZ#~", k=rng.randrange(3)))))) for u in urls(rng, n)}) for n in (150, 400))
    held = spark.createDataFrame([(x, i, x) for i, x in enumerate(live)], "t string, live_idx bigint, live_url string")
    order = sets.rarity(held)
    targets = sets.prepared(held, "t", order, "t")
    queries = sets.prepared(spark.createDataFrame([(x,) for x in broken], "q string"), "q", order, "q")
    rows = sets.candidates(queries, targets, max(map(len, live)), 0.9, alpha, beta, 1000)
    pairs = {(r["q"], live[r["live_idx"]]) for r in rows.collect()}

    def score(q, t):
        a, b = set(q), set(t)
        return len(a & b) / (len(a & b) + alpha * len(a - b) + beta * len(b - a))
    near = {(q, t) for q in broken for t in live if score(q, t) >= 0.9}
    assert near and near == pairs


def test_direction_join_keeps_near_pairs_and_few_others(spark):
    rng = random.Random(9)
    hosts = [f"https://{''.join(rng.choices('abcdefghijklmnopqrstuvwxyz', k=8))}.org/" for _ in range(40)]
    broken, live = ([rng.choice(hosts) + "".join(rng.choices("abcdefghijk/-", k=rng.randrange(6, 20))) for _ in range(n)] for n in (100, 300))
    broken, live = list(dict.fromkeys(broken)), list(dict.fromkeys(live))
    documents = spark.createDataFrame(list(enumerate(live)), "live_idx bigint, url string")
    counts = vectors.gram_counts(documents, "live_idx", 2, 3)
    vocabulary = counts.groupBy("gram").agg(F.count("*").alias("right_rows")).withColumn(
        "idf", F.log(F.lit(1 + len(live)) / (1 + F.col("right_rows"))) + 1).withColumn("number", F.xxhash64("gram"))
    held = vectors._directions(counts, vocabulary, "live_idx")
    queries = spark.createDataFrame(list(enumerate(broken)), "idx bigint, url string")
    asked = vectors._directions(vectors.gram_counts(queries, "idx", 2, 3), vocabulary, "idx").withColumn("floor", F.lit(0.6))
    pairs = {(r["idx"], r["live_idx"]) for r in vectors.near_directions(asked, held, 1000).collect()}

    def unit(rows, row_id):
        return {r[row_id]: {x["gram"]: x["w"] for x in r["terms"]} for r in rows.collect()}
    left, right = unit(asked, "idx"), unit(held, "live_idx")
    near = {(i, j) for i, q in left.items() for j, t in right.items() if sum(w * t.get(g, 0.0) for g, w in q.items()) >= 0.6}
    assert near and near <= pairs
    assert len(pairs) <= 0.2 * len(broken) * len(live)
