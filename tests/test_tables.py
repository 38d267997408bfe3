"""Check log, consensus, history, review, features, model and storage."""
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from relinker import schemas
from relinker.config import Settings
from relinker.operators import checks, consensus, features, history, model, reports, review
from relinker.plans import run
from relinker.sources import sinks, stage, tables


def votes_of(spark, rows):
    return spark.createDataFrame(rows, schemas.VOTES)


def test_prepare_urls(spark):
    df = spark.createDataFrame([("b", 3), ("a", 2), (None, 1), ("a", 0)], "` Link ` string, n int")
    got = tables.prepare_urls(df, "Link", F.col("n")).orderBy("idx").collect()
    assert [(r["url"], r["idx"]) for r in got] == [("a", 0), ("b", 3)]
    with pytest.raises(ValueError):
        tables.prepare_urls(df, "URL", F.col("n"))
    with pytest.raises(ValueError):
        tables.require_columns(df, ["link", "URL"])


def test_checks(spark):
    rows = [("a", 1, "503", None), ("a", 2, "404", None), ("b", 1, "503", None), ("b", 2, "200", None),
            ("c", 1, "browser error", None), ("d", 1, "200", None), ("d", 2, "404", None)]
    log = spark.createDataFrame(rows, schemas.CHECKS)
    overlay = checks.retry_overlay(log)
    assert {r["url"]: r["status"] for r in overlay.collect()} == {"a": "404", "b": "200", "c": "browser error", "d": "200"}
    assert {r["url"] for r in checks.broken_only(overlay).collect()} == {"a"}
    listed = Settings(failed_labels=("browser error",))
    assert {r["url"] for r in checks.broken_only(overlay, listed).collect()} == {"a", "c"}
    assert checks.broken_only(overlay, Settings(use_404check=False)).count() == 4
    hops = spark.createDataFrame([
        ("u", 1, None, [("u", 301, "v"), ("v", 404, None)]), ("w", 1, None, []),
    ], schemas.CHECKS)
    got = {r["url"]: (r["status_followed"], r["status_own"]) for r in checks.check_status(hops).collect()}
    assert got == {"u": (404, 301), "w": (200, 200)}
    assert [r["n_redirects"] for r in checks.redirect_chains(hops).orderBy("url").collect()] == [1, 0]


def test_consensus_ties_and_blanks(spark):
    votes = votes_of(spark, [
        ("q", "jaccard", "u", 0.9, 0), ("q", "tversky", "u", 0.1, 0), ("q", "hamming", "v", 0.6, 1),
        ("q", "ML", "v", 0.5, 1), ("q", "mystery", "w", 9.0, 2), ("p", "hamming", None, 0.0, None)])
    got = {r["url_404"]: r for r in consensus.mapping(votes).collect()}
    q = got["q"]
    assert (q["best_redirect"], q["agreement"]) == ("v", 2) and q["ml"] == "v" and q["ml_score"] == 0.5
    assert q["best_redirect_tot_score"] == pytest.approx(1.1) and q["tot_score"] == pytest.approx(2.1)
    p = got["p"]
    assert (p["agreement"], p["best_redirect"], p["best_redirect_tot_score"], p["fuzzy_score"]) == (0, None, 0.0, 0.0)
    flags = consensus.agreement_flags(votes, consensus.consensus(votes)).where("is_best").collect()
    assert {r["algo"] for r in flags} == {"hamming", "ml"}


def test_algorithm_stats_percentages(spark):
    cfg = Settings(algorithms=("jaccard",))
    table = spark.createDataFrame(
        [("a", "x", "x"), ("b", "y", "z"), ("c", None, "z"), ("d", None, None)],
        "url_404 string, jaccard string, best_redirect string")
    assert reports.algorithm_stats(table, cfg).first()["percentage"] == "33.33%"
    assert reports.algorithm_stats(table.where("best_redirect is null"), cfg).first()["percentage"] == "0%"


def at(i):
    return datetime(2024, 1, 1) + timedelta(hours=i)


def history_rows(spark, human, high, others):
    rows = [(at(i), f"h/en/{i}", "r", 999, 1.0, "human", True, "human") for i in range(human)]
    rows += [(at(50 + i), f"k/en/{i}", "r", 10, 1.0, "fuzzy", True, "auto") for i in range(high)]
    rows += [(at(100 + i), f"o{lang}{i}", "r", None if i == 0 else 8, 1.0, "fuzzy", True, None)
             for i, lang in enumerate(others)]
    return spark.createDataFrame(rows, schemas.HISTORY)


def test_retention(spark):
    past = history_rows(spark, 4, 3, ["/en/"] * 6 + ["/fr/"] * 2 + ["-"])
    kept = history.retain(past, 10).collect()
    assert len(kept) == 10
    assert sum(r["source"] == "human" for r in kept) == 4
    assert {r["url_404"] for r in kept if r["url_404"].startswith("o")} == {"o/en/5", "o/fr/7", "o-8"}
    assert history.retain(past, 3).count() == 4
    assert history.retain(past, 16).count() == 16
    assert {r["url_404"] for r in history.retain(past, 6).collect() if r["source"] == "auto"} == {"k/en/2", "k/en/1"}


def test_newest_with_one_timestamp(spark):
    """A run stamps all its rows alike; the cut is still exact."""
    rows = [(at(0), f"u/en/{i:04d}", "r", 1, 1.0, "fuzzy", True, "auto") for i in range(500)]
    past = spark.createDataFrame(rows, schemas.HISTORY).repartition(7)
    assert {r["url_404"] for r in history.newest(past, 123).collect()} == {f"u/en/{i:04d}" for i in range(123)}
    assert history.newest_per_language(past, 50).count() == 50


def test_add_rows_fills_missing_columns(spark):
    old = spark.createDataFrame([("a", 3)], "url_404 string, agreement_score bigint")
    new = spark.createDataFrame([("b", True, "human")], "url_404 string, is_best_match boolean, source string")
    got = {r["url_404"]: (r["agreement_score"], r["is_best_match"], r["source"]) for r in history.add_rows(old, new).collect()}
    assert got == {"a": (3, False, "auto"), "b": (0, True, "human")}


def eleven(agree, best="best", rest=("x", "y")):
    names = Settings().algorithms
    urls = [best] * agree + [rest[i % len(rest)] for i in range(len(names) - agree)]
    return [("q", a, u, 0.5, i) for i, (a, u) in enumerate(zip(names, urls))]


def test_training_rows(spark):
    rows = model.auto_training_rows(votes_of(spark, eleven(9) )).collect()
    assert {(r["live_url"], r["label"], r["copies"]) for r in rows} == {("best", 1, 1), ("x", 0, 1), ("y", 0, 1)}
    rows = model.auto_training_rows(votes_of(spark, eleven(10))).collect()
    assert {(r["live_url"], r["label"], r["weight"]) for r in rows} == {("best", 1, 3.0), ("x", 0, 1.0)}
    assert model.auto_training_rows(votes_of(spark, eleven(7, rest=("x", "y", "z", "w")))).count() == 0
    human = model.human_training_rows(history_rows(spark, 2, 1, [])).collect()
    assert {(r["label"], r["weight"]) for r in human} == {(1, 10.0)} and len(human) == 2


def test_review(spark, sample):
    broken, live = sample
    base = "https://www.example.com"
    votes = votes_of(spark, [
        (f"{base}/about/x", "jaccard", f"{base}/products", 1.0, 1), (f"{base}/about/x", "tversky", f"{base}/", 1.0, 4),
        (f"{base}/about/x", "fuzzy", f"{base}/", 1.0, 4), (f"{base}/gone", "hamming", None, 0.0, None)])
    queue = review.review_queue(votes, live)
    got = [(r["url_404"], r["option_no"], r["option_url"], r["is_parent"]) for r in queue.orderBy("url_404", "option_no").collect()]
    assert got == [(f"{base}/about/x", 1, f"{base}/", False), (f"{base}/about/x", 2, f"{base}/products", False),
                   (f"{base}/gone", 1, f"{base}/", True)]
    verdicts = spark.createDataFrame(
        [(f"{base}/about/x", "2", None), (f"{base}/about/x", "9", None), (f"{base}/gone", "M", f"{base}/about/team "),
         (f"{base}/gone", "m", "nowhere"), (f"{base}/gone", "skip", None)], schemas.VERDICTS)
    pairs = review.verified_pairs(queue, verdicts, live).collect()
    assert {(r["url_404"], r["live_url"]) for r in pairs} == {
        (f"{base}/about/x", f"{base}/products"), (f"{base}/gone", f"{base}/about/team")}


def test_pair_features(spark):
    a, b = "https://h.com/en/a/b.html?x=1&y=2", "https://h.com/en/b.html?x=3&z="
    corpus = spark.createDataFrame([(a,), (b,)], "url string")
    pairs = spark.createDataFrame([(a, b), ("", b)], "url_404 string, live_url string")
    got = {r["url_404"]: r for r in features.pair_features(pairs, corpus).collect()}
    r = got[a]
    assert r["segment_match_ratio"] == pytest.approx(2 / 3) and r["path_similarity"] == pytest.approx(0.909091, abs=1e-6)
    assert (r["ext_match"], r["param_overlap"], r["domain_match"]) == (1.0, 0.5, 1.0)
    assert 0 < r["tfidf_similarity"] <= 1
    assert all(got[""][c] == 0.0 for c in features.FEATURES)


def test_model_learns_saves_and_loads(spark, tmp_path):
    urls = [f"https://h{i % 7}.com/en/item-{i}.html" for i in range(60)]
    rows = [(u, u.replace("item", "items"), 1, 1.0, 1, "auto") for u in urls]
    rows += [(u, urls[(i * 13 + 5) % 60] + "?page=2", 0, 1.0, 1, "auto") for i, u in enumerate(urls)]
    train = spark.createDataFrame(rows, "url_404 string, live_url string, label int, weight double, copies int, source string")
    corpus = spark.createDataFrame([(u,) for u in sorted({r[0] for r in rows} | {r[1] for r in rows})], "url string")
    assert model.fit(train.limit(10), corpus) is None
    only = model.fit(train.where("label = 1"), corpus, Settings(min_training_samples=10))
    assert only.only_label == 1
    trained = model.fit(train, corpus)
    votes = votes_of(spark, [(urls[0], "jaccard", rows[60][1], 1.0, 1), (urls[0], "fuzzy", rows[0][1], 1.0, 0)])
    voted = {r["algo"]: r for r in model.ml_consensus(votes, trained).collect()}
    assert voted["ml"]["match_url"] == rows[0][1] and voted["ml"]["score"] > 0.7
    model.save(trained, spark, str(tmp_path / "m"))
    again = model.load(spark, str(tmp_path / "m"))
    assert model.ml_match(votes, again).first()["score"] == pytest.approx(voted["ml"]["score"])
    # The loaded model brings its own n-gram weights, whatever URLs it meets.
    assert {tuple(r) for r in again.idf.collect()} == {tuple(r) for r in trained.idf.collect()}
    model.save(only, spark, str(tmp_path / "one"))
    assert model.load(spark, str(tmp_path / "one")) == only
    assert {r["score"] for r in model.ml_match(votes, only).collect()} == {1.0}
    assert model.model_stats(tables.empty_history(spark), None).first()["model_features"] == 0


def test_one_live_url_of_a_cell_leaves_a_block(spark):
    """Of live URLs that the model cannot tell apart the first leaves; a row for each pair left before."""
    idf = spark.createDataFrame([("/a", 1.0)], "gram string, idf double")
    broken = spark.createDataFrame([(f"http://a.org/a{i}",) for i in range(40)], "url string")
    live = spark.createDataFrame([(f"http://{'ab'[i % 2]}.org/a{i}", 90 - i) for i in range(90)], "url string, live_idx bigint")
    by_host = features.all_pair_features(broken, live, idf, lambda found: found["domain_match"].astype(int))
    assert {(r["live_idx"], r["domain_match"]) for r in by_host.collect()} == {(1, 0.0), (2, 1.0)} and by_host.count() == 80


def test_model_votes_for_the_best_of_all_live_urls(spark):
    shown = [f"https://h{i % 7}.com/en/item-{i}.html" for i in range(60)]
    rows = [(u, u.replace("item", "items"), 1, 1.0, 1, "auto") for u in shown]
    rows += [(u, shown[(i * 13 + 5) % 60] + "?page=2", 0, 1.0, 1, "auto") for i, u in enumerate(shown)]
    train = spark.createDataFrame(rows, "url_404 string, live_url string, label int, weight double, copies int, source string")
    corpus = train.select(F.col("url_404").alias("url")).union(train.select("live_url")).distinct()
    trained = model.fit(train, corpus)
    broken = spark.createDataFrame([(u, i) for i, u in enumerate([*shown[:20], "", "ftp://q/é", shown[0]])], "url string, idx bigint")
    texts = [r[1] for r in rows] + ["", None, "https://h1.com/en/a/en;p?x=1&y=2&x=3#f", "https://h1.com/a/en/en.html?y=&x=9", rows[0][1]]
    live = spark.createDataFrame([(u, i) for i, u in enumerate(texts)], "url string, live_idx bigint")
    distinct = [(u, i) for i, u in enumerate(texts) if u and texts.index(u) == i]
    pairs = spark.createDataFrame(
        [(q, u, i) for q in dict.fromkeys(r["url"] for r in broken.collect()) if q for u, i in distinct],
        "url_404 string, live_url string, live_idx bigint")
    want = {(r["url_404"], r["live_idx"]): r for r in features.pair_features(pairs, idf=trained.idf).collect()}
    sides = broken.where("url != ''").select("url").distinct(), spark.createDataFrame(distinct, "url string, live_idx bigint")
    got = {(r["url_404"], r["live_idx"]): r for r in features.all_pair_features(*sides, trained.idf).collect()}
    assert set(got) == set(want)
    assert all(got[k][c] == pytest.approx(want[k][c], abs=1e-8) for k in got for c in features.FEATURES)
    best = {}
    for r in model.confidence(pairs, trained).collect():
        best[r["url_404"]] = max(best.get(r["url_404"], (-1, 0)), (r["confidence"], -r["live_idx"]))
    # Nobody nominated anything; the second row of a URL has a vote of its own.
    votes = model.ml_first_pass(broken, live, trained).collect()
    assert sorted(v["url_404"] for v in votes) == sorted(r["url"] for r in broken.collect())
    for v in votes:
        score, place = best.get(v["url_404"], (0.0, 0))
        hit = (texts[-place], score, -place) if score >= 0.7 else (None, 0.0, None)
        assert (v["match_url"], pytest.approx(v["score"]), v["match_idx"]) == hit and v["algo"] == "ml"
    assert sum(v["match_url"] is not None for v in votes) > 10 and {v["score"] for v in votes if v["url_404"] == ""} == {0.0}
    only = {(v["url_404"] != "", v["match_idx"], v["score"]) for v in model.ml_first_pass(broken, live, model.Trained(None, 1)).collect()}
    assert only == {(True, 0, 1.0), (False, None, 0.0)}
    assert {v["match_url"] for v in model.ml_first_pass(broken, live.limit(0), trained).collect()} == {None}


def test_second_round_scores_all_live_urls(spark, sample):
    broken, live = sample
    votes = votes_of(spark, [("https://www.example.com/promo/expired", "spacy", None, 0.0, None)])
    cfg = Settings(algorithms=("spacy", "ml"))
    out = run.run(broken, live, tables.empty_history(spark), cfg, trained=model.Trained(None, 1), votes=votes).votes.collect()
    assert {(v["url_404"], v["match_idx"]) for v in out if v["algo"] == "ml"} == {(r["url"], 0) for r in broken.collect()}


def test_sinks_and_history_round_trip(spark, tmp_path):
    votes = votes_of(spark, [("https://www.a.example.com/x", "jaccard", "u", 0.9, 0), ("https://b.org/y", "jaccard", "v", 0.2, 1)])
    table = consensus.mapping(votes)
    out = sinks.write_mapping(table, reports.algorithm_stats(table), str(tmp_path), datetime(2024, 5, 6, 7, 8), "csv")
    assert out.endswith("20240506_0708_a_example_com_redirect_map")
    back = tables.load_table(spark, f"{out}/redirects", "csv")
    assert back.count() == 2 and back.columns[0] == "url_404"
    path = str(tmp_path / "history")
    assert tables.load_history(spark, path).count() == 0
    sinks.append_history(history_rows(spark, 1, 1, ["/en/"]), path)
    sinks.append_history(history.human_rows(spark.createDataFrame([("a", "b"), ("", "c")], "url_404 string, live_url string")), path)
    sources = [r["source"] for r in tables.load_history(spark, path).collect()]
    assert sorted(sources) == ["auto", "auto", "human", "human"]
    # A cut history takes the place of the old one; more rows go to the new version.
    sinks.write_history(history.retain(tables.load_history(spark, path), 3), path)
    assert tables.load_history(spark, path).count() == 3
    sinks.append_history(history_rows(spark, 1, 0, []), path)
    back = tables.load_history(spark, path)
    assert back.count() == 4 and sinks.VERSION not in back.columns


def test_history_is_cut_only_on_request(spark):
    past = history_rows(spark, 1, 1, ["/en/"] * 5)
    assert history.retain(past).count() == 7
    assert history.retain(past, cfg=Settings(max_history_size=3)).count() == 3


def test_missing_inputs_are_errors(spark, sample):
    broken, live = sample
    with pytest.raises(ValueError, match="spacy"):
        run.find_votes(broken, live, Settings(algorithms=("jaccard", "spacy")))
    with pytest.raises(ValueError, match="mystery"):
        run.find_votes(broken, live, Settings(algorithms=("mystery",)))
    fitted = run.find_votes(broken, live, Settings(algorithms=("jaccard", "bertopic")))
    assert {r["algo"] for r in fitted.collect()} == {"jaccard", "bertopic"}


def test_second_round_has_a_learned_vote(spark, sample):
    broken, live = sample
    past = spark.createDataFrame([
        (at(i), f"https://www.example.com/old/{i}", f"https://www.example.com/new/{i}", 999, 1.0, "human", True, "human")
        for i in range(120)], schemas.HISTORY)
    outcome = run.two_rounds(broken, live, past, Settings(algorithms=("jaccard", "ml")))
    assert {r["algo"] for r in outcome.votes.collect()} == {"jaccard", "ml"}


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))


def test_registry():
    import __spark_entry__ as registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
