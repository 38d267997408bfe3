"""Personal data, languages, quality, near duplicates and mixing against brute force, and on awkward tables."""
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relinker.llm import chains, langid, minhash, mixing, pii, quality
from tests_support import brute_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score double, kept boolean"


def docs_of(spark, texts, first=0):
    """Documents with extra columns whose names clash with results."""
    rows = [(first + i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "x", 1.0, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and empty texts, repeated rows, a null id, a null source, one very long text."""
    docs = docs_of(spark, ["", None, "one two", "one two", "\n \t", "a " * 30_000, "x" * 20_000, "é ñ ü 12 @"])
    return docs.unionByName(docs.limit(1)).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("bigint"))).coalesce(2)


# Personal data

def plain_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in double) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(0)
    alphabet = list("0123456789" * 3 + "..@@--++  ()ab_%")
    texts = ["".join(rng.choice(alphabet, 60)) for _ in range(3000)]
    texts += ["a@b.c@d.e", "a@b@c.d", "x@y.zz_q@r.s", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111 1", "+1 (017) 555-7713", "9" * 5000, "a" * 5000 + "@b.c", "0010.1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_learned_spans_add_to_the_base():
    field = pii.fit()
    found = {t: pii.learned_spans([t], field)[0] for t in (
        "call (212) 555-0100 now", "call 030-555-1234 please", "write root@localhost soon", "no 4111111111111112 here", "in 2020-2021 with 12 items", "", "1.2.3.² ²³@ ٣٣٣")}
    assert found["call (212) 555-0100 now"] == [("phone", 5, 19)]
    assert found["call 030-555-1234 please"] == [("phone", 5, 17)]
    assert found["write root@localhost soon"] == [("email", 6, 20)]
    assert not found["no 4111111111111112 here"] and not found["in 2020-2021 with 12 items"] and not found[""]
    base = [("ip", 0, 7)]
    assert pii.all_spans(base, [("phone", 3, 9), ("email", 10, 12)]) == [*base, ("email", 10, 12)]
    assert pii.mask("ab 1.2.3.4 x", [("ip", 3, 10)]) == "ab [ip] x"


def test_personal_data_on_awkward_rows(awkward):
    rows = pii.report(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    masked = pii.masked(awkward)
    assert masked.columns == awkward.columns and masked.where("text is null").count() == 1
    assert pii.find(awkward).where("size(spans) > 0").count() == 0
    assert pii.report(awkward.limit(0)).count() == 0


def test_viterbi_and_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    scores, trans, lengths = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([4, 1, 3, 1])
    post, best = chains.forward_backward(scores, lengths, trans), chains.viterbi(scores, lengths, trans)
    at = 0
    for n in lengths:
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        value = np.array([sum(scores[at + i, p[i]] for i in range(n)) + sum(trans[p[i], p[i + 1]] for i in range(n - 1)) for p in paths])
        weight = np.exp(value - value.max())
        for i in range(n):
            want = [weight[paths[:, i] == k].sum() / weight.sum() for k in range(3)]
            assert np.allclose(post[at + i], want)
        assert list(best[at:at + n]) == list(paths[value.argmax()])
        at += n
    assert chains.forward_backward(np.zeros((0, 3)), np.zeros(0, int), trans).shape == (0, 3)


# Languages

WORDS = {"en": "the thing with there where this that house water", "de": "der nicht schule zwischen straße über wasser haus", "fr": "le être français où voilà maison garçon eau"}


def language_docs(spark, n=240):
    rng = np.random.default_rng(2)
    langs = sorted(WORDS)
    rows = []
    for i in range(n):
        lang = langs[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang, "s"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_languages_of_held_out_documents(spark):
    docs = language_docs(spark)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    held = [d for d in got if got[d]["held_out"]]
    assert len(held) > 20 and np.mean([got[d]["lang_pred"] == want[d] for d in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_rare_languages_are_learned(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("the house water "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(7000 + i, f"maison {'abcdefgh'[i]}", "fr") for i in range(8)], docs.schema)
    # A draw of 60 documents holds about none of them.
    bound = 60
    kept = [r["text"] for r in rare.where(~langid.held_out("doc_id")).collect()]
    got = langid.training_rows(docs.unionByName(rare), docs_bound=bound)
    assert sorted(" ".join(w) for lang, w in got if lang == "fr") == sorted(kept)
    assert len([1 for lang, _ in got if lang == "en"]) >= bound - len(kept)
    no_ids = docs.withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.concat("text", F.lit(" ab"), F.translate(F.col("text"), "0123456789", "abcdefghij")))
    assert len(set(map(str, langid.training_rows(no_ids, docs_bound=200)))) >= 200


def test_words_of_switched_text(spark):
    field = langid.fit(langid.training_rows(language_docs(spark)))
    words = "the house water nicht straße schule".split()
    post = chains.forward_backward(langid.word_scores(words, field), np.array([6]), field.trans.astype(float))
    assert [field.labels[i] for i in post.argmax(axis=1)] == ["en"] * 3 + ["de"] * 3
    assert langid.split("Ab cd\n\n12 ef") == (["ab", "cd", "ef"], [2, 1])


def test_languages_on_awkward_rows(awkward, spark):
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(awkward).collect()}
    assert (0, "und", 0.0) in rows and (1, "und", 0.0) in rows and (4, "und", 0.0) in rows
    assert len(langid.identify(awkward).collect()) == awkward.count()
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(awkward.limit(0)).count() == 0
    assert langid.accepted(awkward).columns == awkward.columns


# Quality

def test_quality_by_planted_words(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(400):
        grade = i % 3
        text = list(rng.choice(words, 20)) + {0: ["awful"], 1: ["%%%", "|"], 2: []}[grade]
        docs.append((i, " ".join(text)))
        if i < 300:
            labels.append((i, int(grade == 2), int(grade == 0)))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = [r for r in quality.select(d, lab).collect() if r["doc_id"] >= 300]
    assert np.mean([r["kept"] == (r["doc_id"] % 3 != 0) for r in rows]) >= 0.97
    means = [np.mean([r["expected_grade"] for r in rows if r["doc_id"] % 3 == g]) for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]


def test_quality_on_awkward_rows(awkward, spark):
    labels = spark.createDataFrame([(0, None, None), (2, 1, 0), (2, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert {(r["doc_id"], r["grade"]) for r in quality.ratings(labels).collect()} == {(0, 1), (2, 0)}
    assert quality.select(awkward, labels).count() == awkward.count()
    assert quality.select(awkward, labels.limit(0)).count() == awkward.count()
    assert quality.select(awkward.limit(0), labels).count() == 0


# Near duplicates

@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(spark, percent):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 60))
    texts = ["", None, "A b", "a B", "a  b\n", "x y z v", "ÄB c", "äB c"]
    for size in (6, 12, 40, 70, 200, 400):
        base = list(rng.choice(words, size))
        texts += [" ".join(base)] * 3
        for _ in range(9):
            copy = list(base)
            for k in rng.choice(size, max(1, size // rng.integers(20, 120)), replace=False):
                copy[k] = str(rng.choice(words))
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(rng.choice(words, 30)) for _ in range(25)]
    sizes, root = brute_components(texts, percent)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(spark, texts), percent).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert all(got[i]["kept"] == (root[i] == i) for i in got)


def test_near_duplicates_on_awkward_rows(awkward):
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["component_id"] == 2 and by_id[0]["component_id"] == 0 and by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert minhash.near_duplicates(awkward.limit(0)).count() == 0
    left = minhash.distinct_documents(awkward)
    assert left.columns == awkward.columns and {r["doc_id"] for r in left.select("doc_id").collect()} == {0, 1, 2, 4, 5, 6, 7, None}


def test_near_duplicates_with_few_words_in_a_partition(spark):
    for n in range(6):
        text = " ".join("abcdef"[:n])
        assert [len(s) for s in minhash.shingle_sets([text])] == [max(n - 4, min(n, 1))]
    docs = docs_of(spark, ["a", "b", "a b", "A  b", "a b c", "b c", "a b c", "a b c d"]).repartitionByRange(8, "doc_id")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 4, 7: 7}


# Mixing

def brute_targets(sizes):
    """sizes by source, None last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 2.0 * sizes[s] for s in over})


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), ["a", "b", "c", "d", None][int(rng.integers(0, 5)) if i % 2 else 0], "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, start string")
    got = mixing.taken_words(docs).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets = brute_targets(sizes)
    source = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(targets[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == pytest.approx(targets[s], rel=0.03) for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in mixing.taken_words(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 7))
        assert sorted(out) == list(range(n))


def test_mixed_documents_hold_the_words_taken(spark):
    texts = [" ".join(f"w{i}_{j}" for j in range(40 + i)) + "\n" for i in range(20)]
    docs = docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs.withColumn("doc_id", F.monotonically_increasing_id())).collect()}
    out = mixing.mixed_documents(docs).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(taken.values())
    for r in out:
        words = r["text"].split()
        assert set(words) <= set(texts[r["doc_id"]].split()) and r["n_chars"] == len(r["text"])
        assert max(words.count(w) for w in set(words)) <= 2


def test_mixing_on_awkward_rows(awkward):
    rows = mixing.taken_words(awkward).collect()
    assert len(rows) == awkward.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.taken_words(awkward.limit(0)).count() == 0
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def test_personal_data_is_searched_in_portions(spark, monkeypatch):
    """What is made of the words of all texts of a batch at once filled the memory of its worker."""
    held = []
    monkeypatch.setattr(pii, "through_pandas", lambda df, run, schema: held.append(run))
    monkeypatch.setattr(pii, "PORTION", 300)
    texts = [f"write to a{i}@b.org or call +1 202 555 01{i:02}" for i in range(60)] + [None, "", "x" * 900]
    batch = pd.DataFrame({"doc_id": [str(i) for i in range(len(texts))], "text": texts})
    docs = spark.createDataFrame([(0, "a")], "doc_id bigint, text string")
    field = pii.fit()
    for step in (pii.masked, pii.find, pii.report):
        step(docs, field)
        got = list(held[-1](iter([batch.assign(text=batch["text"].fillna("")) if step is pii.report else batch])))
        assert len(got) > 5 and pd.concat(got)["doc_id"].tolist() == batch["doc_id"].tolist()
    whole = pd.concat(held[0](iter([batch])))
    assert whole["text"].tolist() == ["write to [email] or call [phone]"] * 60 + [None, "", "x" * 900]
