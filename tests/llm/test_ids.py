"""Ids beyond 2^53 stay what they are beside a row without an id, and columns keep their values whatever their names."""
import pytest
from pyspark.sql import functions as F

from relinker.llm import align, bpe, langid, merkle, minhash, pii, quality, secrets, tokenfile

BIG = 2**53
IDS = [BIG + 1, None, BIG + 3, 5]
TEXT = "the quick brown fox jumps over the lazy dog and mails jane.doe@example.org about it number {}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, (TEXT.format("one two three four".split()[i]) + " ") * 3, "en", f"s{i}", None if i == 2 else BIG + 2 * i + 1) for i, d in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=str)


def test_ids_of_the_operators(spark, docs):
    want = sorted(IDS, key=str)
    word, byte, piece = map(bpe.tokenizer_path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    assert ids(pii.report(docs)) == want
    assert ids(langid.identify(docs)) == want
    assert ids(bpe.digests(docs, word)) == want
    assert ids(align.links(docs, byte, piece)) == want
    assert ids(merkle.verified(docs)) == want
    assert ids(secrets.report(docs)) == want
    assert ids(tokenfile.round_trip(docs)) == want
    labels = spark.createDataFrame([(5, 1, 0), (BIG + 1, 0, 0), (BIG + 3, 0, 1)], "doc_id bigint, quality bigint, toxic bigint")
    assert ids(quality.select(docs, labels)) == want
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 95).collect()}
    assert found == {d: d for d in IDS}


def test_other_whole_numbers_stay(docs):
    before = {r["source"]: r["n_chars"] for r in docs.collect()}
    found = pii.find(docs)
    assert found.columns[:5] == docs.columns
    assert {r["source"]: r["n_chars"] for r in found.collect()} == before
    masked = pii.masked(docs).collect()
    assert sorted((r["doc_id"] for r in masked), key=str) == sorted(IDS, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in masked)


def test_accepted_keeps_columns_of_any_name(docs):
    mine = docs.withColumns({"score": F.lit(7), "lang_pred": F.lit("mine"), "_text": F.lit(None).cast("int"), "column 0": F.lit("x")})
    found = langid.accepted(mine)
    assert found.columns == mine.columns
    rows = found.collect()
    assert rows and all((r["score"], r["lang_pred"], r["_text"], r["column 0"]) == (7, "mine", None, "x") for r in rows)
    assert {r["doc_id"] for r in rows} <= set(IDS)


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² ³ ⅷ 12", "en"), (2, TEXT, "en"), (3, "² word", "en")], "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.withColumn("source", F.lit("s"))).collect()}
    assert found[1] == "und" and found[2] == "en"
