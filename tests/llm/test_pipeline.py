"""The pipeline, stage by stage, against what each stage should do to a small table."""
import numpy as np

import corpus_pipeline
from relinker.llm import bpe, mixing, pii
from tests_support import brute_components, plain_encoding


def documents(spark, folder):
    rng = np.random.default_rng(0)
    words = {"en": "the thing with there where this that house water and".split(), "de": "der nicht schule zwischen über wasser haus und die".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(words[lang], 40)), lang, f"s{i % 3}"))
    rows.append((60, rows[5][1] + " tail", "en", "s1"))
    rows.append((61, rows[6][1].upper(), "de", "s0"))
    rows.append((62, "12 34 !?", "en", "s0"))
    rows.append((63, None, "en", None))
    rows.append((64, "mail jane@example.org or +1 (017) 555-7713 the thing with there", "en", "s2"))
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return {r[0]: r for r in rows}


def test_stages(spark, tmp_path):
    rows = documents(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert i == 4 or docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out[name] = {r["doc_id"]: r for r in docs.collect()}
        assert len(out[name]) == docs.count()
    assert set(out["language"]) == set(rows) - {62, 63}
    kept = sorted(out["language"])
    root = brute_components([rows[d][1] for d in kept], 80)[1]
    assert set(out["near_duplicates"]) == {kept[r] for r in root}
    for d, r in out["personal_data"].items():
        text = rows[d][1]
        assert r["text"] == pii.mask(text, pii.base_spans(text)) and r["n_chars"] == len(r["text"])
    assert out["personal_data"][64]["text"] == "mail [email] or [phone] the thing with there"
    words = sum(len(r["text"].split()) for r in out["personal_data"].values())
    mixed = sum(len(r["text"].split()) for r in out["mixture"].values())
    assert abs(mixed - mixing.SHARE * words) <= 0.05 * words
    assert set(out["encoded"]) == set(out["mixture"])
    for d, r in out["encoded"].items():
        assert (r["ids"], r["decoded"]) == plain_encoding(out["mixture"][d]["text"], "word_bpe_49k.json") and r["n_tokens"] == len(r["ids"])
    again = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {d: r["ids"] for d, r in out["encoded"].items()}
    assert bpe.tokenizer_path("word_bpe_49k.json").endswith("word_bpe_49k.json")
