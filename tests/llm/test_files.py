"""Vectors, token files, archives and tokenizers: brute force, exact round trips, and awkward tables."""
import base64
import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from relinker.llm import bpe, common, tokenfile, topk, vectordup, warc
from relinker.llm.common import components
from tests_support import plain_encoding

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, rank int"


def vector_rows(spark, vectors, labels=None, first=0):
    rows = [(first + i, None if v is None else [None if x is None else float(x) for x in v], labels[i] if labels else 0, "x", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VECTORS)


def unusual(spark):
    nan, inf = float("nan"), float("inf")
    df = vector_rows(spark, [None, [1, None], [nan, 1], [inf, 0], [0, 0], [], [1, 0], [1, 0], [2, 0], [1, 0, 0]], [0, 0, 0, 0, 0, 0, 0, 1, 0, None])
    return df.unionByName(df.where("vec_id = 6")).unionByName(df.where("vec_id = 8").withColumn("vec_id", F.lit(None).cast("bigint")))


# Top-k

def brute_top(ids, codes, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = codes @ codes[i]
        out[ids[i]] = [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
    return out


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_topk_against_all_scores(spark, parts, monkeypatch):
    monkeypatch.setattr(topk, "GROUP_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[100:160] = x[3]  # ties and copies, queries among them
    x[200:220] = np.round(x[200:220])
    ids = np.arange(300)
    got = {}
    for r in topk.search(vector_rows(spark, x), every=20, parts=parts).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(ids, np.floor(1024 * x.astype(float)).astype(np.int64), 20, 10)


def test_topk_of_large_components(spark):
    rows = vector_rows(spark, [[1.0, 1.0], [70000, 0], [90000, 0], [1e9, 1], [1e9, -1], [3e38, -3e38], [-1e12, 0]])
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.search(rows, every=7).orderBy("rank").collect()]
    assert got == [(0, 3, 1024**2 * (10**9 + 1)), (0, 4, 1024**2 * (10**9 - 1)), (0, 2, 94_371_840_000), (0, 1, 73_400_320_000),
                   (0, 5, 0), (0, 6, -1024**2 * 999_999_995_904)]
    # Products of two large vectors do not fit in 64 bits and count as the bound.
    both = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.search(rows, every=1).collect()}
    assert both[3, 4] == both[4, 3] == both[3, 5] == 1 << 61
    assert both[6, 5] == -(1 << 61)
    assert both[1, 2] == 70000 * 90000 * 1024**2


def test_topk_on_unusual_rows(spark):
    rows = topk.search(unusual(spark), every=2).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [4, 6, 8]
    assert sorted(got[6])[:3] == [(1, 8, 2048 * 1024), (2, 7, 1024 * 1024), (3, 9, 1024 * 1024)]
    assert topk.search(unusual(spark).limit(0)).count() == 0
    huge = vector_rows(spark, [[3e38, 1], [3e38, -1], [-3e38, 0]])
    assert topk.search(huge, every=1).count() == 6


# Near-duplicate vectors

def brute_links(x, labels, cosine):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= cosine) & (labels[:, None] == labels[None])
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[linked[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == root).all():
            return linked.sum(1), root
        root = new


def test_vector_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectordup, "CELL_ROWS", 8)
    monkeypatch.setattr(vectordup, "SLICE", 10)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    for i in range(100, 300):
        x[i] = x[i % 10] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])
    x[300:340] = x[7]
    x = x.astype(np.float32)
    labels = rng.integers(0, 3, 500)
    labels[300:340] = labels[7]
    links, root = brute_links(x.astype(float), labels, 0.98)
    got = {r["vec_id"]: r for r in vectordup.near_duplicates(vector_rows(spark, x, [int(v) for v in labels])).collect()}
    found = sum(got[i]["n_links"] for i in range(500))
    assert links.sum() > 1000 and 0.99 * links.sum() <= found <= links.sum()
    assert all(got[i]["n_links"] <= links[i] for i in range(500))
    same = np.mean([got[i]["component_id"] == root[i] for i in range(500)])
    assert same >= 0.98 and all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(500))


def test_vector_links_on_unusual_rows(spark):
    rows = vectordup.near_duplicates(unusual(spark)).collect()
    assert len(rows) == unusual(spark).count()
    got = {r["vec_id"]: r for r in rows}
    assert got[6]["n_links"] == 2 and got[8]["component_id"] == 6  # its copy and the longer vector
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (0, 1, 2, 3, 4, 5, 7, 9))
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert vectordup.near_duplicates(unusual(spark).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 201), (203, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got) == set(range(61)) | {200, 201, 203}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in (200, 201, 203)}) == 1
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Token files

def test_coder_round_trip():
    rng = np.random.default_rng(2)
    blocks = [
        np.zeros(0), np.zeros(50), np.full(77, 2**29 - 1), rng.integers(0, 2**29, 300), rng.zipf(1.3, 3000) % 50257,
        np.tile(rng.integers(0, 50257, 20), 60), rng.integers(0, 50257, 1)]
    blocks = [b.astype(np.uint32) for b in blocks]
    coded = tokenfile.encode_blocks(blocks)
    out = tokenfile.decode_blocks(coded, [len(b) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, out, strict=True))
    assert len(coded[5]) < 300  # 1,200 ids that repeat
    one = tokenfile.encode_blocks([blocks[4]])[0]
    assert one == coded[4]  # blocks do not depend on each other


def test_checksums():
    a, b = b"abc" * 41, bytes(range(200))
    assert tokenfile.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_pieces_are_those_of_the_library():
    words = tokenfile.ByteWords(bpe.tokenizer_path("byte_bpe_50k.json"))
    texts = ["a  b\n\n c\t\td \n e", "x <|endoftext|>  y", "  ", "\n", "a\x1cb  \x1c d", "don't  it's  x", "é\xa0　 y  z", "", "汉字 emoji 🙂 \r\n end "]
    for t, ids in zip(texts, words.encode(texts), strict=True):
        assert words.tokenizer.encode(t, add_special_tokens=False).ids == ids.tolist()


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "GROUP", 2)
    texts = ["", None, "hello world", "hello world", "\n", "word " * 9000, "x" * 9000, "the quick brown fox " * 50]
    rows = [(i * 3 - 4, t, "n") for i, t in enumerate(texts)] + [(None, "none", "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(3)
    tokenizer = tokenfile.ByteWords(bpe.tokenizer_path("byte_bpe_50k.json")).tokenizer
    at = 0
    want = {}
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.round_trip(docs).collect()}
    assert got == want
    assert tokenfile.round_trip(docs.limit(0)).count() == 0


def test_documents_cut_by_blocks_are_joined_in_their_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words " * n) for i, n in enumerate((1, 4000, 2, 9000, 0))], "doc_id bigint, text string")
    folder = tokenfile.write_blocks(docs, common.fresh_path(spark, "tokens"), bpe.tokenizer_path("byte_bpe_50k.json"))
    one = spark.read.parquet(folder).coalesce(1).sortWithinPartitions("file", "block")
    assert one.count() > 10
    ordered = common.fresh_path(spark, "tokens")
    one.write.parquet(ordered)
    pieces = tokenfile.read_pieces(spark, ordered).collect()
    assert len(pieces) == 5 and all(p["whole"] for p in pieces)
    # Backwards, every cut document comes in pieces; the result is the same.
    shuffled = common.fresh_path(spark, "tokens")
    one.coalesce(1).sortWithinPartitions(F.desc("block")).write.parquet(shuffled)
    assert tokenfile.read_pieces(spark, shuffled).count() > 10
    assert sorted(tokenfile.documents_of(spark, shuffled).collect()) == sorted(tokenfile.documents_of(spark, ordered).collect())


def test_blocks_are_smaller_than_those_of_zlib():
    texts = [r for r in pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"] if r]
    words = tokenfile.ByteWords(bpe.tokenizer_path("byte_bpe_50k.json"))
    flat = np.concatenate([np.append(ids, 2) for ids in words.encode(texts)]).astype(np.uint32)
    blocks = [flat[i:i + tokenfile.BLOCK] for i in range(0, len(flat), tokenfile.BLOCK)]
    plain = sum(len(zlib.compress(b.astype("<u2").tobytes())) for b in blocks)
    assert sum(map(len, tokenfile.encode_blocks(blocks))) < 0.85 * plain


# Archives

def brute_pages(rows):
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), page)
    out = {}
    for page, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = last[html or ""] == page
        out[page] = (len(data), digest, "response" if own else "revisit", None if own else last[html or ""])
    return out


def test_archives_round_trip(spark):
    odd = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"https://h.example/{i}", h) for i, h in enumerate(
        [None, "", "same", "same", odd, "é" * 100, odd, "x" * 200_000, "\r\n\r\n", "line\nline", "same"])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload_bytes string").repartition(3)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == brute_pages(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(None, None, "a"), (None, "u\r\nx: y", "a"), (3, "u", "b"), (3, "u", "b")], "page_id bigint, url string, html string")
    rows = warc.round_trip(pages).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in rows) == [("3", "response"), ("3", "revisit"), ("None", "response"), ("None", "revisit")]


def test_transactions_are_assembled(spark, tmp_path):
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <{}>\r\n{}Content-Type: {}\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    http = "HTTP/1.1 200 OK\r\nX: 1\r\n\r\nbody"
    whole = (
        head.format("response", "r1", "", "application/http", len(http), http)
        + head.format("request", "q1", "WARC-Concurrent-To: <r1>\r\n", "application/http", 18, "GET / HTTP/1.1\r\n\r\n")
        + head.format("metadata", "m1", "WARC-Concurrent-To: <q1>\r\n", "application/warc-fields", 8, "a: b\r\nc:")
        + head.format("response", "r2", "WARC-Concurrent-To: <q2>\r\n", "application/http", len(http), http)
        + head.format("request", "q2", "", "application/http", 18, "GET / HTTP/1.1\r\n\r\n")
        + head.format("metadata", "m3", "WARC-Concurrent-To: <gone>\r\n", "application/warc-fields", 0, ""))
    (tmp_path / "one.warc").write_bytes(whole.encode())
    found = warc.read_archives(spark, str(tmp_path))
    rows = {r["capture_id"]: r for r in warc.assemble(found).collect()}
    assert set(rows) == {"<r1>", "<r2>"}
    assert rows["<r1>"]["request"]["record_id"] == "<q1>" and rows["<r1>"]["metadata"]["fields"] == {"a": "b", "c": ""}
    assert rows["<r2>"]["request"]["record_id"] == "<q2>" and rows["<r2>"]["metadata"] is None
    assert bytes(rows["<r1>"]["response"]["payload"]) == b"body" and rows["<r1>"]["response"]["fields"]["X"] == "1"


# Tokenizers

PATH = "word_bpe_49k.json"


def plain(text):
    return plain_encoding(text, PATH)


def test_encoding_is_that_of_the_library(spark):
    rng = np.random.default_rng(3)
    texts = [
        "", None, "Hello, World's  best\n\ttext", "a<|endoftext|>b <|startoftext|>", "É é ǅ ΣΑΣ", "x" * 30_000, "ab" * 5000 + "!?" * 4000 + " tail",
        "".join(rng.choice(list("abcdefgh"), 12_000)), "<|endoftext|>" + "".join(rng.choice(list("theing"), 9000)), "1" * 5000, "é" * 6000, "\x00\x01 ok", "a b c"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x")], "doc_id bigint, text string, ids string")
    path = bpe.tokenizer_path(PATH)
    rows = bpe.encode(docs, path).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["ids"], r["decoded"]) == plain(texts[r["doc_id"]]), r["doc_id"]
    for r in bpe.digests(docs, path).collect():
        ids, decoded = plain(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_joined_halves_equal_the_whole():
    tree = bpe.Tree(bpe.tokenizer_path(PATH))
    rng = np.random.default_rng(4)
    for alphabet in ("ab", "thein", "abcdefghijklmnopqrstuvwxyz"):
        run = "".join(rng.choice(list(alphabet), 3000))
        assert tree.encode(run) == tree.leaf(run, True)
