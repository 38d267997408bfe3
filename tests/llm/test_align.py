"""Alignment of two tokenizers beside whole-text encodings."""
import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from relinker.llm import align
from relinker.llm.bpe import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pair():
    return align.Pair(tokenizer_path(A), tokenizer_path(B))


@lru_cache(1)
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(A))
    t.encode_special_tokens = True
    return t


def groups_of(pair, text):
    """Groups of a text from its two whole encodings, or None."""
    if not text:
        return None
    a = library().encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return None

    def ends(ids, sizes):
        at, out = 0, []
        for i in ids:
            at += len(sizes[i])
            out.append(at)
        return out
    end_a, end_b = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    cuts = sorted(set(end_a) & set(end_b))
    place = {e: k for k, e in enumerate(cuts)}

    def dealt(ids, ends):
        parts, k = [[] for _ in cuts], 0
        for x, e in zip(ids, ends):
            parts[k].append(x)
            k += e in place
        return parts
    out = list(zip(dealt(a, end_a), dealt(b, end_b)))
    return out


def brute(pair, rows):
    found = [groups_of(pair, t) for _, t in rows]
    count = Counter()
    for groups in found:
        count.update({(x, y) for a, b in groups or [] for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), groups in zip(rows, found):
        links = [(x, y) for a, b in groups or [] for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        out.append((
            doc_id, sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(groups or []), len(links),
            sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def check(spark, pair, rows, **extra):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(extra)
    found = align.links(docs, tokenizer_path(A), tokenizer_path(B))
    assert found.columns == list(align.RESULT)
    assert sorted(map(tuple, found.collect()), key=str) == brute(pair, rows)


def test_awkward_texts(spark, pair):
    from pyspark.sql import functions as F

    texts = [
        None, "", " ", "   ", "a", " a", "a ", "a  b", "\n", " \n", "a\n b", "a \n b", "a\n\n  b \t c", "x▁y", "▁", "<s> </s> <unk>",
        "<0x41> <|endoftext|>", "it's we'll I've 'tis", "日本語 text ünï ①② ﬁ", "  x  y 　 z", "\x1c a \x1db\x00 c", "😀 😀😀 é",
        "the cat the cat sat", "1234567 12 3", "AAAA aaaa " * 30, "word" * 5000, "ab " * 20_000, "-" * 3000 + " " * 3000 + "z", " " * 300_000, "=" * 200_001 + "x", "\r\n \r\n x\r y"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(2**53 + 1, "the cat"), (None, "the dog"), (None, None), (5, "the cat"), (5, "the cat")]
    check(spark, pair, rows, **{c: F.lit("x") for c in ("block", "a", "pairs", "key", "n", "n_a", "groups_sha256")})


def test_random_texts(spark, pair, monkeypatch):
    r = random.Random(3)
    parts = ["the", "cat", "Über", "straße", "\n", "\t", " ", "  ", "naïve", "x1y2", "'s", ",", "日本", " ", "🎉", "<s>", "ing", "tion", "aeiou", "​", "\u0085"]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randrange(40)))) for i in range(400)]
    check(spark, pair, rows)


def test_empty_table(spark):
    found = align.links(spark.createDataFrame([], "doc_id bigint, text string"), tokenizer_path(A), tokenizer_path(B))
    assert found.columns == list(align.RESULT)
    assert found.count() == 0


def test_little_memory_and_small_blocks(pair, monkeypatch):
    """Results of a text do not depend on which pieces are known."""
    monkeypatch.setattr(align, "CACHE_BYTES", 2000)
    small, large = align.Pieces(pair), align.Pieces(pair)
    r = random.Random(5)
    for _ in range(200):
        texts = [" ".join(r.choice("alpha beta gamma 12 x\ny über  z ▁".split(" ")) for _ in range(20)) for _ in range(r.randrange(4))]
        alone = [next(small.aligned([t])) for t in texts]
        for one, two in zip(alone, large.aligned(texts), strict=True):
            assert one[:2] == two[:2] and all((x == y).all() for x, y in zip(one[2:], two[2:]))


def test_foretold_pairs_have_equal_bytes(pair):
    import numpy as np

    known = np.flatnonzero(pair.same >= 0)
    assert len(known) > 5000
    assert all(pair.a_bytes[i] == pair.b_bytes[pair.same[i]] for i in known)
