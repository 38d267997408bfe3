"""Alignment of two tokenizers: which ids of one stand for the same bytes as which ids of the other, over a whole corpus.

Most groups hold one token of each side with the same bytes. Which B id that is follows from the A id alone, by an array made
from the two vocabularies, so such groups are counted in vectors as long as A's vocabulary. Only pairs of other groups are
shuffled.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relinker.llm.common import written

# Texts are aligned by pieces, each once per task; known pieces are given back beyond this many bytes.
CACHE_BYTES = 128_000_000
# Documents of about this many characters form a block, which looks its pairs up together.
BLOCK_CHARS = 8_000_000
# Texts of about this many characters are aligned together.
PORTION_CHARS = 1_000_000
# Counted pairs that a task holds before it hands them on.
HELD_PAIRS = 1_000_000
# Fixed value: the blank of the piece tokenizer.
BLANK = "▁"
# A blank starts a token of both sides unless a blank is next to it or white space follows.
CUT = re.compile(r"(?<=[^ ])(?= \S)")


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 upwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how the byte-level tokenizer cuts texts before it merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """Both tokenizers, the bytes of their ids, and ``same``: A id -> B id with the same bytes, or -1.

    A is read from its file; its ids are its merge ranks, so that tiktoken gives the same ids several times as fast.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        letters = byte_alphabet()
        vocabulary = {bytes(letters[c] for c in token): i for token, i in json.load(open(a_path))["model"]["vocab"].items()}
        self.a = tiktoken.Encoding("A", pat_str=WORDS, mergeable_ranks=vocabulary, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for x, i in vocabulary.items():
            self.a_bytes[i] = x
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(BLANK, " ").encode()
            for i in range(self.n_b)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        by_bytes = {
            x: i for i, x in reversed(list(enumerate(self.b_bytes)))
            if not self.b.is_control(i) and not self.b.is_unknown(i) and not self.b.is_byte(i)}
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        # No piece goes on over a blank, so B can be cut there as well.
        self.cut = not any(BLANK in self.b.id_to_piece(i).lstrip(BLANK) for i in range(self.n_b))
        # Ids as text, with what stands between them: next token of the side, other side, next group.
        self.a_text = [np.array([b"%d%s" % (i, end) for i in range(self.n_a)], object) for end in (b",", b"|")]
        self.b_text = [np.array([b"%d%s" % (i, end) for i in range(self.n_b)], object) for end in (b",", b";")]


class Column:
    """Numbers that grow at the end."""

    def __init__(self):
        self.data, self.n = np.zeros(1024, np.int64), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[:self.n], np.zeros(self.n + 2 * len(more), np.int64)])
        self.data[self.n:self.n + len(more)] = more
        self.n += len(more)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size numbers) of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else first


class Pieces:
    """Aligned pieces of texts, each with the blank before it, in columns.

    Per piece: numbers of A tokens (-1 where the bytes differ), B tokens, groups and links; the groups as text; its distinct links
    with their numbers: as -1 - A id where ``same`` foretells the B id, else as A id * size of B + B id.
    """

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.plain: dict[str, int] = {}
        self.odd: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.n_a, self.n_b, self.n_groups, self.n_links, self.begin, self.size, self.links, self.times = (Column() for _ in range(8))

    def learn(self, pieces: list[str], into: dict[str, int]) -> None:
        pair = self.pair
        for at in range(0, len(pieces), 16_384):
            part = pieces[at:at + 16_384]
            texts = [(" " + p).encode() for p in part]
            coded = pair.b.encode(part, num_threads=1)
            if b"".join(map(pair.b_bytes.__getitem__, chain.from_iterable(coded))) != b"".join(texts):
                fine = [b"".join(map(pair.b_bytes.__getitem__, c)) == t for c, t in zip(coded, texts, strict=True)]
                bad = [p for p, ok in zip(part, fine, strict=True) if not ok]
                part, texts, coded = ([x for x, ok in zip(xs, fine, strict=True) if ok] for xs in (part, texts, coded))
                into.update(zip(bad, range(len(self.groups), len(self.groups) + len(bad))))
                for c in (self.n_a, self.n_b, self.n_groups, self.n_links, self.begin, self.size):
                    c.extend(np.full(len(bad), -1 if c is self.n_a else 0))
                self.groups += [b""] * len(bad)
                self.held += 200 * len(bad)
            into.update(zip(part, range(len(self.groups), len(self.groups) + len(part))))
            if part:
                # Plain pieces stay apart in a joined text, as each begins a token of A.
                a = pair.a.encode_to_numpy(" " + " ".join(part)) if into is self.plain else np.concatenate([pair.a.encode_to_numpy(" " + p) for p in part])
                self.add(texts, a.astype(np.int64), np.fromiter(chain.from_iterable(coded), np.int64))

    def add(self, texts: list[bytes], a: np.ndarray, b: np.ndarray) -> None:
        """Aligns pieces: A and B tokens of all of them, one after the other."""
        pair = self.pair
        piece_ends = np.cumsum(np.array(list(map(len, texts)), np.int64))
        a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        of_piece = np.searchsorted(piece_ends, ends)
        a_group, b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        n_a, n_b = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))

        # Links of groups of one token each, and of the distinct tokens of all others.
        single = (n_a == 1) & (n_b == 1)
        left, right = a[single[a_group]], b[single[b_group]]
        mixed_a, mixed_b = ~single[a_group], ~single[b_group]
        x, x_times = _counted(a_group[mixed_a] * pair.n_a + a[mixed_a], np.ones(mixed_a.sum(), np.int64))
        y, y_times = _counted(b_group[mixed_b] * pair.n_b + b[mixed_b], np.ones(mixed_b.sum(), np.int64))
        y_sizes = np.bincount(y // pair.n_b, minlength=len(ends))
        y_starts = np.cumsum(y_sizes) - y_sizes
        many = y_sizes[x // pair.n_a]
        i, j = np.repeat(np.arange(len(x)), many), _ranges(y_starts[x // pair.n_a], many)
        group = np.concatenate([np.flatnonzero(single), x[i] // pair.n_a])
        left, right = np.concatenate([left, x[i] % pair.n_a]), np.concatenate([right, y[j] % pair.n_b])
        times = np.concatenate([np.ones(single.sum(), np.int64), x_times[i] * y_times[j]])
        codes = np.where(pair.same[left] == right, -1 - left, left * pair.n_b + right)
        order = np.argsort(of_piece[group], kind="stable")
        sizes = np.bincount(of_piece[group], minlength=len(texts))

        # Tokens as text, in the order of groups, A before B.
        last_a = np.concatenate([a_group[1:] != a_group[:-1], [True]])
        last_b = np.concatenate([b_group[1:] != b_group[:-1], [True]])
        words = np.empty(len(a) + len(b), object)
        a_place = np.arange(len(a)) + np.concatenate([[0], np.cumsum(n_b)])[a_group]
        b_place = np.arange(len(b)) + np.cumsum(n_a)[b_group]
        words[a_place] = np.where(last_a, pair.a_text[1][a], pair.a_text[0][a])
        words[b_place] = np.where(last_b, pair.b_text[1][b], pair.b_text[0][b])
        a_of, b_of = of_piece[a_group], of_piece[b_group]
        of_a, of_b = np.bincount(a_of, minlength=len(texts)), np.bincount(b_of, minlength=len(texts))
        words, stops = words.tolist(), np.cumsum(of_a + of_b).tolist()
        self.groups += [b"".join(words[i:j])[:-1] for i, j in zip([0, *stops], stops, strict=False)]
        self.n_a.extend(of_a)
        self.n_b.extend(of_b)
        self.n_groups.extend(np.bincount(of_piece, minlength=len(texts)))
        self.n_links.extend(_sums(n_a * n_b, np.bincount(of_piece, minlength=len(texts))))
        self.begin.extend(self.links.n + np.cumsum(sizes) - sizes)
        self.size.extend(sizes)
        self.links.extend(codes[order])
        self.times.extend(times[order])
        self.held += 300 * len(texts) + 2 * sum(map(len, texts)) + 16 * len(codes) + 5 * len(words)

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the pieces of each text; with those of the blank before it."""
        if self.held > CACHE_BYTES:
            self.forget()
        if self.pair.cut:
            split = [t.split(" ") if t else [] for t in texts]
            new = [p for p in set().union(*split) if p not in self.plain]
            # A blank next to another one, or before white space, is no place to cut.
            odd = {p for p in new if not p or p[0].isspace()}
            self.learn([p for p in new if p not in odd], self.plain)
            whole = [not odd.isdisjoint(pieces) for pieces in split]
            split = [[p[1:] for p in CUT.split(" " + t)] if w else pieces for t, w, pieces in zip(texts, whole, split, strict=True)]
        else:
            whole, split = [bool(t) for t in texts], [[t] if t else [] for t in texts]
        self.learn([p for p in set().union(*(x for w, x in zip(whole, split, strict=True) if w)) if p not in self.odd], self.odd)
        return [list(map((self.odd if w else self.plain).__getitem__, pieces)) for w, pieces in zip(whole, split, strict=True)]

    def aligned(self, texts: list[str]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: numbers of A tokens, B tokens, groups, links; digest of the groups as text; distinct foretold A ids and their
        links; distinct other codes and their links. Zeros and nothing where bytes differ."""
        numbers = self.numbers(texts)
        numbers = [[] if any(self.n_a.data[i] < 0 for i in x) else x for x in numbers] if self.n_a.data[:self.n_a.n].min(initial=0) < 0 else numbers
        sizes = np.array(list(map(len, numbers)), np.int64)
        flat = np.fromiter(chain.from_iterable(numbers), np.int64)
        sums = np.stack([_sums(c.data[flat], sizes) for c in (self.n_a, self.n_b, self.n_groups, self.n_links)], axis=1).tolist()
        many = self.size.data[flat]
        at = _ranges(self.begin.data[flat], many)
        owner = np.repeat(np.repeat(np.arange(len(texts)), sizes), many)
        shift, wide = self.pair.n_a, self.pair.n_a * (self.pair.n_b + 1)
        keys, times = _counted(owner * wide + self.links.data[at] + shift, self.times.data[at])
        starts = np.searchsorted(keys, np.arange(len(texts)) * wide)
        middles = np.searchsorted(keys, np.arange(len(texts)) * wide + shift)
        stops = np.append(starts[1:], len(keys))
        keys = keys % wide - shift
        for k, pieces in enumerate(numbers):
            sha = hashlib.sha256(b";".join(map(self.groups.__getitem__, pieces))).hexdigest() if pieces else ""
            i, m, j = starts[k], middles[k], stops[k]
            yield sums[k], sha, -1 - keys[i:m], times[i:m], keys[m:j], times[m:j]


@lru_cache(1)
def loaded(a_path: str, b_path: str) -> Pair:
    """One instance for all tasks of a worker."""
    return Pair(a_path, b_path)


ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("block", pa.string()), ("a", pa.binary()), ("a_links", pa.binary()),
    ("pairs", pa.binary()), ("pair_links", pa.binary())])
ALIGNED_SQL = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, block string, "
    "a binary, a_links binary, pairs binary, pair_links binary")


def _align(a_path: str, b_path: str):
    """Per document its counts, and its distinct foretold A ids and other pairs with how often it links them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = Pieces(loaded(a_path, b_path))
        task = TaskContext.get().partitionId()
        block = chars = 0
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), [x or "" for x in batch["text"].to_pylist()]
            at = 0
            while at < len(texts):
                # A portion of texts at a time; blocks end where a portion does.
                stop, held = at, 0
                while stop < len(texts) and held < PORTION_CHARS:
                    held += len(texts[stop])
                    stop += 1
                yield _batch([
                    (doc_id, *sums, sha, f"{task}-{block}", a.astype("<u4").tobytes(), a_links.astype("<i8").tobytes(),
                     pairs.astype("<i8").tobytes(), pair_links.astype("<i8").tobytes())
                    for doc_id, (sums, sha, a, a_links, pairs, pair_links) in zip(ids[at:stop], pieces.aligned(texts[at:stop]), strict=True)], ALIGNED)
                at = stop
                chars += held
                if chars >= BLOCK_CHARS:
                    block, chars = block + 1, 0
        pieces.forget()
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _joined(column, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype)


COUNTED = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _count_vector(n_a: int):
    """Documents per foretold A id, in one vector a task; each document names an id once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(n_a, np.int64)
        for batch in batches:
            vector += np.bincount(_joined(batch["a"], "<u4"), minlength=n_a)
        found = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(vector[found])], schema=COUNTED)
    return run


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per other pair, summed within a task before the shuffle."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        more, n = np.unique(_joined(batch["pairs"], "<i8"), return_counts=True)
        both, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
        keys = both
        if len(keys) > HELD_PAIRS:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], schema=COUNTED)
            keys, counts = keys[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], schema=COUNTED)


NEEDED = pa.schema([("block", pa.string()), ("key", pa.int64())])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each block, as far as a batch holds it."""
    for batch in batches:
        by_block: dict[str, list[bytes]] = {}
        for block, pairs in zip(batch["block"].to_pylist(), batch["pairs"].to_pylist(), strict=True):
            by_block.setdefault(block, []).append(pairs)
        for block, pairs in by_block.items():
            keys = np.unique(np.frombuffer(b"".join(pairs), "<i8"))
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(keys)), pa.array(keys)], schema=NEEDED)


@dataclass(frozen=True)
class Counts:
    """Documents that link each pair: ``vector[a]`` for foretold pairs, ``pairs(key, n)`` for others; ``best[a]``: the highest of an A id."""
    vector: np.ndarray
    best: np.ndarray
    pairs: DataFrame


RESULT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
FIRST_SQL = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, block string, n_best bigint, count_sum bigint, pairs binary, pair_links binary"


def _look_up_vector(vector: np.ndarray, best: np.ndarray):
    """The share of foretold links, from vectors as long as the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [x.split()[0] for x in FIRST_SQL.split(", ")]
        for batch in batches:
            sizes = np.array([len(x.as_py()) // 4 for x in batch["a"]], np.int64)
            a, links = _joined(batch["a"], "<u4"), _joined(batch["a_links"], "<i8")
            new = {
                "n_best": pa.array(_sums(links * (vector[a] == best[a]), sizes)),
                "count_sum": pa.array(_sums(links * vector[a], sizes))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in kept], names=kept)
    return run


def _look_up_pairs(best: np.ndarray, n_b: int):
    """The share of the other links of a block, from the counts of its distinct pairs."""
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(keys := counts["key"].to_numpy())
        keys, n = keys[order], counts["n"].to_numpy()[order]
        sizes = np.array([len(x.as_py()) // 8 for x in docs["pairs"]], np.int64)
        pairs, links = _joined(docs["pairs"], "<i8"), _joined(docs["pair_links"], "<i8")
        found = n[np.searchsorted(keys, pairs)] if len(pairs) else np.zeros(0, np.int64)
        new = {
            "n_best": pa.array(docs["n_best"].to_numpy() + _sums(links * (found == best[pairs // n_b]), sizes)),
            "count_sum": pa.array(docs["count_sum"].to_numpy() + _sums(links * found, sizes))}
        return pa.table({c: new.get(c, docs[c]) for c in RESULT})
    return run


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Written table of every document's alignment: counts, digest of its groups, distinct ids and pairs with their links."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_align(a_path, b_path), ALIGNED_SQL), "aligned")


def count(found: DataFrame, pair: Pair) -> Counts:
    """Corpus-wide counts. What comes to the driver is two vectors as long as A's vocabulary."""
    counted = "key bigint, n bigint"
    vector, best = np.zeros(pair.n_a, np.int64), np.zeros(pair.n_a, np.int64)
    for key, n in found.select("a").mapInArrow(_count_vector(pair.n_a), counted).groupBy("key").agg(F.sum("n")).collect():
        vector[key] = n
    pairs = written(found.select("pairs").mapInArrow(_count_pairs, counted).groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    a = F.floor(F.col("key") / F.lit(pair.n_b)).alias("a")
    for i, n in pairs.groupBy(a).agg(F.max("n")).collect():
        best[i] = n
    return Counts(vector, np.maximum(best, vector), pairs)


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A is a byte-level tokenizer of the tokenizers library and reads a blank and the text, B a sentencepiece model, which adds the
    blank itself. Byte offsets where tokens of both end cut a text into groups; all A and B tokens of a group are linked. A text
    that is null, empty, or whose joined tokens are not the blank and the text (B's blank sign in it) has no tokens: zeros and
    an empty digest. Strings of special tokens are plain text. Long texts are aligned whole. Repeated rows, and rows of one or no
    id, are documents of their own. An empty table gives no rows; other columns are not read.
    """
    pair = loaded(a_path, b_path)
    found = aligned(docs, a_path, b_path)
    counts = count(found, pair)
    first = found.mapInArrow(_look_up_vector(counts.vector, counts.best), FIRST_SQL)
    # A frequent pair is one row per block here, however many documents hold it.
    needed = found.select("block", "pairs").mapInArrow(_needed, "block string, key bigint").distinct()
    of_block = needed.join(counts.pairs, "key")
    types = dict(x.split() for x in FIRST_SQL.split(", "))
    return first.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(
        _look_up_pairs(counts.best, pair.n_b), ", ".join(f"{c} {types[c]}" for c in RESULT))
