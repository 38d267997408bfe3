"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

A file is a Parquet folder whose rows are blocks in order (Spark has no writer for bare bytes); all that is needed to read a block
is in its bytes: a header, a directory of the documents in it, and the coded ids. Every block starts with an empty model, so blocks
are coded in any order and many at a time: one numpy step codes the next id of each block of a group.

Model. For the next id, order 2 (the two ids before) and order 1 (the id before) each predict the id that last followed, with a count of
how often that held; order 0 remembers the last id of every slot of a small table. Counters mixed from the contexts
of both orders give the odds of "the order-2 id", then of "the order-1 id", then of "an id that order 0 knows", which is coded by
how often each slot was asked before; what nobody predicts is coded by an adaptive length class and its remaining bits. All
arithmetic is on integers, so every machine decodes alike.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from relinker.llm.bpe import CACHE, loaded, tokenizer_path
from relinker.llm.common import fresh_path, maybe_broadcast, settle

# Fixed value: the id after every document.
END = 2

BLOCK = 2048
GROUP = 4096
# Characters of the texts of a file, on average, where the shuffle partitions are too few for that.
FILE_CHARS = 1 << 28
MAGIC = b"RCB2"
HEAD = "<4sIIII"
PIECE = "<qqIBB"
HEAD_BYTES, PIECE_BYTES = struct.calcsize(HEAD), struct.calcsize(PIECE)

SLOT_BITS = 10
KNOWN_BITS = 10
# Slots of order 0 are counted one by one and by rows of this many.
ROW_BITS = 5
ROW = 1 << ROW_BITS
CELLS = np.arange(ROW)
TOP = np.uint64(1 << 48)
MASK = np.uint64((1 << 48) - 1)
LEAST = np.uint64(1 << 32)
SHIFT = np.uint64(16)
HIGH = np.uint64(32)
# Odds are out of 4096; a counter moves a sixteenth of the way towards 32 or 4064, so it is never 0 or 4096.
BITS = 12
CLASSES = 33


class Model:
    """The state of a group of blocks. Tables of all blocks lie behind each other; ``rows * size`` is where a block's begins.

    A prediction is an id (below 2**29) times eight plus the times it held in succession, at most seven.
    """

    def __init__(self, n: int):
        self.rows = np.arange(n)
        self.base, self.base_known = self.rows << SLOT_BITS, self.rows << KNOWN_BITS
        self.base_odds, self.base_eight = self.rows << 7, self.rows << 3
        self.two, self.one = np.zeros(n << SLOT_BITS, np.uint32), np.zeros(n << SLOT_BITS, np.uint32)
        self.known = np.full(n << KNOWN_BITS, 0xFFFFFFFF, np.uint32)
        # How often order 0 was asked for the id of each slot: by slot, by row of slots, in all.
        self.asked = np.zeros(n << KNOWN_BITS, np.uint16)
        self.asked_rows, self.asked_all = np.zeros(n << KNOWN_BITS - ROW_BITS, np.uint16), np.zeros(n, np.int32)
        self.by_slot, self.by_row = self.asked.reshape(-1, ROW), self.asked_rows.reshape(n, -1)
        # Odds of the order-2 id by the counts of both orders and whether they agree, mixed with those by order 2 alone.
        self.odds_both, self.odds_two = np.full(n << 7, 2048, np.int32), np.full(n << 3, 2048, np.int32)
        self.odds_one, self.odds_known = np.full(n << 3, 1024, np.int32), np.full(n, 2048, np.int32)
        self.classes = np.ones((n, CLASSES), np.int32)
        self.total = np.full(n, CLASSES, np.int32)
        self.last, self.before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)

    def predict(self, k: int) -> None:
        last = self.last[:k]
        hashed = last * np.uint32(0x9E3779B1) ^ self.before[:k] * np.uint32(0x85EBCA77)
        self.at_two = self.base[:k] + (hashed >> np.uint32(32 - SLOT_BITS))
        self.at_one = self.base[:k] + (last * np.uint32(0xC2B2AE35) >> np.uint32(32 - SLOT_BITS))
        two, one = self.two.take(self.at_two), self.one.take(self.at_one)
        self.id_two, self.n_two = two >> np.uint32(3), two & np.uint32(7)
        self.id_one, self.n_one = one >> np.uint32(3), one & np.uint32(7)
        self.agree = self.id_two == self.id_one
        self.at_both = self.base_odds[:k] + ((self.n_two << np.uint32(4)) + (self.n_one << np.uint32(1)) + self.agree)
        self.at_alone = self.base_eight[:k] + self.n_two
        self.p_both, self.p_alone = self.odds_both.take(self.at_both), self.odds_two.take(self.at_alone)
        self.p_two = (self.p_both + self.p_alone) >> 1

    def ask(self, rows: np.ndarray, slot: np.ndarray, count: np.ndarray | int = 1) -> None:
        """Adds to the counts of a slot; a block has fewer ids than a count can hold."""
        self.asked[self.base_known[rows] + slot] += np.uint16(count)
        self.asked_rows[(self.base_known[rows] + slot) >> ROW_BITS] += np.uint16(count)
        self.asked_all[rows] += count

    def replace(self, rows: np.ndarray, slot: np.ndarray, ids: np.ndarray) -> None:
        """A slot takes a new id; it keeps its counts, and one that had none gets one."""
        at = self.base_known[rows] + slot
        self.known[at] = ids
        new = np.flatnonzero(self.asked.take(at) == 0)
        self.ask(rows[new], slot[new])

    def learn_class(self, rows: np.ndarray, found: np.ndarray) -> None:
        self.classes[rows, found] += 24
        self.total[rows] += 24
        full = rows[self.total[rows] > 4000]
        if len(full):
            self.classes[full] = (self.classes[full] + 1) >> 1
            self.total[full] = self.classes[full].sum(axis=1)

    def update(self, k: int, ids: np.ndarray, hit: np.ndarray) -> None:
        goal = hit * np.int32(4032) + np.int32(32)
        self.odds_both[self.at_both] = self.p_both + ((goal - self.p_both) >> 4)
        self.odds_two[self.at_alone] = self.p_alone + ((goal - self.p_alone) >> 4)
        fresh = ids << np.uint32(3)
        self.two[self.at_two] = fresh + np.minimum(self.n_two + np.uint32(1), np.uint32(7)) * hit
        held = self.id_one == ids
        count = np.where(held, np.minimum(self.n_one + np.uint32(1), np.uint32(7)), self.n_one >> np.uint32(1))
        # A prediction of order 1 that held often is given up only after it has failed as often.
        self.one[self.at_one] = np.where(held | (self.n_one < 2), fresh, self.id_one << np.uint32(3)) + count
        self.before[:k] = self.last[:k]
        self.last[:k] = ids


def _moved(odds: np.ndarray, hit: np.ndarray) -> np.ndarray:
    return odds + ((hit * np.int32(4032) + np.int32(32) - odds) >> 4)


def slot_of(ids: np.ndarray) -> np.ndarray:
    return (ids * np.uint32(0x9E3779B1) >> np.uint32(32 - KNOWN_BITS)).astype(np.int64)


def class_of(ids: np.ndarray) -> np.ndarray:
    """The number of bits of an id."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.int64)


class Encoder:
    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, MASK, np.uint64)
        self.width = 64
        self.out = np.zeros((n, self.width), np.uint16)
        self.used = np.zeros(n, np.int64)

    def bit(self, rows: np.ndarray, hit: np.ndarray, odds: np.ndarray) -> None:
        wide = self.range[rows]
        bound = (wide >> np.uint64(BITS)) * odds.astype(np.uint64)
        self._narrow(rows, np.where(hit, np.uint64(0), bound), np.where(hit, bound, wide - bound))

    def even(self, rows: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        part = self.range[rows] >> bits.astype(np.uint64)
        self._narrow(rows, part * value.astype(np.uint64), part)

    def of(self, rows: np.ndarray, start: np.ndarray, freq: np.ndarray, total: np.ndarray) -> None:
        part = _ratio(self.range[rows], total)
        self._narrow(rows, part * start.astype(np.uint64), part * freq.astype(np.uint64))

    def _narrow(self, rows: np.ndarray, add: np.ndarray, wide: np.ndarray) -> None:
        low = self.low[rows] + add
        over = low >= TOP
        if over.any():
            self._carry(rows[over])
            low &= MASK
        small = np.flatnonzero(wide < LEAST)
        if len(small):
            out = rows[small]
            used = self.used[out]
            if used.max() + 4 > self.width:
                self._widen()
            some = low[small]
            self.out[out, used] = some >> HIGH
            self.used[out] = used + 1
            low[small] = (some << SHIFT) & MASK
            wide[small] <<= SHIFT
        self.low[rows], self.range[rows] = low, wide

    def _carry(self, rows: np.ndarray) -> None:
        at = self.used[rows] - 1
        while len(rows):
            self.out[rows, at] += np.uint16(1)
            more = self.out[rows, at] == 0
            rows, at = rows[more], at[more] - 1

    def _widen(self) -> None:
        self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.width *= 2

    def finish(self) -> list[bytes]:
        rows = np.arange(len(self.low))
        for _ in range(3):
            if len(rows) and self.used.max() + 4 > self.width:
                self._widen()
            self.out[rows, self.used] = self.low >> HIGH
            self.used += 1
            self.low = (self.low << SHIFT) & MASK
        return [self.out[i, :n].astype("<u2").tobytes() for i, n in enumerate(self.used)]


def _ratio(value: np.ndarray, by: np.ndarray) -> np.ndarray:
    """value // by for values below 2**48: a double holds such a quotient well enough to tell it from the next integer."""
    return (value.astype(np.float64) / by).astype(np.uint64)


class Decoder:
    def __init__(self, coded: list[bytes]):
        self.width = max((len(c) for c in coded), default=0) // 2 + 4
        words = np.zeros((len(coded), self.width), np.uint16)
        for i, c in enumerate(coded):
            words[i, :len(c) // 2] = np.frombuffer(c, "<u2")
        first = words[:, :3].astype(np.uint64)
        self.code = (first[:, 0] << HIGH) | (first[:, 1] << SHIFT) | first[:, 2]
        self.words = words.ravel()
        self.next = np.arange(len(coded)) * self.width + 3
        self.range = np.full(len(coded), MASK, np.uint64)

    def bit(self, rows: np.ndarray, odds: np.ndarray) -> np.ndarray:
        wide, code = self.range[rows], self.code[rows]
        bound = (wide >> np.uint64(BITS)) * odds.astype(np.uint64)
        hit = code < bound
        self._narrow(rows, np.where(hit, code, code - bound), np.where(hit, bound, wide - bound))
        return hit

    def even(self, rows: np.ndarray, bits: np.ndarray) -> np.ndarray:
        bits = bits.astype(np.uint64)
        part, code = self.range[rows] >> bits, self.code[rows]
        value = np.minimum(_ratio(code, part), (np.uint64(1) << bits) - np.uint64(1))
        self._narrow(rows, code - part * value, part)
        return value.astype(np.int64)

    def of(self, rows: np.ndarray, total: np.ndarray) -> np.ndarray:
        self.part = _ratio(self.range[rows], total)
        return np.minimum(_ratio(self.code[rows], self.part).astype(np.int64), total - 1)

    def took(self, rows: np.ndarray, start: np.ndarray, freq: np.ndarray) -> None:
        self._narrow(rows, self.code[rows] - self.part * start.astype(np.uint64), self.part * freq.astype(np.uint64))

    def _narrow(self, rows: np.ndarray, code: np.ndarray, wide: np.ndarray) -> None:
        small = np.flatnonzero(wide < LEAST)
        if len(small):
            out = rows[small]
            at = self.next[out]
            code[small] = (code[small] << SHIFT) | self.words.take(at, mode="clip")
            self.next[out] = at + 1
            wide[small] <<= SHIFT
        self.code[rows], self.range[rows] = code, wide


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Codes each block (an array of ids below 2**29); the blocks of a group move together, longest first."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.asarray([len(blocks[i]) for i in order], np.int64)
    ids = np.zeros((len(blocks), int(lengths.max()) if len(blocks) else 0), np.uint32)
    for row, i in enumerate(order):
        ids[row, :len(blocks[i])] = blocks[i]
    ids = np.ascontiguousarray(ids.T)
    model, coder = Model(len(blocks)), Encoder(len(blocks))
    for t in range(len(ids)):
        k = int(np.searchsorted(-lengths, -t, side="left"))
        now = ids[t, :k]
        model.predict(k)
        hit = now == model.id_two
        coder.bit(model.rows[:k], hit, model.p_two)
        rest = np.flatnonzero(~hit)
        if len(rest):
            ask = rest[~model.agree[rest]]
            hit_one = now[ask] == model.id_one[ask]
            at = model.base_eight[ask] + model.n_one[ask]
            odds = model.odds_one.take(at)
            coder.bit(ask, hit_one, odds)
            model.odds_one[at] = _moved(odds, hit_one)
            rest = np.concatenate([ask[~hit_one], rest[model.agree[rest]]])
            _put_rare(model, coder, rest, now[rest])
        model.update(k, now, hit)
    coded = coder.finish()
    out: list[bytes] = [b""] * len(blocks)
    for row, i in enumerate(order):
        out[i] = coded[row]
    return out


def _put_rare(model: Model, coder: Encoder, rows: np.ndarray, ids: np.ndarray) -> None:
    slot = slot_of(ids)
    known = model.known.take(model.base_known[rows] + slot) == ids
    odds = model.odds_known[rows]
    coder.bit(rows, known, odds)
    model.odds_known[rows] = _moved(odds, known)
    _put_slot(model, coder, rows[known], slot[known])
    rows, ids, slot = rows[~known], ids[~known], slot[~known]
    if len(rows):
        found = class_of(ids)
        before = np.cumsum(model.classes[rows], axis=1)
        freq = model.classes[rows, found]
        coder.of(rows, before[np.arange(len(rows)), found] - freq, freq, model.total[rows])
        model.learn_class(rows, found)
        model.replace(rows, slot, ids)
        high, low = _rest_bits(found)
        wide = np.flatnonzero(high)
        if len(wide):
            coder.even(rows[wide], (ids[wide] >> np.uint32(16)) - (1 << high[wide]), high[wide])
        coder.even(rows, np.where(high > 0, ids & np.uint32(0xFFFF), ids & ((1 << low) - 1)), low)


def _rest_bits(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of an id that its length class leaves open, above and within its lowest 16; the first bit is always one."""
    rest = np.maximum(found - 1, 0)
    return np.maximum(rest - 16, 0), np.minimum(rest, 16)


def _put_slot(model: Model, coder: Encoder, rows: np.ndarray, slot: np.ndarray) -> None:
    row, cell = slot >> ROW_BITS, slot & (ROW - 1)
    at = model.base_known[rows] + slot
    before = np.where(CELLS < row[:, None], model.by_row.take(rows, axis=0), 0).sum(axis=1, dtype=np.int32)
    before += np.where(CELLS < cell[:, None], model.by_slot.take(at >> ROW_BITS, axis=0), 0).sum(axis=1, dtype=np.int32)
    coder.of(rows, before, model.asked.take(at), model.asked_all[rows])
    model.ask(rows, slot)


def _found(counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row of counts that holds a place, and what stands before it."""
    ends = np.cumsum(counts, axis=1, dtype=np.int32)
    cell = (ends <= place[:, None]).sum(axis=1)
    at = np.arange(len(place))
    return cell, ends[at, cell] - counts[at, cell]


def _take_slot(model: Model, coder: Decoder, rows: np.ndarray) -> np.ndarray:
    place = coder.of(rows, model.asked_all[rows])
    row, before = _found(model.by_row.take(rows, axis=0), place)
    cell, more = _found(model.by_slot.take((model.base_known[rows] >> ROW_BITS) + row, axis=0), place - before)
    slot = (row << ROW_BITS) + cell
    coder.took(rows, before + more, model.asked.take(model.base_known[rows] + slot))
    model.ask(rows, slot)
    return slot


def decode_blocks(coded: list[bytes], lengths_in: list[int]) -> list[np.ndarray]:
    order = sorted(range(len(coded)), key=lambda i: -lengths_in[i])
    lengths = np.asarray([lengths_in[i] for i in order], np.int64)
    model, coder = Model(len(coded)), Decoder([coded[i] for i in order])
    ids = np.zeros((int(lengths.max()) if len(coded) else 0, len(coded)), np.uint32)
    for t in range(len(ids)):
        k = int(np.searchsorted(-lengths, -t, side="left"))
        model.predict(k)
        now = ids[t, :k]
        hit = coder.bit(model.rows[:k], model.p_two)
        now[:] = model.id_two
        rest = np.flatnonzero(~hit)
        if len(rest):
            ask = rest[~model.agree[rest]]
            at = model.base_eight[ask] + model.n_one[ask]
            odds = model.odds_one.take(at)
            hit_one = coder.bit(ask, odds)
            model.odds_one[at] = _moved(odds, hit_one)
            now[ask] = model.id_one[ask]
            rest = np.concatenate([ask[~hit_one], rest[model.agree[rest]]])
            now[rest] = _take_rare(model, coder, rest)
        model.update(k, now, hit)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    columns = np.ascontiguousarray(ids.T)
    for row, i in enumerate(order):
        out[i] = columns[row, :lengths_in[i]]
    return out


def _take_rare(model: Model, coder: Decoder, rows: np.ndarray) -> np.ndarray:
    ids = np.zeros(len(rows), np.uint32)
    odds = model.odds_known[rows]
    known = coder.bit(rows, odds)
    model.odds_known[rows] = _moved(odds, known)
    some = rows[known]
    ids[known] = model.known.take(model.base_known[some] + _take_slot(model, coder, some))
    some = rows[~known]
    if len(some):
        place = coder.of(some, model.total[some])
        before = np.cumsum(model.classes[some], axis=1)
        found = (before <= place[:, None]).sum(axis=1)
        freq = model.classes[some, found]
        coder.took(some, before[np.arange(len(some)), found] - freq, freq)
        model.learn_class(some, found)
        high, low = _rest_bits(found)
        value = np.where(found > 0, np.int64(1) << high + low, 0)
        wide = np.flatnonzero(high)
        if len(wide):
            value[wide] |= coder.even(some[wide], high[wide]) << 16
        fresh = (value | coder.even(some, low)).astype(np.uint32)
        ids[~known] = fresh
        model.replace(some, slot_of(fresh), fresh)
    return ids


# --- blocks of documents -------------------------------------------------------------------------------------------

# White space of the tokenizer's pattern (Unicode White_Space).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = re.compile(f"[{_WHITE}]+(?![^{_WHITE}])| ?[^{_WHITE}]+|[{_WHITE}]")


class ByteWords:
    """Ids of texts by a byte-level tokenizer, each piece between white space encoded once by the library.

    The tokenizer's own pattern never joins characters across these pieces. A text with a special token is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        # U+0120 stands for a space in byte-level vocabularies.
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.ids: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.ids]
        if len(self.ids) + len(new) > CACHE:
            self.ids = {}
            new = list(pieces)
        # Pieces that start with a space can stand behind each other: only their first ids start with one.
        spaced = [p for p in new if len(p) > 1 and p[0] == " " and p[1] not in _WHITE]
        for at in range(0, len(spaced), 4096):
            some = spaced[at:at + 4096]
            joined = "".join(some)
            if any(s in joined for s in self.special):
                self._learn_each(some)
                continue
            ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            raw, ends = ids.tobytes(), (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
            self.ids.update(zip(some, (raw[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True))
        self._learn_each([p for p in new if len(p) < 2 or p[0] != " " or p[1] in _WHITE])

    def _learn_each(self, pieces: list[str]) -> None:
        from array import array

        coded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        self.ids.update(zip(pieces, (array("I", c.ids).tobytes() for c in coded), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if any(s in t for s in self.special) else PIECES.findall(t) for t in texts]
        self.learn(set().union(*(s for s in split if s)))
        out = []
        for text, pieces in zip(texts, split, strict=True):
            if pieces is None:
                out.append(np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(self.ids.__getitem__, pieces)), np.uint32))
        return out


def block_bytes(ids: np.ndarray, coded: bytes, pieces: list[tuple[int | None, int, int, bool, bool]]) -> bytes:
    """Header, directory (document, its number in the file, ids in this block, first piece, last piece) and coded ids."""
    directory = b"".join(struct.pack(PIECE, doc or 0, number, n, first | (doc is None) << 1, last) for doc, number, n, first, last in pieces)
    return struct.pack(HEAD, MAGIC, len(ids), len(coded), len(pieces), zlib.crc32(ids.astype("<u4").tobytes())) + directory + coded


def write_blocks(docs: DataFrame, folder: str, path: str) -> str:
    """Writes the ids of documents in ascending order of doc_id as (file, block, data) rows.

    Documents are dealt out by ranges of doc_id, so files follow each other in that order; a null doc_id comes first.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = loaded(ByteWords, path)
        held: list[np.ndarray] = []
        pieces: list[list] = [[]]
        room, block, number, file = BLOCK, 0, 0, 0

        def flush(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, pieces, block
            flat = np.concatenate(held) if held else np.zeros(0, np.uint32)
            full = len(flat) // BLOCK
            n = -(-len(flat) // BLOCK) if last else full
            blocks = [flat[i * BLOCK:(i + 1) * BLOCK] for i in range(n)]
            coded = encode_blocks(blocks)
            if n:
                rows = [block_bytes(b, c, p) for b, c, p in zip(blocks, coded, pieces[:n], strict=True)]
                yield pd.DataFrame({"file": file, "block": range(block, block + n), "data": rows})
            block += n
            held, pieces = [flat[n * BLOCK:]], pieces[n:] or [[]]

        for batch in batches:
            file = int(batch["file"].iloc[0]) if len(batch) else file
            docs_in = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            texts = batch["text"].tolist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) < 1_000_000):
                    size += len(texts[stop])
                    stop += 1
                for doc, ids in zip(docs_in[at:stop], words.encode(texts[at:stop]), strict=True):
                    left = len(ids) + 1
                    held += [ids, np.array([END], np.uint32)]
                    first = True
                    while left:
                        n = min(left, room)
                        left -= n
                        room -= n
                        pieces[-1].append((doc, number, n, first, left == 0))
                        first = False
                        if room == 0:
                            pieces.append([])
                            room = BLOCK
                    number += 1
                at = stop
                if len(pieces) > GROUP:
                    yield from flush(False)
        yield from flush(True)
        words.ids = {}

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-(slim.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // FILE_CHARS))
    sorted_docs = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").withColumn("file", F.spark_partition_id())
    # As text: pandas would turn ids beside a null one into doubles.
    sorted_docs = sorted_docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    sorted_docs.mapInPandas(run, "file int, block bigint, data binary").write.parquet(folder)
    return folder


PIECE_SCHEMA = "file int, number bigint, doc_id bigint, block bigint, offset bigint, n bigint, crc bigint, whole boolean"


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, bytes, tuple, bytes]]:
    """(file, block, data, head, raw ids) of each row; a block that fails its own checksum raises."""
    for batch in batches:
        for at in range(0, len(batch), GROUP):
            part = batch.iloc[at:at + GROUP]
            heads = [struct.unpack_from(HEAD, d) for d in part["data"]]
            coded = [d[HEAD_BYTES + h[3] * PIECE_BYTES:][:h[2]] for d, h in zip(part["data"], heads, strict=True)]
            found = decode_blocks(coded, [h[1] for h in heads])
            for file, block, data, head, ids in zip(part["file"], part["block"], part["data"], heads, found, strict=True):
                raw = ids.astype("<u4").tobytes()
                if head[0] != MAGIC or zlib.crc32(raw) != head[4]:
                    raise ValueError(f"block {block} of file {file} is damaged")
                yield int(file), int(block), data, head, raw


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run of a document's ids that a task meets in order, with their checksum; ``whole`` if that is all of them.

    A task reads the blocks of a file one after the other and carries the checksum of the document that the end of a block
    cuts, so only documents at the border of two tasks come in several rows.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        # What is open: file, number, document, its first block and offset, ids, checksum, whether it began here, last block.
        held: list | None = None

        def close(last: bool) -> None:
            nonlocal held
            file, number, doc, block, offset, n, crc, began, _ = held
            rows.append((file, number, doc, block, offset, n, crc, began and last))
            held = None

        def table() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[x.split()[0] for x in PIECE_SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

        for file, block, data, head, raw in _decoded(batches):
            offset = 0
            for i in range(head[3]):
                doc, number, n, flags, last = struct.unpack_from(PIECE, data, HEAD_BYTES + i * PIECE_BYTES)
                piece = raw[4 * offset:4 * (offset + n)]
                if held and not (held[0] == file and held[1] == number and held[8] == block - 1):
                    close(False)
                if held:
                    held[5], held[6], held[8] = held[5] + n, zlib.crc32(piece, held[6]), block
                else:
                    held = [file, number, None if flags & 2 else doc, block, offset, n, zlib.crc32(piece), bool(flags & 1), block]
                offset += n
                if last:
                    close(True)
            if len(rows) >= 10_000:
                yield table()
                rows.clear()
        if held:
            close(False)
        yield table()

    return spark.read.schema("file int, block bigint, data binary").parquet(folder).mapInPandas(run, PIECE_SCHEMA)


def _times(matrix: Sequence[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@lru_cache(64)
def _zero_bytes(i: int) -> tuple[int, ...]:
    """The operator that feeds 2**i zero bytes to a CRC-32, one column per bit."""
    if i == 0:
        power = [0xEDB88320] + [1 << k for k in range(31)]
        for _ in range(3):
            power = [_times(power, power[k]) for k in range(32)]
        return tuple(power)
    half = _zero_bytes(i - 1)
    return tuple(_times(half, half[k]) for k in range(32))


def crc_joined(first: int, second: int, bytes_in_second: int) -> int:
    """The CRC-32 of two byte strings behind each other, from their own: as many zero bytes are fed to the first."""
    for i in range(bytes_in_second.bit_length()):
        if bytes_in_second >> i & 1:
            first = _times(_zero_bytes(i), first)
    return first ^ second


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    pieces = settle(read_pieces(spark, folder))
    totals = pieces.groupBy("file").agg(F.sum("n").alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    place = F.col("block") * BLOCK + F.col("offset")
    whole = pieces.where("whole").select("file", "doc_id", place.alias("place"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        crc, n = 0, 0
        for c, k in zip(group["crc"], group["n"], strict=True):
            crc = crc_joined(crc, int(c), 4 * int(k)) if n else int(c)
            n += int(k)
        first = group.iloc[0]
        return pd.DataFrame({
            "file": [first["file"]], "doc_id": pd.array([first["doc_id"]], "Int64"),
            "place": [int(first["block"]) * BLOCK + int(first["offset"])], "n_tokens": [n], "ids_crc32": [crc]})

    cut = pieces.where("not whole").groupBy("file", "number").applyInPandas(
        joined, "file int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    found = whole.unionByName(cut)
    return found.join(maybe_broadcast(starts, starts.count()), "file").select(
        "doc_id", (F.col("before") + F.col("place")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes all texts, writes the files below the shared folder, reads them back and reports each document.

    A null text is empty and has the end id alone; a null doc_id comes first and stays null; a repeated doc_id gives as many
    rows; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = write_blocks(docs, fresh_path(spark, "tokens"), path or tokenizer_path("byte_bpe_50k.json"))
    return documents_of(spark, folder)
