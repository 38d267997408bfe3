"""Best match of every string of a block among the strings of another one, without scoring all pairs exactly.

The letters that two strings share bound every score here. They are counted in words of bits, a few instructions to a pair; what may
still win goes on to the longest common subsequence, the edit distance or the exact score, of many pairs at once.
"""
from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle

from relinker.functions import strings

# The helpers travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of bits to a string, letters that may have bits, and bits of one letter at most. What has no bit is bounded by its number.
WORDS, LETTERS, LEVELS = 3, 64, 16
# Cells of the table of letters of a strip of targets, queries that meet it at a time, and pairs compared at a time.
STRIP_CELLS, QUERIES, PAIRS = 1 << 21, 256, 1 << 14
# Targets of a piece of a strip, and pairs that are bounded at a time.
PIECE, BOUNDED = 4096, 1 << 16
# Neighbours by text, on each side of each order, that give each query a first floor, and how many pairs are scored first where that is costly.
NEIGHBOURS, FIRST = 3, 2
# Pairs of a query with the highest bounds, scored before all others that pass.
LEADERS = 8
# Longest string whose places are the bits of a word.
PLACES = 64
# Words of bits of couples of letters.
COUPLES = 4
# Bits of the number of a letter that places are compared by first, and letters compared at a time.
BITS, MATCHED = 2, 1 << 20
EPS = 1e-9
# An edit distance d is the score FAR - d, which is above 0 for any two strings.
FAR = float(1 << 31)

ONE = np.uint64(1)


def _alphabet(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct code points, the place of each one among them, and how often each stands there."""
    count = np.bincount(codes)
    held = np.flatnonzero(count)
    number = np.zeros(len(count), np.int64)
    number[held] = np.arange(len(held))
    return held, number[codes], count[held]


class Strip:
    """Targets of about one length, as letters and as words of bits."""

    def __init__(self, texts: list[str]):
        codes = strings._codes(texts, -1)
        self.texts = texts
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.alphabet, number, total = _alphabet(codes[codes >= 0])
        self.letters = np.zeros(codes.shape, np.int32)
        self.letters[codes >= 0] = number + 1
        self.counted = np.sort(np.argsort(-total, kind="stable")[:LETTERS]) + 1
        # What two strings share is counted in bytes where it fits.
        self.count = np.uint8 if codes.shape[1] < 256 else np.uint32
        counts = self.counts(self.letters)
        levels = [(float((counts[:, c] >= k).mean()), c, k) for c in range(counts.shape[1]) for k in range(1, LEVELS + 1)]
        self.levels = [(c, k) for share, c, k in sorted(levels, reverse=True)[:64 * WORDS] if share > 0]
        self.words, self.rest = self.bits(counts, self.lengths)
        self.couples = _couples(self.letters)

    @property
    def unknown(self) -> int:
        return len(self.alphabet) + 1

    def numbered(self, texts: list[str]) -> np.ndarray:
        """Letters of queries; one that no target has, and the end of a query, equals no letter of a target."""
        codes = strings._codes(texts, -1)
        at = np.minimum(np.searchsorted(self.alphabet, codes), max(len(self.alphabet) - 1, 0))
        known = self.alphabet[at] == codes if len(self.alphabet) else np.zeros(codes.shape, bool)
        return np.where(known, at + 1, self.unknown).astype(np.int32)

    def counts(self, letters: np.ndarray) -> np.ndarray:
        column = np.zeros(self.unknown + 1, np.int64)
        column[self.counted] = np.arange(1, len(self.counted) + 1)
        width = len(self.counted) + 1
        cells = np.arange(len(letters))[:, None] * width + column[letters]
        return np.bincount(cells.ravel(), minlength=len(letters) * width).reshape(len(letters), width)[:, 1:]

    def bits(self, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.zeros((WORDS, len(counts)), np.uint64)
        for i, (c, k) in enumerate(self.levels):
            words[i // 64] |= (counts[:, c] >= k).astype(np.uint64) << np.uint64(i % 64)
        rest = lengths - np.bitwise_count(words).sum(axis=0)
        return words, np.minimum(rest, np.iinfo(self.count).max).astype(self.count)

    def asked(self, texts: list[str]) -> Queries:
        return Queries(texts, self)

    def may_share(self, q: Queries, some: np.ndarray, low: int, high: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of some queries and the targets of a piece that may share as many letters as needed, with at least as many as they share."""
        shared = np.minimum(self.rest[low:high], q.rest[some, None])
        both = np.empty(shared.shape, np.uint64)
        for w in range(WORDS):
            np.bitwise_and(q.words[w, some, None], self.words[w, low:high], out=both)
            shared += np.bitwise_count(both)
        at = np.flatnonzero(shared >= need[:, None].astype(self.count))
        a, b = np.divmod(at, high - low)
        return some[a], low + b, shared.ravel()[at].astype(np.int64)


class Queries:
    """Some queries beside a strip."""

    def __init__(self, texts: list[str], strip: Strip):
        self.texts = texts
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.letters = strip.numbered(texts)
        self.words, self.rest = strip.bits(strip.counts(self.letters), self.lengths)
        self.masks = _places(self.letters, strip.unknown)
        # The end of a query has the number of an unknown letter.
        self.couples = _couples(np.where(np.arange(self.letters.shape[1]) < self.lengths[:, None], self.letters, 0))


def _places(letters: np.ndarray, end: int) -> np.ndarray:
    """The places of each letter in each string, as bits; only the first 64 places."""
    out = np.zeros((len(letters), end + 1), np.uint64)
    row = np.arange(len(letters))
    for i in range(min(letters.shape[1], PLACES)):
        out[row, letters[:, i]] |= ONE << np.uint64(i)
    out[:, [0, end]] = 0
    return out


def _couples(letters: np.ndarray) -> np.ndarray:
    """The letters of each string and those after them, as some words of bits by a number of both; 0 is no letter."""
    out = np.zeros((COUPLES, len(letters)), np.uint64)
    row = np.arange(len(letters))
    for i in range(letters.shape[1] - 1):
        number = letters[:, i].astype(np.int64) * 37 + letters[:, i + 1]
        word, bit = number // 64 % COUPLES, (number % 64).astype(np.uint64)
        out[word, row] |= (letters[:, i + 1] > 0).astype(np.uint64) << bit
    return out


class Places:
    """Targets of about one length for the comparison place by place: the bits of the numbers of their letters, a word for 64 places."""

    def __init__(self, texts: list[str]):
        codes = strings._codes(texts, -1)
        self.texts = texts
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.alphabet, number, count = _alphabet(codes[codes >= 0])
        # Numbers by frequency, so that the lowest bits tell apart frequent letters. 1 is for a letter that no target has.
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(2, len(count) + 2)
        self.rank = rank
        self.letters = np.zeros(codes.shape, np.int32)
        self.letters[codes >= 0] = rank[number]
        self.width, self.depth = codes.shape[1], int(len(count) + 1).bit_length()
        self.planes = self.bits(self.letters)

    def bits(self, letters: np.ndarray) -> np.ndarray:
        words = max((self.width + 63) // 64, 1)
        out = np.zeros((self.depth, words, len(letters)), np.uint64)
        for i in range(min(letters.shape[1], self.width)):
            at, column = np.uint64(i % 64), letters[:, i].astype(np.uint64)
            for k in range(self.depth):
                out[k, i // 64] |= (column >> np.uint64(k) & ONE) << at
        return out

    def asked(self, texts: list[str]) -> PlacedQueries:
        return PlacedQueries(texts, self)

    def may_share(self, q: PlacedQueries, some: np.ndarray, low: int, high: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``Strip.may_share``, of equal letters in place. Places where two bits of the numbers differ are no more than those of different letters.

        A place that only one string has is counted as different, so that what is left of the longer one is equal.
        """
        kind = np.int16 if max(self.width, q.letters.shape[1]) < 1 << 14 else np.int64
        longer = np.maximum(q.lengths[some, None].astype(kind), self.lengths[None, low:high].astype(kind))
        for w in range(self.planes.shape[1]):
            differ = q.planes[0, w, some, None] ^ self.planes[0, w, low:high]
            for k in range(1, min(self.depth, BITS)):
                differ |= q.planes[k, w, some, None] ^ self.planes[k, w, low:high]
            longer -= np.bitwise_count(differ)
        # Places of a query beyond all targets.
        longer -= np.maximum(q.lengths[some, None] - self.width, 0).astype(kind)
        at = np.flatnonzero(longer >= need[:, None].astype(kind))
        a, b = np.divmod(at, high - low)
        return some[a], low + b, longer.ravel()[at].astype(np.int64)


class PlacedQueries:
    """Some queries beside the places of targets."""

    def __init__(self, texts: list[str], strip: Places):
        self.texts = texts
        self.lengths = np.array([len(x) for x in texts], np.int64)
        codes = strings._codes(texts, -1)
        at = np.minimum(np.searchsorted(strip.alphabet, codes), max(len(strip.alphabet) - 1, 0))
        known = strip.alphabet[at] == codes if len(strip.alphabet) else np.zeros(codes.shape, bool)
        self.letters = np.where(known, strip.rank[at] if len(strip.rank) else 0, codes >= 0).astype(np.int32)
        self.planes = strip.bits(self.letters)


def common_subsequences(q: Queries, strip: Strip, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair (a of q, b of strip)."""
    out = np.zeros(len(a), np.int64)
    short = q.lengths[a] <= PLACES
    for i in np.flatnonzero(~short):
        out[i] = strings.lcs_length(q.texts[a[i]], strip.texts[b[i]])
    for start in range(0, len(a), PAIRS):
        some = start + np.flatnonzero(short[start:start + PAIRS])
        if not len(some):
            continue
        base = a[some] * q.masks.shape[1]
        letters = strip.letters[b[some], :int(strip.lengths[b[some]].max())].T
        masks = q.masks.ravel()
        row = np.full(len(some), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in letters:
            hit = row & masks[base + at]
            row = (row + hit) | (row - hit)
        out[some] = 64 - np.bitwise_count(row).astype(np.int64)
    return out


def edit_distances(q: Queries, strip: Strip, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each pair (a of q, b of strip), neither string empty.

    A column of the table of distances is held as the differences between its cells, a bit each (Myers); what the last cell gains
    with each letter of the target is added up. Strings of more than 64 characters take several words, with carries.
    """
    out = np.zeros(len(a), np.int64)
    words = (q.lengths[a] + PLACES - 1) // PLACES
    for count in np.unique(words):
        masks = [_places(q.letters[:, PLACES * w:PLACES * (w + 1)], strip.unknown).ravel() for w in range(count)]
        alike = np.flatnonzero(words == count)
        # Pairs of about one length stop together.
        alike = alike[np.argsort(strip.lengths[b[alike]], kind="stable")]
        for start in range(0, len(alike), PAIRS):
            some = alike[start:start + PAIRS]
            out[some] = _edit_distances(q, strip, a[some], b[some], masks)
    return out


def _edit_distances(q: Queries, strip: Strip, a: np.ndarray, b: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    base = a * (strip.unknown + 1)
    letters = strip.letters[b, :int(strip.lengths[b].max())].T
    distance = q.lengths[a].copy()
    top = ((q.lengths[a] - 1) % PLACES).astype(np.uint64)
    rises = [np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in masks]
    falls = [np.zeros(len(a), np.uint64) for _ in masks]
    last = len(masks) - 1
    for at in letters:
        # Along the first row each letter costs one more.
        carry, rise_in, fall_in = np.uint64(0), ONE, np.uint64(0)
        for w, mask in enumerate(masks):
            rise, fall = rises[w], falls[w]
            hit = mask[base + at]
            same = hit & rise
            total = same + rise
            over = total < same
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            level = (total ^ rise) | hit | fall
            up, down = fall | ~(level | rise), rise & level
            if w == last:
                # A target that has ended gains nothing more.
                distance += np.where(at > 0, ((up >> top) & ONE).astype(np.int64) - ((down >> top) & ONE).astype(np.int64), 0)
            next_rise, next_fall = up >> np.uint64(63), down >> np.uint64(63)
            up, down = (up << ONE) | rise_in, (down << ONE) | fall_in
            rise_in, fall_in = next_rise, next_fall
            kept = hit | fall
            rises[w], falls[w] = down | ~(kept | up), up & kept
    return distance


def jaro_winklers(q: Queries, strip: Strip, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``strings.jaro_winkler`` of each pair (a of q, b of strip), rounded to nine places."""
    out = np.zeros(len(a))
    fits = (q.lengths[a] <= PLACES) & (strip.lengths[b] <= PLACES)
    for i in np.flatnonzero(~fits):
        out[i] = strings.jaro_winkler(q.texts[a[i]], strip.texts[b[i]])
    step = max(256, min(PAIRS, (1 << 22) // (strip.unknown + 1)))
    for start in range(0, len(a), step):
        some = start + np.flatnonzero(fits[start:start + step])
        if len(some):
            out[some] = _jaro_winklers(q, strip, a[some], b[some])
    return np.array([round(x, 9) for x in out.tolist()])


def _jaro_winklers(q: Queries, strip: Strip, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    la, lb = q.lengths[a], strip.lengths[b]
    targets, at = np.unique(b, return_inverse=True)
    t_letters = strip.letters[targets, :max(int(lb.max()), 1)]
    masks = _places(t_letters, strip.unknown)
    base, masks = at * masks.shape[1], masks.ravel()
    q_letters = q.letters[a, :max(int(la.max()), 1)]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    span = (ONE << (2 * reach + 1).astype(np.uint64)) - ONE
    taken = np.zeros(len(a), np.uint64)
    used = np.zeros(q_letters.shape, bool)
    for i in range(q_letters.shape[1]):
        window = (span << np.maximum(i - reach, 0).astype(np.uint64)) >> np.maximum(reach - i, 0).astype(np.uint64)
        free = masks[base + q_letters[:, i]] & window & ~taken
        first = free & (~free + ONE)
        taken |= first
        used[:, i] = first != 0
    m = np.bitwise_count(taken).astype(np.int64)
    in_b = (taken[:, None] >> np.arange(t_letters.shape[1], dtype=np.uint64)) & ONE != 0
    # Both sides have as many matched letters in every pair, so they stand beside each other.
    moved = q_letters[used] != t_letters[at][in_b]
    swaps = np.bincount(np.repeat(np.arange(len(a)), m), weights=moved, minlength=len(a)).astype(np.int64) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / some) / 3, 0.0)
    width = min(4, q_letters.shape[1], t_letters.shape[1])
    lead = np.cumprod(q_letters[:, :width] == t_letters[at][:, :width], axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * lead * (1 - jaro), jaro)


# ---- measures -------------------------------------------------------------------------------
# reach(m, a, b): a score that strings of lengths a and b with m letters in common cannot exceed.
# best(q, strip, a, b, floor): (a, b, score) of those of the pairs that may be the best of their query, the best among them.

def _ratio_reach(m, a, b):
    return 2.0 * m / np.maximum(a + b, 1)


def _percent_reach(m, a, b):
    return np.rint(100 * _ratio_reach(m, a, b))


def _jaro_winkler_reach(m, a, b):
    jaro = np.where(m > 0, (m / np.maximum(a, 1) + m / np.maximum(b, 1) + 1) / 3, 0.0)
    return jaro + 0.4 * (1 - jaro) * (m > 0)


def _distance_reach(m, a, b):
    return FAR - (np.maximum(a, b) - m)


def _distances(q: Queries, strip: Strip, a: np.ndarray, b: np.ndarray, floor: np.ndarray):
    """An edit changes two couples of neighbouring letters of a string at most, so half of those that the other lacks are no more than the distance."""
    lacking, more = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for mine, other in zip(q.couples, strip.couples):
        x, y = mine[a], other[b]
        lacking += np.bitwise_count(x & ~y)
        more += np.bitwise_count(y & ~x)
    some = np.flatnonzero(FAR - (np.maximum(lacking, more) + 1) // 2 >= floor[a] - EPS)
    a, b = a[some], b[some]
    return a, b, FAR - edit_distances(q, strip, a, b)


def _percents(q: Queries, strip: Strip, a: np.ndarray, b: np.ndarray, floor: np.ndarray):
    return a, b, np.rint(100 * (2 * common_subsequences(q, strip, a, b) / (q.lengths[a] + strip.lengths[b])))


def _ratcliffs(q: Queries, strip: Strip, a: np.ndarray, b: np.ndarray, floor: np.ndarray):
    """Matching blocks are a common subsequence. The longest of these are scored first, and give a floor for the others."""
    upper = 2 * common_subsequences(q, strip, a, b) / (q.lengths[a] + strip.lengths[b])
    order = np.lexsort((-upper, a))
    order = order[upper[order] >= floor[a[order]] - EPS]
    a, b, upper = a[order], b[order], upper[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    score = np.full(len(a), -1.0)
    floor = floor.copy()
    for now in (rank < FIRST, rank >= FIRST):
        some = np.flatnonzero(now & (upper >= floor[a] - EPS))
        score[some] = strings.ratcliff_ratios([q.texts[i] for i in a[some]], [strip.texts[i] for i in b[some]])
        np.maximum.at(floor, a[some], score[some])
    return a, b, score


def _jaros(q: Queries, strip: Strip, a: np.ndarray, b: np.ndarray, floor: np.ndarray):
    return a, b, jaro_winklers(q, strip, a, b)


def _placed_reach(m, a, b):
    """Share of equal letters in place over the common length, damped by up to half for a length difference."""
    short, long = np.minimum(a, b), np.maximum(a, b)
    some = np.maximum(short, 1)
    return (1 - (short - m) / some) * (1 - 0.5 * ((long - short) / np.maximum(long, 1)))


def _placeds(q: PlacedQueries, strip: Places, a: np.ndarray, b: np.ndarray, floor: np.ndarray):
    width = min(q.letters.shape[1], strip.letters.shape[1])
    equal = np.zeros(len(a), np.int64)
    step = max(1, MATCHED // max(width, 1))
    for start in range(0, len(a), step):
        x, y = q.letters[a[start:start + step], :width], strip.letters[b[start:start + step], :width]
        equal[start:start + step] = ((x == y) & (x > 0)).sum(axis=1)
    return a, b, _placed_reach(equal, q.lengths[a], strip.lengths[b])


MEASURES: dict[str, tuple[Callable, Callable]] = {
    "ratcliff": (_ratio_reach, _ratcliffs),
    "fuzzy": (_percent_reach, _percents),
    "jaro_winkler": (_jaro_winkler_reach, _jaros),
    "levenshtein": (_distance_reach, _distances),
    "hamming": (_placed_reach, _placeds),
}


def _strips(lengths: np.ndarray) -> list[np.ndarray]:
    """Places of the strings by length, cut so that a table of each strip's letters stays small."""
    order = np.argsort(lengths, kind="stable")
    out = []
    stop = len(order)
    while stop:
        start = max(0, stop - max(1, STRIP_CELLS // max(int(lengths[order[stop - 1]]), 1)))
        out.append(order[start:stop])
        stop = start
    return out


class Neighbours:
    """Texts in two orders, forwards and backwards."""

    def __init__(self, texts: list[str]):
        self.orders = []
        for step in (1, -1):
            keys = [x[::step] for x in texts]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            self.orders.append((step, [keys[i] for i in order], np.array(order, np.int64)))

    def of(self, text: str) -> np.ndarray:
        found = []
        for step, keys, order in self.orders:
            at = bisect_left(keys, text[::step])
            found.append(order[max(at - NEIGHBOURS, 0):at + NEIGHBOURS])
        return np.concatenate(found)


def _needs(reach: Callable, lengths: np.ndarray, sizes: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The fewest letters that queries of some lengths share with targets of some sizes to reach their floors; where none do, one too many."""
    a, b = lengths[:, None], sizes[None, :]
    low, high = np.zeros((len(lengths), len(sizes)), np.int64), np.minimum(a, b) + 1
    while (low < high).any():
        middle = (low + high) // 2
        enough = (reach(middle, a, b) >= floor[:, None] - EPS) | (low >= high)
        low, high = np.where(enough, low, middle + 1), np.where(enough, np.minimum(middle, high), high)
    return high


def nearest(name: str, queries: list[str], targets: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The best score of each query and the place of its target; ties go to the earlier place, and -1 is for no score above 0.

    Neighbours in the orders of the texts give each query a floor. What it has to share to reach that floor follows from the lengths
    alone, so that most pairs are no more than a count of common bits beside that number.
    """
    reach, scored = MEASURES[name]
    score, place = np.zeros(len(queries)), np.full(len(queries), -1, np.int64)
    lengths = np.array([len(x) for x in targets], np.int64)
    blank = np.flatnonzero(lengths == 0)
    if len(blank) and name not in ("jaro_winkler", "hamming"):
        # Only another empty string is like an empty one.
        empty = [i for i, x in enumerate(queries) if not x]
        score[empty], place[empty] = reach(1, 1, 1), blank[0]
    asked = np.array([len(x) for x in queries], np.int64)
    # Queries of about one length need about the same.
    filled = np.argsort(asked, kind="stable")
    filled = filled[asked[filled] > 0]
    for strip_places in _strips(lengths):
        strip_places = strip_places[lengths[strip_places] > 0]
        if not len(strip_places) or not len(filled):
            continue
        strip = (Places if name == "hamming" else Strip)([targets[i] for i in strip_places])
        near = Neighbours(strip.texts)
        sizes = np.unique(strip.lengths)
        for start in range(0, len(filled), QUERIES):
            some = filled[start:start + QUERIES]
            q = strip.asked([queries[i] for i in some])
            s, p = score[some], place[some]

            def keep(a: np.ndarray, b: np.ndarray, got: np.ndarray) -> None:
                t = strip_places[b]
                order = np.lexsort((t, -got, a))
                a, t, got = a[order], t[order], got[order]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
                a, t, got = a[first], t[first], got[first]
                better = (got > s[a]) | (got == s[a]) & (got > 0) & (t < p[a])
                s[a[better]], p[a[better]] = got[better], t[better]

            def compare(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
                """Those with the highest bounds first, as they raise the floor for the others."""
                if not found:
                    return
                a, b, m = (np.concatenate(x) for x in zip(*found))
                upper = reach(m, q.lengths[a], strip.lengths[b])
                hit = np.flatnonzero((upper >= s[a] - EPS) & (upper > 0))
                order = hit[np.lexsort((-upper[hit], a[hit]))]
                a, b, upper = a[order], b[order], upper[order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                for now in (rank < LEADERS, rank >= LEADERS):
                    hit = np.flatnonzero(now & (upper >= s[a] - EPS))
                    if len(hit):
                        keep(*scored(q, strip, a[hit], b[hit], s))

            seeds = [near.of(x) for x in q.texts]
            a, b = np.repeat(np.arange(len(some)), [len(x) for x in seeds]), np.concatenate(seeds)
            compare([(a, b, np.minimum(q.lengths[a], strip.lengths[b]))])
            needs = _needs(reach, q.lengths, sizes, s)
            found, held = [], 0
            # Targets of about the lengths of the queries first.
            pieces = np.arange(0, len(strip.texts), PIECE)
            middle = strip.lengths[np.minimum(pieces + PIECE // 2, len(strip.texts) - 1)]
            for low in pieces[np.argsort(np.abs(middle - np.median(q.lengths)), kind="stable")]:
                high = min(low + PIECE, len(strip.texts))
                first, last = np.searchsorted(sizes, [strip.lengths[low], strip.lengths[high - 1]])
                need = needs[:, first:last + 1].min(axis=1)
                open_rows = np.flatnonzero((needs[:, first:last + 1] <= np.minimum(q.lengths[:, None], sizes[first:last + 1])).any(axis=1))
                step = max(BOUNDED // (high - low), 1)
                for at in range(0, len(open_rows), step):
                    rows = open_rows[at:at + step]
                    found.append(strip.may_share(q, rows, low, high, need[rows]))
                    held += len(found[-1][0])
                    if held > 16 * PAIRS:
                        compare(found)
                        found, held = [], 0
                        needs = _needs(reach, q.lengths, sizes, s)
                        need = needs[:, first:last + 1].min(axis=1)
            compare(found)
            score[some], place[some] = s, p
    return score, place


# ---- sparse vectors -------------------------------------------------------------------------

# Terms that are multiplied as a table: at most so many, each in at least one of so many targets; and queries at a time.
DENSE, DENSE_PER, ROWS = 128, 50, 64
# Vectors of a group, columns that the terms of all groups share, groups that come before all others, and cells of a table of queries.
GROUP, COLUMNS, FIRST_GROUPS, BOUND_QUERIES, TABLE_CELLS = 16, 4096, 4, 2048, 1 << 22


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """The row numbers and the values of a list of arrays."""
    sizes = [len(x) for x in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.asarray(x) for x in rows]) if sum(sizes) else np.zeros(0)


def _products(q_terms: list, q_weights: list, t_terms: list, t_weights: list) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each query with its inner products with all targets.

    The most frequent terms are multiplied as a table, each other one runs through the targets that have it.
    """
    t_row, t_term = _flat(t_terms)
    q_row, q_term = _flat(q_terms)
    if not len(t_term) or not len(q_term):
        return
    t_weight, q_weight = _flat(t_weights)[1], _flat(q_weights)[1]
    terms, t_term = np.unique(t_term, return_inverse=True)
    at = np.minimum(np.searchsorted(terms, q_term), len(terms) - 1)
    known = terms[at] == q_term
    q_row, q_term, q_weight = q_row[known], at[known], q_weight[known]
    count = np.bincount(t_term, minlength=len(terms))
    frequent = np.argsort(-count, kind="stable")[:DENSE]
    frequent = frequent[count[frequent] * DENSE_PER >= len(t_terms)]
    column = np.full(len(terms), -1)
    column[frequent] = np.arange(len(frequent))

    def table(row, term, weight, n) -> np.ndarray:
        out = np.zeros((n, len(frequent)))
        some = column[term] >= 0
        out[row[some], column[term[some]]] = weight[some]
        return out

    t_table, q_table = table(t_row, t_term, t_weight, len(t_terms)).T, table(q_row, q_term, q_weight, len(q_terms))
    order = np.argsort(t_term, kind="stable")
    t_row, t_weight = t_row[order], t_weight[order]
    ends = np.concatenate([[0], np.cumsum(count)])
    rare = column[q_term] < 0
    q_row, q_term, q_weight = q_row[rare], q_term[rare], q_weight[rare]
    begins = np.searchsorted(q_row, np.arange(len(q_terms) + 1))
    for start in range(0, len(q_terms), ROWS):
        products = q_table[start:start + ROWS] @ t_table
        for i, found in enumerate(products, start):
            for k in range(begins[i], begins[i + 1]):
                low, high = ends[q_term[k]], ends[q_term[k] + 1]
                found[t_row[low:high]] += q_weight[k] * t_weight[low:high]
            yield i, found


# Bits of a character in the number of an n-gram; three fit.
CHARACTER = 21


def _grams(texts: list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and the number of each n-gram of the texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64) + 1
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    rows, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(low, high + 1):
        starts = max(len(codes) - n + 1, 0)
        whole = row[:starts] == row[len(row) - starts:]
        gram = np.zeros(starts, np.int64)
        for i in range(n):
            gram = gram << CHARACTER | codes[i:i + starts]
        rows.append(row[:starts][whole])
        grams.append(gram[whole])
    return np.concatenate(rows), np.concatenate(grams)


def unit_terms(texts: list[str], grams: list[str], weights: list[float], low: int, high: int) -> tuple[list, list]:
    """The vectors of n-gram counts times weights, of length 1, as numbers of n-grams and values; n-grams without a weight are left out."""
    own = np.zeros(len(grams), np.int64)
    for i, gram in enumerate(grams):
        for c in gram:
            own[i] = own[i] << CHARACTER | ord(c) + 1
    order = np.argsort(own)
    own, weight = own[order], np.asarray(weights, float)[order]
    row, gram = _grams(texts, low, high)
    at = np.searchsorted(own, gram)
    known = at < len(own)
    known[known] = own[at[known]] == gram[known]
    cells, times = np.unique(row[known] * max(len(own), 1) + at[known], return_counts=True)
    row, at = np.divmod(cells, max(len(own), 1))
    value = times * weight[at]
    value /= np.sqrt(np.bincount(row, value * value, minlength=len(texts)))[row]
    ends = np.searchsorted(row, np.arange(1, len(texts)))
    return np.split(own[at], ends), np.split(value, ends)


def unit_means(texts: list[str], words: list[str], vectors: list) -> np.ndarray:
    """The mean vector of the words of each text that have vectors, of length 1; zeros where there is none, or no length."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if not number:
        return np.zeros((len(texts), 0))
    held = np.array([*map(np.asarray, vectors)], float)
    entry = np.array([number[w] for w in words])
    sums, counts = np.zeros((len(number), held.shape[1])), np.bincount(entry)
    np.add.at(sums, entry, held)
    row, word = _flat([[number[w] for w in x.split(" ") if w in number] for x in texts])
    word = word.astype(np.int64)
    with np.errstate(invalid="ignore", divide="ignore"):
        total = np.bincount(row, counts[word], len(texts))[:, None]
        mean = np.stack([np.bincount(row, column[word], len(texts)) for column in sums.T], axis=1) / total
        length = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
        return np.where((total > 0) & (length != 0), mean / length, 0.0)


class Groups:
    """Sparse vectors without negative weights, in groups of some that stand together in an order.

    ``most`` has the largest weight of each term in each group; the rarer terms share columns. So what a query makes of ``most`` is
    no less than its inner product with any vector of the group.
    """

    def __init__(self, terms: list, weights: list, order: np.ndarray):
        row, term = _flat(terms)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.terms, term, count = np.unique(term, return_inverse=True, return_counts=True)
        self.count = -(-len(order) // GROUP)
        by_count = np.empty(len(self.terms), np.int64)
        by_count[np.argsort(-count, kind="stable")] = np.arange(len(self.terms))
        own = COLUMNS * 3 // 4
        self.column = np.where(by_count < own, by_count, own + (by_count - own) % (COLUMNS - own))
        weight = _flat(weights)[1]
        group = rank[row] // GROUP
        self.most = np.zeros((min(len(self.terms), COLUMNS), self.count), np.float32)
        np.maximum.at(self.most, (self.column[term], group), np.nextafter(weight.astype(np.float32), np.float32(np.inf)))
        by_group = np.argsort(group, kind="stable")
        self.row, self.term, self.weight = row[by_group], term[by_group], weight[by_group]
        self.ends = np.searchsorted(group[by_group], np.arange(self.count + 1))
        self.tables: dict[int, tuple] = {}

    def table(self, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of a group's vectors, ascending, its terms, and the weights as a table."""
        if g not in self.tables:
            some = slice(self.ends[g], self.ends[g + 1])
            places, at = np.unique(self.row[some], return_inverse=True)
            terms, column = np.unique(self.term[some], return_inverse=True)
            table = np.zeros((len(terms), len(places)))
            table[column, at] = self.weight[some]
            self.tables[g] = places, terms, table
        return self.tables[g]


def nearest_vectors(q_terms: list, q_weights: list, t_terms: list, t_weights: list,
                    q_order: np.ndarray | None = None, t_order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best inner product of each query, rounded to nine places, and the place of its target; as ``nearest``.

    The vectors that stand together in ``t_order`` had better be alike: one bound for each group of them decides whether a query is
    multiplied with them. The group with the highest bound comes first and gives a floor, then the next few, then all others that may reach it.
    """
    score, place = np.zeros(len(q_terms)), np.full(len(q_terms), -1, np.int64)
    if not sum(map(len, t_terms)) or not sum(map(len, q_terms)):
        return score, place
    if min(x.min() for side in (q_weights, t_weights) for x in side if len(x)) < 0:
        return _nearest_vectors_in_pairs(q_terms, q_weights, t_terms, t_weights)
    groups = Groups(t_terms, t_weights, np.arange(len(t_terms)) if t_order is None else t_order)
    q_row, term = _flat(q_terms)
    at = np.minimum(np.searchsorted(groups.terms, term), len(groups.terms) - 1)
    known = groups.terms[at] == term
    q_row, term, weight = q_row[known], at[known], _flat(q_weights)[1][known]
    begins = np.searchsorted(q_row, np.arange(len(q_terms) + 1))
    order = np.arange(len(q_terms)) if q_order is None else q_order
    chunk = int(max(1, min(BOUND_QUERIES, TABLE_CELLS // len(groups.terms))))
    for start in range(0, len(order), chunk):
        some = order[start:start + chunk]
        bound = np.zeros((len(some), groups.count), np.float32)
        full = np.zeros((len(some), len(groups.terms)))
        for k, i in enumerate(some):
            mine = slice(begins[i], begins[i + 1])
            full[k, term[mine]] = weight[mine]
            bound[k] = weight[mine].astype(np.float32) @ groups.most[groups.column[term[mine]]]
        # The bounds are sums of single precision.
        bound *= np.float32(1 + 1e-4)
        rounded, found = np.zeros(len(some)), np.full(len(some), -1, np.int64)

        def multiply(rows: np.ndarray, in_group: np.ndarray) -> None:
            by_group = np.argsort(in_group, kind="stable")
            rows, in_group = rows[by_group], in_group[by_group]
            cuts = np.flatnonzero(np.r_[True, in_group[1:] != in_group[:-1]]) if len(rows) else np.zeros(0, np.int64)
            for low, high in zip(cuts, np.r_[cuts[1:], len(rows)]):
                places, terms, table = groups.table(int(in_group[low]))
                mine = rows[low:high]
                products = np.rint(full[mine[:, None], terms] @ table * 1e9) / 1e9
                j = products.argmax(axis=1)
                got, t = products[np.arange(len(mine)), j], places[j]
                better = (got > rounded[mine]) | (got == rounded[mine]) & (got > 0) & (t < found[mine])
                rounded[mine[better]], found[mine[better]] = got[better], t[better]

        every = np.arange(len(some))
        done = np.zeros(bound.shape, bool)
        for ahead in (1, FIRST_GROUPS):
            best = np.argpartition(bound, groups.count - min(ahead, groups.count), axis=1)[:, -min(ahead, groups.count):]
            rows, in_group = np.repeat(every, best.shape[1]), best.ravel()
            open_pairs = ~done[rows, in_group] & (bound[rows, in_group] >= rounded[rows] - 2e-9) & (bound[rows, in_group] > 0)
            rows, in_group = rows[open_pairs], in_group[open_pairs]
            done[rows, in_group] = True
            multiply(rows, in_group)
        multiply(*np.nonzero((bound >= (rounded - 2e-9)[:, None]) & (bound > 0) & ~done))
        score[some], place[some] = rounded, found
    return score, place


def _nearest_vectors_in_pairs(q_terms: list, q_weights: list, t_terms: list, t_weights: list) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest_vectors``, for weights of any sign: all products are made."""
    score, place = np.zeros(len(q_terms)), np.full(len(q_terms), -1, np.int64)
    for i, found in _products(q_terms, q_weights, t_terms, t_weights):
        some = np.flatnonzero(found >= found.max() - 2e-9)
        rounded = np.rint(found[some] * 1e9) / 1e9
        j = int(rounded.argmax())
        if rounded[j] > 0:
            score[i], place[i] = rounded[j], some[j]
    return score, place


def nearest_sets(queries: list[str], targets: list[str], alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, of sets of characters, by c / (c + alpha (a - c) + beta (b - c)); c is what sets of a and b characters share.

    Sets are words of bits, a bit for each letter of the targets. Of targets of one size that with the largest c is the best, so that
    a score is made for each size and not for each pair.
    """
    score, place = np.zeros(len(queries)), np.full(len(queries), -1, np.int64)
    if not queries or not targets:
        return score, place
    if min(alpha, beta) < 0 or alpha == beta == 0:
        return _nearest_sets_in_pairs(queries, targets, alpha, beta)
    alphabet = np.unique(strings._codes(targets, -1))
    alphabet = alphabet[alphabet >= 0]

    def bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = strings._codes(texts, -1)
        row, code = np.nonzero(codes >= 0)[0], codes[codes >= 0]
        # A letter that stands twice counts once.
        row, code = np.divmod(np.unique(row.astype(np.int64) << CHARACTER | code), 1 << CHARACTER)
        at = np.minimum(np.searchsorted(alphabet, code), max(len(alphabet) - 1, 0))
        known = alphabet[at] == code if len(alphabet) else np.zeros(len(code), bool)
        words = np.zeros(((len(alphabet) + 63) // 64, len(texts)), np.uint64)
        np.bitwise_or.at(words, (at[known] // 64, row[known]), ONE << (at[known] % 64).astype(np.uint64))
        return words, np.bincount(row, minlength=len(texts))

    (q_words, a), (t_words, b) = bits(queries), bits(targets)
    asked = np.argsort(a, kind="stable")
    # By size, and within a size in the order of the targets, so that the first of the largest is the earliest.
    order = np.argsort(b, kind="stable")
    t_words, starts = t_words[:, order], np.searchsorted(b[order], np.unique(b))
    kind = np.uint8 if 64 * len(t_words) < 256 else np.int64
    for low, high in zip(starts, np.r_[starts[1:], len(order)]):
        size = int(b[order[low]])
        for first in range(low, high, PIECE):
            last = min(first + PIECE, high)
            step = max(BOUNDED // (last - first), 1)
            for at in range(0, len(asked), step):
                some = asked[at:at + step]
                c = np.zeros((len(some), last - first), kind)
                both = np.empty(c.shape, np.uint64)
                for w in range(len(t_words)):
                    np.bitwise_and(q_words[w, some, None], t_words[w, first:last], out=both)
                    c += np.bitwise_count(both)
                j = c.argmax(axis=1)
                most = c[np.arange(len(some)), j].astype(float)
                below = most + alpha * (a[some] - most) + beta * (size - most)
                found = np.divide(most, below, out=np.zeros(len(most)), where=below > 0)
                t = order[first + j]
                better = (found > score[some]) | (found == score[some]) & (found > 0) & (t < place[some])
                score[some[better]], place[some[better]] = found[better], t[better]
    return score, place


def _nearest_sets_in_pairs(queries: list[str], targets: list[str], alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest_sets``, a score for each pair, where the largest c need not be the only best one of a size."""
    score, place = np.zeros(len(queries)), np.full(len(queries), -1, np.int64)

    def sides(texts: list[str]) -> tuple[list, list]:
        letters = [np.unique(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32)) for x in texts]
        return letters, [np.ones(len(x)) for x in letters]

    (q_letters, q_ones), (t_letters, t_ones) = sides(queries), sides(targets)
    b = np.array([len(x) for x in t_letters], float)
    for i, c in _products(q_letters, q_ones, t_letters, t_ones):
        below = c + alpha * (len(q_letters[i]) - c) + beta * (b - c)
        found = np.divide(c, below, out=np.zeros(len(c)), where=below > 0)
        j = int(found.argmax())
        if found[j] > 0:
            score[i], place[i] = found[j], j
    return score, place


def nearest_directions(q_rows: list, t_rows: list) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest_vectors``, of vectors of one length; what is no finite number is no score."""
    score, place = np.zeros(len(q_rows)), np.full(len(q_rows), -1, np.int64)
    if not len(q_rows) or not len(t_rows):
        return score, place
    queries, targets = np.array([*map(np.asarray, q_rows)], float), np.array([*map(np.asarray, t_rows)], float)
    if not queries.shape[1]:
        return score, place
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((targets * targets).sum(axis=1)).max()
    # Where single precision holds all products, those that may be the largest are made again in double precision.
    single = bool(a.max() < 1e15 and b < 1e15)
    # No product is off by more, for any order of its sum.
    off = 4 * (queries.shape[1] + 2) * float(np.finfo(np.float32).eps) * a * b + 1e-30
    columns = targets.T.astype(np.float32) if single else targets.T
    rows = queries.astype(np.float32) if single else queries
    for start in range(0, len(queries), ROWS):
        products = rows[start:start + ROWS] @ columns
        if not single:
            products[~np.isfinite(products)] = 0
        largest = products.max(axis=1)
        for i, (found, most) in enumerate(zip(products, largest), start):
            if single:
                some = np.flatnonzero(found >= np.float32(most - 2 * off[i] - 4e-9))
                exact = targets[some] @ queries[i]
                some, exact = some[exact >= exact.max() - 2e-9], exact[exact >= exact.max() - 2e-9]
            else:
                some = np.flatnonzero(found >= most - 2e-9)
                exact = found[some]
            rounded = np.rint(exact * 1e9) / 1e9
            j = int(rounded.argmax())
            if rounded[j] > 0:
                score[i], place[i] = rounded[j], some[j]
    return score, place
