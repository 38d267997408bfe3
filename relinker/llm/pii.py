"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes beside them."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from relinker.llm import chains
from relinker.llm.chains import Field
from relinker.llm.common import portions, through_pandas

# Kinds in order, their patterns and limits.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS = (12, 19)
PHONE_DIGITS = (9, 15)

OUTSIDE = "outside"
LABELS = (OUTSIDE, *KINDS)
HASHED = 1 << 14
MARK = re.compile(r"[0-9@]")
WORD = re.compile(r"\S+")
# Characters of the texts that are searched at a time.
PORTION = 1_000_000

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each @ belongs to one run of local characters, so the leftmost matches are found from the @ signs in linear time."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            last = m.end()
            found.append(("email", begin, last))
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass the limits, by start, then kind."""
    if not MARK.search(text):
        return []
    found = emails(text)
    # A match can only start at the first digit of a run: all later starts would need the same rest.
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m.group()) <= PHONE_DIGITS[1]:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def digest_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@lru_cache(1 << 14)
def shape(word: str) -> str:
    """Letters as x or X, digits as d, runs of one class shortened; other signs stay."""
    out: list[str] = []
    for c in word[:80]:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s or s not in "dxX":
            out.append(s)
    return "".join(out)


@lru_cache(1 << 14)
def own_features(word: str) -> tuple[str, ...]:
    """Features of a word alone: shape, bare shape, number of digits, outer signs, checks that its digits pass."""
    bare = word.strip(".,;:!?\"'`*#%&$<>[]{}|")
    digits = re.sub(r"\D", "", bare)
    parts = bare.split(".")
    octets = len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) <= 255 for p in parts)
    card = CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and len(digits) == len(bare) and luhn(digits)
    return (
        "s=" + shape(bare), "w=" + shape(word), f"n={min(len(digits), 20)}", f"all={bool(digits) and len(digits) == len(bare)}",
        f"octets={octets}", f"card={card}", f"plus={bare[:1] == '+'}", f"paren={bare[:1] == '('}", f"at={'@' in bare}",
        f"dashes={min(bare.count('-'), 4)}", f"groups={'-'.join(str(len(g)) for g in re.findall(r'[0-9]+', bare)[:6])}")


def _crc(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode()) % HASHED


@lru_cache(1 << 14)
def features(before: str, word: str, after: str) -> tuple[int, ...]:
    """Feature numbers of a word between its neighbours (empty at the ends of a chain): shapes, and the lower-case cue before."""
    own = own_features(word)
    return tuple(map(_crc, (
        *own, "b=" + shape(before), "a=" + shape(after), "c=" + before.lower().strip(".,:;()"),
        f"{own[0]}|b={shape(before)}", f"{own[0]}|a={shape(after)}", f"{own[10]}|b={shape(before)}")))


# A small labelled table: marked spans are personal data of the kind named before the colon. Numbers are invented.
LABELLED = """
write to <email:jane.doe@example.org> today
mail <email:a_b@mail.example.com>, thanks
contact <email:info@localhost> for access
the address <email:x.y@intranet> works inside
ask <email:sales+eu@shop.example> about it
meet me @noon or @home then
price 5 @ 3 each and 7 @ 2
server <ip:10.0.0.1> is down
host <ip:192.168.17.4>. Next line
from <ip:8.8.8.8> to <ip:172.16.254.1> in 3 hops
at <ip:203.0.113.77>!! and more
version 1.2.3.400 of the tool
section 3.4.5.6.7 and chapter 12.1
build 999.888.777.666 failed
release 2.10.3 came out
card <card:4111111111111111> was used
paid with <card:5500005555555559> today
number <card:340000000000009> ok
<card:6011000990139424> is stored
order 4111111111111112 shipped
serial 1234567890123456 on the back
hash 04dbebab91ab85687d33eeaaf9ac6993 here
invoice 9807915762804491 is open
call <phone:+1 (017) 555-7713> now
ring <phone:+49 30 1234567> later
phone <phone:+44 20 7946 0958>.
tel <phone:(212) 555-0187> office
call <phone:(030) 555-4433> or <phone:(089) 555-1020> soon
dial <phone:(617) 555-0123>, please
phone <phone:212-555-0187> works
fax <phone:617-555-0199> too
tel <phone:030-555-7788>
from 2019-2020 to 2021
in 1999 there were 12 of 30
pages 10-20 and 30-40-50
on 2024-01-31 at 10:30
date 12-05-2021 noted
room (12) on floor 3
figure (212) shows 555 cases
see (1) and (2) of 100-200
score 3-1 in 90 minutes
about 1,000,000 people in 2020
licence 4.0 and GPL-3.0 apply
token = "04dbebab91ab85687d33"
key 7695f98391c04c2f5d secret
total 512.75 of 1024
plus +5 points and +10 more
temperature +20 or -5
zip 12345-6789 in town
isbn 978-3-16-148410-0 printed
part 555-77 of the set
ratio 1:250 and 3/4
"""
SPAN = re.compile(r"<(email|ip|card|phone):([^>]*)>")


def labelled_rows() -> list[tuple[str, list[Span]]]:
    """The labelled table as texts with spans."""
    rows = []
    for line in LABELLED.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in SPAN.finditer(line):
            text += line[at:m.start()]
            spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
            text += m.group(2)
            at = m.end()
        rows.append((text + line[at:], spans))
    return rows


def fit(rows: list[tuple[str, list[Span]]] | None = None, rounds: int = 150) -> Field:
    """Fits the field on labelled texts (by default the table above)."""
    flat, owner, gold, lengths = [], [], [], []
    for text, spans in rows if rows is not None else labelled_rows():
        for chain in chains_of(text):
            words = [text[a:b] for a, b in chain]
            for i, (a, b) in enumerate(chain):
                f = features(words[i - 1] if i else "", words[i], words[i + 1] if i + 1 < len(words) else "")
                flat += f
                owner += [len(gold)] * len(f)
                kind = next((k for k, x, y in spans if a < y and x < b), OUTSIDE)
                gold.append(LABELS.index(kind))
            lengths.append(len(chain))
    n = len(gold)
    return chains.train(
        LABELS, np.asarray(flat, np.int64), np.asarray(owner, np.int64), np.arange(n), np.asarray(gold, np.int64),
        np.asarray(lengths, np.int64), HASHED, rounds=rounds)


def chains_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words with a digit or an @ within a line, each with the word before and after it.

    Only such words can carry a label other than ``outside``; the words around a run are outside for certain, so the best
    labels of a line are those of its runs, and nothing of a text is left out.
    """
    found: list[list[tuple[int, int]]] = []
    at = 0
    while m := MARK.search(text, at):
        begin = m.start()
        while begin > 0 and not text[begin - 1].isspace():
            begin -= 1
        run: list[tuple[int, int]] = []
        place = begin
        while w := WORD.search(text, place):
            if run and "\n" in text[place:w.start()]:
                break
            run.append(w.span())
            place = w.end()
            if not MARK.search(w.group()):
                break
        # The word before, on the same line.
        stop = begin
        while stop > 0 and text[stop - 1].isspace() and text[stop - 1] != "\n":
            stop -= 1
        start = stop
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        found.append([(start, stop), *run] if start < stop else run)
        at = place
    return found


def trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    while begin < end and not (text[begin].isalnum() or text[begin] in "+("):
        begin += 1
    while end > begin and not text[end - 1].isalnum():
        end -= 1
    return begin, end


def learned_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans that the field finds, by Viterbi over the chains of all texts together."""
    flat, counts, lengths, place, marked = [], [], [], [], []
    for t, text in enumerate(texts):
        for chain in chains_of(text):
            words = [text[a:b] for a, b in chain]
            for i, (a, b) in enumerate(chain):
                f = features(words[i - 1] if i else "", words[i], words[i + 1] if i + 1 < len(words) else "")
                flat += f
                counts.append(len(f))
                place.append((t, a, b))
                marked.append(MARK.search(words[i]) is not None)
            lengths.append(len(chain))
    out: list[list[Span]] = [[] for _ in texts]
    if not place:
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    scores = np.stack([np.bincount(owner, field.weights[flat, j], len(counts)) for j in range(len(LABELS))], axis=1)
    scores[~np.asarray(marked), 1:] = -1e9
    best = chains.viterbi(scores, np.asarray(lengths), field.trans.astype(float))
    at = 0
    for n in lengths:
        i = at
        while i < at + n:
            j = i
            while j < at + n and best[j] == best[i]:
                # Only phones have more than one word.
                j += 1
                if LABELS[best[i]] != "phone":
                    break
            if best[i]:
                t = place[i][0]
                begin, end = trimmed(texts[t], place[i][1], place[j - 1][2])
                if begin < end:
                    out[t].append((LABELS[best[i]], begin, end))
            i = j
        at += n
    return out


def all_spans(base: list[Span], learned: list[Span]) -> list[Span]:
    """Base spans and those learned ones that overlap neither a base span nor each other."""
    taken = sorted((a, b) for _, a, b in base)
    added, i, last = [], 0, -1
    for k, a, b in sorted(learned, key=lambda s: s[1]):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        clash = any(x < b and a < y for x, y in taken[max(0, i - 4):i + 4])
        if not clash and a >= last:
            added.append((k, a, b))
            last = b
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Adds ``base`` and ``spans``, arrays of (kind, begin, end) in code points, to documents; other columns stay.

    A null or empty text has no spans; an empty table gives no rows; repeated rows get equal results. Columns named base
    or spans are replaced.
    """
    field = field or fit()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches, "text", PORTION):
            texts = batch["text"].fillna("").tolist()
            base = [base_spans(t) for t in texts]
            learned = learned_spans(texts, field)
            both = [all_spans(b, x) if x else b for b, x in zip(base, learned, strict=True)]
            yield batch.assign(base=_structs(base), spans=_structs(both))

    rows = docs.drop("base", "spans")
    span = "array<struct<kind:string,begin:bigint,end:bigint>>"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return through_pandas(rows, run, f"{kept}, base {span}, spans {span}")


def _structs(spans: list[list[Span]]) -> list[list[dict]]:
    return [[{"kind": k, "begin": a, "end": b} for k, a, b in s] for s in spans]


def report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); the counts and the digest are of base spans."""
    field = field or fit()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches, "text", PORTION):
            texts = batch["text"].tolist()
            base = [base_spans(t) for t in texts]
            learned = learned_spans(texts, field)
            rows = []
            for b, x in zip(base, learned, strict=True):
                both = all_spans(b, x) if x else b
                kinds = [k for k, _, _ in b]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(digest_text(b).encode()).hexdigest(), digest_text(both), len(both) - len(b)))
            columns = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1)

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return through_pandas(slim, run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def masked(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; columns stay and ``n_chars`` follows the text.

    Overlapping spans are replaced together, under the kind of the first. A null text stays null.
    """
    field = field or fit()
    has_length = "n_chars" in docs.columns
    # Whole numbers travel as text.
    length = (lambda t: str(len(t))) if has_length and isinstance(docs.schema["n_chars"].dataType, IntegralType) else len

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches, "text", PORTION):
            texts = batch["text"].tolist()
            plain = [t if isinstance(t, str) else "" for t in texts]
            learned = learned_spans(plain, field)
            out = []
            for t, x, original in zip(plain, learned, texts, strict=True):
                spans = all_spans(base_spans(t), x)
                out.append(mask(t, spans) if spans else original)
            batch = batch.assign(text=out)
            if has_length:
                batch["n_chars"] = [length(t) if isinstance(t, str) else n for t, n in zip(out, batch["n_chars"], strict=True)]
            yield batch

    return through_pandas(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


def mask(text: str, spans: list[Span]) -> str:
    out, at, stop = [], 0, 0
    for kind, begin, end in spans:
        if begin >= stop:
            out += [text[at:begin], f"[{kind}]"]
        at = stop = max(stop, end)
    return "".join([*out, text[at:]])
