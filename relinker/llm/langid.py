"""Language identification of code-switched text: a linear-chain conditional random field labels every word."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from relinker.llm import chains
from relinker.llm.chains import Field
from relinker.llm.common import through_pandas

# The label of a text without letters, and the rows that are held out.
UNDETERMINED = "und"
FOLDS = 4
HELD_OUT = 2

#: Bounds of training: documents, words of each of them, width of the hashed feature space, words of a switched piece.
TRAIN_DOCS = 2000
TRAIN_WORDS = 80
#: Documents of each language that are learned at least, where there are so many, on top of ``TRAIN_DOCS``.
TRAIN_LANG = 100
HASHED = 1 << 16
PIECE = 20
#: A document of whose words less than this share is in its language is rejected by a filter.
LEAST_SCORE = 0.5

# Letters alone: fractions and raised digits are none.
TOKENS = regex.compile(r"\p{L}+|\n")
EDGE = 1
CACHE = 200_000


def held_out(doc_id: Column | str) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, word) of all features of a list of words.

    Affixes are the runs of two to four characters that hold an edge of the word, n-grams those inside it; the lexicon
    feature is the whole word. Words longer than their n-grams have as many features as characters.
    """
    codes = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = codes == EDGE
    number = np.cumsum(edge) - 1
    out, own = [], []
    with np.errstate(over="ignore"):
        run = codes * np.uint64(0x9E3779B97F4A7C15)
        for n in (2, 3, 4):
            if len(codes) < n:
                break
            run = run[:-1] * np.uint64(0x100000001B3) + codes[n - 1:] * np.uint64(0x9E3779B97F4A7C15)
            # An edge may only stand at either end of a run.
            inside = np.zeros(len(run), bool)
            for j in range(1, n - 1):
                inside |= edge[j:len(run) + j]
            keep = ~inside & ~(edge[:len(run)] & edge[n - 1:])
            out.append(run[keep] + np.uint64(n))
            own.append(number[:len(run)][keep])
        last = np.flatnonzero(edge)
        place = np.arange(len(codes)) - last[number]
        power = _powers(int(place.max()) + 1 if len(place) else 1)
        whole = np.add.reduceat(codes * power[place], last)[:-1] if len(words) else np.zeros(0, np.uint64)
        out.append(whole * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(99))
        own.append(np.arange(len(words)))
        hashed = np.concatenate(out)
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xD6E8FEB86659FD93)
        hashed ^= hashed >> np.uint64(32)
    return (hashed % np.uint64(HASHED)).astype(np.int64), np.concatenate(own)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x9E3779B97F4A7C15 | 1, np.uint64))


def word_scores(words: list[str], field: Field) -> np.ndarray:
    """Score of each word for each label."""
    features, owner = word_features(words)
    return np.stack([np.bincount(owner, field.weights[features, j], len(words)) for j in range(len(field.labels))], axis=1)


def split(text: str) -> tuple[list[str], list[int]]:
    """Lower-case words of a text, and the words of each of its lines: a line is a chain."""
    tokens = TOKENS.findall(text.lower())
    if "\n" not in tokens:
        return tokens, [len(tokens)] if tokens else []
    words, lengths, last = [], [], -1
    for i in [i for i, t in enumerate(tokens) if t == "\n"] + [len(tokens)]:
        if i > last + 1:
            words += tokens[last + 1:i]
            lengths.append(i - last - 1)
        last = i
    return words, lengths


def training_rows(docs: DataFrame, docs_bound: int = TRAIN_DOCS, words_bound: int = TRAIN_WORDS) -> list:
    """(lang, words) of at most ``docs_bound`` labelled documents outside the held-out fold, chosen by a hash of their ids.

    A language with fewer than ``TRAIN_LANG`` of them gets more, so that rare languages are learned from tables of any size.
    Of each, at most ``words_bound`` neighbouring words from a place given by that hash are used.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    # Rows without an id, which would all have one hash, are drawn by their texts.
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    draw = F.when(F.col("doc_id").isNull(), own).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    usable = usable.select("lang", "text", draw.alias("draw"), own.alias("own"))
    sizes = {r["lang"]: (r["n"], r["draws"]) for r in usable.groupBy("lang").agg(
        F.count("*").alias("n"), F.approx_count_distinct("own").alias("draws")).collect()}
    total = sum(n for n, _ in sizes.values())
    share = min(1.0, 1.5 * docs_bound / max(total, 1))
    drawn = usable.where(F.col("draw") < F.lit(int(share * (1 << 30)) + 1)).select("lang", "text", "draw")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, text, draw in batch.itertuples(index=False):
                words = split(text)[0]
                at = draw % max(1, len(words) - words_bound + 1)
                if words:
                    rows.append((lang, " ".join(words[at:at + words_bound]), draw))
            yield pd.DataFrame(rows, columns=["lang", "words", "draw"])

    found = drawn.mapInPandas(windows, "lang string, words string, draw bigint").orderBy("draw", "lang", "words").limit(docs_bound).collect()
    seen = Counter(r["lang"] for r in found)
    few = [(lang, min(1.0, 2.0 * TRAIN_LANG / max(draws, 1))) for lang, (n, draws) in sizes.items() if seen[lang] < min(n, TRAIN_LANG)]
    if few:
        parts = docs.sparkSession.createDataFrame(few, "lang string, part double")
        more = usable.join(parts, "lang").where(F.col("own") <= F.col("part") * (1 << 30)).dropDuplicates(["lang", "own"])
        more = more.select("lang", "text", "draw").mapInPandas(windows, "lang string, words string, draw bigint")
        known = {(r["lang"], r["words"]) for r in found}
        for r in sorted(more.collect(), key=lambda r: (r["draw"], r["lang"], r["words"])):
            if seen[r["lang"]] < TRAIN_LANG and (r["lang"], r["words"]) not in known:
                seen[r["lang"]] += 1
                known.add((r["lang"], r["words"]))
                found.append(r)
    return [(r["lang"], r["words"].split(" ")) for r in found]


def fit(rows: list) -> Field:
    """Fits the field on code-switched chains: pieces of documents of all languages in turn."""
    labels = tuple(sorted({lang for lang, _ in rows}))
    pieces = [(labels.index(lang), words[i:i + PIECE]) for lang, words in rows for i in range(0, len(words), PIECE)]
    # A fixed shuffle lets languages follow each other; two pieces of a chain are joined, the rest stay alone.
    order = np.random.Generator(np.random.PCG64(0)).permutation(len(pieces))
    numbers: dict[str, int] = {}
    words, gold, lengths = [], [], []
    for place, i in enumerate(order):
        label, piece = pieces[i]
        words += [numbers.setdefault(w, len(numbers)) for w in piece]
        gold += [label] * len(piece)
        if place % 4 in (0, 1, 3) or not lengths:
            lengths.append(len(piece))
        else:
            lengths[-1] += len(piece)
    features, owner = word_features(list(numbers))
    return chains.train(labels, features, owner, np.asarray(words, np.int64), np.asarray(gold, np.int64),
                        np.asarray(lengths, np.int64), HASHED)


class Labeller:
    """Scores of words are kept between batches, up to ``CACHE`` of them."""

    def __init__(self, field: Field):
        self.field = field
        self.move = field.trans.astype(float)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.field.labels)))

    def look_up(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.number]
        if len(self.number) + len(new) > CACHE:
            self.clear()
            new = list(set(words))
        if new:
            base = len(self.number)
            self.number.update(zip(new, range(base, base + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, word_scores(new, self.field)])
        return self.scores[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the label with the largest mean marginal over all its words."""
        words, lengths, counts = [], [], []
        for text in texts:
            w, n = split(text)
            words += w
            lengths += n
            counts.append(len(w))
        k = len(self.field.labels)
        sums = np.zeros((len(texts), k))
        if words and k:
            post = chains.forward_backward(self.look_up(words), np.asarray(lengths), self.move)
            owner = np.repeat(np.arange(len(texts)), counts)
            sums = np.stack([np.bincount(owner, post[:, j], len(texts)) for j in range(k)], axis=1)
        n = np.asarray(counts)
        some = (n > 0) & (k > 0)
        best = sums.argmax(axis=1) if k else np.zeros(len(texts), int)
        score = np.where(some, sums[np.arange(len(texts)), best] / np.maximum(n, 1), 0.0) if k else np.zeros(len(texts))
        return [self.field.labels[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)], np.clip(score, 0.0, 1.0)


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """Adds lang_pred and score to documents with a column ``text``; other columns stay.

    Every line is a chain of all its words (runs of letters, in lower case). A null text, a text without letters and an
    untrained field give ``und`` with score 0. Repeated rows get equal results; an empty table gives no rows.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(field)
        for batch in batches:
            texts = batch["_text"].tolist()
            found, at = [], 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held + len(texts[stop]) < 2_000_000):
                    held += len(texts[stop])
                    stop += 1
                langs, scores = labeller.label(texts[at:stop])
                found.append(pd.DataFrame({"lang_pred": langs, "score": scores}))
                at = stop
            if found:
                yield pd.concat([batch.drop(columns="_text").reset_index(drop=True), pd.concat(found, ignore_index=True)], axis=1)

    rows = docs.drop("lang_pred", "score").withColumn("_text", F.coalesce("text", F.lit("")))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"])
    return through_pandas(rows, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a field fitted on the labelled ones."""
    field = fit(training_rows(docs))
    slim = docs.select("doc_id", "text")
    out = predict(slim.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), field)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """Documents in a language: those without letters and those of whose words less than ``LEAST_SCORE`` is in their language go.

    Null and empty texts have no letters and go, texts of any length are read whole, repeated rows stay or go together, an empty table
    gives no rows. All columns are returned as they were, also those with names that are used here.
    """
    names = [c if c == "text" else f"column {i}" for i, c in enumerate(docs.columns)]
    found = predict(docs.toDF(*names), fit(training_rows(docs)))
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)])
