"""BPE encoding and decoding of whole texts; long unsplit runs by tree concatenation."""
from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from relinker.llm.common import through_pandas, written

# Tasks are the unit of parallel work; threads of the library in each of them only add overhead.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

# A run without white space of at least this many characters is cut and put together again.
UNSPLIT = 4096
LEAF = 1024
WINDOW = 16
CACHE = 250_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Encodes and decodes texts by their pieces between ASCII white space, each piece once.

    The library encodes a text as the sequence of its pieces: white space ends every word of the tokenizer, and neither
    normal form, lower case nor special tokens reach across it. A tokenizer without a decoder joins token texts with
    blanks, so decoded pieces can be joined as well; otherwise whole id lists are decoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = self.tokenizer.decoder is None
        self.forget()

    def learn(self, pieces: set[bytes]) -> None:
        new = [p for p in pieces if p not in self.ids]
        if len(self.ids) + len(new) > CACHE:
            self.forget()
            new = list(pieces)
        coded = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
        ids = [c.ids for c in coded]
        self.ids.update(zip(new, (array("I", x).tobytes() for x in ids), strict=True))
        if self.by_piece:
            self.text.update(zip(new, (t.encode() for t in self.tokenizer.decode_batch(ids, skip_special_tokens=False)), strict=True))

    def forget(self) -> None:
        """Gives the memory of known pieces back; workers outlive their tasks."""
        self.ids, self.text = {b"": b""}, {b"": b""}

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Id bytes and decoded UTF-8 of each text."""
        split = [t.encode().split() for t in texts]
        self.learn(set().union(*split))
        for pieces in split:
            ids = b"".join(map(self.ids.__getitem__, pieces))
            if self.by_piece:
                # A piece that the tokenizer drops altogether (a control character) leaves no blank.
                yield ids, b" ".join(filter(None, map(self.text.__getitem__, pieces)))
            else:
                yield ids, self.decode(ids)

    def decode(self, ids: bytes) -> bytes:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()


class Tree:
    """Exact BPE of one long run from encodings of its parts.

    A token sequence is the encoding of its text exactly if every two neighbours are the encoding of their joined text.
    So left and right encodings are joined by encoding a window around the join anew: where its first token is the left
    side's token at that place and its last token the right side's, all neighbours are proper; else the window grows.
    Only a run that reaches the end of the word has the end-of-word suffix.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        spec = json.load(open(path))
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keep = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "fuse_unk") if model.get(k)}
        self.inner = models.BPE(vocab=model["vocab"], merges=merges, **keep)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix, **keep) if self.suffix else self.inner
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_id = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def leaf(self, run: str, ends: bool) -> list[tuple[int, int]]:
        """(id, characters) of each token."""
        tokens = (self.last if ends else self.inner).tokenize(run)
        if run.isascii():
            return [(t.id, t.offsets[1] - t.offsets[0]) for t in tokens]
        raw = run.encode()
        return [(t.id, len(raw[t.offsets[0]:t.offsets[1]].decode())) for t in tokens]

    def join(self, run: str, left: list, right: list, ends: bool) -> list:
        """``run`` is the text of both sides; ``ends``: it reaches the end of its word."""
        if not left or not right:
            return left + right
        width = WINDOW
        cut = sum(n for _, n in left)
        while True:
            i, begin = len(left), cut
            while i > 0 and cut - begin < width:
                i -= 1
                begin -= left[i][1]
            j, stop = 0, cut
            while j < len(right) and stop - cut < width:
                stop += right[j][1]
                j += 1
            window = self.leaf(run[begin:stop], ends and stop == len(run))
            left_agrees = i == 0 or window[0] == left[i]
            right_agrees = j == len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[:i] + window + right[j:]
            width *= 2

    def encode(self, run: str, ends: bool = True) -> list:
        """By halves."""
        if len(run) <= LEAF:
            return self.leaf(run, ends)
        half = len(run) // 2
        return self.join(run, self.encode(run[:half], False), self.encode(run[half:], ends), ends)

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Words of the tokenizer as it hands them to its model; (token, id) for a special token in the text."""
        pieces = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for piece in pieces:
            if piece in self.special_id:
                yield piece, self.special_id[piece]
                continue
            if self.tokenizer.normalizer is not None:
                piece = self.tokenizer.normalizer.normalize_str(piece)
            for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece):
                yield word, None


_loaded: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One instance for all batches of a worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def long_runs(text: Column | str) -> Column:
    """Whether a text holds a run without ASCII white space of ``UNSPLIT`` characters."""
    long = F.length(text) >= UNSPLIT
    return F.coalesce(F.when(long, F.regexp_like(text, F.lit(rf"[^\x20\x09-\x0D]{{{UNSPLIT}}}"))).otherwise(F.lit(False)), F.lit(False))


Finish = Callable[[bytes, bytes], tuple]


def _short(path: str, finish: Finish, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = loaded(Words, path)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            kept = batch.drop(columns="text").reset_index(drop=True)
            # Pieces are looked up, and results handed on, for about a million characters at a time.
            at = 0
            while at < len(texts):
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held + len(texts[stop]) < 1_000_000):
                    held += len(texts[stop])
                    stop += 1
                found = pd.DataFrame([finish(*x) for x in words.encode(texts[at:stop])], columns=names)
                yield pd.concat([kept.iloc[at:stop].reset_index(drop=True), found], axis=1)
                at = stop
        # Workers outlive their tasks, and the next stage needs the memory.
        words.forget()
    return run


def _cut(path: str):
    """The words of a text with long runs; long words as halves of halves, in order. ``size`` counts a word's parts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = loaded(Tree, path)
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                out, seq = [], 0
                for word, special in tree.parts(text):
                    n = 1 if special is not None or len(word) <= LEAF else -(-len(word) // LEAF)
                    edges = [len(word) * i // n for i in range(n + 1)]
                    for i in range(n):
                        out.append((row, seq, i, n, word[edges[i]:edges[i + 1]], special))
                        if len(out) == 2000:
                            yield _frame(out)
                            out = []
                    seq += 1
                if out:
                    yield _frame(out)
    return run


def _frame(rows: list) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["row", "seq", "part", "parts", "run", "special"])
    return df.astype({"special": "Int64"})


CUT_SCHEMA = "row bigint, seq bigint, part bigint, parts bigint, run string, special bigint"


def _leaves(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = loaded(Tree, path)
        for batch in batches:
            coded = [
                [(int(s), len(r))] if not pd.isna(s) else tree.leaf(r, part == parts - 1)
                for r, s, part, parts in zip(batch["run"], batch["special"], batch["part"], batch["parts"], strict=True)]
            yield batch.drop(columns="special").assign(ids=[[i for i, _ in c] for c in coded], widths=[[n for _, n in c] for c in coded])
    return run


def _assemble(path: str, finish: Finish, names: list[str]):
    """All parts of one text, joined pairwise level by level."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        words = loaded(Words, path)
        tree = loaded(Tree, path)
        ids: list[int] = []
        for _, word in group.sort_values(["seq", "part"]).groupby("seq", sort=True):
            level = [(r, list(zip(i, w, strict=True))) for r, i, w in zip(word["run"], word["ids"], word["widths"], strict=True)]
            while len(level) > 1:
                pairs = []
                for k in range(0, len(level) - 1, 2):
                    (a, left), (b, right) = level[k], level[k + 1]
                    pairs.append((a + b, tree.join(a + b, left, right, k + 2 == len(level))))
                level = pairs + level[len(pairs) * 2:]
            ids += [i for i, _ in level[0][1]]
        coded = np.asarray(ids, "<u4").tobytes()
        return pd.DataFrame([(group["row"].iloc[0], *finish(coded, words.decode(coded)))], columns=["row", *names])
    return run


def encode_with(docs: DataFrame, path: str, finish: Finish, schema: str, keep: list[str]) -> DataFrame:
    """Applies ``finish`` to the id bytes (little-endian, 32 bits each) and the decoded bytes of every text of docs.

    Ordinary texts are encoded piece by piece in the task that reads them. A text with a run of ``UNSPLIT`` characters is
    cut into leaves that tasks encode in parallel; one task joins the leaves of a text. Null counts as empty and gives
    no ids; other columns than ``keep`` are dropped; repeated rows give repeated results.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"), long_runs("text").alias("long"))
    short = through_pandas(rows.where("not long").drop("long"), _short(path, finish, names), f"{kept}, {schema}")
    # Written, as it is read twice and found only by a look at every text.
    numbered = written(rows.where("long").drop("long").withColumn("row", F.monotonically_increasing_id()), "long")
    leaves = (
        numbered.select("row", "text").mapInPandas(_cut(path), CUT_SCHEMA)
        .repartition("row", "seq", "part").mapInPandas(_leaves(path), CUT_SCHEMA.replace("special bigint", "ids array<bigint>, widths array<bigint>")))
    whole = leaves.groupBy("row").applyInPandas(_assemble(path, finish, names), f"row bigint, {schema}")
    long = numbered.drop("text").join(whole, "row", "left").select(*keep, *names)
    return short.unionByName(long)


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, ids array<int>, decoded string) of every document."""
    def finish(ids: bytes, decoded: bytes) -> tuple:
        return np.frombuffer(ids, "<u4").astype(np.int32), decoded.decode()
    return encode_with(docs, path, finish, "ids array<int>, decoded string", keep or ["doc_id"])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded, and only the digests leave the task."""
    def finish(ids: bytes, decoded: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
    return encode_with(docs, path, finish, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["doc_id"])
