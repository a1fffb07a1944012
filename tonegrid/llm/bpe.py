"""Byte-level BPE by dynamic programming over prefixes (p8)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public tokenizers' files are; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary splits a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words and their ids that a worker keeps; a full cache is emptied. Longer words than LONG (texts without spaces are one word) aren't kept. The
#: ids are the same with any number.
KEPT, LONG = 64_000_000, 200


class PrefixEncoder:
    """Exact BPE of byte strings: each prefix has one valid last token, and the encoding of a text is read backwards from them.

    A token may follow another exactly if BPE, given the bytes of both, leaves the two as they are; that is decided by undoing merges
    on both sides of the seam. A table of last tokens therefore grows by appending, and an edit keeps all rows before it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < rank and b < rank and self._stay(a, b):
                    self.merged[a, b], self.halves[rank] = rank, (a, b)
                    break
            else:
                raise ValueError(f"token {rank} isn't made by merges")

    def _stay(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b, one after the other, leaves a and b."""
        bound = 1 << 62  # a merge across the seam of this rank or a later one comes too late
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < bound:
                return False
            if a > b:  # the later made of the two is undone first
                sides = (0, 1)
            else:
                sides = (1, 0)
            for side in sides:
                if side == 0:
                    half = self.halves[a][1]
                    if half != a:
                        bound, a = a, half
                        break
                else:
                    half = self.halves[b][0]
                    if half != b:
                        bound, b = b + 1, half
                        break
            else:
                return True

    def extend(self, data: bytes, last: list[int], seen: int = 0) -> list[int]:
        """The table of last tokens of data, of whose first `seen` bytes `last` already has the rows."""
        ranks, fits = self.ranks, self.fits
        last = last[:seen]
        for end in range(seen + 1, len(data) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = ranks.get(data[begin:end])
                if token is None:
                    continue
                if begin == 0:
                    break
                pair = (last[begin - 1], token)
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) > 1 << 20:
                        fits.clear()
                    ok = fits[pair] = self._stay(*pair)
                if ok:
                    break
            last.append(token)
        return last

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """The ids of the prefix of `end` bytes."""
        end, out = len(last) if end is None else end, []
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(self.extend(data, []))

    def edit(self, old: bytes, last: list[int], new: bytes) -> list[int]:
        """The table of `new` from that of `old`: rows of the common prefix are kept."""
        same = next((i for i, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
        return self.extend(new, last, same)


class _Words(dict):
    """Ids of words, as bytes of INTs, made where they are missing."""

    def __init__(self, encoder: PrefixEncoder, before: str):
        super().__init__()
        self.held = 0
        self.encoder, self.before, self.split = encoder, before, regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> bytes:
        ids = [x for piece in self.split(self.before + word) for x in self.encoder.encode(piece.encode())]
        made = np.asarray(ids, np.int32).tobytes()
        if len(word) <= LONG:
            self[word] = made
            self.held += 200 + 2 * len(word) + len(made)
        return made


class TextEncoder:
    """Encodes texts; null and empty texts have no ids.

    A space followed by something that isn't white space always begins a new piece of PATTERN, so a text may be cut before each such
    space, and words that occur again are looked up. Marks of special tokens are ordinary text.
    """

    odd = re.compile(r" (?=\s|$)").search
    cuts = re.compile(r"(?= \S)").split

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        with open(f"{folder}/{vocabulary}", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoder = PrefixEncoder(ranks)
        self.alone, self.spaced = _Words(encoder, ""), _Words(encoder, " ")

    def __call__(self, text: str | None) -> bytes:
        """The ids as bytes of INTs."""
        if not text:
            return b""
        if self.alone.held + self.spaced.held > KEPT:
            for words in (self.alone, self.spaced):
                words.clear()
                words.held = 0
        if self.odd(text):
            return b"".join(map(self.alone.__getitem__, self.cuts(text)))
        first, *rest = text.split(" ")
        return self.alone[first] + b"".join(map(self.spaced.__getitem__, rest))


@lru_cache(1)
def text_encoder(folder: str, vocabulary: str) -> TextEncoder:
    return TextEncoder(folder, vocabulary)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: the ids of its text, without special tokens; an empty list for empty and for null text.

    No shuffle: rows are encoded where they are read. Repeated rows and null keys are kept as they are.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(folder, vocabulary)
        for batch in it:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [enc(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(made) + 1, np.int32)
                np.cumsum([len(m) // 4 for m in made], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(batches, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str, keep: Iterable[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and n_tokens, the number of ids of the text (0 for null), of every row."""
    keep = list(keep)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(folder, vocabulary)
        for batch in it:
            n = pa.array([len(enc(t)) // 4 for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], [f"c{i}" for i in range(len(keep))] + ["n"])

    schema = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", n bigint"
    return df.select(*keep, text).mapInArrow(batches, schema).toDF(*keep, "n_tokens")
