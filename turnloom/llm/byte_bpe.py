"""Byte-level BPE over a public vocabulary, exact merges in linear time.

A pre-token's bytes are read as Latin-1, so that one Aho-Corasick automaton over the vocabulary finds every
token at every place. The encoder takes the longest token, and steps back to a shorter one whenever it can't
follow its predecessor: two tokens may stand side by side only if merging their joined bytes gives just these
two. That test is memoised, and a place where no token can follow is never tried again, so the work is linear in the
length. The result is the one sequence whose neighbours are all compatible, which is what the ranked merges give.

Texts are whole. They are cut before single spaces that follow a visible character, where the pattern always cuts;
the pieces between are met again and again and come from a bounded cache, the older half of which goes when it is full.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import bound_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces (in each of two generations), pre-tokens and token pairs that a Python worker keeps at most.
CACHE_PIECES, CACHE_WORDS, CACHE_PAIRS = 150_000, 50_000, 150_000
#: Marks that are a pre-token of their own between letters and a space.
_STOPS = frozenset(".,;:!?")
#: No token, and not looked up yet.
_NONE, _UNKNOWN = -1, -2
#: Python's own \s holds every character that the pattern takes for space, so these cut too seldom, never too often.
_SPACES, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder over ranks (token bytes to rank) and a pre-token pattern; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values(), default=-1) + 1
        self.tokens, self.lengths, self._shorter = [b""] * size, [0] * size, [_UNKNOWN] * size
        for token, rank in ranks.items():
            self.tokens[rank], self.lengths[rank] = token, len(token)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.most = max(self.lengths, default=1)
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        #: The shortcuts for letters and stops hold for this pattern.
        self._usual = pattern == public_tokenizers.PATTERN
        self._words: dict[str, list[int]] = {}
        self._pairs: dict[int, bool] = {}
        self._merged: dict[int, tuple[int, int] | None] = {}

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a single byte."""
        if rank not in self._merged:
            token, halves = self.tokens[rank], None
            if len(token) > 1:
                parts = self._merge(token, rank)
                halves = (parts[0], parts[1]) if len(parts) == 2 else None
            self._merged[rank] = halves
        return self._merged[rank]

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain ranked merges of data with the ranks below `below`."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, below) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best >= below:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the tokens can stand side by side: no merge across the seam comes before theirs.

        Undo, again and again, the later of the merges that made the two tokens next to the seam; if what
        then stands at the seam could merge earlier than the one just undone, the tokens would not have formed.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is not None:
            return known
        limit, a, b, answer = 1 << 62, left, right, True
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit:
                answer = False
                break
            of_a, of_b = self._halves(a), self._halves(b)
            if of_a is None and of_b is None:
                break
            if of_b is None or (of_a is not None and a > b):
                limit, a = a, of_a[1]
            else:  # of two equal merges the right one comes later, and the seam's may equal it
                limit, b = b + 1, of_b[0]
        if len(self._pairs) >= CACHE_PAIRS:
            self._pairs.clear()
        self._pairs[key] = answer
        return answer

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        line, pairs, compatible, lengths = data.decode("latin-1"), self._pairs, self.compatible, self.lengths
        ids = [rank for _, rank in self.automaton.iter_long(line)]
        last, at = ids[0], lengths[ids[0]]
        for good in range(1, len(ids)):
            rank = ids[good]
            fits = pairs.get(last << 32 | rank)
            if not (compatible(last, rank) if fits is None else fits):
                break
            last = rank
            at += lengths[rank]
        else:  # longest tokens one after another, and all may stand so
            return ids
        # From here on longest tokens are known where those above began; others are looked up when they are asked for.
        n, place, longest, dead, shorter = len(data), at, {}, set(), self._shorter
        for rank in ids[good:]:
            longest[place] = rank
            place += lengths[rank]
        rank = self.shorter(ids[good])
        del ids[good:]
        while at < n:
            last = ids[-1] if ids else _NONE
            while rank >= 0:
                if at + lengths[rank] not in dead:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | rank)
                    if compatible(last, rank) if fits is None else fits:
                        break
                rank = shorter[rank] if shorter[rank] != _UNKNOWN else self.shorter(rank)
            if rank < 0:
                dead.add(at)
                rank = ids.pop()
                at -= lengths[rank]
                rank = self.shorter(rank)
            else:
                ids.append(rank)
                at += lengths[rank]
                if at < n:
                    rank = longest.get(at, _NONE)
                    if rank < 0:
                        rank = longest[at] = next(self.automaton.iter_long(line[at : at + self.most]))[1]
        return ids

    def shorter(self, rank: int) -> int:
        """The longest token that this one starts with, other than itself."""
        found = self._shorter[rank]
        if found == _UNKNOWN:
            token = self.tokens[rank]
            found = self._shorter[rank] = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), _NONE)
        return found

    def _ids(self, piece: str) -> bytes:
        if self._usual and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            ids = self.encode_piece(piece.encode("utf-8"))  # letters, after a space or not: one pre-token
        else:
            ids = []
            for word in self.pattern.findall(piece):
                found = self._words.get(word)
                if found is None:
                    found = self.encode_piece(word.encode("utf-8", "surrogatepass"))
                    if len(word) <= 64:
                        if len(self._words) >= CACHE_WORDS:
                            self._words.clear()
                        self._words[word] = found
                ids += found
        packed = array("I", ids)
        if sys.byteorder != "little":
            packed.byteswap()
        return packed.tobytes()

    def _cached(self, piece: str) -> bytes:
        """Ids of a piece, which begins a text or with a space, and which a space or the text's end follows."""
        found = self._pieces.get(piece)
        if found is not None:
            return found
        found = self._older.get(piece)
        if found is None:
            stem = piece[:-1]
            if self._usual and piece[-1:] in _STOPS and stem[1:].isalpha() and (stem[0] == " " or stem[0].isalpha()):
                found = self._cached(stem) + self._cached(piece[-1])
            else:
                found = self._ids(piece)
        if len(piece) <= 64:
            if len(self._pieces) >= CACHE_PIECES:
                self._older, self._pieces = self._pieces, {}
            self._pieces[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null: none."""
        if not text:
            return b""
        if _SPACES.search(text):
            return b"".join(map(self._cached, _CUT.split(text)))
        known, cached, (first, *rest) = self._pieces.get, self._cached, text.split(" ")
        return b"".join([cached(first), *(known(x) or cached(x) for x in map(" ".__add__, rest))])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def vocabulary_path(name: str) -> str:
    """A file's place; a plain name is one of the installed public vocabularies."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def encode(text: Column, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Column:
    """array<int> of token ids for each text; null and empty texts: no ids."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(vocabulary_path(vocabulary), pattern)
        for batch in texts:
            yield pd.Series([np.frombuffer(bpe.encode(x), "<u4").astype(np.int32) for x in batch], dtype=object)

    bound_batches()
    return F.pandas_udf(batches, "array<int>")(text)


def decode(ids: Column, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes that the ids stand for; null: empty."""

    def batches(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(vocabulary_path(vocabulary), pattern)
        for batch in lists:
            yield pd.Series([bpe.decode(b"" if x is None else np.asarray(x, "<u4").tobytes()) for x in batch], dtype=object)

    bound_batches()
    return F.pandas_udf(batches, "binary")(ids)


def encode_checked(text: Column, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Column:
    """struct<ids binary, round_trip boolean>: ids as little-endian unsigned 32-bit integers, the form that training
    readers map into memory, and whether they decode to the text's bytes.

    A null or empty text has no ids and makes the trip. Texts are encoded whole, however long; equal texts get equal ids.
    """

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary_path(vocabulary), pattern)
        for batch in texts:
            coded = [bpe.encode(x) for x in batch]
            same = [bpe.decode(ids) == (x or "").encode("utf-8", "surrogatepass") for x, ids in zip(batch, coded, strict=True)]
            yield pd.DataFrame({"ids": coded, "round_trip": same})

    bound_batches()
    return F.pandas_udf(batches, "ids binary, round_trip boolean")(text)


def digest(text: Column, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: what encoding gives and what decoding its ids gives back.

    A null or empty text has 0 tokens and the digests of nothing. Texts are encoded whole; equal texts get equal digests.
    """

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, sha = load(vocabulary_path(vocabulary), pattern), hashlib.sha256
        for batch in texts:
            rows = []
            for text in batch:
                ids = bpe.encode(text)
                rows.append((len(ids) // 4, sha(ids).hexdigest(), sha(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches()
    return F.pandas_udf(batches, "n_tokens long, ids_sha256 string, decoded_sha256 string")(text)
