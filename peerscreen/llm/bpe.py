"""Byte-pair encoding and decoding with a prefix trie of words.

A text is cut into words by the vocabulary's own pattern. The distinct words of a batch make a byte
trie whose nodes hold the last token of the encoding of their prefix. That state follows from the
states above: the last token of a prefix is the one vocabulary entry t that ends it and that the
encoding of what lies before t may be followed by. The trie is walked depth first as it is built:
sorted words are its leaves in that order, so the path to the last word is all that has to be kept,
states of the prefix that the next word shares with it stand, and only the rest is added. Prefixes
that words share are therefore encoded once, and a word's tokens are read off by walking its path
back, token by token.

Each task keeps the tokens of the words it has met from batch to batch and starts anew when they
have grown to MAX_WORDS, so memory is bounded and nothing is shuffled; results don't depend on it.

Edge cases: a null text counts as empty and has no tokens; a word of any length is one path; the strings of special tokens in a text become
those tokens; null or unknown ids are skipped in decoding, null lists give an empty text, and bytes
that aren't UTF-8 become replacement characters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from peerscreen.llm.common import clear

# Fixed value: how byte-level vocabularies cut text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MAX_WORDS = 400_000
CHUNK = 1_000_000  # characters encoded at a time


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_strings(data: dict) -> list[bytes]:
    """The bytes of every id."""
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    found = {i: bytes(letters[c] for c in name) for name, i in data["model"]["vocab"].items() if name not in special}
    found |= {i: name.encode() for name, i in special.items()}
    return [found.get(i, b"") for i in range(max(found) + 1)]


class Vocabulary:
    """Tokens, merges and which token may follow which."""

    def __init__(self, source: str):
        data = json.loads(source)
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        named = {name: i for name, i in ids.items() if name not in self.special}
        self.bytes_of = byte_strings(data)
        merges = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank[ids[a], ids[b]] = r
            made.setdefault(ids[a + b], (ids[a], ids[b]))
        self.made = made
        #: Every ending of a token: the token it is, or -1.
        self.ending: dict[bytes, int] = {}
        for i in named.values():
            for k in range(1, len(self.bytes_of[i])):
                self.ending.setdefault(self.bytes_of[i][k:], -1)
        self.ending |= {self.bytes_of[i]: i for i in named.values()}
        self.sizes = [len(x) for x in self.bytes_of]
        self.edges: dict[int, list[tuple[int, float, float]]] = {}  # at most two a token
        self.follows: dict[int, bool] = {}  # a << 32 | b, as far as asked

    def _edge(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """Tokens at one edge while `token` is being merged: token, rank that made it, rank that consumed it."""
        key = token << 1 | side
        if key in self.edges:
            return self.edges[key]
        out: list[tuple[int, float, float]] = []
        until = inf
        self.edges[key] = out
        while True:
            pair = self.made.get(token)
            born = self.rank[pair] if pair else -1
            out.append((token, born, until))
            if not pair:
                return out
            token, until = pair[side], born

    def may_follow(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: no merge reaches over their border before both are complete.

        Where one rule could apply at two places, the left one goes first.
        """
        if len(self.follows) > 500_000:
            self.follows.clear()
        rank, left, known = self.rank.get, self._edge(b, 0), True
        for x, born_x, until_x in self._edge(a, 1):
            for y, born_y, until_y in left:
                m = rank((x, y))
                if m is not None and born_x < m < until_x and born_y < m <= until_y:
                    known = False
        self.follows[a << 32 | b] = known
        return known


class Encoder:
    """Tokens of words, by a trie that grows with the words it meets."""

    def __init__(self, source: str):
        self.vocabulary = Vocabulary(source)
        self.words = regex.compile(PATTERN)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.restart()

    def restart(self) -> None:
        special = self.vocabulary.special
        self.slot: dict[str, int] = {name: k for k, name in enumerate(special)}
        self.tokens = np.array(list(special.values()), dtype=np.int32)
        self.starts = np.arange(len(special) + 1, dtype=np.int64)

    def walk(self, words: list[str]) -> None:
        """Go over the trie of sorted words and keep the tokens of each.

        last[d] is the last token of the encoding of the first d bytes of the current path.
        """
        ending, known, may_follow = self.vocabulary.ending, self.vocabulary.follows.get, self.vocabulary.may_follow
        sizes = self.vocabulary.sizes
        last, path, first = [-1], b"", len(self.starts) - 1
        tokens: list[int] = []
        ends: list[int] = []
        for k, word in enumerate(words):
            raw = word.encode("utf-8", "surrogatepass")
            length, shared = len(raw), 0
            for x, y in zip(raw, path):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            path = raw
            for end in range(shared + 1, length + 1):
                start = end - 1
                while True:
                    token = ending[raw[start:end]]  # a shorter ending fits before this can fail
                    if token >= 0:
                        if not start:
                            break
                        before = last[start]
                        fits = known(before << 32 | token)
                        if fits or fits is None and may_follow(before, token):
                            break
                    start -= 1
                last.append(token)
            ids, end = [], length
            while end:
                token = last[end]
                ids.append(token)
                end -= sizes[token]
            tokens += ids[::-1]
            ends.append(len(tokens))
            self.slot[word] = first + k
        if words:
            self.starts = np.concatenate([self.starts, np.array(ends, dtype=np.int64) + self.starts[-1]])
            self.tokens = np.concatenate([self.tokens, np.array(tokens, dtype=np.int32)])

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.vocabulary.special):
            return self.words.findall(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.vocabulary.special else self.words.findall(part))]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.slot) > MAX_WORDS:
            self.restart()
        words: list[str] = []
        ends = [0]
        for t in texts:
            if t:
                words += self.pieces(t)
            ends.append(len(words))
        self.walk(sorted(set(words) - self.slot.keys()))
        slots = np.fromiter(map(self.slot.__getitem__, words), dtype=np.int64, count=len(words))
        sizes = np.diff(self.starts)[slots]
        before = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(self.starts[slots] - before[:-1], sizes) + np.arange(before[-1])
        found = pa.ListArray.from_arrays(pa.array(before[ends], type=pa.int32()), pa.array(self.tokens[places]))
        if len(self.tokens) > 8 * MAX_WORDS:  # very long words
            self.restart()
        return found


class Decoder:
    def __init__(self, source: str):
        table = byte_strings(json.loads(source))
        self.sizes = np.array([len(b) for b in table] + [0], dtype=np.int64)  # the last stands for unknown ids
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.frombuffer(b"".join(table), dtype=np.uint8)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        ids = lists.flatten()
        numbers = np.asarray(ids.fill_null(-1), dtype=np.int64)
        numbers = np.where((numbers < 0) | (numbers >= len(self.sizes) - 1), len(self.sizes) - 1, numbers)
        counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        sizes = self.sizes[numbers]
        before = np.concatenate([[0], np.cumsum(sizes)])
        out, first = [], 0
        while first < len(counts):  # some texts at a time
            last = first + 1
            while last < len(counts) and before[ends[last + 1]] - before[ends[first]] <= CHUNK:
                last += 1
            a, b = ends[first], ends[last]
            places = np.repeat(self.starts[numbers[a:b]] - (before[a:b] - before[a]), sizes[a:b]) + np.arange(before[b] - before[a])
            data = self.flat[places].tobytes()
            cuts = before[ends[first : last + 1]] - before[a]
            out += [data[cuts[i] : cuts[i + 1]].decode("utf-8", "replace") for i in range(last - first)]
            first = last
        return pa.array(out, type=pa.string())


_KEPT: dict[tuple[str, int], object] = {}


def _of(kind: type, source: str):
    """One per worker process and vocabulary: later tasks of the process go on with it."""
    key = (kind.__name__, hash(source))
    if key not in _KEPT:
        _KEPT.clear() if len(_KEPT) > 4 else None
        _KEPT[key] = kind(source)
    return _KEPT[key]


def _vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def chunks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts, about CHUNK characters at a time."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield texts.slice(a, b - a).to_pylist()


def encoder(df: DataFrame, path: str):
    """An Arrow function from texts to token ids; the vocabulary file (a few MB) is read here and broadcast."""
    source = df.sparkSession.sparkContext.broadcast(_vocabulary_text(path))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _of(Encoder, source.value)
        for texts in batches:
            yield pa.concat_arrays([own.encode(part) for part in chunks(texts)])

    return encode


def round_tripper(df: DataFrame, path: str):
    """An Arrow function from texts to (token ids, text of those ids): both steps in one Python worker."""
    source = df.sparkSession.sparkContext.broadcast(_vocabulary_text(path))

    @F.arrow_udf("struct<ids:array<int>,text:string>")
    def trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, decode = _of(Encoder, source.value).encode, _of(Decoder, source.value).decode
        for texts in batches:
            parts = []
            for part in chunks(texts):
                ids = encode(part)
                parts.append(pa.StructArray.from_arrays([ids, decode(ids)], names=["ids", "text"]))
            yield pa.concat_arrays(parts)

    return trip


def decoder(df: DataFrame, path: str):
    source = df.sparkSession.sparkContext.broadcast(_vocabulary_text(path))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _of(Decoder, source.value)
        for lists in batches:
            yield own.decode(lists)

    return decode


def encoded(df: DataFrame, path: str, text: str | Column = "text", out: str = "token_ids") -> DataFrame:
    """df with the token ids of a text column; an input column named `out` is replaced."""
    source = F.col(text) if isinstance(text, str) else text
    named = clear(df.withColumn("_text", source.cast("string")), out)
    return named.withColumn(out, encoder(df, path)("_text")).drop("_text")


def decoded(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the text of a column of token ids."""
    return clear(df, out).withColumn(out, decoder(df, path)(ids))


def round_trip(df: DataFrame, path: str, text: str = "text", out: str = "token_ids", back: str = "decoded") -> DataFrame:
    """df with the token ids of a text column and what they decode to, in one pass over the texts."""
    named = clear(df.withColumn("_text", F.col(text).cast("string")), out, back)
    both = named.withColumn("_both", round_tripper(df, path)("_text")).drop("_text")
    return both.withColumns({out: F.col("_both.ids"), back: F.col("_both.text")}).drop("_both")
