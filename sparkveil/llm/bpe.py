"""Byte-level BPE by a backtracking encoder; decoding by an offset table.

Within a piece, an automaton gives the longest token at each place. The encoder takes them from
left to right, tries the next shorter token where two neighbours could not stand side by side
after the merges, and steps back where none fits. A place that failed is not tried again, so the
work is linear in the piece. Which neighbours are possible follows from the merges alone: undo
the later merge of both sides again and again, and see whether the two tokens at the seam would
have merged before that.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.llm.common import free_name, slices, text_of
from sparkveil.llm.pieces import PieceCache, Remembered, byte_letters, splitter


class Vocabulary:
    """Tokens as Latin-1 strings of their bytes, merges by rank, and the special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        as_bytes = _byte_names()
        self.id = {as_bytes(name): number for name, number in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.merge: dict[tuple[str, str], int] = {}
        self.rank = dict.fromkeys(self.id, -1)
        self.halves: dict[str, tuple[str, str]] = {}
        own = {name: name for name in self.id}  # one string per token, however many merges name it
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = (own.get(x, x) for x in map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge))
            halves, whole = (left, right), own.get(left + right, left + right)
            self.merge[halves] = rank
            self.rank[whole] = rank
            self.halves[whole] = halves


def _byte_names():
    """A token's name in the file -> its bytes as a Latin-1 string."""
    letter = byte_letters()
    return lambda name: "".join(chr(letter[c]) for c in name)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for token in vocabulary.id:
            self.automaton.add_word(token, token)
        self.automaton.make_automaton()
        self.fits = Remembered(self.compatible, 150_000)
        self.shorter_of: dict[str, str] = {}

    def shorter(self, token: str) -> str:
        """The longest token that is a proper start of this one; empty if there is none."""
        found = self.shorter_of.get(token)
        if found is None:
            known = self.vocabulary.id
            found = self.shorter_of[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in known), "")
        return found

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether two tokens can stand side by side after the merges."""
        left, right = pair
        v = self.vocabulary
        before = len(v.merge)
        while True:
            if v.merge.get((left, right), before) < before:
                return False  # the seam would have merged before both sides were whole
            if v.rank[left] > v.rank[right]:
                before = v.rank[left]
                left = v.halves[left][1]
            elif v.rank[right] >= 0:
                before = v.rank[right] + 1  # an equal merge further left comes first
                right = v.halves[right][0]
            else:
                return True

    def tokens(self, piece: str) -> list[str]:
        """Tokens of one piece, given and returned as Latin-1 strings of bytes."""
        if piece in self.vocabulary.id:
            return [piece]
        n, matches = len(piece), self.automaton.iter_long
        # the chain of longest tokens covers most places that are looked at; others are asked for when needed
        longest: dict[int, str] = {}
        at = 0
        for end, token in matches(piece):
            longest[at] = token
            at = end + 1
        if at != n:
            raise ValueError("the vocabulary lacks a byte of the text")
        fits, dead = self.fits, set()
        found: list[str] = []
        at, token, before = 0, longest[0], ""
        while at < n:
            while token:
                end = at + len(token)
                if end not in dead:
                    if not before or fits[before, token]:
                        found.append(token)
                        at, before = end, token
                        if at < n:
                            token = longest.get(at)
                            if token is None:
                                token = longest[at] = next(matches(piece, at))[1]
                        break
                shorter = self.shorter_of.get(token)
                token = self.shorter(token) if shorter is None else shorter
            else:
                if not found:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                token = found.pop()
                at -= len(token)
                before = found[-1] if found else ""
                shorter = self.shorter_of.get(token)
                token = self.shorter(token) if shorter is None else shorter
        return found

    def ids(self, piece: str) -> bytes:
        """Ids of one piece of text, as 32-bit integers."""
        number = self.vocabulary.id
        return array("i", [number[t] for t in self.tokens(piece.encode("utf-8").decode("latin-1"))]).tobytes()


class Coder:
    """Whole texts to ids, one per worker."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.special = vocabulary.special
        self.cache = PieceCache(Encoder(vocabulary).ids)
        self.split = splitter()

    def encode(self, text: str) -> bytes:
        if not any(mark in text for mark in self.special):
            return b"".join(map(self.cache.__getitem__, self.split(text)))
        parts = [text]
        for mark, number in self.special.items():
            code = np.array([number], dtype="<i4").tobytes()
            cut: list[str | bytes] = []
            for part in parts:
                if isinstance(part, bytes):
                    cut.append(part)
                else:
                    for k, rest in enumerate(part.split(mark)):
                        cut += [code, rest] if k else [rest]
            parts = cut
        return b"".join(p if isinstance(p, bytes) else b"".join(map(self.cache.__getitem__, self.split(p))) for p in parts)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; copies that stand together are encoded once."""
        found: list[bytes] = []
        for k, text in enumerate(texts):
            found.append(found[-1] if k and text == texts[k - 1] else self.encode(text))
        return found


class Decoder:
    """Ids to bytes by an offset table: the bytes of all tokens, and where each begins."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        as_bytes = _byte_names()
        tokens = {number: as_bytes(name).encode("latin-1") for name, number in data["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in data["added_tokens"]}
        table = [tokens.get(k, b"") for k in range(max(tokens) + 1)]
        self.blob = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, gathered from the offset table."""
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return np.empty(0, dtype=np.uint8)
        return self.blob[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]

    def text(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return self.decode(ids.astype(np.int64)).tobytes().decode("utf-8", "replace")


@cache
def coder(path: str) -> Coder:
    return Coder(path)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids", unchanged: str | None = None) -> DataFrame:
    """`docs` with the token ids of its whole text (null: empty) as array<int>, the text left out.

    Marks of special tokens in a text become those tokens, as the tokenizers library does it. With
    `unchanged`, a column of that name tells whether the decoder gives the text back.
    """
    names = [into, *([unchanged] if unchanged else [])]
    if any(free_name(docs, name) != name for name in names):
        raise ValueError(f"columns {names} exist already")
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(into, T.ArrayType(T.IntegerType(), False)), *(T.StructField(c, T.BooleanType()) for c in names[1:])])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, back = coder(path), decoder(path) if unchanged else None
        for batch in slices(batches):
            texts = batch.column(len(rest)).to_pylist()
            parts = code.encode_all(texts)
            columns = [*batch.columns[: len(rest)], _lists(parts)]
            if back:
                columns.append(pa.array([back.text(np.frombuffer(p, dtype="<i4")) == t for p, t in zip(parts, texts, strict=True)]))
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, *names])

    return docs.select(*(F.col(f"`{c}`") for c in rest), text_of(text).alias(text)).mapInArrow(add, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`tokens` with the text of its ids (null: empty); bytes that are no UTF-8 become U+FFFD."""
    if free_name(tokens, into) != into:
        raise ValueError(f"column {into} exists already")
    rest = [c for c in tokens.columns if c != ids]
    schema = T.StructType([*(tokens.schema[c] for c in rest), tokens.schema[ids], T.StructField(into, T.StringType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = decoder(path)
        for batch in slices(batches):
            column = batch.column(len(rest))
            texts = [code.text(np.asarray(row.values)) if row.is_valid else "" for row in column]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], column, pa.array(texts, pa.string())], names=[*rest, ids, into])

    return tokens.select(*rest, ids).mapInArrow(add, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", into: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """`encode` and `decode` in one pass: one Python worker a core instead of two, and ids that need not travel between them."""
    rest = [c for c in docs.columns if c != text]
    if {c.lower() for c in rest} & {c.lower() for c in into}:
        raise ValueError(f"columns {into} exist already")
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(into[0], T.ArrayType(T.IntegerType(), False)), T.StructField(into[1], T.StringType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, back = coder(path), decoder(path)
        for batch in slices(batches):
            parts = code.encode_all(batch.column(len(rest)).to_pylist())
            texts = pa.array([back.text(np.frombuffer(p, dtype="<i4")) for p in parts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], _lists(parts), texts], names=[*rest, *into])

    return docs.select(*rest, text_of(text).alias(text)).mapInArrow(add, schema)
