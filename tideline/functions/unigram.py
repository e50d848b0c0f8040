"""Unigram tokenisers, read from SentencePiece model files.

The file is a protobuf message of varints and byte strings, of which the vocabulary, the kind of model
and the normaliser are read. A text is normalised by the file's own table of prefixes, cut into words
that each start with ``▁``, and each word gets the segmentation with the best sum of scores, by
Viterbi over the lattice of its pieces. Characters that no piece covers are unknown, neighbouring ones together.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tideline.session import ship_package

# Fixed values of the file format.
UNIGRAM = 1
NORMAL, UNKNOWN, CONTROL, USER, UNUSED = 1, 2, 3, 4, 5
SPACE = "▁"
UNKNOWN_COST = 10.0
CACHE_WORDS = 200_000


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(field number, value)`` of a message: numbers for varints, bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(raw):
                raise ValueError("the message is cut short")
            if shift > 63:
                raise ValueError("a varint of more than 64 bits")
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} is unknown")
            size = varint()
        if at + size > len(raw):
            raise ValueError("the message is cut short")
        yield key >> 3, raw[at : at + size]
        at += size


class CharsMap:
    """A table of prefixes and what they are replaced by: a double array over UTF-8 bytes, then strings that end with a zero."""

    def __init__(self, raw: bytes) -> None:
        size = struct.unpack("<I", raw[:4])[0]
        self.units = np.frombuffer(raw[4 : 4 + size], "<u4").tolist()
        self.strings = raw[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest prefix from ``at`` that the table has, and its replacement."""
        units, found = self.units, None
        node = self._offset(units[0])
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                place = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.strings[place : self.strings.index(b"\0", place)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def apply(self, text: str) -> str:
        """Each longest prefix replaced, from the left; characters without one stay."""
        raw, out, at = text.encode(), [], 0
        while at < len(raw):
            hit = self.longest(raw, at)
            if hit is None:
                byte = raw[at]
                size = 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                hit = size, raw[at : at + size]
            out.append(hit[1])
            at += hit[0]
        return b"".join(out).decode()


@dataclass
class Unigram:
    """A vocabulary with scores, and how texts are prepared for it."""

    scores: dict[str, float]
    charsmap: CharsMap | None = None
    add_space: bool = True
    squeeze: bool = True
    unknown: str = "<unk>"
    least: float = 0.0
    longest: int = 1
    known: dict[str, list[tuple[str, float]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.least = min(self.scores.values(), default=0.0)
        self.longest = max(map(len, self.scores), default=1)

    @classmethod
    def parse(cls, raw: bytes) -> Unigram:
        """A model file; one that isn't a unigram model is an error."""
        pieces: list[tuple[str, float, int]] = []
        kind, charsmap, add_space, squeeze = UNIGRAM, b"", True, True
        for number, value in fields(raw):
            if number == 1 and isinstance(value, bytes):
                told = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(fields(value))
                if not told[1]:
                    raise ValueError("a piece without text")
                pieces.append((told[1].decode(), struct.unpack("<f", told[2])[0], told[3]))
            elif number == 2 and isinstance(value, bytes):
                kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3 and isinstance(value, bytes):
                told = dict(fields(value))
                charsmap, add_space, squeeze = told.get(2, b""), bool(told.get(3, 1)), bool(told.get(4, 1))
        if not pieces:
            raise ValueError("no pieces: this is no SentencePiece model")
        if kind != UNIGRAM:
            raise ValueError(f"a model of kind {kind}; only unigram models are read")
        unknown = next((p for p, _, k in pieces if k == UNKNOWN), "<unk>")
        scores = {p: s for p, s, k in pieces if k in (NORMAL, USER)}
        return cls(scores, CharsMap(charsmap) if charsmap else None, add_space, squeeze, unknown)

    def words(self, text: str) -> list[str]:
        """The normalised words of a text, each with the mark of a space before it if there was one."""
        text = self.charsmap.apply(text) if self.charsmap else text
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.add_space and not text.startswith(SPACE):
            text = SPACE + text
        found, start = [], 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k] == SPACE:
                found.append(text[start:k])
                start = k
        return found

    def best(self, word: str) -> list[tuple[str, float]]:
        """The pieces of the best segmentation of a word, with their scores."""
        if word not in self.known:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = self._viterbi(word)
        return self.known[word]

    def _viterbi(self, word: str) -> list[tuple[str, float]]:
        n = len(word)
        total: list[float] = [0.0] + [-np.inf] * n
        start, own = [0] * (n + 1), [0.0] * (n + 1)
        unknown = [False] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                score = self.scores.get(word[i:j])
                missing = score is None and j == i + 1
                if missing:
                    score = self.least - UNKNOWN_COST
                if score is not None and total[i] + score > total[j]:
                    total[j], start[j], own[j], unknown[j] = total[i] + score, i, score, missing
        found: list[tuple[str, float, bool]] = []
        at = n
        while at:
            piece = word[start[at] : at], own[at], unknown[at]
            if found and piece[2] and found[-1][2]:
                found[-1] = piece[0] + found[-1][0], piece[1] + found[-1][1], True
            else:
                found.append(piece)
            at = start[at]
        return [(p, s) for p, s, _ in reversed(found)]

    def encode(self, text: str | None) -> list[str]:
        """The pieces of a text; none of null."""
        return [p for word in self.words(text or "") for p, _ in self.best(word)]

    def decode(self, pieces: list[str]) -> str:
        """The normalised text of pieces."""
        text = "".join(pieces).replace(SPACE, " ")
        return text[1:] if self.add_space and text.startswith(" ") else text


def unigram_pieces(spark: SparkSession, text: Column, model: Unigram) -> Column:
    """The pieces of a text column, as an array; null for null."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # a vocabulary, as large as its file

    @F.pandas_udf("array<string>")
    def pieces(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else shared.value.encode(x))

    return pieces(text)
