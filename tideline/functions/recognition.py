"""Recognisers and mark restorers as table functions: an utterance that fails costs its own rows only.

A table function gets a session's rows by ``PARTITION BY`` and ``ORDER BY`` of the call, one after the other,
and gives rows while the next ones come; nothing is held of a session but the model's own state and the end of
what was heard. Models are loaded once for each Python worker. What a model raises becomes a row
with ``error`` and without text, which ``failures`` counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tideline.session import ship_package

RATE = 16_000
PROMPT_CHARS = 200
Word = tuple[str, float, float]
HEARD = "session_id long, piece_no long, text string, start_s double, end_s double, words array<struct<text:string,start:double,end:double>>, error string"
MARKED = "session_id long, line_id long, text string, marked boolean, error string"

_loaded: dict[Any, Any] = {}


@dataclass
class Heard:
    """What an engine says of audio: an open hypothesis (``final`` false) or a closed one."""

    text: str
    words: list[Word]
    final: bool = False


class Engine(Protocol):
    """A recogniser. Times are seconds on the audio's line, which ``origin`` gives for the first sample."""

    def capabilities(self) -> dict[str, bool]:
        """``streaming``: whether it takes chunks; ``word_times``; ``punctuated``."""

    def backend(self) -> dict[str, str]:
        """What was loaded, and what it runs on."""

    def set_prompt(self, text: str) -> None:
        """The end of what was heard, which the next pass leans towards."""

    def feed(self, pcm: list[float], origin: float) -> list[Heard]:
        """The next chunk, or the whole utterance."""

    def finalize(self) -> Heard | None:
        """Close what is open."""

    def open_words(self) -> list[Word]:
        """The words of the open hypothesis, without closing it."""


class Restorer(Protocol):
    """Puts punctuation and case into text, and changes nothing else."""

    def restore(self, text: str) -> str: ...


class LevelEngine:
    """A deterministic stand-in: each sample of ``least`` or more is a word of its whole part; ``most`` or more is an error."""

    def __init__(self, least: float = 1.0, most: float = float("inf"), rate: float = RATE) -> None:
        self.least, self.most, self.rate = least, most, rate
        self.prompt, self.held, self.number = "", [], 0

    def capabilities(self) -> dict[str, bool]:
        return {"streaming": True, "word_times": True, "punctuated": False}

    def backend(self) -> dict[str, str]:
        return {"model": "levels", "device": "cpu"}

    def set_prompt(self, text: str) -> None:
        self.prompt = text

    def feed(self, pcm: list[float], origin: float) -> list[Heard]:
        if any(x >= self.most for x in pcm):
            raise ValueError("overdriven")
        self.held = [(str(int(x)), origin + k / self.rate, origin + (k + 1) / self.rate) for k, x in enumerate(pcm) if x >= self.least]
        return [Heard(" ".join(w for w, _, _ in self.held), list(self.held))]

    def finalize(self) -> Heard | None:
        closed, self.held = self.held, []
        return Heard(" ".join(w for w, _, _ in closed), closed, True) if closed else None

    def open_words(self) -> list[Word]:
        return list(self.held)


def once(load: Callable[[], Any], key: Any) -> Any:
    """What ``load`` gives, loaded once in this Python worker."""
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def recognised(pieces: DataFrame, load: Callable[[], Engine], key: Any, rate: int = RATE, prompt_chars: int = PROMPT_CHARS) -> DataFrame:
    """``session_id, piece_no, text, start_s, end_s, words, error`` of ``pieces(session_id, piece_no, start_s, pcm)``.

    A session's pieces are heard in order, each with the end of what was heard of it as prompt.
    Pieces without samples aren't heard, and those without text have no row. The span is that of the words, or
    the piece's own where the engine tells none. ``key`` names the model among those of a worker.
    """
    ship_package(pieces.sparkSession)

    class Recognise:
        def __init__(self) -> None:
            self.heard = ""

        def eval(self, row: Row) -> Iterator[tuple]:
            if row.session_id is None or not row.pcm:
                return
            try:
                engine = once(load, key)
                engine.set_prompt(self.heard[-prompt_chars:] if prompt_chars else "")
                event = next(iter(engine.feed(list(row.pcm), row.start_s)), None)
            except Exception as error:  # noqa: BLE001  whatever a model raises is the utterance's
                yield row.session_id, row.piece_no, None, None, None, None, f"{type(error).__name__}: {error}"
                return
            text = " ".join(event.text.split()) if event else ""
            if text:
                start = event.words[0][1] if event.words else row.start_s
                end = event.words[-1][2] if event.words else row.start_s + len(row.pcm) / rate
                self.heard = f"{self.heard}{text} "[-2 * max(1, prompt_chars) :]
                yield row.session_id, row.piece_no, text, start, end, event.words, None

    function = F.udtf(Recognise, returnType=HEARD)
    return function(pieces.select("session_id", "piece_no", "start_s", "pcm").asTable().partitionBy("session_id").orderBy("piece_no"))


def same_but_marks(text: str, marked: str) -> bool:
    """Whether two texts have the same words but for marks and case."""

    def bare(words: str) -> list[str]:
        return [w for w in ("".join(c for c in x if c.isalnum() or c == "'").casefold() for x in words.split()) if w]

    return bare(text) == bare(marked)


def restored(lines: DataFrame, load: Callable[[], Restorer] | None, key: Any = None) -> DataFrame:
    """``session_id, line_id, text, marked, error`` of ``lines(session_id, line_id, text)``.

    A restorer that changes words isn't followed, one that fails leaves the line as it is, and without one
    all lines pass as they are.
    """
    ship_package(lines.sparkSession)

    class Restore:
        def eval(self, row: Row) -> Iterator[tuple]:
            error, marked = None, row.text
            if load is not None and row.text:
                try:
                    marked = once(load, key).restore(row.text)
                except Exception as raised:  # noqa: BLE001  whatever a model raises is the line's
                    error = f"{type(raised).__name__}: {raised}"
            good = error is None and row.text is not None and marked != row.text and same_but_marks(row.text, marked)
            yield row.session_id, row.line_id, marked if good else row.text, good, error

    function = F.udtf(Restore, returnType=MARKED)
    return function(lines.select("session_id", "line_id", "text").asTable().partitionBy("session_id").orderBy("line_id"))


def failures(rows: DataFrame) -> DataFrame:
    """``session_id, n, failed``: how many rows each session has, and how many of them are errors."""
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed"))
