"""Plug points for models: recognisers, translators, mark restorers, scorers.

Models are opaque: rows in, rows out. They are loaded once for each Python worker and
called with Arrow batches. The stand-ins are deterministic, for tests and demos.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.text import content_words
from tideline.session import ship_package


class Translator(Protocol):
    """Many pieces in, as many translations out, in order; blank where there is none."""

    def translate(self, pieces: list[str]) -> list[str]: ...


class Recogniser(Protocol):
    """One utterance's samples in, ``(text, start, end)`` words out."""

    def recognise(self, samples: list[float], prompt: str) -> list[tuple[str, float, float]]: ...


class EchoTranslator:
    """A stand-in: words in reverse."""

    def translate(self, pieces: list[str]) -> list[str]:
        return [" ".join(reversed(p.split())) for p in pieces]


def translate_rows(rows: DataFrame, load: Callable[[], Translator], text: str = "text") -> DataFrame:
    """``rows`` with ``translation``; lines without content never reach the model."""
    ship_package(rows.sparkSession)
    wanted = rows.where(F.size(content_words(F.col(text))) > 0)
    place = wanted.columns.index(text)
    schema = T.StructType([*wanted.schema.fields, T.StructField("translation", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield frame.assign(translation=model.translate(frame.iloc[:, place].tolist()))

    return wanted.mapInPandas(run, schema)


def fill_missing(first: list[str], pieces: list[str], second: Translator) -> list[str]:
    """Answers of a second translator where the first has none that is usable."""
    usable = [bool(x.strip()) and not any("\ue000" <= c <= "\uf8ff" for c in x) for x in first]
    holes = [i for i, ok in enumerate(usable) if not ok]
    for i, answer in zip(holes, second.translate([pieces[i] for i in holes]), strict=True):
        first[i] = answer
    return first


def recognise_rows(utterances: DataFrame, load: Callable[[], Recogniser], prompt_chars: int = 200) -> DataFrame:
    """``session_id, piece_no, text, start_s, end_s`` of ``utterances(session_id, piece_no, start_s, pcm)``.

    Each session's pieces are heard in order, with the end of what was heard as prompt; a
    piece without words gives no row.
    """

    ship_package(utterances.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        model, heard, rows = load(), "", []
        for row in frame.sort_values("piece_no").itertuples():
            words = model.recognise(list(row.pcm), heard[-prompt_chars:])
            text = " ".join(w for w, _, _ in words).strip()
            if text:
                rows.append((row.session_id, row.piece_no, text, row.start_s + words[0][1], row.start_s + words[-1][2]))
                heard = f"{heard} {text}".strip()
        return pd.DataFrame(rows, columns=["session_id", "piece_no", "text", "start_s", "end_s"])

    return utterances.groupBy("session_id").applyInPandas(run, "session_id long, piece_no long, text string, start_s double, end_s double")
