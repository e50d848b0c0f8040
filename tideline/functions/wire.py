"""Rows as events on the wire, names of states and selectors, lines for a narrow display."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import ship_package

EVENT = (
    "kind string, line_id long, text string, lane string, settled boolean, start_s double, end_s double, reason string, state string,"
    " stage string, latency_s double"
)


def encode(event: Column) -> Column:
    """A struct as JSON; fields without a value are left out."""
    return F.to_json(event)


def decode(text: Column) -> Column:
    return F.from_json(text, EVENT)


def partial(line_id: Column, text: Column, lane: Column, closed_at: Column) -> Column:
    """A line that may still change; ``settled`` says whether its words are final."""
    return F.struct(F.lit("partial").alias("kind"), line_id.alias("line_id"), text.alias("text"), lane.alias("lane"), closed_at.isNotNull().alias("settled"))


def final(line_id: Column, text: Column, start: Column, end: Column, lane: Column, reason: Column) -> Column:
    return F.struct(
        F.lit("final").alias("kind"), line_id.alias("line_id"), text.alias("text"), start.alias("start_s"), end.alias("end_s"), lane.alias("lane"), reason.alias("reason")
    )


def describe_status(state: Column, detail: Column) -> Column:
    """A state as a sentence."""
    return (
        F.when(state == "model_loading", F.concat(F.lit("loading "), detail, F.lit("…")))
        .when(state == "running", "listening")
        .when(state == "paused", "paused")
        .when(state == "reconnecting", F.concat(F.lit("reconnecting to "), detail, F.lit("…")))
        .when(state == "error", F.concat(F.lit("error: "), detail))
        .when(state == "stopped", "stopped")
    )


def selector(name: Column) -> Column:
    """What a device name selects; a word that is unknown is a device's id."""
    kind = F.when(name.isin("system", "loopback"), "system").when(name.isin("mic", "microphone"), "mic").otherwise("device")
    return F.struct(kind.alias("kind"), F.when(kind == "device", name).alias("device_id"))


def take_while(items: Column, test) -> Column:  # noqa: ANN001
    """Items from the front while ``test`` holds."""
    first = F.array_position(F.transform(items, lambda x: ~test(x)), True)
    return F.when(first == 0, items).otherwise(F.slice(items, 1, (first - 1).cast("int")))


def clamp(seconds: Column, limit: Column) -> Column:
    """A time inside the audio that was given."""
    return F.least(F.greatest(seconds, F.lit(0.0)), limit)


def truncate_tokens(tokens: Column, most: int = 200) -> Column:
    return F.slice(tokens, 1, most)


def frame_tokens(tokens: Column, source: str, end: str = "</s>") -> Column:
    """Tokens as a translation model takes them: a language tag, the tokens, an end mark."""
    return F.concat(F.array(F.lit(source)), truncate_tokens(tokens), F.array(F.lit(end)))


def width(char: str) -> int:
    """Display columns of a character."""
    if unicodedata.combining(char) or unicodedata.category(char) in ("Cc", "Cf", "Mn", "Me"):
        return 0
    return 2 if unicodedata.east_asian_width(char) in ("W", "F") else 1


def wrap_text(text: str, columns: int) -> list[str]:
    """Lines of at most ``columns``, cut at the last space that fits, or anywhere if there is none."""
    lines, rest = [], text
    while True:
        used, fits = 0, 0
        for char in rest:
            used += width(char)
            if used > columns and fits:
                break
            fits += 1
        if fits == len(rest):
            return [*lines, rest]
        space = rest.rfind(" ", 1, fits)
        if space > 0:
            lines.append(rest[:space].rstrip())
            rest = rest[space:].lstrip()
        else:
            lines.append(rest[:fits])
            rest = rest[fits:]


def wrapped(text: Column, columns: int) -> Column:
    """``wrap_text`` over a column."""
    ship_package(SparkSession.active())

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else wrap_text(t, columns))

    return run(text)
