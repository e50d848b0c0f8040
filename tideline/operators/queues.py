"""Bounded memory between producers and consumers: draft caches, queues that drop or block, pauses, retention.

What a row finds depends on what earlier rows left, in a state of fixed size; sessions are
dealt by key and folded in order by one Python function each, which holds that state alone.
What windows can say is said by windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import ship_package

DRAFTS = 8
RATE = 16_000
#: name -> (rows that may wait, what happens to a row that finds no room)
QUEUES = {"utterances": (2, "drop"), "translations": (8, "drop"), "frames": (64, "drop"), "sink": (64, "block")}


def _folded(rows: DataFrame, order: list[str], schema: str, fold: Callable[[pd.DataFrame], list[tuple]]) -> DataFrame:
    ship_package(rows.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(frame.sort_values(order)), columns=names)

    return rows.groupBy("session_id").applyInPandas(run, schema)


def reuse_once(jobs: DataFrame, most: int = DRAFTS) -> DataFrame:
    """``session_id, seq, answer`` of the settled ones of ``jobs(session_id, seq, settled, line_id, source, answer)``.

    Drafts leave their answer in a memory of ``most``, from which the oldest goes first. A
    settled job takes the newest answer to the very same line and source; with it all
    drafts of its line are forgotten.
    """

    def fold(frame: pd.DataFrame) -> list[tuple]:
        held: deque[tuple] = deque(maxlen=most)
        found = []
        for row in frame.itertuples():
            if not row.settled:
                held.append((row.line_id, row.source, row.answer))
                continue
            answers = [answer for line, source, answer in held if (line, source) == (row.line_id, row.source)]
            found.append((row.session_id, row.seq, answers[-1] if answers else None))
            held = deque((x for x in held if x[0] != row.line_id), maxlen=most)
        return found

    return _folded(jobs, ["seq"], "session_id long, seq long, answer string", fold)


def queued(offers: DataFrame, capacity: int, policy: str) -> DataFrame:
    """``session_id, seq, admitted, done_at`` of ``offers(session_id, at, seq, work)`` before one worker.

    ``capacity`` rows may be under way. One that finds no room is dropped, or waits for room
    with all that come after it.
    """

    def fold(frame: pd.DataFrame) -> list[tuple]:
        under_way: deque[float] = deque()
        free_at, now, found = 0.0, 0.0, []
        for row in frame.itertuples():
            now = max(now, row.at)
            while under_way and under_way[0] <= now:
                under_way.popleft()
            if len(under_way) >= capacity and policy == "drop":
                found.append((row.session_id, row.seq, False, None))
                continue
            if len(under_way) >= capacity:
                now = under_way.popleft()
            free_at = max(free_at, now) + row.work
            under_way.append(free_at)
            found.append((row.session_id, row.seq, True, free_at))
        return found

    return _folded(offers, ["at", "seq"], "session_id long, seq long, admitted boolean, done_at double", fold)


def endpoints(steps: DataFrame, blank: float, after_text: float, longest: float) -> DataFrame:
    """``session_id, seq, segment_no, rule`` of ``steps(session_id, at, seq, voiced, decoded)``: where segments end.

    A segment ends after ``blank`` of silence without any text, after ``after_text`` of
    silence with some, or when it is ``longest``; the next one begins there.
    """

    def fold(frame: pd.DataFrame) -> list[tuple]:
        number, start, loud, text, found = 0, None, None, False, []
        for row in frame.itertuples():
            if start is None:
                start = loud = row.at
            loud = row.at if row.voiced else loud
            text = text or bool(row.decoded)
            silence = row.at - loud
            rule = "text" if text and silence >= after_text else "blank" if not text and silence >= blank else "long" if row.at - start >= longest else None
            found.append((row.session_id, row.seq, number, rule))
            if rule:
                number, start, loud, text = number + 1, row.at, row.at, False
        return found

    return _folded(steps, ["at", "seq"], "session_id long, seq long, segment_no long, rule string", fold)


def dwelt(texts: DataFrame, least: float) -> DataFrame:
    """``session_id, seq, shown_at`` of ``texts(session_id, at, seq)``: what is shown, each for ``least`` at least.

    While one is shown, the newest that has come since waits, and the others are skipped.
    """

    def fold(frame: pd.DataFrame) -> list[tuple]:
        until, waiting, found = float("-inf"), None, []
        for row in frame.itertuples():
            if waiting is not None and row.at >= until:
                found.append((row.session_id, waiting, until))
                until, waiting = until + least, None
            if row.at >= until:
                found.append((row.session_id, row.seq, row.at))
                until = row.at + least
            else:
                waiting = row.seq
        return found if waiting is None else [*found, (frame["session_id"].iloc[0], waiting, until)]

    return _folded(texts, ["at", "seq"], "session_id long, seq long, shown_at double", fold)


def unpaused(rows: DataFrame, control: Column) -> DataFrame:
    """``rows(session_id, at, seq, samples)`` that come while not paused, with ``audio_s``: the audio delivered before each, in seconds.

    ``control`` is true for a row that pauses, false for one that resumes, and null for
    frames; paused frames are discarded and the audio's clock stands still.
    """
    so_far = Window.partitionBy("session_id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("control", control).withColumn("paused", F.coalesce(F.last("control", ignorenulls=True).over(so_far), F.lit(False)))
    kept = marked.where("control is null and not paused")
    before = Window.partitionBy("session_id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("audio_s", F.coalesce(F.sum("samples").over(before), F.lit(0)) / F.lit(float(RATE))).drop("control", "paused")


def retained(rows: DataFrame, seconds: float) -> DataFrame:
    """``session_id, at, seq, n_held``: how many rows of the last ``seconds`` a session holds at each."""
    held = Window.partitionBy("session_id").orderBy((F.col("at") * 1_000_000).cast("long")).rangeBetween(-round(seconds * 1_000_000), Window.currentRow)
    return rows.select("session_id", "at", "seq", F.count(F.lit(1)).over(held).alias("n_held"))
