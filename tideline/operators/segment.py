"""Ordered folds over sessions: capped pieces, levels, kept lines.

These depend on order in ways that windows can't express; sessions are dealt by key and
worked through by an Arrow batch function each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.gate import OPEN_AT, SILENT_BELOW
from tideline.session import ship_package

WINDOW_S = 0.032
PAD = 6


def speech_runs(p: np.ndarray, pause: int) -> list[tuple[int, int, int]]:
    """``(first, last voiced, end)`` of each run of speech: from an opening window to the ``pause``-th silent one in a row."""
    voiced = np.flatnonzero(p >= SILENT_BELOW)
    # stretches of voice with less than a pause between them; each counts from its first opening window
    stretches = np.split(voiced, np.flatnonzero(np.diff(voiced) > pause) + 1) if len(voiced) else []
    found = []
    for stretch in stretches:
        opening = stretch[p[stretch] >= OPEN_AT]
        if len(opening):
            found.append((int(opening[0]), int(stretch[-1]), min(len(p), int(stretch[-1]) + 1 + pause)))
    return found


def cut_pieces(p: np.ndarray, pause: int, longest: int, look_back: int) -> list[tuple[int, int]]:
    """Pieces of speech ``(first, end)``, in windows, of one session's probabilities.

    A run of speech that reaches ``longest`` windows is cut at the quietest of its last
    ``look_back`` windows, the earliest of several, and again from there on. Ends that are
    no such cuts get a padding; what is left behind a cut without voice is no piece, and
    the cut is the end of the piece before it.
    """
    look_back = max(min(look_back, longest - 1), 1)
    found: list[tuple[int, int]] = []
    for first, last, end in speech_runs(p, pause):
        places = [first]
        while end - places[-1] > longest or (end - places[-1] == longest and (end < last + 1 + pause or pause == 0)):
            full = places[-1] + longest
            places.append(full - look_back + int(p[full - look_back : full].argmin()))
        stop = last + 1
        while places[-1] > last:
            stop = places.pop()
        edges = [*places, stop]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            found.append((a if k else max(0, a - PAD), b if k + 2 < len(edges) else min(len(p), b + PAD)))
    return found


class PieceCutter:
    """Collects one session's probabilities, a window at a time, for ``cut_pieces``."""

    def __init__(self, pause: int, longest: int, look_back: int) -> None:
        self.limits = (pause, longest, look_back)
        self.windows: list[float] = []

    def push(self, p: float) -> None:
        self.windows.append(p)

    def finish(self) -> list[tuple[int, int]]:
        return cut_pieces(np.array(self.windows), *self.limits)


def capped_pieces(series: DataFrame, pause: float, longest: float, look_back: float) -> DataFrame:
    """``session_id, piece_no, first, last_end``: pieces of each session, in windows."""
    ship_package(series.sparkSession)
    windows = [round(x * 1000) // 32 for x in (pause, longest, look_back)]

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        found = cut_pieces(frame.sort_values(["at", "seq"])["p"].to_numpy(), *windows)
        rows = [(frame["session_id"].iloc[0], i, a, b) for i, (a, b) in enumerate(found)]
        return pd.DataFrame(rows, columns=["session_id", "piece_no", "first", "last_end"])

    return series.select("session_id", "at", "seq", "p").groupBy("session_id").applyInPandas(cut, "session_id long, piece_no long, first long, last_end long")


def fold_levels(series: DataFrame, keep: float, floor: float) -> DataFrame:
    """``session_id, seq, level``: exponential average that holds on values below ``floor``.

    A session's rows pass in order; what is held of it is its level.
    """
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = series.select("session_id", "at", "seq", "value").repartition(parts, "session_id").sortWithinPartitions("session_id", "at", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, level = None, None
        for batch in batches:
            levels = []
            for key, value in zip(batch["session_id"], batch["value"], strict=True):
                if key != session:
                    session, level = key, None
                if value >= floor:
                    level = value if level is None else level * keep + value * (1 - keep)
                levels.append(level)
            yield pd.DataFrame({"session_id": batch["session_id"], "seq": batch["seq"], "level": pd.Series(levels, dtype="float64", index=batch.index)})

    return ordered.mapInPandas(run, "session_id long, seq long, level double")


def place_row(shown: list[int], line_id: int, keep: int) -> list[int]:
    """The lines on display after one more arrives: only what is newer than all of them enters."""
    newer = all(line_id > other for other in shown)
    return (shown + [line_id] * newer)[-max(keep, 1) :]


def keep_newest(rows: DataFrame, keep: int) -> DataFrame:
    """``session_id, shown``: the lines that each session shows in the end, one at least.

    A line enters if it is newer than all before it; of those that entered, the last ``keep`` stay.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    newest = F.max("line_id").over(order.rowsBetween(Window.unboundedPreceding, -1))
    entered = rows.select("session_id", "seq", "line_id", newest.alias("newest")).where("newest is null or line_id > newest")
    from_end = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    last = entered.withColumn("from_end", from_end).where(F.col("from_end") <= max(keep, 1))
    return last.groupBy("session_id").agg(F.sort_array(F.collect_list("line_id")).alias("shown"))


def admit(offers: DataFrame, capacity: int) -> DataFrame:
    """``session_id, seq, admitted``: offers that find fewer than ``capacity`` admitted ones under way."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "seq"])
        busy: list[float] = []
        taken = []
        for at, done in zip(frame["at"], frame["done_at"], strict=True):
            busy = [x for x in busy if x > at]
            taken.append(len(busy) < capacity)
            if taken[-1]:
                busy.append(done)
        return pd.DataFrame({"session_id": frame["session_id"], "seq": frame["seq"], "admitted": pd.Series(taken, index=frame.index, dtype=bool)})

    return offers.groupBy("session_id").applyInPandas(fold, "session_id long, seq long, admitted boolean")
