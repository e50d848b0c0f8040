"""Streaming forms of the operators, with the batch forms' state and results.

Input streams are files (``availableNow`` or continuous). Event time has to be a
TIMESTAMP; parquet times without zone are cast first. State is bounded: a key's state goes
when it stops, or ``IDLE`` after its last row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.operators.gate import MIN_SILENCE, OPEN_AT, SILENT_BELOW
from tideline.operators.lines import BOTH, OUTPUT, LineMachine, feed_frame, frame_of, rows_of
from tideline.operators.merge import settle
from tideline.session import ship_package, shared_folder

#: How long a session or key may be quiet before its state goes, in seconds.
IDLE_S = 6 * 3600.0


def _millis(seconds: float) -> int:
    return int(seconds * 1000)


def line_stream(inputs: DataFrame, mode: str = BOTH, delay: str = "1 hour", idle_s: float = IDLE_S) -> DataFrame:
    """Final lines of a stream of input rows; a ``stop`` row ends a session and its state.

    Event time is ``now``, in seconds; rows more than ``delay`` behind are dropped. A timer
    lets lines go whose time is up while a session is quiet, and ends one that stays quiet
    for ``idle_s``.
    """
    ship_package(inputs.sparkSession)
    timed = inputs.withColumn("event_time", F.timestamp_seconds("now")).withWatermark("event_time", delay)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = LineMachine.load(state.get[0]) if state.exists else LineMachine(mode=mode)
        until = state.get[1] if state.exists else 0.0
        events: list[dict] = []
        stopped = False
        if state.hasTimedOut:
            passed = state.getCurrentWatermarkMs() / 1000
            stopped = passed >= until
            events = machine.finish() if stopped else machine.tick(passed)
        else:
            for frame in frames:
                events += feed_frame(machine, frame)
                stopped = stopped or bool((frame["kind"] == "stop").any())
                until = max(until, float(frame["now"].max()) + idle_s)
        if stopped:
            state.remove()
        else:
            state.update((machine.dump(), until))
            due = machine.due_at()
            wake = until if due is None else min(due, until)
            state.setTimeoutTimestamp(max(_millis(wake), state.getCurrentWatermarkMs() + 1, 1))
        if rows := rows_of(int(key[0]), events):
            yield frame_of(rows)

    return timed.groupBy("session_id").applyInPandasWithState(run, OUTPUT, "machine string, until double", "append", GroupStateTimeout.EventTimeTimeout)


class GateState:
    """A gate that rows are pushed into, one at a time."""

    def __init__(self, loud_at: float | None = None, speaking: bool = False, first: float | None = None) -> None:
        self.loud_at, self.speaking, self.first = loud_at, speaking, first

    def push(self, at: float, p: float, min_silence: float) -> str | None:
        """``start``, ``end`` or None."""
        self.first = at if self.first is None else self.first
        if p >= SILENT_BELOW:
            self.loud_at = at
        silence = at - (self.first if self.loud_at is None else self.loud_at)
        before = self.speaking
        self.speaking = True if p >= OPEN_AT else (False if silence >= min_silence else before)
        return None if self.speaking == before else ("start" if self.speaking else "end")


def gate_stream(series: DataFrame, min_silence: float = MIN_SILENCE, delay: str = "1 hour", idle_s: float = 90 * 24 * 3600.0) -> DataFrame:
    """``session_id, at, seq, event`` of a stream of ``session_id, at, seq, p``, in order within each key.

    Event time is ``at``, in seconds; a key that is quiet for ``idle_s`` loses its state.
    """
    ship_package(series.sparkSession)
    timed = series.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", delay)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        gate = GateState(*state.get) if state.exists else GateState()
        whole = pd.concat(list(frames)).sort_values(["at", "seq"])
        rows = []
        for at, seq, p in zip(whole["at"], whole["seq"], whole["p"], strict=True):
            event = gate.push(float(at), float(p), min_silence)
            if event:
                rows.append((int(key[0]), float(at), int(seq), event))
        state.update((gate.loud_at, gate.speaking, gate.first))
        state.setTimeoutTimestamp(max(_millis(float(whole["at"].max()) + idle_s), state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["session_id", "at", "seq", "event"])

    return timed.groupBy("session_id").applyInPandasWithState(
        run, "session_id long, at double, seq long, event string", "loud_at double, speaking boolean, first double", "append", GroupStateTimeout.EventTimeTimeout
    )


def settled_stream(lanes: DataFrame) -> DataFrame:
    """Settled rows; the decision has no state, so that batch and stream are one expression."""
    return settle(lanes)


def fold_stream(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The folded view, as an aggregate for ``outputMode("update")`` or ``complete``."""
    from tideline.operators.fold import fold_log

    return fold_log(log, keys, seq)


def late_dropped(series: DataFrame, delay: str, width: str) -> DataFrame:
    """Tumbling counts of a stream with event time ``ts``; rows later than ``delay`` are dropped."""
    timed = series.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("session_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is, into files of the shared folder by batch, and return them as a table.

    A batch that is run again writes to the same folder; in ``complete`` mode the last one counts.
    """
    spark: SparkSession = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch={number if mode == 'append' else 0}"
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def upsert_files(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str):  # noqa: ANN201
    """Append each micro-batch's log rows to ``path`` once, by batch number; readers fold them.

    A batch that is run again writes to the same folder, so that a restart adds no rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
