"""How much of its time a lane spends on its audio, and how late each stage of a line is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import stats

PASSES = 32


def work_load(passes: DataFrame, most: int = PASSES) -> DataFrame:
    """``session_id, seq, n, mean_window, factor, keeping_up`` of ``passes(session_id, at, seq, window_s, cost_s)``.

    Each pass is judged by itself and those before it, ``most`` together: the mean length of what was
    heard, the cost of a second of it (0 where nothing was), and whether the lane keeps up.
    """
    last = Window.partitionBy("session_id").orderBy("at", "seq").rowsBetween(1 - most, Window.currentRow)
    heard, cost, n = F.sum("window_s").over(last), F.sum("cost_s").over(last), F.count(F.lit(1)).over(last)
    judged = passes.select("session_id", "seq", n.alias("n"), heard.alias("heard"), cost.alias("cost"))
    factor = F.when(F.col("heard") > 0, F.col("cost") / F.col("heard")).otherwise(0.0)
    return judged.select("session_id", "seq", "n", (F.col("heard") / F.col("n")).alias("mean_window"), factor.alias("factor"), (factor < 1.0).alias("keeping_up"))


def stage_latencies(emitted: DataFrame, ends: DataFrame) -> DataFrame:
    """``session_id, line_id, stage, latency``: how long after the end of a line's speech each of its stages came first.

    ``emitted(session_id, line_id, stage, at)``, ``ends(session_id, line_id, end_at)``, on one clock. What comes before
    the end is of no latency; a line without an end has no reading.
    """
    first = emitted.groupBy("session_id", "line_id", "stage").agg(F.min("at").alias("at"))
    return first.join(ends, ["session_id", "line_id"]).select("session_id", "line_id", "stage", F.greatest(F.col("at") - F.col("end_at"), F.lit(0.0)).alias("latency"))


def stage_table(latencies: DataFrame) -> DataFrame:
    """``stage, n, p50, p90, longest`` of latencies."""
    return stats.at_ranks(latencies, ["stage"], "latency", {"p50": stats.near_rank(0.5), "p90": stats.near_rank(0.9)}).select("stage", "n", "p50", "p90", "longest")
