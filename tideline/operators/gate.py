"""Hysteresis gates, silence runs, gaps and levels over scored series.

A series has ``session_id``, ``at`` (seconds), ``seq`` (breaks ties) and ``p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_AT = 0.5
SILENT_BELOW = 0.35
MIN_SILENCE = 0.2


def _ordered() -> Window:
    return Window.partitionBy("session_id").orderBy("at", "seq")


def gate(series: DataFrame, min_silence: float = MIN_SILENCE, open_at: float = OPEN_AT, silent_below: float = SILENT_BELOW) -> DataFrame:
    """``series`` with ``silence`` (seconds since it was last loud) and ``speaking``.

    Opens at once at ``open_at``; closes when it has been below ``silent_below`` for
    ``min_silence``. The two conditions exclude one another, so that the state is the
    last condition that held: no loop over rows is needed.
    """
    order = _ordered()
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    loud = F.last(F.when(F.col("p") >= silent_below, F.col("at")), ignorenulls=True).over(past)
    first = F.min("at").over(past)
    timed = series.withColumn("silence", F.col("at") - F.coalesce(loud, first))
    mark = F.when(F.col("p") >= open_at, True).when(F.col("silence") >= min_silence, False)
    return timed.withColumn("speaking", F.coalesce(F.last(mark, ignorenulls=True).over(past), F.lit(False)))


def gate_events(series: DataFrame, **settings: float) -> DataFrame:
    """``session_id, at, seq, event``: where speech starts and ends."""
    states = gate(series, **settings)
    before = F.coalesce(F.lag("speaking").over(_ordered()), F.lit(False))
    changed = states.withColumn("before", before).where("speaking <> before")
    return changed.select("session_id", "at", "seq", F.when(F.col("speaking"), "start").otherwise("end").alias("event"))


def silence_runs(series: DataFrame, least: float) -> DataFrame:
    """``session_id, start_at, longest, n``: stretches of rows whose silence is at least ``least``."""
    states = gate(series).withColumn("quiet", F.col("silence") >= least)
    opens = F.when(F.col("quiet") & ~F.coalesce(F.lag("quiet").over(_ordered()), F.lit(False)), 1).otherwise(0)
    numbered = states.withColumn("opens", opens).withColumn("run", F.sum("opens").over(_ordered()))
    return (
        numbered.where("quiet")
        .groupBy("session_id", "run")
        .agg(F.min("at").alias("start_at"), F.max("silence").alias("longest"), F.count(F.lit(1)).alias("n"))
        .drop("run")
    )


def missing_silence(series: DataFrame, idle: float = 0.25, most: float = 2.0) -> DataFrame:
    """``series`` with ``filled``: the silence to put before each row; the first row is never late."""
    gap = F.col("at") - F.lag("at").over(_ordered())
    return series.withColumn("filled", F.coalesce(F.when(gap >= idle, F.least(gap, F.lit(most))), F.lit(0.0)))


def sessions(series: DataFrame, pause: float) -> DataFrame:
    """``session_id, start_at, end_at, n``: rows with less than ``pause`` between neighbours."""
    gap = F.col("at") - F.lag("at").over(_ordered())
    numbered = series.withColumn("opens", F.coalesce((gap >= pause).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(_ordered()))
    return numbered.groupBy("session_id", "run").agg(F.min("at").alias("start_at"), F.max("at").alias("end_at"), F.count(F.lit(1)).alias("n")).drop("run")


def changed_only(series: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` differs from the row before."""
    before = F.lag(column).over(_ordered())
    first = F.row_number().over(_ordered()) == 1
    return series.withColumn("fresh", first | ~F.col(column).eqNullSafe(before)).where("fresh").drop("fresh")


def settled_after(series: DataFrame, column: str, quiet: float) -> DataFrame:
    """Changes of ``column`` that nothing followed for ``quiet`` seconds."""
    changes = changed_only(series, column)
    after = F.lead("at").over(_ordered())
    return changes.withColumn("after", after).where((F.col("after") - F.col("at") >= quiet) | F.col("after").isNull()).drop("after")


def windowed(samples: DataFrame, size: int = 512) -> DataFrame:
    """``session_id, window, n, energy``: windows of ``size`` samples, however they arrived."""
    return (
        samples.groupBy("session_id", F.floor(F.col("sample_no") / size).alias("window"))
        .agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("energy"))
    )


def gain(level: Column, target: float = 0.067, most: float = 20.0) -> Column:
    """What a level is multiplied by: amplify only, within bounds."""
    return F.when(level.isNull() | (level <= 0), F.lit(1.0)).otherwise(F.least(F.greatest(target / level, F.lit(1.0)), F.lit(most)))
