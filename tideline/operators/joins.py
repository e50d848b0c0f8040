"""As-of joins and sweeps, without pairs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_at(rows: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """``rows`` with the first of ``points(session_id, at)`` at or after their ``at``."""
    both = rows.withColumn("_point", F.lit(None).cast("double")).withColumn("_kind", F.lit(0)).unionByName(
        points.select("session_id", "at", F.col("at").alias("_point"), F.lit(1).alias("_kind")), allowMissingColumns=True
    )
    ahead = Window.partitionBy("session_id").orderBy("at", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn(name, F.first("_point", ignorenulls=True).over(ahead)).where("_kind = 0").drop("_point", "_kind")


def wall_clock(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """``rows`` with ``wall``: the newest anchor's wall time, carried on to the row's position.

    ``anchors(session_id, at, wall)`` pairs a stream position with a wall time. Rows
    before the first anchor are carried back from it.
    """
    both = rows.withColumn("_anchor", F.lit(None).cast("struct<at:double,wall:double>")).withColumn("_kind", F.lit(1)).unionByName(
        anchors.select("session_id", "at", F.struct("at", "wall").alias("_anchor"), F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    order = Window.partitionBy("session_id").orderBy("at", "_kind")
    last = F.last("_anchor", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("_anchor", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumn("_at", F.coalesce(last, first)).where("_kind = 1")
    return found.withColumn("wall", F.col("_at.wall") + (F.col("at") - F.col("_at.at"))).drop("_anchor", "_kind", "_at")


def cut_ranges(frames: DataFrame, spans: DataFrame, pad: float, width: float) -> DataFrame:
    """Frames inside each span widened by ``pad``: a range join by buckets of ``width`` seconds.

    ``frames(session_id, at, ...)`` and ``spans(session_id, span_id, start, end)``.
    """
    bucketed = frames.withColumn("bucket", F.floor(F.col("at") / width))
    wanted = spans.withColumn(
        "bucket", F.explode(F.sequence(F.floor((F.col("start") - pad) / width), F.floor((F.col("end") + pad) / width)))
    )
    hits = bucketed.join(wanted, ["session_id", "bucket"])
    return hits.where((F.col("at") >= F.col("start") - pad) & (F.col("at") < F.col("end") + pad)).drop("bucket")


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Files that are wanted and not present in the same size."""
    return wanted.join(present.select("path", "size"), ["path", "size"], "left_anti")
