"""Which intervals a point is in, by a sweep over their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def in_pieces(points: DataFrame, pieces: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``points(session_id, place, ...)`` with ``piece_no``, once for each of ``pieces(session_id, piece_no, first, last_end)`` with ``first <= place < last_end``.

    Edges and points are sorted together. Pieces are numbered as they open; at a point, running sums
    tell how many have opened, and how many from the first on have closed without a gap: those in
    between are the open ones, and of pieces that lie inside others a few more, which their own ends sort out. No pairs
    are formed but those of the result and these. Places are dealt in chunks, which pieces are put into
    as far as they reach, so that a long session isn't one task's.
    """
    whole = pieces.where("last_end > first").select("session_id", "piece_no", "first", "last_end")
    span = F.sequence(F.floor(F.col("first") / chunk), F.floor((F.col("last_end") - 1) / chunk))
    spread = whole.withColumn("chunk", F.explode(span))
    key = ["session_id", "chunk"]
    order = Window.partitionBy(*key).orderBy("first", "last_end", "piece_no")
    numbered = spread.withColumn("number", F.row_number().over(order)).withColumn(
        "closes", F.max("last_end").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    edges = numbered.select(*key, F.inline(F.array(
        F.struct(F.col("first").alias("_at"), F.lit(1).alias("_open"), F.lit(0).alias("_closed")),
        F.struct(F.col("closes").alias("_at"), F.lit(0).alias("_open"), F.lit(1).alias("_closed")),
    )))
    placed = points.withColumn("chunk", F.floor(F.col("place") / chunk)).withColumn("_at", F.col("place"))
    both = placed.withColumn("_point", F.lit(1)).unionByName(edges.withColumn("_point", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*key).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("_opened", F.sum(F.coalesce("_open", F.lit(0))).over(so_far)).withColumn("_done", F.sum(F.coalesce("_closed", F.lit(0))).over(so_far))
    met = counted.where("_point = 1 and _opened > _done").withColumn("number", F.explode(F.sequence(F.col("_done") + 1, F.col("_opened"))))
    found = met.join(numbered.select(*key, F.col("number").cast("long").alias("number"), "piece_no", "last_end"), [*key, "number"])
    return found.where(F.col("place") < F.col("last_end")).select(*points.columns, "piece_no")
