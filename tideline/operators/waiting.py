"""Rows that wait for others: ordered joins, drafts, claims, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_order(lines: DataFrame, translations: DataFrame) -> DataFrame:
    """Lines with their translation and how they leave the queue.

    A line leaves when its translation is there, when a later line's is (it was
    overtaken: its own never comes), or when the session ends.
    """
    newest = translations.groupBy("session_id").agg(F.max("line_id").alias("newest"))
    both = lines.join(translations, ["session_id", "line_id"], "left").join(newest, "session_id", "left")
    state = F.when(F.col("translation").isNotNull(), "translated").when(F.col("line_id") < F.col("newest"), "overtaken").otherwise("flushed")
    return both.select("session_id", "line_id", "translation", state.alias("state"))


def reuse_drafts(jobs: DataFrame, drafts: DataFrame) -> DataFrame:
    """``jobs`` with the answer of the newest draft of the same line and the very same source."""
    newest = drafts.groupBy("session_id", "line_id", "source").agg(F.max_by("answer", "made").alias("answer"))
    return jobs.join(newest, ["session_id", "line_id", "source"], "left")


def claim_words(words: DataFrame, lines: DataFrame) -> DataFrame:
    """``session_id, line_id, n_words``: words go to the first line that ends after their middle.

    The ends of lines and the words are put in one order and every word looks ahead to the
    next end, so that no pairs of words and lines are formed.
    """
    ends = lines.select("session_id", F.col("t_end").alias("at"), "line_id", F.lit(0).alias("kind"))
    running = Window.partitionBy("session_id").orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.max("at").over(running), F.lit(0.0))
    real = ends.withColumn("late", late).where(F.col("at") > F.col("late")).drop("late")
    heard = words.select("session_id", F.col("mid").alias("at"), F.lit(None).cast("bigint").alias("line_id"), F.lit(1).alias("kind"))
    ahead = Window.partitionBy("session_id").orderBy("at", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    claimed = real.unionByName(heard).withColumn("line_id", F.first("line_id", ignorenulls=True).over(ahead)).where("kind = 1 and line_id is not null")
    counts = claimed.groupBy("session_id", "line_id").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(counts, ["session_id", "line_id"], "left").select("session_id", "line_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_words"))


def prune_superseded(queue: DataFrame) -> DataFrame:
    """``queue(session_id, job_id, line_id, rank)`` without the work that newer work makes pointless.

    Settled jobs (rank 2) all stay; of the others only the newest whose line and rank are
    the highest of the whole queue.
    """
    whole = Window.partitionBy("session_id")
    best = F.max(F.struct("line_id", "rank")).over(whole)
    last = F.max(F.when(F.struct("line_id", "rank") == best, F.col("job_id"))).over(whole)
    kept = queue.withColumn("best", best).withColumn("last", last)
    return kept.where((F.col("rank") == 2) | ((F.struct("line_id", "rank") == F.col("best")) & (F.col("job_id") == F.col("last")))).drop("best", "last")

