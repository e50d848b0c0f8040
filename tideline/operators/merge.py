"""The two lanes of a line reconciled: which text is shown, and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import content_words, has_repeated_run, let


@dataclass(frozen=True)
class MergeConfig:
    """Guards on how much the lanes may differ; counts are of content words."""

    truncation_guard: float = 0.6
    min_drop_words: int = 5
    repetition_guard: float = 1.5
    min_extra_words: int = 5
    repetition_run: int = 4
    promote_after: float = 8.0


DECISION = "struct<text:string,lane:string,reason:string>"


def suspicion(quick: Column, accurate: Column, config: MergeConfig = MergeConfig()) -> Column:
    """Why an accurate text isn't trusted, or null."""

    def judge(pair: Column) -> Column:
        a, n, m = pair["a"], F.size(pair["q"]), F.size(pair["a"])
        short = (n - m >= config.min_drop_words) & (m < config.truncation_guard * n)
        long = (m - n >= config.min_extra_words) & (m > config.repetition_guard * n)
        return (
            F.when(n == 0, None)
            .when((m == 0) | short, "accurate_truncated")
            .when(long & has_repeated_run(a, config.repetition_run), "accurate_looped")
        )

    return let(F.struct(content_words(quick).alias("q"), content_words(accurate).alias("a")), judge)


def decide(quick: Column, accurate: Column, timed_out: Column, config: MergeConfig = MergeConfig()) -> Column:
    """``struct<text, lane, reason>``, or null while a line has to wait.

    The accurate text wins unless it is suspect; without one, the quick text is promoted
    once the line has timed out.
    """

    def choose(reason: Column) -> Column:
        kept = F.struct(quick.alias("text"), F.lit("fast").alias("lane"), reason.alias("reason"))
        better = F.struct(accurate.alias("text"), F.lit("accurate").alias("lane"), F.lit(None).cast("string").alias("reason"))
        promoted = F.struct(quick.alias("text"), F.lit("fast").alias("lane"), F.lit("accurate_timeout").alias("reason"))
        return (
            F.when(accurate.isNotNull() & quick.isNotNull() & reason.isNotNull(), kept)
            .when(accurate.isNotNull(), better)
            .when(quick.isNotNull() & timed_out, promoted)
            .otherwise(F.lit(None).cast(DECISION))
        )

    return let(suspicion(quick, accurate, config), choose)


def settle(lines: DataFrame, config: MergeConfig = MergeConfig()) -> DataFrame:
    """Settled rows of ``lines(session_id, line_id, quick, accurate, timed_out, start_s, end_s)``."""
    decided = lines.withColumn("decision", decide(F.col("quick"), F.col("accurate"), F.col("timed_out"), config))
    return decided.where("decision is not null").select(
        "session_id", "line_id", "start_s", "end_s", F.col("decision.text").alias("source"), F.col("decision.lane").alias("lane"), F.col("decision.reason").alias("reason")
    )


def lane_mode(quick: bool, accurate: bool) -> str:
    """Which lanes run; none is an error."""
    if not (quick or accurate):
        raise ValueError("at least one lane has to be enabled")
    return {(True, True): "both", (True, False): "quick_only", (False, True): "accurate_only"}[quick, accurate]


def timed_out(now: Column, deadline: Column, config: MergeConfig = MergeConfig()) -> Column:
    """A line without a deadline, cut early and still open, never times out."""
    return F.coalesce(now >= deadline + config.promote_after, F.lit(False))
