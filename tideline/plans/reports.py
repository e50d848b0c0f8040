"""Queries of loads, stages, content gates and of plain column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import stats, times, wire
from tideline.functions import text as tx
from tideline.operators import load, render, scoring
from tideline.plans import sqltext as sq
from tideline.plans.conversations import turns
from tideline.plans.registry import register
from tideline.plans.series import _SERIES, HOUR, listed, series
from tideline.plans.texts import lanes_to_score


@listed(
    "work_load",
    f"""WITH {_SERIES}, w AS (SELECT session_id, seq, count(*) OVER k AS n, sum(floor(value)) OVER k AS heard, sum(CASE WHEN event_type = 'error' THEN 2 * floor(value) ELSE floor(value) / 2 END) OVER k AS cost
      FROM s WINDOW k AS (PARTITION BY session_id ORDER BY at, seq ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)),
    f AS (SELECT *, CASE WHEN heard > 0 THEN cost / heard ELSE 0 END AS factor FROM w)
    SELECT session_id, seq, n, heard / n AS mean_window, factor, factor < 1 AS keeping_up FROM f""",
)
def work_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = F.floor("value").cast("double")
    cost = F.when(F.col("event_type") == "error", heard * 2).otherwise(heard / 2)
    return load.work_load(series(spark, sf_dir).select("session_id", "at", "seq", heard.alias("window_s"), cost.alias("cost_s")))


@listed(
    "stage_table",
    f"""WITH {_SERIES}, e AS (SELECT session_id, seq // 8 AS line_id, event_type AS stage, min(at) AS at FROM s GROUP BY ALL),
    f AS (SELECT session_id, seq // 8 AS line_id, min(at) + 1800.0 AS end_at FROM s WHERE event_type = 'view' GROUP BY ALL),
    l AS (SELECT stage, list_sort(list(greatest(e.at - end_at, 0.0))) AS v FROM e JOIN f USING (session_id, line_id) GROUP BY stage)
    SELECT stage, len(v)::BIGINT AS n, v[round(0.5 * (len(v) - 1))::BIGINT + 1] AS p50, v[round(0.9 * (len(v) - 1))::BIGINT + 1] AS p90, v[len(v)] AS longest FROM l""",
)
def stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight events make a line: its speech ends half an hour after its first view, and types are the stages."""
    rows = series(spark, sf_dir).select("session_id", F.floor(F.col("seq") / 8).alias("line_id"), F.col("event_type").alias("stage"), "at")
    ends = rows.where("stage = 'view'").groupBy("session_id", "line_id").agg((F.min("at") + 0.5 * HOUR).alias("end_at"))
    return load.stage_table(load.stage_latencies(rows, ends))


@register("content_gates")
def content_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's content error and drop rates, and the verdicts on them: at most 15 and 2 %."""
    lines = lanes_to_score(spark, sf_dir)
    whole = [F.array_join(F.sort_array(F.collect_list(F.struct("line_id", c)))[c], " ").alias(c) for c in ("ref", "hyp")]
    found = scoring.measure(lines.groupBy("session_id").agg(*whole), ["session_id"])
    return found.select("session_id", F.round("content_wer", 6).alias("content_wer"), F.round("drop_rate", 6).alias("drop_rate"), stats.verdict(F.col("content_wer") <= 15.0).alias("g2a"), stats.verdict(F.col("drop_rate") <= 2.0).alias("g2b"))


_W = sq.words("text")


@register(
    "text_checks",
    f"""WITH t AS (SELECT conv_id AS session_id, turn AS line_id, text, {_W} AS w,
      CASE turn % 4 WHEN 0 THEN '[' || text || ']' WHEN 1 THEN '(' || text WHEN 2 THEN regexp_replace(text, '[^.,!? ]+', '', 'g') ELSE text END AS odd FROM conversations WHERE text IS NOT NULL)
    SELECT session_id, line_id, regexp_matches(trim(odd), '(?s)^(\\[.*\\]|\\(.*\\))$') AS noise, NOT regexp_matches(odd, '[\\p{{L}}\\p{{N}}]') AS marks, length(trim(odd)) > 0 AS usable,
      lower(regexp_replace(w[1], '[^\\p{{L}}\\p{{N}}'']', '', 'g')) AS bare, array_to_string(list_slice(w, 4, len(w)), ' ') AS tail, w[1] || ' ' || w[2] AS joined,
      trim(regexp_replace(replace('▁' || replace(odd, ' ', '▁'), '▁', ' '), '\\s+', ' ', 'g')) AS partial,
      list_slice(w, 1, greatest(coalesce(list_position(list_transform(w, lambda x: length(x) <= 2), true), len(w) + 1) - 1, 0)) AS long_ones
    FROM t WHERE len(w) >= 2""",
)
def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noises, marks and blanks among turns that are put in brackets, or stripped of their words; heads and tails."""
    text, w = F.col("text"), tx.words(F.col("text"))
    kind = F.col("line_id") % 4
    odd = F.when(kind == 0, F.concat(F.lit("["), text, F.lit("]"))).when(kind == 1, F.concat(F.lit("("), text)).when(kind == 2, F.regexp_replace(text, "[^.,!? ]+", "")).otherwise(text)
    rows = turns(spark, sf_dir).where(F.size(w) >= 2).select("session_id", "line_id", "text", odd.alias("odd"), w.alias("w"))
    return rows.select(
        "session_id", "line_id", tx.annotation(F.col("odd")).alias("noise"), tx.only_marks(F.col("odd")).alias("marks"), tx.usable_translation(F.col("odd")).alias("usable"),
        tx.bare(F.get("w", F.lit(0))).alias("bare"), tx.tail_words(F.col("text"), 3).alias("tail"),
        tx.join_words(F.array(F.get("w", F.lit(0)), F.lit("  "), F.concat(F.lit(" "), F.get("w", F.lit(1)), F.lit(" ")))).alias("joined"),
        tx.partial_text(F.concat(F.lit("▁"), F.replace("odd", F.lit(" "), F.lit("▁")))).alias("partial"),
        wire.take_while(F.col("w"), lambda x: F.length(x) > 2).alias("long_ones"),
    )


@register(
    "number_shapes",
    """WITH t AS (SELECT event_id AS seq, value, floor(value * 100)::BIGINT AS s, value * 10000000 / 1048576.0::DOUBLE AS mb FROM events)
    SELECT seq, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(((s // 60) % 60)::VARCHAR, 2, '0') ELSE ((s // 60) % 60)::VARCHAR END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock,
      CASE WHEN mb >= 1024 THEN printf('%.2f GB', mb / 1024) ELSE printf('%.0f MB', mb) END AS size, least(greatest(value - 50, 0.0), 100.0)::DOUBLE AS clamped, value + greatest(50 - value, 0.0) / 2 AS middle FROM t""",
)
def number_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks, sizes, clamped times and midpoints of values."""
    value = F.col("value")
    return series(spark, sf_dir).select(
        "seq", times.clock(value * 100).alias("clock"), times.human_bytes(value * 10_000_000).alias("size"),
        wire.clamp(value - 50, F.lit(100.0)).alias("clamped"), times.midpoint(value, F.lit(50.0)).alias("middle"),
    )


@register(
    "translation_blocks",
    f"""SELECT conv_id AS session_id, turn AS line_id, trim(regexp_replace(lower(text), '[\\x00-\\x1f\\x7f-\\x9f ]+', ' ', 'g')) || chr(10) AS block FROM conversations
    WHERE text IS NOT NULL AND turn % 3 > 0 AND trim(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f ]+', ' ', 'g')) <> ''""",
)
def translation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of translations alone: lines without one give no row."""
    lines = turns(spark, sf_dir).select("session_id", "line_id", F.when(F.col("line_id") % 3 > 0, F.lower("text")).alias("translation"))
    return render.txt_translation(lines)
