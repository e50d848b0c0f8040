"""Queries of the line machine and of the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.models import EchoTranslator, translate_rows
from tideline.operators import lines
from tideline.plans import series as sr
from tideline.plans import sqltext as sq
from tideline.plans.conversations import LANES_SQL, PACE, fold_patches, turns, two_lanes
from tideline.plans.registry import oracle_of, register
from tideline.session import shared_folder, table
from tideline.streaming import queries as st


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _name(what: str) -> str:
    return f"{what}_{uuid.uuid4().hex[:8]}"


_LINES_SQL = f"""
, base AS (
  SELECT session_id, line_id AS turn, quick, accurate, timed_out, start_s, end_s FROM lanes
), spoken AS (
  SELECT *, {sq.words("coalesce(quick, '')")} AS q, {sq.words("coalesce(accurate, '')")} AS a FROM base
), halved AS (
  SELECT *, CASE WHEN turn % 3 = 1 AND len(q) >= 8 THEN len(q) // 2 END AS h FROM spoken
), parts AS (
  -- numbers: the partial of a turn takes one, which a cut uses up, and each further piece of 40 words another
  SELECT *, CASE WHEN h IS NULL THEN greatest(1, ceil(len(q) / 40)::INT) ELSE 1 + ceil((len(q) - h) / 40)::INT END AS numbers FROM halved
), numbered AS (
  SELECT *, coalesce(sum(numbers) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM parts
), inputs AS (
  SELECT session_id, turn * 5 AS seq, start_s AS now, NULL::DOUBLE AS hears FROM parts
  UNION ALL SELECT session_id, turn * 5 + 1, start_s + {PACE} * h + 0.1, NULL FROM parts WHERE h IS NOT NULL
  UNION ALL SELECT session_id, turn * 5 + 2, end_s, NULL FROM parts
  UNION ALL SELECT session_id, turn * 5 + 3, end_s + 1.0, greatest(end_s + 1.0, start_s + {PACE} * len(a)) FROM parts WHERE accurate IS NOT NULL
  UNION ALL SELECT session_id, turn * 5 + 4, end_s + 8.0, NULL FROM parts WHERE timed_out
), clocked AS (
  SELECT session_id, seq, max(now) OVER o AS clock, CASE WHEN hears IS NOT NULL THEN greatest(hears, max(now) OVER o) END AS hears FROM inputs
  WINDOW o AS (PARTITION BY session_id ORDER BY seq)
), events AS (
  SELECT session_id, seq, clock, coalesce(max(hears) OVER (PARTITION BY session_id ORDER BY seq), 0) AS covers FROM clocked
), closed AS (
  SELECT session_id, turn, (taken + 1 + k + (h IS NOT NULL)::INT)::BIGINT AS line_id, start_s + {PACE} * (coalesce(h, 0) + k * 40) AS s, start_s + {PACE} * least(coalesce(h, 0) + k * 40 + 40, len(q)) AS e,
    array_to_string(list_slice(q, coalesce(h, 0) + k * 40 + 1, coalesce(h, 0) + k * 40 + 40), ' ') AS quick, turn * 5 + 2 AS closed_at, NULL::DOUBLE AS due
  FROM numbered, unnest(generate_series(0, ceil((len(q) - coalesce(h, 0)) / 40)::INT - 1)) AS t(k) WHERE len(q) > 0
  UNION ALL SELECT n.session_id, turn, (taken + 1)::BIGINT, start_s, start_s + {PACE} * h, array_to_string(list_slice(q, 1, h), ' '), turn * 5 + 1, v.clock
  FROM numbered n JOIN events v ON v.session_id = n.session_id AND v.seq = turn * 5 + 2 WHERE h IS NOT NULL
), ready AS (
  SELECT c.*, (SELECT min(seq) FROM events v WHERE v.session_id = c.session_id AND v.covers >= c.e) AS cover_at,
    (SELECT min(seq) FROM events v WHERE v.session_id = c.session_id AND v.clock >= coalesce(c.due, c.e) + 8.0) AS late_at,
    (SELECT max(seq) + 1 FROM events v WHERE v.session_id = c.session_id) AS last
  FROM closed c
), out AS (
  SELECT *, max(greatest(closed_at, least(coalesce(cover_at, last), coalesce(late_at, last)))) OVER o AS let_go,
    coalesce(max(e) OVER (PARTITION BY session_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS edge
  FROM ready WINDOW o AS (PARTITION BY session_id ORDER BY line_id)
), heard AS (
  SELECT session_id, turn * 5 + 3 AS seq, i, a[i] AS word, start_s + {PACE} * (i - 1) AS ws, start_s + {PACE} * i AS we
  FROM spoken, unnest(generate_series(1, len(a))) AS t(i) WHERE accurate IS NOT NULL
), shares AS (
  SELECT o.session_id, o.line_id, string_agg(h.word, ' ' ORDER BY h.seq, h.i) AS accurate
  FROM out o JOIN heard h ON h.session_id = o.session_id AND h.ws + greatest(h.we - h.ws, 0) / 2 >= o.edge AND h.ws + greatest(h.we - h.ws, 0) / 2 < o.e AND h.seq <= o.let_go
  GROUP BY o.session_id, o.line_id
), decided AS (
  SELECT o.session_id, o.line_id, o.s AS start_s, o.e AS end_s, o.quick,
    CASE WHEN o.cover_at <= o.let_go THEN coalesce(x.accurate, '') END AS accurate
  FROM out o LEFT JOIN shares x ON x.session_id = o.session_id AND x.line_id = o.line_id
), counted_again AS (
  SELECT *, {sq.content_words("quick")} AS q, {sq.content_words("coalesce(accurate, '')")} AS a FROM decided
), reasoned AS (
  SELECT *, CASE WHEN accurate IS NULL THEN 'accurate_timeout' WHEN len(q) = 0 THEN NULL
    WHEN len(a) = 0 OR (len(q) - len(a) >= 5 AND len(a) < 0.6 * len(q)) THEN 'accurate_truncated'
    WHEN len(a) - len(q) >= 5 AND len(a) > 1.5 * len(q) AND {sq.repeated('a', 4)} THEN 'accurate_looped' END AS reason
  FROM counted_again
)
SELECT session_id, line_id, start_s, end_s, CASE WHEN reason IS NULL THEN accurate ELSE quick END AS source,
  CASE WHEN reason IS NULL THEN 'accurate' ELSE 'fast' END AS lane, reason
FROM reasoned
"""


@register("line_machine", LANES_SQL + _LINES_SQL)
def line_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.replay(lines.inputs_of(two_lanes(spark, sf_dir), PACE))


@register(
    "translated_lines",
    f"""SELECT conv_id AS session_id, turn AS line_id, text, array_to_string(list_reverse({sq.words('text')}), ' ') AS translation
    FROM conversations WHERE len({sq.content_words('text')}) > 0""",
)
def translated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate_rows(turns(spark, sf_dir), EchoTranslator)


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@register("stream_gate_events", oracle_of("gate_events"))
def stream_gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streamed(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0
    rows = events.select(F.col("user_id").alias("session_id"), at.alias("at"), F.col("event_id").alias("seq"), F.least(F.col("value") / 200, F.lit(1.0)).alias("p"))
    return st.run_to_end(st.gate_stream(rows, sr.HOUR), _name("gate"), _scratch(spark))


@register("stream_fold_patches", oracle_of("fold_patches"))
def stream_fold_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch query's log, as files, folded by a stream."""
    path = _scratch(spark)
    log = fold_patches(spark, sf_dir).select("session_id", "line_id", F.lit(0).alias("seq"), "start_s", "end_s", "source", F.lit(None).cast("string").alias("translation"))
    patches = fold_patches(spark, sf_dir).where("translation is not null").select(
        "session_id", "line_id", F.lit(1).alias("seq"), *(F.lit(None).cast(k).alias(c) for c, k in (("start_s", "double"), ("end_s", "double"), ("source", "string"))), "translation"
    )
    log.unionByName(patches).write.parquet(f"{path}/log")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/log").schema).parquet(f"{path}/log")
    return st.run_to_end(st.fold_stream(stream, ["session_id", "line_id"], "seq"), _name("fold"), f"{path}/state", "complete")


@register("stream_line_machine", oracle_of("line_machine"))
def stream_line_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    inputs = lines.inputs_of(two_lanes(spark, sf_dir), PACE)
    stop = inputs.groupBy("session_id").agg((F.max("seq") + 1).alias("seq"), F.max("now").alias("now")).withColumn("kind", F.lit("stop"))
    inputs.unionByName(stop, allowMissingColumns=True).select(inputs.columns).write.parquet(f"{path}/inputs")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/inputs").schema).parquet(f"{path}/inputs")
    return st.run_to_end(st.line_stream(stream), _name("lines"), f"{path}/state")
