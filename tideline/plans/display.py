"""Queries of wire rows, displays, windows and boundary timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import wire
from tideline.functions import text as tx
from tideline.operators import confirm, earliness, gate
from tideline.plans import sqltext as sq
from tideline.plans.conversations import PACE, settled_lines, timed, turns
from tideline.plans.registry import oracle_of, register
from tideline.session import table


@register(
    "wire_rows",
    f"""SELECT session_id, '{{"kind":"final","line_id":' || line_id || ',"text":' || to_json(source)::VARCHAR || ',"start_s":' || start_s::VARCHAR || ',"end_s":' || round(end_s, 3)::VARCHAR ||
    ',"lane":"' || lane || '"' || CASE WHEN reason IS NULL THEN '' ELSE ',"reason":"' || reason || '"' END || '}}' AS row FROM ({oracle_of('settled_lines')})""",
)
def wire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled_lines(spark, sf_dir)
    event = wire.final(F.col("line_id"), F.col("source"), F.col("start_s"), F.round("end_s", 3), F.col("lane"), F.col("reason"))
    return rows.select("session_id", wire.encode(event).alias("row"))


@register(
    "status_sentences",
    """SELECT seq, CASE state WHEN 'model_loading' THEN 'loading ' || detail || '…' WHEN 'running' THEN 'listening' WHEN 'reconnecting' THEN 'reconnecting to ' || detail || '…'
    WHEN 'error' THEN 'error: ' || detail ELSE state END AS sentence
    FROM (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'model_loading' WHEN 'view' THEN 'running' WHEN 'click' THEN 'reconnecting' WHEN 'purchase' THEN 'paused' ELSE event_type END AS state, props AS detail FROM events)""",
)
def status_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as states of an engine, with their properties as details."""
    kind = F.col("event_type")
    state = F.when(kind == "signup", "model_loading").when(kind == "view", "running").when(kind == "click", "reconnecting").when(kind == "purchase", "paused").otherwise(kind)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), wire.describe_status(state, F.col("props")).alias("sentence"))


@register(
    "selectors",
    """SELECT doc_id, CASE WHEN name IN ('system', 'loopback') THEN 'system' WHEN name IN ('mic', 'microphone') THEN 'mic' ELSE 'device' END AS kind,
    CASE WHEN name NOT IN ('system', 'loopback', 'mic', 'microphone') THEN name END AS device_id
    FROM (SELECT doc_id, CASE lang WHEN 'de' THEN 'system' WHEN 'en' THEN 'loopback' WHEN 'es' THEN 'mic' ELSE coalesce(source, 'microphone') END AS name FROM documents)""",
)
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document would be heard: its language stands for a source's name, its source for a device's."""
    lang = F.col("lang")
    name = F.when(lang == "de", "system").when(lang == "en", "loopback").when(lang == "es", "mic").otherwise(F.coalesce("source", F.lit("microphone")))
    found = table(spark, sf_dir, "documents").select("doc_id", wire.selector(name).alias("s"))
    return found.select("doc_id", F.col("s.kind").alias("kind"), F.col("s.device_id").alias("device_id"))


@register(
    "display_lines",
    """WITH RECURSIVE k AS (
      SELECT conv_id AS session_id, turn AS line_id, []::VARCHAR[] AS shown, trim(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f ]+', ' ', 'g')) AS rest, false AS done FROM conversations WHERE text IS NOT NULL
      UNION ALL
      SELECT session_id, line_id, list_append(shown, CASE WHEN ends THEN rest WHEN p > 0 THEN regexp_replace(left(rest, p), '\\s+$', '') ELSE left(rest, 40) END),
        CASE WHEN p > 0 THEN regexp_replace(substr(rest, p + 1), '^\\s+', '') ELSE substr(rest, 41) END, ends
      FROM (SELECT *, length(rest) <= 40 AS ends, CASE WHEN strpos(reverse(substr(rest, 2, 39)), ' ') > 0 THEN 40 - strpos(reverse(substr(rest, 2, 39)), ' ') ELSE 0 END AS p FROM k WHERE NOT done)
    ) SELECT session_id, line_id, shown FROM k WHERE done""",
)
def display_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("session_id", "line_id", wire.wrapped(tx.one_line(F.col("text")), 40).alias("shown"))


@register(
    "fixed_windows",
    """WITH n AS (SELECT user_id AS session_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_no FROM events)
    SELECT session_id, sample_no // 8 AS "window", count(*) AS n, round(sqrt(avg(value * value)), 6) AS energy FROM n GROUP BY session_id, sample_no // 8""",
)
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    samples = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "value", (F.row_number().over(order) - 1).alias("sample_no"))
    return gate.windowed(samples, 8).withColumn("energy", F.round("energy", 6))


@register(
    "translation_lag",
    """SELECT user_id AS session_id, event_id AS seq, (epoch_us(ts) - epoch_us(max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS lag FROM events""",
)
def translation_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since the newest capture: what a stage is behind."""
    past = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    newest = F.max(F.when(F.col("event_type") == "view", micros)).over(past)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), ((micros - newest) / 1_000_000.0).alias("lag"))


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = timed(spark, sf_dir)
    closed = lines.select("session_id", "line_id", F.col("source").alias("text"), F.lit(0.0).alias("start_s"), F.lit(PACE).alias("pace"), (F.col("end_s") - F.col("start_s") + 1.0).alias("close_at"))
    return earliness.boundary_timings(confirm.growing(turns(spark, sf_dir), 3, PACE), closed)


_TIMINGS = f"""WITH l AS (SELECT conv_id AS session_id, turn AS line_id, {sq.words('text')} AS w FROM conversations WHERE text IS NOT NULL),
h AS (SELECT session_id, line_id, k AS hyp_no, k * 3 * {PACE}::DOUBLE AS t, list_slice(w, 1, k * 3) AS w FROM l, unnest(generate_series(1, ceil(len(w) / 3.0)::BIGINT)) AS g(k) WHERE len(w) > 0),
v AS (SELECT * FROM h WHERE len(w) >= 2), z AS (SELECT session_id, line_id, max(hyp_no) AS last_no FROM v GROUP BY ALL),
s AS (SELECT session_id, line_id, hyp_no, t, len(w) AS n, i - 1 AS word_no FROM v, unnest(generate_series(1, len(w))) AS g(i) WHERE regexp_matches(w[i], '[.!?]["'')\\]”]*$')),
i AS (SELECT *, hyp_no - row_number() OVER (PARTITION BY session_id, line_id, word_no ORDER BY hyp_no) AS island FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, line_id, word_no, island ORDER BY hyp_no) AS streak FROM i),
m AS (SELECT session_id, line_id, word_no, min(t) AS first_t, min(t) FILTER (WHERE streak >= 2 AND word_no + 1 < n) AS stable, count(DISTINCT island) AS islands, max(hyp_no) AS seen_no FROM r GROUP BY ALL),
e AS (SELECT session_id, line_id, i - 1 AS word_no, {PACE}::DOUBLE * len(w) + 1.0 AS close_t FROM l, unnest(generate_series(1, len(w))) AS g(i) WHERE i < len(w) AND regexp_matches(w[i], '[.!?]["'')\\]”]*$'))
"""


@register(
    "boundary_timings",
    _TIMINGS
    + f"""SELECT session_id, line_id, word_no, CASE WHEN stable IS NOT NULL THEN round(greatest(close_t - stable, 0), 6) END AS saved, CASE WHEN first_t IS NOT NULL THEN round(greatest(close_t - first_t, 0), 6) END AS saved_raw,
    round(stable - {PACE} * (word_no + 1), 6) AS lag, coalesce(islands - 1 + CASE WHEN seen_no < last_no THEN 1 ELSE 0 END, 0)::BIGINT AS flaps
    FROM e LEFT JOIN m USING (session_id, line_id, word_no) LEFT JOIN z USING (session_id, line_id)""",
)
def boundary_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timings(spark, sf_dir).select("session_id", "line_id", "word_no", *(F.round(c, 6).alias(c) for c in ("saved", "saved_raw", "lag")), "flaps")


def _columns(name: str) -> str:
    ordered = f"list_sort(list({name}::DOUBLE) FILTER (WHERE {name} IS NOT NULL))"
    ranks = (f"coalesce({ordered}[round({q} * (count({name}) - 1))::BIGINT + 1], 'nan'::DOUBLE) AS {name}_p{round(100 * q)}" for q in (0.5, 0.9))
    return f"count({name}) AS {name}_n, {', '.join(ranks)}, max({name}::DOUBLE) AS {name}_max"


@register(
    "earliness_table",
    f"""WITH t AS ({oracle_of("boundary_timings")})
    SELECT *, saved_n > 0 AND saved_p50 >= 1.0 AS passed FROM (
      SELECT count(*) AS n, count(*) FILTER (WHERE saved_raw IS NULL) AS never_seen, count(*) FILTER (WHERE saved_raw IS NOT NULL AND saved IS NULL) AS never_stable,
        {", ".join(_columns(name) for name in ("saved", "saved_raw", "lag", "flaps"))} FROM t
    )""",
)
def earliness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earliness.earliness_table(boundary_timings(spark, sf_dir))
