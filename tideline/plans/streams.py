"""Queries of the streams with state of their own: retained frames, scores of windows, quiescence."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import recognition
from tideline.plans.registry import oracle_of
from tideline.plans.series import _SERIES, HOUR, listed, series
from tideline.session import shared_folder
from tideline.streaming import queries as st
from tideline.streaming import stateful

PAD, KEEP = 0.5 * HOUR, 4 * HOUR
WINDOW, CONTEXT, FRAME = 8, 2, 5


def as_stream(rows: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``rows``, written to a folder of its own, as a stream of its files."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/input-{name}-{uuid.uuid4().hex}"
    (rows if files is None else rows.repartition(files)).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def run(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives, as a table."""
    spark = stream.sparkSession
    return st.run_to_end(stream, f"{name}_{uuid.uuid4().hex[:8]}", f"{shared_folder(spark)}/state-{uuid.uuid4().hex}")


def frames_and_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A user's events as frames, and for each error a span of two hours that is asked for up to three hours later."""
    rows = series(spark, sf_dir)
    errors = rows.where("event_type = 'error'")
    spans = errors.select("session_id", F.col("seq").alias("span_id"), (F.col("at") - 2 * HOUR).alias("start"), F.col("at").alias("end"), (F.col("at") + (F.col("seq") % 4) * HOUR).alias("asked"))
    return rows.select("session_id", "at", "seq"), spans


@listed(
    "held_cuts",
    f"""WITH {_SERIES}, p AS (SELECT session_id, seq AS span_id, at - 7200.0 AS s, at AS e, at + (seq % 4) * 3600.0 AS asked FROM s WHERE event_type = 'error')
    SELECT s.session_id, s.seq, p.span_id FROM s JOIN p ON s.session_id = p.session_id
    AND s.at BETWEEN p.s - 1800.0 AND p.asked AND s.at < p.e + 1800.0 AND s.at > p.asked - 14400.0""",
)
def held_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.held_cuts(*frames_and_spans(spark, sf_dir), pad=PAD, keep=KEEP).select("session_id", "seq", "span_id")


@listed("stream_held_cuts", oracle_of("held_cuts").replace('"at"', "at"))
def stream_held_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, spans = (as_stream(rows, name) for rows, name in zip(frames_and_spans(spark, sf_dir), ("frames", "spans"), strict=True))
    return run(stateful.held_cuts_stream(frames, spans, pad=PAD, keep=KEEP, delay="1 hour").select("session_id", "seq", "span_id"), "cuts")


def sample_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values, whole, in order as samples, in frames of five: ``session_id, offset, samples``."""
    order = Window.partitionBy("session_id").orderBy("at", "seq")
    numbered = series(spark, sf_dir).select("session_id", F.floor("value").cast("double").alias("value"), (F.row_number().over(order) - 1).cast("long").alias("n"))
    first = (F.col("n") - F.col("n") % FRAME).alias("offset")
    taken = numbered.groupBy("session_id", first).agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("rows"))
    return taken.select("session_id", "offset", F.col("rows.value").alias("samples"))


@listed(
    "window_scores",
    f"""WITH RECURSIVE {_SERIES}, n AS (SELECT session_id, floor(value) AS value, row_number() OVER (PARTITION BY session_id ORDER BY at, seq) - 1 AS n FROM s),
    w AS (SELECT session_id, n // {WINDOW} AS k, avg(value) AS mean, avg(value) FILTER (WHERE n % {WINDOW} >= {WINDOW - CONTEXT}) AS last FROM n GROUP BY ALL HAVING count(*) = {WINDOW}),
    r AS (SELECT session_id, k, mean AS hidden, 0.0::DOUBLE AS before, last FROM w WHERE k = 0
      UNION ALL SELECT w.session_id, w.k, r.hidden / 2 + w.mean, r.last, w.last FROM r JOIN w ON w.session_id = r.session_id AND w.k = r.k + 1)
    SELECT session_id, k::BIGINT AS window_no, hidden + before / 2 AS score FROM r""",
)
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stateful.scores(sample_frames(spark, sf_dir), stateful.LinearScorer(CONTEXT), WINDOW, CONTEXT)
    return scored.select("session_id", F.col("window").alias("window_no"), "score")


@listed("stream_window_scores", oracle_of("window_scores").replace('"at"', "at"))
def stream_window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames arrive in any order."""
    frames = as_stream(sample_frames(spark, sf_dir), "samples", 8)
    scored = stateful.scored_stream(frames, stateful.LinearScorer(CONTEXT), WINDOW, CONTEXT, ttl_s=None)
    with stateful.in_rocksdb(spark):
        return run(scored.select("session_id", F.col("window").alias("window_no"), "score"), "scores")


@listed("stream_quiescent_types", oracle_of("quiescent_types").replace('"at"', "at"))
def stream_quiescent_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clock row at the end moves the watermark; the sessions' own last changes come out by their timers."""
    rows = series(spark, sf_dir).select("session_id", "at", "seq", F.col("event_type").alias("value"))
    clock = rows.agg((F.max("at") + 10 * HOUR).alias("at")).select(F.lit(-1).cast("long").alias("session_id"), "at", F.lit(-1).cast("long").alias("seq"), F.lit("clock").alias("value"))
    quiet = stateful.quiescent_stream(as_stream(rows.unionByName(clock), "types"), 2 * HOUR, "1 hour")
    with stateful.in_rocksdb(spark):
        return run(quiet.where("seq >= 0").select("session_id", "seq", F.col("value").alias("event_type")), "quiet")


@listed(
    "recognised_frames",
    f"""WITH {_SERIES}, n AS (SELECT session_id, floor(value) AS v, at, seq, row_number() OVER (PARTITION BY session_id ORDER BY at, seq) - 1 AS n FROM s),
    f AS (SELECT session_id, n // 5 AS piece_no, max(v) >= 280 AS bad, string_agg(v::BIGINT::VARCHAR, ' ' ORDER BY n) FILTER (WHERE v >= 90) AS text,
      min(n) FILTER (WHERE v >= 90) AS a, max(n) FILTER (WHERE v >= 90) AS b FROM n GROUP BY ALL)
    SELECT session_id, piece_no::BIGINT AS piece_no, CASE WHEN NOT bad THEN text END AS text, CASE WHEN NOT bad THEN a::DOUBLE END AS start_s, CASE WHEN NOT bad THEN b + 1.0::DOUBLE END AS end_s,
      CASE WHEN bad THEN 'ValueError: overdriven' END AS error FROM f WHERE bad OR text IS NOT NULL""",
)
def recognised_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values as samples, heard by the stand-in engine; a frame that it fails on costs its own row only."""
    frames = sample_frames(spark, sf_dir)
    pieces = frames.select("session_id", F.floor(F.col("offset") / FRAME).alias("piece_no"), F.col("offset").cast("double").alias("start_s"), F.col("samples").cast("array<float>").alias("pcm"))
    heard = recognition.recognised(pieces, lambda: recognition.LevelEngine(90.0, 280.0, 1.0), "levels-90-280", rate=1)
    return heard.select("session_id", "piece_no", "text", "start_s", "end_s", "error")


MIN_SILENCE, PAUSE, LONGEST = HOUR, 1.5 * HOUR, 12 * HOUR


@listed(
    "forced_utterances",
    f"""WITH RECURSIVE {_SERIES}, k AS (
      SELECT session_id, 0::BIGINT AS rn, NULL::DOUBLE AS loud, NULL::DOUBLE AS since, false AS speaking, NULL::DOUBLE AS began, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::BOOLEAN AS forced FROM o GROUP BY session_id
      UNION ALL SELECT session_id, rn, loud, since, speaking, CASE WHEN ended THEN NULL WHEN cut THEN t ELSE began END, CASE WHEN ended OR cut THEN began END, CASE WHEN (ended AND began IS NOT NULL) OR cut THEN t END, cut
      FROM (SELECT *, NOT ended AND coalesce(t - began >= {LONGEST}, false) AS cut FROM (SELECT *, was AND NOT speaking AND silence >= {PAUSE} AS ended, CASE WHEN speaking AND NOT was AND start IS NULL THEN t - silence ELSE start END AS began
        FROM (SELECT *, p >= 0.5 OR (was AND silence < {MIN_SILENCE}) AS speaking
          FROM (SELECT *, t - coalesce(loud, since) AS silence
            FROM (SELECT o.session_id, o.rn, o.at AS t, o.p, k.speaking AS was, k.began AS start, CASE WHEN o.p >= 0.35 THEN o.at ELSE k.loud END AS loud, coalesce(k.since, o.at) AS since
              FROM k JOIN o ON o.session_id = k.session_id AND o.rn = k.rn + 1)))))
    ) SELECT session_id, a AS start_s, b AS end_s, forced FROM k WHERE b IS NOT NULL""",
)
def forced_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of one lane alone: most end with a pause, the others by time."""
    return _named(stateful.utterances(series(spark, sf_dir), MIN_SILENCE, PAUSE, LONGEST))


def _named(found: DataFrame) -> DataFrame:
    return found.select("session_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "forced")


@listed("stream_forced_utterances", oracle_of("forced_utterances").replace('"at"', "at"))
def stream_forced_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream of eight files; a clock row at the end moves the watermark."""
    rows = series(spark, sf_dir).select("session_id", "at", "seq", "p")
    clock = rows.agg((F.max("at") + 10 * HOUR).alias("at")).select(F.lit(-1).cast("long").alias("session_id"), "at", F.lit(-1).cast("long").alias("seq"), F.lit(0.0).alias("p"))
    found = stateful.utterance_stream(as_stream(rows.unionByName(clock), "speech", 8), MIN_SILENCE, PAUSE, LONGEST, "1 hour")
    with stateful.in_rocksdb(spark):
        return run(_named(found.where("session_id >= 0")), "utterances")
